"""Order, ties, competition and the ordered confidence policy over ranked rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from lexiform import config as C
from lexiform.functions import text as T
from lexiform.functions.similarity import anchored_py, payload_py, payload_support, shared_stem_py, slot_fuzzy_py, slot_match_py

TIE_DIGITS = 12


def slot_preference(replacements: Column, preferences: Column) -> Column:
    """1 where a (slot, lower-cased value) of the replacements is among the preferences (arrays of struct slot, value)."""
    have = F.transform(F.map_entries(replacements), lambda e: F.struct(e["key"].alias("slot"), F.lower(e["value"]).alias("value")))
    return F.when(F.arrays_overlap(have, preferences), 1.0).otherwise(0.0)


def ordered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``rank`` per query: final score, slot preference, slot count, preferred intent of an opposing pair in a tie, then position.

    Needs qid, final, pos, intent, n_slots; ``preference`` is optional. Scores within 1e-12 are a tie.
    """
    if "preference" not in rows.columns:
        rows = rows.withColumn("preference", F.lit(0.0))
    rows = rows.withColumn("__f", F.round("final", TIE_DIGITS))
    tie = Window.partitionBy("qid", "__f", "preference", "n_slots")
    rows = rows.withColumn("__set", F.array_sort(F.collect_set("intent").over(tie)))  # the intents of one tie; ranked rows a query are bounded by the prefilter
    wins = F.lit(0)
    for better, worse in C.OPPOSING:
        wins = F.when((F.col("__set") == F.array(*[F.lit(x) for x in sorted((better, worse))])) & (F.col("intent") == better), 1).otherwise(wins)
    order = Window.partitionBy("qid").orderBy(F.desc("__f"), F.desc("preference"), F.desc("n_slots"), wins.desc(), "pos")
    return rows.withColumn("rank", F.row_number().over(order)).drop("__f", "__set")


def disambiguated(rows: DataFrame) -> DataFrame:
    """Swaps ranks 1 and r where r is the first of another intent, ties exactly with 1, and has the better intent score."""
    q = Window.partitionBy("qid")
    top = lambda c: F.max(F.when(F.col("rank") == 1, F.col(c))).over(q)
    rows = rows.withColumns({"__i": top("intent"), "__s": top("intent_score"), "__f": top("final")})
    rows = rows.withColumn("__r", F.min(F.when(F.col("intent") != F.col("__i"), F.col("rank"))).over(q))
    swap = F.max(F.when((F.col("rank") == F.col("__r")) & (F.abs(F.col("final") - F.col("__f")) <= C.TIE) & (F.col("intent_score") > F.col("__s")), F.col("__r"))).over(q)
    rows = rows.withColumn("__w", swap)
    return rows.withColumn("rank", F.when(F.col("rank") == F.col("__w"), 1).when((F.col("rank") == 1) & F.col("__w").isNotNull(), F.col("__w")).otherwise(F.col("rank"))).drop("__i", "__s", "__f", "__r", "__w")


def slots_text(slots: Column) -> Column:
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(slots))))


def equivalent_intents(a: Column, b: Column) -> Column:
    out = F.lit(False)
    for group in C.EQUIVALENT:
        out = out | (a.isin(*group) & b.isin(*group))
    return out


def with_competition(rows: DataFrame, supported: bool = True) -> DataFrame:
    """``rows`` with ``competes``: false for rank 1 and for rows that mean what rank 1 means.

    Those are rows of one text and slots, of equivalent list intents, and of one intent with the same slots, with slot words that hold rank 1's or are
    held by them, or (if ``supported`` is on) where the query has the words that tell rank 1 from the row and not those that tell the row from rank 1.
    """
    q = Window.partitionBy("qid")
    top = lambda c: F.first(F.when(F.col("rank") == 1, F.col(c)), True).over(q)
    rows = rows.withColumn("__slots", slots_text(F.col("slots")))
    rows = rows.withColumns({"t_norm": top("norm"), "t_intent": top("intent"), "t_slots": top("__slots"), "t_tokens": top("slot_tokens")})
    same_slots, same_intent = F.col("__slots") == F.col("t_slots"), F.col("intent") == F.col("t_intent")
    twin = ((F.col("norm") == F.col("t_norm")) & same_slots) | equivalent_intents(F.col("intent"), F.col("t_intent")) | (same_intent & same_slots)
    nested = same_intent & (F.size("slot_tokens") > 0) & (F.size("t_tokens") > 0) & ((F.size(F.array_except("slot_tokens", "t_tokens")) == 0) | (F.size(F.array_except("t_tokens", "slot_tokens")) == 0))
    rows = rows.withColumn("__same", twin | nested)
    if supported and "q_tokens" in rows.columns:
        open_ = (F.col("rank") > 1) & same_intent & ~F.col("__same")  # the words are compared in Python; other rows hand it nulls
        told = lambda a, b: payload_support(F.when(open_, F.col(a)), F.col(b), F.col("q_tokens"))
        rows = rows.withColumns({"__mine": told("t_tokens", "slot_tokens"), "__theirs": told("slot_tokens", "t_tokens")})
        alone = F.coalesce(F.col("__mine") & ~F.col("__theirs"), F.lit(False)) & (F.size(F.array_union("slot_tokens", "t_tokens")) > 0)
        rows = rows.withColumn("__same", F.col("__same") | alone).drop("__mine", "__theirs")
    return rows.withColumn("competes", (F.col("rank") > 1) & ~F.col("__same")).drop("__slots", "t_norm", "t_intent", "t_slots", "t_tokens", "__same")


def limited(rows: DataFrame, n: int = C.MAX_CANDIDATES) -> DataFrame:
    """The first n ranks; where none of them competes with rank 1, the last place goes to the first one beyond that does."""
    first = F.min(F.when(F.col("competes"), F.col("rank"))).over(Window.partitionBy("qid"))
    rows = rows.withColumn("__c", first)
    beyond = F.col("__c") > n
    keep = F.when(F.coalesce(beyond, F.lit(False)), (F.col("rank") < n) | (F.col("rank") == F.col("__c"))).otherwise(F.col("rank") <= n)
    return rows.where(keep).withColumn("rank", F.when(F.col("rank") > n, n).otherwise(F.col("rank"))).drop("__c")


def is_action(intent: Column) -> Column:
    return F.startswith(intent, F.lit("Hass")) & ~F.contains(intent, F.lit("Get")) & ~intent.isin(*C.NEUTRAL)


def opposing(a: Column, b: Column) -> Column:
    out = F.lit(False)
    for x, y in C.OPPOSING:
        out = out | ((a == x) & (b == y)) | ((a == y) & (b == x))
    return out


@F.pandas_udf(BooleanType())
def payload_supported(payload: pd.Series, query: pd.Series) -> pd.Series:
    """Whether a payload has words and each has the query's support: itself, without diacritics, a bounded variation, a shared stem or its ratio. A null payload gives null."""
    return pd.Series([None if p is None else len(p) > 0 and all(anchored_py(t, tuple(q)) for t in p) for p, q in zip(payload, query, strict=True)], dtype="boolean")


@F.pandas_udf(BooleanType())
def supported_literal(variants: pd.Series, query: pd.Series) -> pd.Series:
    """Whether some literal variant's words all stand in the query, exactly, without diacritics or as a bounded variation; empty variants do."""
    alike = lambda t, w: t == w or T.fold_py(t) == T.fold_py(w) or slot_match_py(t, w) or slot_match_py(w, t)
    return pd.Series([any(all(any(alike(t, w) for w in q) for t in v) for v in vs) for vs, q in zip(variants, query, strict=True)], dtype="boolean")


def evidence(rows: DataFrame) -> DataFrame:
    """One row for each query with the evidence that the policies read, from ranked rows with ``competes``.

    Needs qid, rank, cid, text, intent, slots, n_slots, static_slots, query_slots, slot_tokens, literal_variants, final, fuzzy, char, intent_score, tokens, q_tokens.
    """
    cols = ["cid", "text", "intent", "slots", "n_slots", "static_slots", "query_slots", "slot_tokens", "literal_variants", "final", "fuzzy", "char", "intent_score", "tokens", "replacement_words"]
    if "replacement_words" not in rows.columns:
        rows = rows.withColumn("replacement_words", F.lit(0).cast("long"))
    rows = rows.withColumn("__concrete", F.col("concrete_tokens") if "concrete_tokens" in rows.columns else F.col("slot_tokens"))
    rows = rows.withColumn("__lit", supported_literal(F.col("literal_variants"), F.col("q_tokens")))
    per_intent = F.max("__lit").over(Window.partitionBy("qid", "intent"))
    rows = rows.withColumns({"__lit_intent": per_intent, "__item": F.struct("rank", *cols, F.col("__lit").alias("literal"), per_intent.alias("literal_intent"))})
    # a concrete target that the query names, in a row without placeholders below one with them and without a target
    free = F.max(F.when(F.col("rank") == 1, (F.col("replacement_words") > 0) & (F.size("__concrete") == 0))).over(Window.partitionBy("qid"))
    rows = rows.withColumn("__free", F.coalesce(free, F.lit(False)))
    rows = rows.withColumn("__named", payload_supported(F.when(F.col("__free") & (F.col("rank") > 1) & (F.col("replacement_words") == 0) & (F.size("__concrete") > 0), F.col("__concrete")), F.col("q_tokens")))
    absorbs = F.max(F.col("__named").cast("int"))
    out = rows.groupBy("qid").agg(
        F.first("q_tokens").alias("query_tokens"), F.min_by("__item", F.when(F.col("rank") == 1, F.lit(1))).alias("top"),
        F.min_by("__item", F.when(F.col("competes"), F.col("rank"))).alias("rival"), F.coalesce(absorbs, F.lit(0)).alias("concrete"),
    )
    t, r, q = F.col("top"), F.col("rival"), F.col("query_tokens")
    return out.withColumns({
        "margin": F.when(r.isNotNull(), t["final"] - r["final"]),
        "top_action": is_action(t["intent"]), "rival_action": is_action(r["intent"]),
        "opposing": opposing(t["intent"], r["intent"]),
        "same_intent": t["intent"] == r["intent"],
        "target_incompatible": (t["intent"] == r["intent"]) & (slots_text(t["slots"]) != slots_text(r["slots"])),
        "target_supported": F.coalesce(payload_support(t["slot_tokens"], r["slot_tokens"], q), F.lit(False)) | (F.size(F.array_except(t["slot_tokens"], r["slot_tokens"])) == 0),
        "covers": F.forall(q, lambda w: F.array_contains(t["tokens"], w)),
        "absorbed": F.col("concrete") > 0,
    })


def decision(found: DataFrame, min_confidence: float = C.MIN_CONFIDENCE, min_margin: float = C.MIN_MARGIN, lexical: bool = True) -> DataFrame:
    """The first policy with an opinion decides each query: policy, required margin, whether it's accepted and why not.

    ``found`` is from ``evidence``; queries without candidates have a null ``top``. ``lexical`` turns on the policies on literal words.
    """
    t, r, m = F.col("top"), F.col("rival"), F.col("margin")
    score = t["final"]
    action_clash = F.coalesce(F.col("top_action") != F.col("rival_action"), F.lit(False))
    relaxed = F.lit(min_margin <= C.MIN_MARGIN)
    no_slots = (t["n_slots"] == 0) & (r["n_slots"] == 0)
    safe_empty = relaxed & no_slots & (score >= C.EMPTY_SLOT_SCORE) & (m >= C.EMPTY_SLOT_MARGIN)
    advantage = t["intent_score"] - r["intent_score"]
    broad = F.array_contains(t["static_slots"], "domain") & F.array_contains(t["static_slots"], "name")
    only_name = F.coalesce(t["query_slots"] == F.array(F.lit("name")), F.lit(False))
    safe_intent = relaxed & (F.round(advantage, TIE_DIGITS) >= C.SAFE_INTENT_ADVANTAGE) & (score >= C.SAFE_INTENT_LOW) & (score < C.SAFE_INTENT_HIGH) & ~only_name & ~broad
    target = F.col("target_incompatible")
    lit, use = t["literal"], F.lit(lexical)
    unknown = (t["intent"] != r["intent"]) & F.col("top_action") & F.col("rival_action") & ~F.col("opposing")
    base = m >= min_margin
    steps = [  # name, condition, required margin, accepted, reason
        ("no_candidate", t.isNull(), 0.0, False, "no_candidate"),
        ("hard_min_confidence", score < min_confidence, 0.0, False, "low_confidence"),
        ("no_competitor", r.isNull(), 0.0, True, None),
        ("wildcard_absorbed_concrete_target", F.col("absorbed"), min_margin, False, "low_confidence"),
        ("exact_lexical", (t["fuzzy"] >= 1) & (t["char"] >= 1), 0.0, True, None),
        ("read_only_incomplete_literal", use & ~F.col("top_action") & ~t["literal_intent"] & ~F.col("covers"), min_margin, False, "low_confidence"),
        ("state_change_incomplete_literal", use & F.col("top_action") & action_clash & ~lit & ~F.col("covers"), min_margin, False, "low_confidence"),
        ("supported_literal_action_evidence", use & F.col("top_action") & F.col("rival_action") & (t["intent"] != r["intent"]) & t["literal_intent"] & ~r["literal_intent"], 0.0, True, None),
        ("safe_empty_slot_relaxation", ~target & (safe_empty | safe_intent) & no_slots, C.EMPTY_SLOT_MARGIN, True, None),
        ("safe_intent_evidence_relaxation", ~target & (safe_empty | safe_intent), 0.0, True, None),
        ("high_confidence_relaxation", ~target & relaxed & (score >= C.HIGH_SCORE) & (m >= C.HIGH_MARGIN), C.HIGH_MARGIN, True, None),
        ("weak_zero_intent_evidence", (t["intent_score"] <= 0) & (score < C.ZERO_INTENT_SCORE) & (m <= C.ZERO_INTENT_MARGIN), min_margin, False, "low_confidence"),
        ("action_incompatible_weaker_intent_evidence", action_clash & ~F.col("top_action") & F.col("rival_action") & (t["intent_score"] < r["intent_score"]), min_margin, False, "low_confidence"),
        ("target_without_query_support", target & ~F.col("target_supported") & (F.size(t["slot_tokens"]) > 0) & (F.size(r["slot_tokens"]) > 0), min_margin, False, "low_confidence"),
        ("target_base_margin", target, min_margin, base, "low_margin"),
        ("opposing_action_base_margin", F.col("opposing"), min_margin, base, "low_margin"),
        ("action_incompatible_base_margin", action_clash, min_margin, base, "low_margin"),
        ("unknown_action_base_margin", unknown, min_margin, base, "low_margin"),
        ("base_margin", F.lit(True), min_margin, base, "low_margin"),
    ]
    policy, need, ok, why = (F.lit(None).cast(k) for k in ("string", "double", "boolean", "string"))
    for name, when, margin, accept, reason in reversed(steps):
        when = F.coalesce(when, F.lit(False))
        yes = F.lit(accept) if isinstance(accept, bool) else accept
        policy, need = F.when(when, name).otherwise(policy), F.when(when, F.lit(float(margin))).otherwise(need)
        ok, why = F.when(when, yes).otherwise(ok), F.when(when, F.when(~yes, reason)).otherwise(why)
    return found.select(
        "qid", F.lit(min_confidence).alias("configured_min_confidence"), F.lit(min_margin).alias("configured_base_margin"), F.sha2(t["text"], 256).alias("top_text_sha256"), t["intent"].alias("top_intent"), t["cid"].alias("top_cid"),
        F.round(score, 6).alias("top_score"), r["cid"].alias("competitor_cid"), F.round(m, 6).alias("observed_margin"), need.alias("required_margin"), policy.alias("margin_policy"),
        policy.isin("exact_lexical", "supported_literal_action_evidence", "safe_empty_slot_relaxation", "safe_intent_evidence_relaxation", "high_confidence_relaxation").alias("relaxation_used"),
        F.coalesce(F.col("opposing"), F.lit(False)).alias("opposing_action_competition"), action_clash.alias("action_incompatible_competition"), F.coalesce(target, F.lit(False)).alias("target_incompatible_competition"),
        ok.alias("accepted"), F.when(ok, t["cid"]).alias("accepted_cid"), why.alias("rejection_reason"),
    )


def same_word(a: str, b: str) -> bool:
    return T.fold_py(a) == T.fold_py(b) or slot_match_py(a, b) or shared_stem_py(a, b) or slot_fuzzy_py(a, b)


def supported_rows(ranked: list[dict]) -> list[dict]:
    """``ranked`` rows of one query without leaders whose target the query doesn't name while it names that of a lower row of their intent; again while there is one."""
    while len(ranked) > 1:
        top, query = ranked[0], list(ranked[0]["q_tokens"])
        mine = set(top["slot_tokens"])
        literal = {w for v in top["literal_variants"] for w in v}

        def better(row: dict, top=top, query=query, mine=mine, literal=literal) -> bool:
            own = set(row["slot_tokens"])
            if row["intent"] != top["intent"] or dict(row["slots"]) == dict(top["slots"]) or not own or (mine and (own <= mine or mine <= own)):
                return False
            if not mine and all(any(same_word(w, x) for x in literal) for w in own):
                return False
            return payload_py(list(own), list(mine), query) and not payload_py(list(mine), list(own), query)

        best = next((row for row in ranked[1:] if better(row)), None)
        if best is None:
            break
        own = list(best["slot_tokens"])
        loses = lambda row, own=own, query=query: payload_py(own, list(row["slot_tokens"]), query) and not payload_py(list(row["slot_tokens"]), own, query)
        ranked = [row for row in ranked if row is best or row["intent"] != best["intent"] or not loses(row)]
    return ranked


def drop_unsupported_leaders(rows: DataFrame) -> DataFrame:
    """``rows`` without the leaders that ``supported_rows`` drops; ranks close up. A query has at most a few dozen ranked rows, so each group is small."""

    need = ["qid", "rank", "cid", "intent", "slots", "slot_tokens", "literal_variants", "q_tokens"]
    slim = rows.select(*[F.map_entries(c).alias(c) if c == "slots" else c for c in need])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ranked = pdf.sort_values("rank").to_dict("records")
        for r in ranked:
            r["slots"] = [(e["key"], e["value"]) for e in r["slots"]]
        left = supported_rows(ranked)
        return pd.DataFrame({"qid": [r["qid"] for r in left], "rank": [r["rank"] for r in left], "new_rank": range(1, len(left) + 1)})

    kept = slim.groupBy("qid").applyInPandas(run, f"qid {rows.schema['qid'].dataType.simpleString()}, rank int, new_rank int")
    return rows.join(kept, ["qid", "rank"]).withColumn("rank", F.col("new_rank")).drop("new_rank")
