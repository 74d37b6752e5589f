"""Scoring of retrieved pairs: fuzzy, n-gram, BM25 and intent evidence, then multiplicative adjustments in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiform import config as C
from lexiform.functions import similarity as S
from lexiform.functions import text as T

NO_WORDS = "array<string>"


def words(*columns: Column) -> Column:
    return F.array(*columns).cast(NO_WORDS)


def numbers(tokens: Column) -> Column:
    return F.filter(F.transform(tokens, T.parse_float), lambda x: x.isNotNull())


def value_tokens(values: Column) -> Column:
    """The distinct words of a map's values."""
    return F.array_distinct(F.flatten(F.transform(F.map_values(values), lambda v: T.slot_value_tokens(v))))


def intent_score(variants: Column, query: Column, own: Column, slots: Column, other_words: Column | None = None) -> Column:
    """How much of the intent's wording the query has.

    Without literals that is the query's coverage. A literal wholly in the query (one without words only if the query's words are all the candidate's) gives
    the share of the query's words that the candidate has if the literals have two words and more, 1 if the candidate has slots, and else the coverage. Otherwise
    words are aligned. ``other_words`` are the query's words that no literal has: the candidate's square share of them weighs in with a twentieth.
    """
    share, coverage = S.exact_intent(variants, query), S.query_coverage(query, own)
    covered = F.size(F.array_except(query, own)) == 0
    spoken = F.exists(variants, lambda v: (F.size(v) > 0) & (F.size(F.array_except(v, query)) == 0))
    exact = F.when((share >= 1) & ~spoken & ~covered, F.lit(0.0)).otherwise(share)
    whole = F.when(F.size(F.array_distinct(F.flatten(variants))) >= 2, F.size(F.array_intersect(query, own)) / F.size(F.array_distinct(query))).when(F.size(slots) > 0, F.lit(1.0)).otherwise(coverage)
    # the alignment runs in Python; rows that need none hand it nulls
    aligned = S.positional_intent(F.when((F.size(variants) > 0) & (exact < 1) & ~covered, variants), query, own)
    score = F.when(F.size(variants) == 0, coverage).when(exact >= 1, whole).when(covered, exact).otherwise(aligned)
    return score if other_words is None else F.when(F.size(variants) == 0, coverage).otherwise(S.coverage_blend(score, other_words, own, C.NON_ENTITY_BLEND))


def slot_conflict(slot_tokens: Column, query_slot_tokens: Column, q_near: Column, c_near: Column) -> Column:
    """How far slot tokens agree where not all of a query's are the candidate's, from 0 to 1: by the share of either side's tokens that meet."""
    q_hit = F.size(F.array_intersect(query_slot_tokens, q_near))
    c_hit = F.size(F.array_intersect(slot_tokens, c_near))
    both = (F.size(slot_tokens) > 0) & (F.size(query_slot_tokens) > 0) & (q_hit < F.size(query_slot_tokens))
    return F.when(both, c_hit / F.size(slot_tokens) * (0.8 + 0.2 * q_hit / F.size(query_slot_tokens))).otherwise(1.0)


def context_agreement(slots: Column, context_slots: Column, context: Column, silent: Column) -> Column:
    """Context keys that a candidate's slots agree with, less those they contradict; a place's slots stand for one another, ``silent`` keys count for nothing.

    A key that the candidate has no slot for counts where the grammar takes it from the context.
    """
    places = F.array(*[F.lit(s) for s in C.LOCATION_SLOTS])
    names = lambda k: F.when(F.array_contains(places, k), places).otherwise(F.array(k))

    def one(e: Column) -> Column:
        own = F.filter(F.map_entries(slots), lambda s: F.array_contains(names(e["key"]), s["key"]))
        same = F.exists(own, lambda s: F.sort_array(T.slot_value_tokens(s["value"])) == F.sort_array(F.array_distinct(e["value"])))
        vote = F.when(F.size(own) > 0, F.when(same, 1).otherwise(-1)).when(F.array_contains(context_slots, e["key"]), 1).otherwise(0)
        return F.when(F.array_contains(silent, e["key"]), 0).otherwise(vote)

    return F.aggregate(F.map_entries(context), F.lit(0), lambda a, e: a + one(e))


def explicit_context_keys(rows: DataFrame) -> DataFrame:
    """(qid, silent): the context keys that a query states itself, from scored pairs (qid, slots, c_anchor, context): a spoken entity silences places too."""
    anchored = F.map_filter("slots", lambda k, v: (F.size(T.slot_value_tokens(v)) > 0) & (F.size(F.array_except(T.slot_value_tokens(v), "c_anchor")) == 0))
    stated = rows.where(F.size("context") > 0).select("qid", F.map_keys("context").alias("context"), F.explode(F.map_keys(anchored)).alias("slot")).distinct()
    places = F.array(*[F.lit(s) for s in C.LOCATION_SLOTS])
    hit = lambda k: (k == F.col("slot")) | (F.array_contains(places, k) & F.col("slot").isin(*C.LOCATION_SLOTS, *C.ENTITY_SLOTS))
    return stated.select("qid", F.explode(F.filter("context", hit)).alias("key")).groupBy("qid").agg(F.collect_set("key").alias("silent"))  # a context has a few keys


def unknown_queries(rows: DataFrame) -> DataFrame:
    """(qid) of queries with a context and a word that no literal, slot value or scored candidate has: their context says nothing.

    Needs qid, context, q_tokens, q_slot_tokens, q_other (the query's words that no literal has, exactly or by position), tokens.
    """
    strange = F.filter("q_other", lambda w: ~F.array_contains("q_slot_tokens", w) & ~w.rlike(r"\d") & ~F.exists("q_slot_tokens", lambda s: S.slot_token_match(s, w)))
    one = rows.where(F.size("context") > 0).select("qid", "tokens", F.explode(strange).alias("word"))
    return one.groupBy("qid", "word").agg(F.max(F.array_contains("tokens", F.col("word")).cast("int")).alias("known")).where("known = 0").select("qid").distinct()


def adjusted(rows: DataFrame, min_confidence: float = C.MIN_CONFIDENCE) -> DataFrame:
    """``rows`` with ``final`` from ``weighted``: slot conflict, absorbed slot words, numbers, anchors, coverage, context, wildcard length, in this order.

    Needs weighted, tokens, q_tokens, slots, slots_raw, static_slots, context_slots, wildcard_slots, slot_tokens, q_slot_tokens, context
    (map of slot to tokens), silent, replacement_words (long, 0 without a wildcard), wildcard_tokens, first_wildcard, literal_variants, and the tokens of ``near_tokens``.
    """
    q, own, slots = F.col("q_tokens"), F.col("tokens"), F.col("slots")
    # what is used more than once is a column of its own, so that it's computed once; placeholders are no slot words
    open_ = F.flatten(F.transform("wildcard_slots", lambda n: T.slot_value_tokens(n)))
    rows = rows.withColumn("__concrete", F.when(F.size("wildcard_slots") > 0, F.array_except("slot_tokens", open_)).otherwise(F.col("slot_tokens")))
    lone = (F.size("wildcard_slots") > 0) & (F.col("first_wildcard") == 0) & (F.size("__concrete") == 0)
    missed = F.size(F.array_except("q_slot_tokens", F.array_union("q_near_text", "wildcard_tokens"))) > 0
    conflict = F.when(lone & missed, 0.0).otherwise(slot_conflict(F.col("__concrete"), F.col("q_slot_tokens"), F.array_union("q_near", "wildcard_tokens"), F.col("c_near")))
    rows = rows.withColumn("__slot", conflict)
    rows = rows.withColumns({"__q_num": numbers(q), "__own_num": numbers(own), "__rest": F.array_except(q, own), "__dynamic": F.map_filter(slots, lambda k, v: ~F.array_contains("static_slots", k)), "__absorbed": F.when(lone, words()).otherwise(F.col("wildcard_tokens"))})
    q_num, own_num, rest, dynamic, slot = (F.col(f"__{c}") for c in ("q_num", "own_num", "rest", "dynamic", "slot"))
    rows = rows.withColumn("__slot_nums", F.filter(F.transform(F.map_values(dynamic), T.parse_float), lambda x: x.isNotNull()))
    slot_nums = F.col("__slot_nums")
    floor = min(1.0, max(0.1, min_confidence - 0.05))
    s = F.col("weighted") * (floor + (1 - floor) * slot)
    s = s * F.when((F.size("__concrete") == 0) & F.arrays_overlap("q_slot_tokens", "__absorbed"), C.WILDCARD_KNOWN).otherwise(1.0)
    absent = F.exists(q_num, lambda n: ~F.exists(own_num, lambda m: F.abs(n - m) <= C.NUMERIC_TOLERANCE))
    s = s * F.when(absent, C.NUMBER_ABSENT).otherwise(1.0)
    spoken = F.filter(F.transform(F.concat(F.map_values(dynamic), F.map_values("slots_raw")), T.parse_float), lambda x: x.isNotNull())
    alone = (F.size(slot_nums) > 0) & (F.size(q_num) == 0)
    s = s * F.when(alone, C.NUMERIC_WITHOUT_QUERY * F.when(F.size(own_num) > 0, C.NUMERIC_LITERAL).otherwise(1.0)).otherwise(1.0)
    differ = (F.size(slot_nums) > 0) & (F.size(q_num) > 0) & ~F.exists(spoken, lambda v: F.exists(q_num, lambda n: F.abs(F.abs(n) - F.abs(v)) <= C.NUMERIC_TOLERANCE))
    s = s * F.when(differ, C.NUMERIC_MISMATCH).otherwise(1.0)
    named = lambda k: k.isin(*C.ENTITY_SLOTS)
    loose_entity = F.size(F.map_filter(dynamic, lambda k, v: named(k) & (F.size(T.slot_value_tokens(v)) > 0) & ~F.arrays_overlap(T.slot_value_tokens(v), "c_entity"))) > 0
    s = s * F.when(loose_entity, C.UNANCHORED_ENTITY).otherwise(1.0)
    bound = lambda k: F.array_contains("static_slots", k) | F.array_contains("context_slots", k) | F.array_contains("wildcard_slots", k) | k.isin(*C.ENTITY_SLOTS, *C.LOCATION_SLOTS)
    plain = lambda k, v: F.map_contains_key(slots, k) & T.parse_float(v).isNull() & T.parse_float(F.element_at(slots, k)).isNull()
    loose = F.size(F.map_filter("slots_raw", lambda k, v: ~bound(k) & plain(k, v) & (F.size(F.array_except(T.slot_value_tokens(v), "c_anchor")) > 0))) > 0
    s = s * F.when(loose, C.UNANCHORED_SEMANTIC).otherwise(1.0)
    implicit = F.exists("literal_variants", lambda v: F.size(v) == 0) | (F.size("literal_variants") == 0)
    only_target = implicit & (F.size(dynamic) > 0) & F.arrays_overlap("slot_tokens", q)
    s = s * F.when(only_target & (F.size(rest) > 0), C.ENTITY_UNCOVERED).otherwise(1.0)
    static_entity = F.exists(F.map_keys(slots), lambda k: named(k) & F.array_contains("static_slots", k)) & ~F.exists(F.map_keys(dynamic), named)
    s = s * F.when(static_entity & (F.size(F.array_except(q, "q_near_text")) > 0), C.STATIC_UNCOVERED).otherwise(1.0)
    static_clash = F.exists(F.map_keys(slots), lambda k: F.array_contains("static_slots", k)) & (F.size(F.array_except("q_slot_tokens", "q_near_text")) > 0)
    s = s * F.when(static_clash, C.STATIC_CONFLICT).otherwise(1.0)
    rows = rows.withColumns({"__s": s, "__c": context_agreement(slots, F.col("context_slots"), F.col("context"), F.col("silent"))})
    s, c = F.col("__s"), F.col("__c")
    s = F.when(c > 0, s + C.CONTEXT_BOOST * c * slot * F.greatest(F.lit(0.0), 1 - s)).when(c < 0, s * F.pow(F.lit(C.CONTEXT_MISMATCH), -c)).otherwise(s)
    s = F.when(F.col("replacement_words") > 0, F.greatest(F.lit(0.0), s - C.WILDCARD_WORD_PENALTY * F.col("replacement_words"))).otherwise(s)
    return rows.withColumn("final", s).withColumn("concrete_tokens", F.col("__concrete")).drop("__slot", "__q_num", "__own_num", "__rest", "__dynamic", "__slot_nums", "__s", "__c", "__concrete", "__absorbed")


def paired(pairs: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (qid, cid, bm25, char) with what both sides have; what a query lacks of slot words, short words, context and preferences is empty."""
    kinds = {"q_slot_tokens": NO_WORDS, "q_short": NO_WORDS, "q_other": NO_WORDS, "context": "map<string,array<string>>", "preferences": "array<struct<slot:string,value:string>>"}
    have = [c for c in kinds if c in queries.columns]
    rows = pairs.join(docs, "cid").join(queries.select("qid", F.col("text").alias("query"), F.col("norm").alias("q_norm"), F.col("tokens").alias("q_tokens"), *have), "qid")
    empty = {c: (F.create_map() if k.startswith("map") else F.array()).cast(k) for c, k in kinds.items()}
    rows = rows.withColumns({c: F.coalesce(F.col(c), empty[c]) if c in have else empty[c] for c in kinds})
    more = {"replacements": F.create_map().cast("map<string,string>"), "replacement_words": F.lit(0).cast("long"), "wildcard_tokens": words(), "first_wildcard": F.lit(-1)}
    return rows.withColumns({c: v for c, v in more.items() if c not in rows.columns})


def evidence(rows: DataFrame) -> DataFrame:
    """``rows`` of ``paired`` with fuzzy, intent_score, weighted and the tokens of ``near_tokens``.

    Pairs of one query and text meet in one task, where each different one is aligned once; small as the rows are, they're spread over all cores.
    """
    spark = rows.sparkSession
    cores = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartition(cores, "q_norm", "norm").sortWithinPartitions("q_norm", "norm")
    own_slots = F.array_distinct(F.concat("slot_tokens", value_tokens(F.col("slots")), value_tokens(F.col("slots_raw"))))
    near = S.near_tokens(F.array_union("q_tokens", "q_slot_tokens"), F.col("tokens"), own_slots, F.col("q_short"))
    shown = F.coalesce(F.col("filled_norm"), F.col("norm")) if "filled_norm" in rows.columns else F.col("norm")
    score = intent_score(F.col("literal_variants"), F.col("q_tokens"), F.col("tokens"), F.col("slot_tokens"), F.col("q_other"))
    rows = rows.withColumns({"fuzzy": S.fuzzy(F.col("q_norm"), shown), "__near": near, "intent_score": score}).select("*", "__near.*").drop("__near")
    return rows.withColumn("weighted", S.weighted_score(F.col("fuzzy"), F.col("char"), F.col("bm25"), F.col("intent_score")))


def with_silence(rows: DataFrame) -> DataFrame:
    """``rows`` of ``evidence`` with ``silent``, the context keys that count for nothing: those the query states, or all where it has unknown words."""
    stated, strange = explicit_context_keys(rows), unknown_queries(rows).withColumn("__strange", F.lit(True))
    out = rows.join(stated, "qid", "left").join(strange, "qid", "left")
    silent = F.when(F.col("__strange"), F.map_keys("context")).otherwise(F.coalesce("silent", words()))
    return out.withColumn("silent", silent).drop("__strange")


def scored(pairs: DataFrame, queries: DataFrame, docs: DataFrame, min_confidence: float = C.MIN_CONFIDENCE) -> DataFrame:
    """Scores of prefiltered pairs (qid, cid, bm25, char): fuzzy, intent, weighted and final, each in [0, 1]. ``queries`` may have a context (see ``paired``)."""
    return finished(paired(pairs, queries, docs), "context" in queries.columns, min_confidence)


def finished(rows: DataFrame, with_context: bool, min_confidence: float = C.MIN_CONFIDENCE) -> DataFrame:
    """Final scores of ``paired`` rows."""
    rows = evidence(rows)
    return adjusted(with_silence(rows) if with_context else rows.withColumn("silent", words()), min_confidence)
