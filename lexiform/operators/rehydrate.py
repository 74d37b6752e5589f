"""Placeholders of a matched template filled with the words of the query they stand for."""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiform.config import STEM_ALIGNMENT
from lexiform.functions import text as tx
from lexiform.functions.similarity import jaccard, ratio
from lexiform.functions.text import normalize_py
from lexiform.operators.index import bm25_weight
from lexiform.operators.retrieve import rehydrated_bm25


def placeholders(tokens: Column, names: Column) -> Column:
    """Indices and names of the tokens that are, or hold, a placeholder name."""
    hit = lambda t: F.element_at(F.array_append(F.filter(names, lambda n: F.contains(t, n)), F.lit("")), 1)
    return F.filter(F.transform(tokens, lambda t, i: F.struct(i.alias("idx"), hit(t).alias("name"))), lambda s: s["name"] != "")


def alike(a: str, b: str) -> float:
    """1 for equal tokens, 0 beyond the length ratio that the threshold allows, else their ratio."""
    if a == b:
        return 1.0
    low, high = sorted((len(a), len(b)))
    return 0.0 if not low or high / low >= 2 / STEM_ALIGNMENT - 1 + 1e-4 else ratio(a, b) / 100


def aligned(part: list[str], query: list[str], spans) -> int:
    """The first start among ``spans`` where ``part`` stands exactly, else the best one where all tokens are alike; -1 if none."""
    best, at = -1.0, -1
    for s in spans:
        window = query[s : s + len(part)]
        if len(window) < len(part):
            continue
        if window == part:
            return s
        sims = [alike(x, y) for x, y in zip(part, window, strict=True)]
        if min(sims, default=1.0) >= STEM_ALIGNMENT and sum(sims) > best:
            best, at = sum(sims), s
    return at


def raw_tokens(text: str) -> list[tuple[str, int, int]]:
    """Normalised tokens of a text with the span of the raw text each comes from."""
    out = []
    for m in regex.finditer(r"\S+", text):
        for w in (normalize_py(m[0]) or "").split():
            out.append((w, m.start(), m.end()))
    return out


def fill(candidate: list[str], names: list[str], query: str) -> tuple[str, dict[str, str]] | None:
    """(text, replacements) with every placeholder of the candidate's tokens filled from ``query`` in its own letters; None where that fails.

    The words before the first and after the last placeholder, and between two, must align with the query. Adjacent placeholders and empty spans fail.
    """
    spots = [(i, n) for i, t in enumerate(candidate) for n in names if t == n]
    if not spots:
        return " ".join(candidate), {}
    if any(b - a == 1 for (a, _), (b, _) in zip(spots, spots[1:], strict=False)):
        return None
    raw = raw_tokens(query)
    q = [w for w, _, _ in raw]
    parts = [candidate[a + 1 : b] for (a, _), (b, _) in zip([(-1, ""), *spots], [*spots, (len(candidate), "")], strict=True)]
    at, found = 0, {}
    if parts[0]:
        at = aligned(parts[0], q, range(0, 1)) if aligned(parts[0], q, range(0, 1)) >= 0 else aligned(parts[0], q, range(len(q)))
        if at < 0:
            return None
        at += len(parts[0])
    out = list(candidate)
    for (i, name), after in zip(spots, parts[1:], strict=True):
        if after:
            last = i == spots[-1][0]
            starts = range(len(q) - len(after), at, -1) if last else range(at + 1, len(q) - len(after) + 1)
            end = aligned(after, q, starts)
            if end < 0:
                return None
        else:
            end = len(q)
        if end <= at:
            return None
        value = query[raw[at][1] : raw[end - 1][2]].strip(" \t\n.,;:!?\"'")
        if not value:
            return None
        found[name] = value
        out[i] = value
        at = end + len(after)
    return " ".join(out), found


RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("replacements", T.MapType(T.StringType(), T.StringType()))])


@F.pandas_udf(RESULT)
def rehydrated(candidate: pd.Series, names: pd.Series, query: pd.Series) -> pd.DataFrame:
    """``fill`` of columns; text and replacements are null where it fails."""
    got = [fill(list(c), list(n), q) or (None, None) for c, n, q in zip(candidate, names, query, strict=True)]
    return pd.DataFrame({"text": [t for t, _ in got], "replacements": [r for _, r in got]})


def rehydrate(rows: DataFrame) -> DataFrame:
    """``rows`` (tokens, wildcard_slots, query) with rehydrated, replacements and replacement_words; rows whose placeholders can't be filled go."""
    rows = rows.withColumn("__r", rehydrated("tokens", "wildcard_slots", "query")).where(F.col("__r.text").isNotNull())
    words = F.aggregate(F.map_values("__r.replacements"), F.lit(0).cast("long"), lambda a, v: a + F.size(F.filter(F.split(v, r"\s+"), lambda w: w != "")))
    return rows.select(*[c for c in rows.columns if c not in ("__r", "rehydrated", "replacements", "replacement_words")], F.col("__r.text").alias("rehydrated"), F.col("__r.replacements").alias("replacements"), words.alias("replacement_words"))


def filled_slots(slots: Column, replacements: Column) -> Column:
    """Slot values with the names of placeholders replaced."""
    return F.transform_values(slots, lambda k, v: F.coalesce(F.element_at(replacements, v), v))


def rescored(rows: DataFrame, stats: DataFrame, corpus: DataFrame, tops: DataFrame) -> DataFrame:
    """``rows`` of pairs whose candidates have placeholders, filled from their queries: norm's own words stay, but tokens, n-grams, BM25 and literals are those of the filled text.

    Rows that can't be filled go. ``stats`` is from ``index.term_stats``, ``corpus`` from ``index.corpus_stats``, ``tops`` has each query's best raw BM25 (qid, top).
    """
    rows = rehydrate(rows).where(F.size("replacements") > 0)
    said = F.array_distinct(F.flatten(F.transform(F.map_values("replacements"), lambda v: tx.slot_value_tokens(v))))
    first = F.array_min(F.transform("wildcard_slots", lambda n: F.array_position("tokens", n).cast("int") - 1))
    rows = rows.withColumns({"first_wildcard": first, "wildcard_tokens": said, "filled_norm": tx.normalize_any(F.col("rehydrated"))})
    spoken = lambda w: F.coalesce(tx.slot_value_tokens(F.element_at(F.col("replacements"), w)), F.array(w))
    variants = F.transform("literal_variants", lambda v: F.array_distinct(F.flatten(F.transform(v, lambda w: F.when(F.map_contains_key("replacements", w), spoken(w)).otherwise(F.array(w))))))
    rows = rows.withColumns({"tokens": tx.tokens(F.col("filled_norm")), "grams": tx.char_ngrams(F.col("filled_norm")), "literal_variants": variants})
    rows = rows.withColumn("char", jaccard(F.col("grams"), tx.char_ngrams(F.col("q_norm"))))
    terms = rows.select("qid", "cid", "tokens", F.explode(F.array_distinct(F.array_intersect("q_tokens", "tokens"))).alias("term"))
    terms = terms.join(stats.select("term", "idf"), "term", "left").crossJoin(F.broadcast(corpus))  # broadcast: one row
    raw = terms.groupBy("qid", "cid").agg(F.sum(bm25_weight(F.coalesce("idf", F.log1p((F.col("n") + 0.5) / 0.5)), F.size(F.filter("tokens", lambda t: t == F.col("term"))), F.size("tokens"), F.col("avgdl"))).alias("raw"))
    rows = rows.join(raw, ["qid", "cid"], "left").join(tops, "qid", "left")
    return rows.withColumn("bm25", rehydrated_bm25(F.coalesce("raw", F.lit(0.0)), F.coalesce("top", F.lit(0.0)))).drop("raw", "top")
