"""Hotwords, routing and bounded validation of ranked texts."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiform.config import HOTWORD_CONFIDENCE, PREFLIGHT_ATTEMPTS
from lexiform.functions import similarity as S
from lexiform.functions import text as tx


def hotword_similarity(queries: DataFrame, hotwords: list[str], least: float = HOTWORD_CONFIDENCE) -> DataFrame:
    """``queries`` with hotword, similarity and matched: the best hotword by its likeness to as many first words of the query.

    The hotwords are options, a short list; ties go to the earlier one.
    """
    spark = queries.sparkSession
    words = [(i, w, tx.normalize_py(w) or "", len((tx.normalize_py(w) or "").split())) for i, w in enumerate(x.strip() for x in hotwords if x and x.strip())]
    if not words:
        return queries.withColumns({"hotword": F.lit(None).cast("string"), "similarity": F.lit(0.0), "matched": F.lit(False)})
    table = F.broadcast(spark.createDataFrame(words, "hpos int, hotword string, h_norm string, h_n int"))  # broadcast: one row for each option
    both = queries.crossJoin(table).withColumn("head", F.array_join(F.slice("tokens", F.lit(1), F.col("h_n")), " "))
    sim = F.when(F.col("head") == F.col("h_norm"), 1.0).when(tx.fold(F.col("head")) == tx.fold(F.col("h_norm")), 1.0).otherwise(F.greatest(S.indel_ratio("head", "h_norm") / 100, S.fuzzy("head", "h_norm")))
    both = both.withColumn("similarity", sim)
    best = both.groupBy("qid").agg(F.max_by(F.struct("hotword", "similarity", "h_n"), F.struct("similarity", -F.col("hpos"))).alias("b"))
    return queries.join(best.select("qid", "b.hotword", "b.similarity", "b.h_n"), "qid", "left").withColumn("matched", F.coalesce(F.col("similarity") >= least, F.lit(False)))


def strip_hotword(text: Column, words: Column) -> Column:
    """The text after its first ``words`` words and the punctuation that follows; never empty: then the text itself."""
    rest = tx.strip_leading_punctuation(F.array_join(F.slice(F.filter(F.split(text, r"\s+"), lambda w: w != ""), words + 1, F.greatest(F.lit(0), F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")) - words)), " "))
    return F.when(rest == "", text).otherwise(rest)


def route(matched: Column, shortcut: Column, indexed: Column, accepted: Column, reason: Column, valid: Column, ranked: Column | None = None, failed: Column | None = None) -> tuple[Column, Column]:
    """(route, reason) of a request: hotword to the fallback, the native shortcut, an empty index, a failed ranking, the gate, validation, another failure, then execution."""
    ranked, failed = F.lit(True) if ranked is None else ranked, F.lit(False) if failed is None else failed
    steps = [(matched, "fallback", F.lit("hotword_matched")), (shortcut, "native", F.lit(None)), (~indexed, "fallback", F.lit("empty_index")), (~ranked, "fallback", F.lit("ranking_failed"))]
    steps += [(~accepted, "fallback", F.coalesce(reason, F.lit("no_candidate"))), (~valid, "fallback", F.lit("validation_failed")), (failed, "fallback", F.lit("unexpected_exception"))]
    where, why = F.lit("execute"), F.lit(None).cast("string")
    for when, to, because in reversed(steps):
        where, why = F.when(when, to).otherwise(where), F.when(when, because).otherwise(why)
    return where, why


def target(where: Column, primary: str, fallback: str | None, own: str) -> Column:
    """Which agent gets a request: the primary one where it's executed or native, else the fallback one; never the engine itself, and null where there is none."""
    agent = F.when(where.isin("execute", "native"), F.lit(primary)).otherwise(F.lit(fallback))
    return F.when(agent != own, agent)


def delegated(original: Column, rehydrated: Column, where: Column) -> Column:
    """The text handed on: the canonical one on execution (the original where a placeholder stayed open), else the original."""
    return F.when(where == "execute", F.coalesce(rehydrated, original)).otherwise(original)


def observation(kind: Column, intent: Column, slots: Column) -> Column:
    """A recognition as a struct; only an intent can be executed; values are cut to 128 characters."""
    return F.struct(kind.alias("kind"), intent.alias("intent"), F.transform_values(slots, lambda k, v: F.substring(v, 1, 128)).alias("slots"), (kind == "intent").alias("executable"))


def divergence(intent: Column, slots: Column, want_intent: Column, want_slots: Column) -> Column:
    """Why a recognition differs from the metadata: intent, slots, intent_and_slots, or null."""
    key = lambda m: F.to_json(F.map_from_entries(F.array_sort(F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("key"), tx.normalize(e["value"]).alias("value"))))))
    i, s = intent != want_intent, key(slots) != key(want_slots)
    return F.when(i & s, "intent_and_slots").when(i, "intent").when(s, "slots")


def area_context(requests: DataFrame, devices: DataFrame, areas: DataFrame) -> DataFrame:
    """``requests`` (qid, satellite, device) with area, area_name and context {area: words}: the area of the satellite, else of the device; null where neither has one.

    ``devices`` has (device, area), ``areas`` (area, name): the registry's tables, one row for each key.
    """
    place = devices.select(F.col("device").alias("satellite"), F.col("area").alias("__s"))
    rows = requests.join(place, "satellite", "left").join(devices.select("device", F.col("area").alias("__d")), "device", "left").withColumn("area", F.coalesce("__s", "__d"))
    rows = rows.join(areas.select("area", F.col("name").alias("area_name")), "area", "left").drop("__s", "__d")
    words = tx.slot_value_tokens(F.col("area_name"))
    return rows.withColumn("context", F.when(F.size(words) > 0, F.create_map(F.lit("area"), words)))


def trace(rows: DataFrame) -> DataFrame:
    """Trace rows with digests in place of texts. Needs qid, delegated, source, kind, intent, attempts, divergence, recovered."""
    return rows.select("qid", F.sha2("delegated", 256).alias("delegated_sha256"), "source", "kind", "intent", "attempts", "divergence", "recovered")


PREFLIGHT = T.StructType([T.StructField(n, k) for n, k in (("qid", T.LongType()), ("text", T.StringType()), ("attempts", T.IntegerType()), ("kind", T.StringType()), ("intent", T.StringType()), ("divergent", T.BooleanType()), ("recovered", T.BooleanType()))])


def preflight(rows: DataFrame, recognise: Callable[[str], tuple[str, str | None]], attempts: int = PREFLIGHT_ATTEMPTS) -> DataFrame:
    """Validates the distinct gated texts of each query (qid, rank, text, intent, accepted), ``attempts`` at most, in rank order.

    ``recognise`` maps a text to (kind, intent). The first text recognised with its own intent wins; else the first that is an intent at all, marked divergent. If
    nothing matched or only targets were missing, one more text is tried once as recovery.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        tried, spare, last = 0, None, "no_match"
        texts = list(dict.fromkeys(zip(pdf["text"][pdf["accepted"]], pdf["intent"][pdf["accepted"]], strict=True)))
        for k, (text, want) in enumerate(texts[: attempts + 1]):
            if k == attempts and (spare or last not in ("no_match", "unmatched_target")):
                break
            tried += 1
            last, got = recognise(text)
            if last == "intent" and got == want:
                return pd.DataFrame([(pdf["qid"].iloc[0], text, tried, last, got, False, k == attempts)], columns=PREFLIGHT.names)
            if last == "intent" and spare is None:
                spare = (text, got)
        text, got = spare or (None, None)
        return pd.DataFrame([(pdf["qid"].iloc[0], text, tried, "intent" if spare else last, got, spare is not None, False)], columns=PREFLIGHT.names)

    return rows.select("qid", "rank", "text", "intent", "accepted").groupBy("qid").applyInPandas(run, PREFLIGHT)
