"""Evaluation: outcome statistics, breakdowns, latency summaries, ablation, regressions, threshold gates, slot equality."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiform.operators.decide import equivalent_intents
from lexiform.operators.index import source_rank


def _n(cond: Column, name: str) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False))).alias(name)


def _share(a: Column, b: Column) -> Column:
    return F.round(F.when(b == 0, F.lit(0.0)).otherwise(a / b), 6)


def category_stats(cases: DataFrame, *keys: str) -> DataFrame:
    """Totals and rates of cases (intent_ok, slots_ok, fallback, drift); drifted cases leave the denominators. mismatch = total - both - fallback - drift."""
    both = F.col("intent_ok") & F.col("slots_ok")
    out = cases.groupBy(*keys).agg(F.count("*").alias("total"), _n(F.col("intent_ok"), "intent"), _n(F.col("slots_ok"), "slots"), _n(both, "correct"), _n(F.col("fallback"), "fallback"), _n(F.col("drift"), "drift"))
    base = F.col("total") - F.col("drift")
    mismatch = F.col("total") - F.col("correct") - F.col("fallback") - F.col("drift")
    return out.withColumns({"mismatch": mismatch, "accuracy": _share(F.col("correct"), base), "fallback_rate": _share(F.col("fallback"), base), "mismatch_rate": _share(mismatch, base)})


def outcome_partition(cases: DataFrame, *keys: str) -> DataFrame:
    """A native parser first (baseline_ok), then the engine (direct_ok, fallback): accuracy, what was recovered or protected, mismatches and fallbacks."""
    b, d = F.col("baseline_ok"), F.col("direct_ok")
    out = cases.groupBy(*keys).agg(
        F.count("*").alias("total"), _n(b | d, "effective"), _n(b, "baseline"), _n(~b & d, "recovered"), _n(b & ~d, "protected"), _n(b & d, "both"), _n(~b & ~d, "neither"), _n(~b & ~d & F.col("fallback"), "fallback"), _n(~b & ~d & ~F.col("fallback"), "mismatch"),
    )
    return out.withColumns({"accuracy": _share(F.col("effective"), F.col("total")), "uplift": _share(F.col("effective") - F.col("baseline"), F.col("total"))})


def breakdowns(cases: DataFrame, *keys: str) -> DataFrame:
    """The partition's counts in total and by each key alone, in one pass by grouping sets; keys that aren't a row's own are null."""
    sets = [[], *[[F.col(k)] for k in keys]]
    b, d = F.col("baseline_ok"), F.col("direct_ok")
    return cases.groupingSets(sets, *keys).agg(F.count("*").alias("total"), _n(b | d, "effective"), _n(~b & d, "recovered"), F.grouping_id().alias("set_id"))


def latency(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """min, mean, median, nearest-rank p95, max, and requests a second (1000 / mean)."""
    v = F.col(value)
    return rows.groupBy(*keys).agg(
        F.count(v).alias("n"), F.round(F.min(v), 6).alias("min"), F.round(F.avg(v), 6).alias("mean"), F.round(F.median(v), 6).alias("median"), F.round(F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})"), 6).alias("p95"), F.round(F.max(v), 6).alias("max"),
        F.round(F.when(F.avg(v) > 0, 1000 / F.avg(v)), 6).alias("rps"),
    )


def profile(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """mean, median, interpolated p50, p95, p99, sample deviation and coefficient of variation."""
    v = F.col(value)
    return rows.groupBy(*keys).agg(F.count(v).alias("n"), F.round(F.avg(v), 6).alias("mean"), *[F.round(F.percentile(v, p), 6).alias(f"p{int(p * 100)}") for p in (0.5, 0.95, 0.99)], F.round(F.stddev_samp(v), 6).alias("stdev"), F.round(F.when(F.avg(v) != 0, F.stddev_samp(v) / F.avg(v)), 6).alias("cov"))


def ablation(rows: DataFrame, *components: str) -> DataFrame:
    """The winner of each query by each single score; ties by final score, then cid."""
    pairs = ", ".join(f"'{c}', `{c}`" for c in components)
    long = rows.select("qid", "cid", "intent", "final", F.expr(f"stack({len(components)}, {pairs}) AS (component, score)"))
    order = Window.partitionBy("qid", "component").orderBy(F.desc("score"), F.desc("final"), "cid")
    return long.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def regressions(current: DataFrame, baseline: DataFrame, *keys: str, percent: float = 10.0) -> DataFrame:
    """Metrics (keys, metric, value) that grew by more than ``percent`` over the baseline."""
    both = current.join(baseline.withColumnRenamed("value", "base"), [*keys, "metric"])
    change = F.when(F.col("base") != 0, (F.col("value") - F.col("base")) / F.abs("base") * 100)
    return both.withColumn("change_pct", F.round(change, 6)).where(F.col("change_pct") > percent)


def threshold_gates(stats: DataFrame, min_accuracy: float = 0.0, max_fallback: float = 1.0, max_mismatch: float = 1.0) -> DataFrame:
    """Failed gates, one row each: gate, value, limit, with the keys of ``stats``."""
    checks = [("accuracy", F.col("accuracy") < min_accuracy, min_accuracy), ("fallback_rate", F.col("fallback_rate") > max_fallback, max_fallback), ("mismatch_rate", F.col("mismatch_rate") > max_mismatch, max_mismatch)]
    found = F.filter(F.array(*[F.when(bad, F.struct(F.lit(n).alias("gate"), F.col(n).alias("value"), F.lit(float(x)).alias("limit"))) for n, bad, x in checks]), lambda s: s.isNotNull())
    keep = [c for c in stats.columns if c not in ("total", "intent", "slots", "correct", "fallback", "drift", "mismatch", "accuracy", "fallback_rate", "mismatch_rate")]
    return stats.select(*keep, F.explode(found).alias("g")).select(*keep, "g.gate", "g.value", "g.limit")


def counts(rows: DataFrame, *keys: str) -> DataFrame:
    """Counts by each key alone: (dimension, value, n)."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("dimension"), F.col(k).cast("string").alias("value")) for k in keys])).alias("d"))
    return long.groupBy("d.dimension", "d.value").agg(F.count("*").alias("n"))


def native_parses(queries: DataFrame, sentences: DataFrame, domains: tuple[str, ...] = (), best: bool = False) -> DataFrame:
    """What an exact parser makes of queries (qid, norm): the sentences (cid, norm, intent, source, pos, …) of an expanded grammar that are the query; or the best.

    Best is a sentence whose slot ``domain`` is among ``domains`` in their order (where sentences have slots), then the user's own, then the first.
    """
    hits = queries.select("qid", "norm").join(sentences, "norm")
    if not best:
        return hits
    order = []
    if domains and "slots" in sentences.columns:
        at = F.array_position(F.array(*map(F.lit, domains)), F.element_at("slots", "domain"))
        order.append(F.when(at > 0, at).otherwise(len(domains) + 1))
    order += [source_rank(F.col("source")), F.col("pos"), F.col("cid")]
    return hits.withColumn("__rn", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).where("__rn = 1").drop("__rn")


def profiled(spark: SparkSession, stages: dict[str, Callable[[], DataFrame]], iterations: int = 10, warm_up: int = 3) -> DataFrame:
    """(stage, iteration, ms, n_rows): each stage run to its end ``iterations`` times after ``warm_up`` runs that don't count."""
    rows = []
    for name, make in stages.items():
        for i in range(-warm_up, iterations):
            began = time.perf_counter()
            n = make().count()
            if i >= 0:
                rows.append((name, i, (time.perf_counter() - began) * 1000, n))
    return spark.createDataFrame(rows, "stage string, iteration int, ms double, n_rows long")


def slowest(cases: DataFrame, by: str = "ms", n: int = 10) -> DataFrame:
    """The ``n`` slowest cases (a report's limit)."""
    return cases.orderBy(F.desc(by)).limit(n)


def equivalent(a: Column, b: Column) -> Column:
    """Intents equal as such, list intents with one action suffix, or those of one group of equivalent list intents."""
    suffix = lambda x: F.regexp_extract(x, r"^Hass(?:Shopping)?List(\w+)$", 1)
    return (a == b) | ((suffix(a) != "") & (suffix(a) == suffix(b))) | equivalent_intents(a, b)


def slots_equal(want: Column, got: Column) -> Column:
    """Every expected slot stands in ``got`` by its name, its base or an alias, equal as a number or as text, or as a part of name and place together."""
    low = lambda v: F.lower(F.trim(v))
    near = lambda v, w: (low(v) == low(w)) | F.coalesce(F.abs(v.try_cast("double") - w.try_cast("double")) <= 1e-9, F.lit(False))
    names = F.map_entries(got)
    same = lambda k, g: (k == g) | (F.split_part(k, F.lit(":"), F.lit(1)) == F.split_part(g, F.lit(":"), F.lit(1))) | (k.isin("name", "entity", "entity_name") & g.isin("name", "entity", "entity_name")) | (k.isin("area", "area_name") & g.isin("area", "area_name"))
    joined = F.concat(F.lit(" "), F.array_join(F.map_values(got), " "), F.lit(" "))
    inside = lambda v: F.forall(F.split(low(v), " "), lambda w: F.contains(F.lower(joined), F.concat(F.lit(" "), w, F.lit(" ")))) & (F.size(F.split(F.trim(joined), " ")) - F.size(F.split(low(v), " ")) <= 2)
    return F.forall(F.map_entries(want), lambda e: F.exists(names, lambda g: same(e["key"], g["key"]) & near(e["value"], g["value"])) | (e["key"].isin("name", "entity", "entity_name") & inside(e["value"])))


def coverage(built_in: DataFrame, candidates: DataFrame, dataset: DataFrame) -> DataFrame:
    """(intent, missing_from): intents of the grammar without candidates or without a test, and tested ones the grammar lacks."""
    a, b, c = (x.select("intent").distinct() for x in (built_in, candidates, dataset))
    part = lambda x, y, why: x.join(y, "intent", "left_anti").select("intent", F.lit(why).alias("missing_from"))
    return part(a, b, "candidates").union(part(a, c, "dataset")).union(part(c, a, "grammar"))


def dataset_hash(rows: DataFrame, *columns: str) -> DataFrame:
    from lexiform.operators.index import fingerprint

    return fingerprint(rows, *columns)


def expectations(cases: DataFrame, grammar: DataFrame) -> DataFrame:
    """Cases (case_id, canonical, intent) against expanded sentences (norm, intent, slots): what the canonical text now means, and whether it drifted."""
    return cases.join(grammar.select(F.col("norm").alias("canonical_norm"), F.col("intent").alias("now_intent"), F.col("slots").alias("now_slots")), cases.norm == F.col("canonical_norm"), "left").drop("canonical_norm").withColumn("drift", F.col("now_intent").isNull())


def evaluated(labels: DataFrame, baseline: DataFrame, decisions: DataFrame) -> DataFrame:
    """Case rows from labels (qid, intent, slots, expected_fallback), a native parse (qid, intent) and decisions (qid, accepted, top_intent, got_slots)."""
    b = baseline.select("qid", F.col("intent").alias("b_intent"))
    rows = labels.join(b, "qid", "left").join(decisions, "qid", "left")
    rows = rows.withColumns({"baseline_ok": F.coalesce(equivalent(F.col("b_intent"), F.col("intent")), F.lit(False)), "intent_ok": F.coalesce(F.col("accepted") & equivalent(F.col("top_intent"), F.col("intent")), F.lit(False)), "fallback": ~F.coalesce("accepted", F.lit(False))})
    ok = F.when(F.col("expected_fallback"), F.col("fallback")).otherwise(F.col("intent_ok") & F.coalesce(slots_equal(F.col("slots"), F.col("got_slots")), F.lit(False)))
    return rows.withColumn("direct_ok", ok)


def oracle_comparison(control: DataFrame, request: DataFrame) -> DataFrame:
    """Executed control against request by case: intent, slots, resolved entities (as sets), success, text."""
    c, r = control.alias("c"), request.alias("r")
    sets = lambda x: F.array_sort(F.array_distinct(x))
    return c.join(r, "case_id").select("case_id", (F.col("c.intent") == F.col("r.intent")).alias("intent_equal"), slots_equal(F.col("c.slots"), F.col("r.slots")).alias("slots_equal"), (sets(F.col("c.entities")) == sets(F.col("r.entities"))).alias("entities_equal"), (F.col("c.success") & F.col("r.success")).alias("both_succeeded"), (F.lower("c.text") == F.lower("r.text")).alias("text_equal"))


def correlated(events: DataFrame) -> DataFrame:
    """Trace events of each conversation and agent: the last tool call, and how many attempts there were."""
    return events.groupBy("conversation_id", "agent_id").agg(F.max_by("tool", F.when(F.col("tool").isNotNull(), F.col("seq"))).alias("last_tool"), F.count_if(F.col("kind") == "attempt").alias("attempts"))


def selected(cases: DataFrame, languages: list[str] | None = None, categories: list[str] | None = None, first: int | None = None) -> DataFrame:
    if languages:
        cases = cases.where(F.col("language").isin(languages))
    if categories:
        cases = cases.where(F.col("category").isin(categories))
    if first is not None:
        cases = cases.orderBy("case_id").limit(first)
    if cases.isEmpty():
        raise ValueError("no case is selected")
    return cases


def smoke_samples(sentences: DataFrame) -> DataFrame:
    """One sentence for each (language, target) that binds it: fewest mentions of places, then the first."""
    order = Window.partitionBy("language", "target").orderBy("mentions", "sentence_pos")
    return sentences.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def slowest(rows: DataFrame, value: str, n: int = 10) -> DataFrame:
    return rows.orderBy(F.desc(value)).limit(n)


def text_report(stats: DataFrame, limit: int = 1000) -> str:
    """A small frame of statistics as a Markdown table; ``limit`` rows at most, as reports are for reading, and a line that says so where there are more."""
    rows = stats.limit(limit + 1).collect()
    head = "| " + " | ".join(stats.columns) + " |\n|" + "---|" * len(stats.columns)
    body = "".join("\n| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows[:limit])
    return head + body + (f"\n\nOnly the first {limit} rows." if len(rows) > limit else "")
