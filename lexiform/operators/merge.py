"""Merging of static and dynamic results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiform.operators.index import source_rank


def merged(static: DataFrame, dynamic: DataFrame) -> DataFrame:
    """One row for each (qid, norm, intent) of both: the best final score, then the better source, then the first."""
    both = static.unionByName(dynamic, allowMissingColumns=True)
    order = Window.partitionBy("qid", "norm", "intent").orderBy(F.desc(F.round("final", 12)), source_rank(F.col("source")), "pos", "cid")
    return both.withColumn("__rn", F.row_number().over(order)).where("__rn = 1").drop("__rn")


def perfect(rows: DataFrame) -> DataFrame:
    """Queries whose rank 1 has every score perfect and whose perfect rows share one intent: they need no dynamic pass."""
    all_one = (F.col("fuzzy") >= 1) & (F.col("char") >= 1) & (F.col("bm25") >= 1) & (F.col("intent_score") >= 1) & (F.col("final") >= 1)
    return rows.groupBy("qid").agg(F.max(F.when(F.col("rank") == 1, all_one)).alias("top"), F.count_distinct(F.when(all_one, F.col("intent"))).alias("n")).where("top and n = 1").select("qid")


def dynamic_queries(queries: DataFrame, rows: DataFrame) -> DataFrame:
    return queries.join(perfect(rows), "qid", "left_anti")


def rescue_kind(accepted: Column, text: Column) -> Column:
    """What a dynamic pass may add: templates of literals only where the query has a digit, wildcards only where the static pass was rejected."""
    return F.when(accepted, F.lit("none")).when(text.rlike(r"\d"), "literal").otherwise("wildcard")
