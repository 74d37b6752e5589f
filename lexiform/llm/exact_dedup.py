"""Exact deduplication by deterministic block naming, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiform.llm.common import SPACE, documents, drop_written, written


def normalised(text: Column) -> Column:
    """Each run of white space as one space; runs that are one space already aren't touched."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"[\x09-\x0D]{SPACE}*|\x20{SPACE}+", " ")


def named(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """``pieces`` made distinct, sorted, and each given an integer name (column ``name``), written once.

    The names follow the sort order and are unique whatever the hash values; they're written because a
    recomputed sort may cut its ranges elsewhere.
    """
    ordered = pieces.distinct().repartitionByRange(keys[0]).sortWithinPartitions(*keys)  # ranges of the first key alone: the driver sees no blocks
    return ordered.withColumn("name", F.monotonically_increasing_id())


def block_identities(rows: DataFrame, text: str, block_chars: int = 4096) -> DataFrame:
    """(key, levels, name, times) for ``rows`` of (key, text): equal (levels, name) exactly when the texts are equal.

    A text is cut into blocks of ``block_chars`` characters (an empty text has one empty block). The distinct
    blocks are sorted and named by integers; then adjacent names are paired and the distinct pairs named in
    the same way, until a text has one name left. ``levels`` counts the pairings, so names of different rounds
    never meet. A block's 64-bit hash only routes it: two blocks of one hash are told apart by a rank within it.
    Repeated rows share a key; ``times`` counts them. Null texts must have been replaced before.
    """
    blocks = F.regexp_extract_all(F.col(text), F.lit("(?s).{1,%d}" % block_chars), F.lit(0))
    spread = rows.select("key", F.when(F.length(text) <= block_chars, F.array(text)).otherwise(blocks).alias("blocks"))
    spread = spread.select("key", F.size("blocks").alias("n"), F.posexplode("blocks").alias("pos", "block"))
    hashed = spread.select("key", "n", "pos", F.xxhash64("block").alias("h"), "block")
    names = written(named(hashed.select("h", "block"), ["h", "block"]).select("h", "name"), "block-names")
    twins = names.groupBy("h").agg(F.min("name").alias("lo"), F.max("name").alias("hi")).where("lo < hi").select("h")
    alone = names.join(twins, "h", "left_anti")
    lean = written(hashed.select("key", "n", "pos", "h"), "blocks")
    placed = lean.join(alone, "h").select("key", "n", "pos", "name")
    if not twins.isEmpty():  # two different blocks with one hash: those rows are named by the block itself
        same = hashed.join(twins, "h")
        exact = written(named(same.select("h", "block"), ["h", "block"]).select("h", "block", (F.lit(-1) - F.col("name")).alias("name")), "block-twins")
        placed = placed.union(same.join(exact, ["h", "block"]).select("key", "n", "pos", "name"))
    placed = placed.groupBy("key", "n", "pos", "name").agg(F.count("*").alias("times"))
    cur, level, done = written(placed, "names-0"), 0, None
    while True:
        ended = cur.where("n = 1").select("key", F.lit(level).alias("levels"), "name", "times")
        done = ended if done is None else done.union(ended)
        rest = cur.where("n > 1")
        if rest.isEmpty():
            return done
        level += 1
        pairs = rest.groupBy("key", "n", F.shiftright("pos", 1).alias("pos")).agg(F.max(F.expr("if(pos & 1 = 0, name, null)")).alias("l"), F.coalesce(F.max(F.expr("if(pos & 1 = 1, name, null)")), F.lit(0)).alias("r"), F.max(F.expr("pos & 1")).alias("two"), F.first("times").alias("times"))
        pairs = written(pairs, "pairs")
        names = written(named(pairs.select("l", "r", "two"), ["l", "r", "two"]), "pair-names")
        cur = written(pairs.join(names, ["l", "r", "two"]).select("key", F.expr("cast((n + 1) div 2 as int)").alias("n"), "pos", "name", "times"), f"names-{level}")
        drop_written(pairs)


def exact_dedup(docs: DataFrame, block_chars: int = 4096) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs`` (doc_id, text; other columns are ignored).

    Texts are equal when identical after each run of white space became one space; a null text counts as
    empty. Of equal texts the row with the smallest doc_id stays. A row without a doc_id is never the one that
    stays unless its whole group has none (keep_id is null then and every such row has kept = true). Rows that
    repeat a doc_id and a text count each in group_size; all of them are kept where that doc_id stays.
    An empty table gives an empty result.
    """
    rows = docs.select("doc_id", normalised(F.col("text")).alias("text"))
    rows = rows.select("doc_id", "text", F.sha2("text", 256).alias("text_sha256"))
    keyed = rows.select(F.struct(F.col("doc_id"), F.col("text_sha256").alias("sha")).alias("key"), "text")
    ids = block_identities(keyed, "text", block_chars)
    per = written(ids.select("key.doc_id", F.col("key.sha").alias("text_sha256"), "levels", "name", "times"), "identities")
    groups = per.groupBy("levels", "name").agg(F.min("doc_id").alias("keep_id"), F.sum("times").alias("group_size"))
    out = per.join(groups, ["levels", "name"]).select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), "text_sha256", "times")
    return out.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).drop("i", "times")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every document; nulls and odd rows as in ``exact_dedup``."""
    return exact_dedup(documents(spark, sf_dir))


OP4_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM t
"""
