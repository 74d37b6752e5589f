"""Cross-site line deduplication: HyperLogLog spread of each line, exact counts near the threshold. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiform.llm.common import SPACE, documents, shielded, written

#: Sites from which on a line is boilerplate.
MIN_SITES = 8
#: log2 of the sketch's registers; its standard error is about 1.6 %.
LG_K = 12
#: Estimates within this share of the threshold are counted exactly: over six standard errors.
NEAR = 0.1


def trimmed(line: Column) -> Column:
    """What two occurrences of a line are compared by: runs of white space as one space, ends trimmed."""
    return F.trim(F.regexp_replace(line, rf"[\x09-\x0D]{SPACE}*|\x20{SPACE}+", " "))


def identity(line: Column) -> Column:
    """A trimmed line's 128-bit identity, as two hashes with different seeds."""
    return F.struct(F.xxhash64(line).alias("h"), F.xxhash64(F.lit(1), line).alias("g"))


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, th, source, pos, h, g) for each line of ``docs`` that isn't blank; th is a hash of the whole text, pos counts from 0."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("th"), "source", F.posexplode(F.transform(F.split("text", "\n"), trimmed)).alias("pos", "line")).where("line <> ''")
    return lines.select("doc_id", "th", "source", "pos", identity(F.col("line")).alias("i")).select("doc_id", "th", "source", "pos", "i.h", "i.g")


def without(parts: Column, cuts: Column) -> Column:
    """``parts`` without those at the sorted places ``cuts``: the slices between neighbouring places."""
    ends = F.concat(F.array(F.lit(-1)), cuts, F.array(F.size(parts)))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(cuts)), lambda i: F.slice(parts, F.get(ends, i) + 2, F.get(ends, i + 1) - F.get(ends, i) - 1)))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(h, g, first_id) of the lines that stand on at least ``min_sites`` sites; first_id is the smallest document with it.

    A line with fewer occurrences than that can't have as many sites; the others get a HyperLogLog sketch of their sites each, merged by
    the aggregation. Estimates clear of the threshold decide; those near it are replaced by exact distinct counts.
    """
    often = lines.groupBy("h", "g").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where(F.col("n") >= min_sites)
    often = written(often, "often")
    found = lines.join(often.select("h", "g"), ["h", "g"]).select("h", "g", "source")
    spread = found.groupBy("h", "g").agg(F.hll_sketch_estimate(F.hll_sketch_agg("source", LG_K)).alias("sites"))
    spread = written(spread.where(F.col("sites") >= min_sites * (1 - NEAR)), "spread")
    clear = spread.where(F.col("sites") > min_sites * (1 + NEAR)).select("h", "g")
    near = spread.where(F.col("sites") <= min_sites * (1 + NEAR)).select("h", "g")
    exact = found.join(near, ["h", "g"]).distinct().groupBy("h", "g").agg(F.count("source").alias("sites")).where(F.col("sites") >= min_sites)
    return often.select("h", "g", "first_id").join(clear.union(exact.select("h", "g")), ["h", "g"])


def line_dedup(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with n_lines, n_removed and clean_text: text without the boilerplate lines of other sites.

    Lines are parted by newline. A line is boilerplate when its trimmed form stands in documents of at least ``min_sites`` sources; the
    document with the smallest doc_id that has it keeps it (in every place there), all others lose it. Blank
    lines are never boilerplate. A null source is no site; a null or empty text has no lines and a null or empty
    clean_text; a row with a null doc_id never keeps a line. Rows that repeat a doc_id keep or lose a line alike. An empty table gives an empty result. Other
    columns pass unchanged; those named like the new ones are replaced.
    """
    inner, back = shielded(docs, ("doc_id", "source", "text"), ("n_lines", "n_removed", "clean_text"))
    lines = written(lines_of(inner), "lines")
    marks = written(boilerplate(lines, min_sites), "boilerplate")
    hits = lines.join(marks, ["h", "g"]).where(F.col("doc_id").isNull() | F.col("first_id").isNull() | (F.col("doc_id") != F.col("first_id")))
    hits = hits.groupBy(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).agg(F.sort_array(F.collect_set("pos")).alias("__cut"))  # at most the lines of one text
    out = inner.join(hits, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__th")), "left")
    parts = F.split("text", "\n")
    some = F.coalesce(F.length("text"), F.lit(0)) > 0
    n = F.when(some, F.size(parts)).otherwise(0).cast("long")
    clean = F.when(F.col("__cut").isNull(), F.col("text")).otherwise(F.array_join(without(parts, F.col("__cut")), "\n"))
    return back(out.withColumns({"n_lines": n, "n_removed": F.when(F.col("__cut").isNull(), 0).otherwise(F.size("__cut")).cast("long"), "clean_text": clean}))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed and the digest of what is left of every document; nulls and odd rows as in ``line_dedup``."""
    out = line_dedup(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("clean_text", F.lit("")), 256).alias("kept_sha256"))


OP1_SQL = rf"""
WITH p AS (SELECT doc_id, source, text, CASE WHEN coalesce(text, '') = '' THEN []::VARCHAR[] ELSE string_split(text, chr(10)) END AS parts FROM documents),
e AS (SELECT doc_id, source, unnest(parts) AS raw, unnest(range(1, len(parts) + 1)) AS pos FROM p),
l AS (SELECT doc_id, source, raw, pos, trim(regexp_replace(raw, '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS line FROM e),
b AS (SELECT line, min(doc_id) AS first_id FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}),
k AS (SELECT l.doc_id, count(*) AS n, count(*) FILTER (b.line IS NOT NULL AND l.doc_id <> b.first_id) AS cut,
             string_agg(raw, chr(10) ORDER BY pos) FILTER (b.line IS NULL OR l.doc_id = b.first_id) AS kept
      FROM l LEFT JOIN b ON b.line = l.line GROUP BY l.doc_id)
SELECT p.doc_id, coalesce(k.n, 0) AS n_lines, coalesce(k.cut, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM p LEFT JOIN k USING (doc_id)
"""
