"""Sharding by extendible hashing: a directory of hash prefixes in which only oversized buckets split."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiform.llm.common import documents, drop_written, shielded, written

#: Bits of the hash; it's the head of an MD5, so other engines can compute it too.
HASH_BITS = 60
#: Bits by which the counted cells are finer than buckets of the limit would be on average.
FINER = 6
#: First bits of the hash whose prefixes' sums the driver holds, and by which cells are dealt to tasks.
HEAD_BITS = 12


def key_hash(key) -> F.Column:
    """The 60-bit hash of a key column's text; a null key hashes as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def first_fits(cells: np.ndarray, n_bytes: np.ndarray, top: int, low: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of the distinct cells of ``top`` bits: the first depth from ``low`` on at which its prefix's bytes fit the limit (-1 if none does), and those bytes."""
    depth, size = np.full(len(cells), -1), np.zeros(len(cells), np.int64)
    for d in range(low, top + 1):
        _, own = np.unique(cells >> (top - d), return_inverse=True)
        total = np.zeros(own.max(initial=-1) + 1, np.int64)
        np.add.at(total, own, n_bytes)
        fits = (depth < 0) & ((total[own] <= limit) | (d == HASH_BITS))
        depth[fits], size[fits] = d, total[own][fits]
    return depth, size


def leaves_of(bits: int, low: int, head: int, known: dict[int, tuple[int, int]], limit: int):
    """A function from the cells of one prefix of ``head`` bits to their depths and buckets' bytes; ``known`` has the prefixes that are settled already."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cell = pdf["cell"].to_numpy(np.int64)
        if (found := known.get(int(cell[0] >> (bits - head)))) is not None:
            depth, size = np.full(len(cell), found[0]), np.full(len(cell), found[1])
        else:
            depth, size = first_fits(cell, pdf["n_bytes"].to_numpy(np.int64), bits, max(low, head + 1), limit)
        return pd.DataFrame({"cell": cell, "depth": depth, "n_bytes": size})

    return run


def directory(sizes: DataFrame, limit_bytes: int) -> DataFrame:
    """(cell, bits, depth, bucket, n_bytes) from ``sizes`` of (h, n_bytes): where each cell of hash space goes.

    A bucket is the set of hashes that share their first ``depth`` bits. Starting from one bucket, a bucket
    over the limit splits on its next bit; a bucket within the limit never splits. As a bucket's bytes only
    fall when it splits, the final depth of a hash is the first at which its prefix fits the limit. Bytes are
    counted once in cells of a few bits more than needed on average. The depths of the first HEAD_BITS bits are read off
    the 2^HEAD_BITS sums of their prefixes, the further ones within each prefix, whose cells meet in one task; only
    cells that are still too large are counted again by more bits. A bucket whose rows all have one hash
    can't split: it ends at 60 bits and may exceed the limit (one huge document, or rows with one key).
    """
    total = sizes.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("t")).first().t
    top = min(HASH_BITS, max(1, (max(1, total // limit_bytes)).bit_length() + FINER))
    done, over, low = None, sizes, 0
    while True:
        bits, from_, head = top, low, min(HEAD_BITS, top)
        cells = written(over.groupBy(F.shiftright("h", HASH_BITS - bits).alias("cell")).agg(F.sum("n_bytes").alias("n_bytes")), "cells")
        sums = cells.groupBy(F.shiftright("cell", bits - head).alias("p")).agg(F.sum("n_bytes").alias("s")).toPandas()  # 2^HEAD_BITS rows at most
        depth, size = first_fits(sums["p"].to_numpy(np.int64), sums["s"].to_numpy(np.int64), head, from_, limit_bytes) if from_ <= head and len(sums) else (np.full(len(sums), -1), np.zeros(len(sums), np.int64))
        known = {int(p): (int(x), int(y)) for p, x, y in zip(sums["p"], depth, size, strict=True) if x >= 0}

        leaf = written(cells.groupBy(F.shiftright("cell", bits - head).alias("p")).applyInPandas(leaves_of(bits, from_, head, known, limit_bytes), "cell long, depth int, n_bytes long"), "leaves")
        drop_written(cells)
        ended = leaf.where("depth >= 0").select("cell", F.lit(bits).alias("bits"), "depth", F.expr(f"shiftright(cell, {bits} - depth)").alias("bucket"), "n_bytes")
        done = ended if done is None else done.union(ended)
        rest = leaf.where("depth < 0").select("cell")
        if rest.isEmpty():
            return done
        over = over.withColumn("cell", F.shiftright("h", HASH_BITS - bits)).join(rest, "cell", "left_semi").drop("cell")
        low, top = bits + 1, min(HASH_BITS, bits + 2 + FINER)


def assign(rows: DataFrame, limit_bytes: int) -> DataFrame:
    """``rows`` of (h, n_bytes, …) with depth, bucket (the prefix as an integer), shard (as text of bits) and shard_bytes."""
    dirs = directory(rows.select("h", "n_bytes"), limit_bytes)
    out = None
    for (bits,) in dirs.select("bits").distinct().collect():  # one round almost always
        part = dirs.where(F.col("bits") == bits).select("cell", "depth", "bucket", F.col("n_bytes").alias("shard_bytes"))
        part = rows.withColumn("cell", F.shiftright("h", HASH_BITS - bits)).join(part, "cell").drop("cell")
        out = part if out is None else out.union(part)
    if out is None:
        out = rows.withColumns({"depth": F.lit(0), "bucket": F.lit(0).cast("long"), "shard_bytes": F.lit(0).cast("long")}).limit(0)
    return out.withColumn("shard", F.expr("if(depth = 0, '', lpad(bin(bucket), depth, '0'))"))


def shard(docs: DataFrame, limit_bytes: int = 1 << 26, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, depth, shard, shard_bytes) for each row of ``docs``; every shard holds at most ``limit_bytes`` of text.

    A null text has 0 bytes; rows with one key (null among them) always share a shard. An empty table gives
    an empty result. Repeated rows each count. Columns other than the two named are ignored.
    """
    rows = docs.select(F.col(key), key_hash(F.col(key)).alias("h"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    return assign(rows, limit_bytes).select(key, "n_bytes", "depth", "shard", "shard_bytes")


def write_shards(docs: DataFrame, path: str, limit_bytes: int = 1 << 26, key: str = "doc_id", text: str = "text") -> None:
    """Writes all columns of ``docs`` as Parquet, one folder ``__shard=…`` for each shard; a column of that name is replaced."""
    inner, back = shielded(docs, (), ("__shard",))
    names = dict(zip(docs.columns, inner.columns, strict=True))
    rows = inner.withColumns({"h": key_hash(F.col(names[key])), "n_bytes": F.coalesce(F.octet_length(names[text]), F.lit(0)).cast("long")})
    out = back(assign(rows, limit_bytes).withColumn("__shard", F.concat(F.lit("b"), "shard")))
    out.repartition("__shard").write.partitionBy("__shard").parquet(path)


#: Production limit of the registered query: bytes of text in a shard.
LIMIT_BYTES = 1 << 20


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, depth, shard, shard_bytes of every document; nulls and odd rows as in ``shard``."""
    return shard(documents(spark, sf_dir), LIMIT_BYTES)


OP9_SQL = f"""
WITH RECURSIVE r AS (SELECT doc_id, ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT AS h, coalesce(strlen(text), 0)::BIGINT AS n_bytes FROM documents),
d AS (SELECT unnest(range(0, 61))::INT AS depth),
s AS (SELECT depth, h >> (60 - depth) AS bucket, sum(n_bytes)::BIGINT AS b FROM r, d GROUP BY ALL),
f AS (SELECT r.doc_id, r.n_bytes, r.h, s.depth, s.bucket, s.b, row_number() OVER (PARTITION BY r.doc_id ORDER BY s.depth) AS rn
      FROM r JOIN s ON s.bucket = r.h >> (60 - s.depth) WHERE s.b <= {LIMIT_BYTES} OR s.depth = 60)
SELECT doc_id, n_bytes, depth, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(bucket), depth, '0') END AS shard, b AS shard_bytes FROM f WHERE rn = 1
"""
