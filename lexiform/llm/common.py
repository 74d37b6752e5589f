"""Shared helpers of the training-data operators: the shared folder, written tables, row sizes."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the white space that separates words, as a Java/RE2 regular expression class.
SPACE = r"[\x20\x09-\x0D]"
#: Fixed value: a word.
WORD = r"[^\x20\x09-\x0D]+"
#: Edges whose components the driver finds at most (16 bytes each); beyond, they're found in rounds of joins.
GATHERED = 1 << 18


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor reaches: ``spark.checkpoint.dir`` of the session.

    Only where the session names none and driver and executors are one process (tests) a folder of our own is set; a cluster must name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that every executor reaches")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="lexiform-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_WRITTEN: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, reread: lineage ends here and lost executors lose nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(schema).parquet(path)


def drop_paths(spark: SparkSession, paths: Iterable[str]) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def drop_written(df: DataFrame) -> None:
    """Deletes the table behind a frame from ``written``; the caller holds no frame that still needs it."""
    drop_paths(df.sparkSession, {f.rpartition("/")[0] for f in df.inputFiles()})


def written_alone(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """``written`` of what ``make`` returns; every other table written meanwhile is deleted, since nothing needs it any more."""
    before = len(_WRITTEN)
    out = written(df := make(), name)
    drop_paths(df.sparkSession, _WRITTEN[before:-1])
    del _WRITTEN[before:-1]
    return out


def shielded(docs: DataFrame, own: Iterable[str], new: Iterable[str] = ()) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with every column but ``own`` under a name that clashes with nothing, and a function that names a result's columns as they were.

    That function appends the columns ``new``; columns of ``docs`` with one of their names are replaced by them.
    """
    own, new = set(own), list(new)
    names = {c: c if c in own else f"__x{i}" for i, c in enumerate(docs.columns)}
    taken = {c.lower() for c in new}

    def back(out: DataFrame) -> DataFrame:
        return out.select(*[F.col(f"`{n}`").alias(c) for c, n in names.items() if c.lower() not in taken], *new)

    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), back


def settle(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of frames that are no longer referenced, which it otherwise keeps until the driver next collects garbage."""
    gc.collect()
    spark._jvm.System.gc()


def give_back() -> None:
    """Returns freed memory of this Python worker to the system: reused workers would otherwise keep their peak."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # no glibc
        pass


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows, which share their memory."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
        del b
        give_back()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labelled(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, component) of the edges a[i], b[i]: the component is the smallest node that links reach."""
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    low = np.arange(len(node))
    while len(x):
        m = np.minimum(low[x], low[y])
        new = low.copy()
        np.minimum.at(new, low[x], m)
        np.minimum.at(new, low[y], m)
        while (new[new] != new).any():
            new = new[new]
        low = new
        open_ = low[x] != low[y]
        x, y = x[open_], y[open_]
    return node, node[low]


def components(edges: DataFrame) -> DataFrame:
    """(node, component): connected components of the edges (a, b) of longs; the label is the smallest node. Nulls and self-loops are dropped.

    Up to GATHERED edges, which are counted first, are labelled by the driver. Beyond, alternating large-star and small-star rounds: each is one
    aggregation with map-side combine and one equi-join that the adaptive planner may split, so a hub's neighbours never meet in one list; rounds
    grow with the logarithm of the longest chain.
    """
    spark = edges.sparkSession
    cur = written(edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct(), "cc")
    if cur.count() <= GATHERED:
        table = cur.toArrow()  # a checked number of rows of two numbers
        node, low = labelled(table.column("a").to_numpy(), table.column("b").to_numpy())
        drop_written(cur)
        settle(spark)
        return spark.createDataFrame(pa.table({"node": node, "component": low}), "node long, component long")
    seen = None
    while True:
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("a"), F.col("m").alias("b")).union(small.select(F.col("u").alias("a"), F.col("m").alias("b")))
        nxt = written(small.where("a <> b").distinct(), "cc")
        mark = nxt.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("sum(cast(xxhash64(b, a) as decimal(38,0)))")).first()
        drop_written(cur)
        cur = nxt
        del both, low, large, small
        settle(cur.sparkSession)
        if mark == seen or mark[0] == 0:
            break
        seen = mark
    low = cur.groupBy("a").agg(F.min("b").alias("component"))
    roots = cur.select(F.col("b").alias("node")).distinct()
    return low.select(F.col("a").alias("node"), "component").union(roots.select("node", F.col("node").alias("component")))
