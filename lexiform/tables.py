"""Tables in the folder that driver and executors share: they end a plan's lineage, and lost executors lose nothing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_RESULTS: list[str] = []
_SCRATCH: list[list[str]] = []
_SETTLED = "_lexiform_table"


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


def drop_paths(spark: SparkSession, paths: Iterable[str]) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` as a Parquet table in the shared folder, reread. Within ``scratch`` it lives as long as that."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    (_SCRATCH[-1] if _SCRATCH else _RESULTS).append(path)
    out = spark.read.schema(schema).parquet(path)
    setattr(out, _SETTLED, True)
    return out


def settled(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` if it's a written table already, else ``written``: for what several branches read."""
    return df if getattr(df, _SETTLED, False) else written(df, name)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written within are deleted at the end."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        drop_paths(spark, _SCRATCH.pop())


def result(df: DataFrame, name: str = "result") -> DataFrame:
    """``df`` written so that it outlives the innermost ``scratch``."""
    inner = _SCRATCH.pop() if _SCRATCH else None
    try:
        return written(df, name)
    finally:
        if inner is not None:
            _SCRATCH.append(inner)


def release(spark: SparkSession) -> int:
    """Deletes the results written so far; returns how many. Frames that read them can't be used any more."""
    n = len(_RESULTS)
    drop_paths(spark, _RESULTS)
    _RESULTS.clear()
    return n
