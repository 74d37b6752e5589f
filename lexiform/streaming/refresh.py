"""State and change streams: memo tables, generations, debounced refresh, subscriptions."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def request_key(language, query, context=None):
    """Hash of what a cached ranking depends on, besides its generations."""
    return F.sha2(F.concat_ws("\x1f", language, query, F.coalesce(F.to_json(context), F.lit("")) if context is not None else F.lit("")), 256)


def cache_misses(requests: DataFrame, memo: DataFrame, generation: int) -> DataFrame:
    """The distinct requests (key) that the memo of this generation lacks; equal requests are ranked once."""
    return requests.dropDuplicates(["key"]).join(memo.where(F.col("generation") == generation).select("key"), "key", "left_anti")


def remembered(memo: DataFrame, results: DataFrame, generation: int, size: int) -> DataFrame:
    """The memo with the accepted results added; older generations go, and the ``size`` most recently used rows stay (a cache is a limit by its nature)."""
    fresh = results.where("accepted").withColumn("generation", F.lit(generation))
    both = memo.where(F.col("generation") == generation).unionByName(fresh, allowMissingColumns=True)
    newest = both.withColumn("__rn", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("used_at")))).where("__rn = 1").drop("__rn")
    return newest.orderBy(F.desc("used_at"), "key").limit(size)


def sessions(events: DataFrame, gap: str, *keys: str) -> DataFrame:
    """Bursts of events parted by at least ``gap`` without one: start, end of the last event, count. Works on batches and streams (with a watermark)."""
    return events.groupBy(F.session_window("ts", gap).alias("w"), *keys).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def debounced(events: DataFrame, gap: str = "5 seconds", late: str = "1 minute") -> DataFrame:
    """One refresh for each burst of registry events of a language, from a stream: emitted once the watermark has passed the gap."""
    stream = events.withWatermark("ts", late) if events.isStreaming else events
    return sessions(stream, gap, "language").select("language", F.col("last_ts").alias("changed_at"), "n")


def changed(current: DataFrame, previous: DataFrame, *keys: str) -> DataFrame:
    """Rows of (keys, fingerprint) that are new or have another fingerprint: only those languages are rebuilt."""
    old = previous.select(*keys, F.col("fingerprint").alias("__old"))
    return current.join(old, list(keys), "left").where(~F.col("fingerprint").eqNullSafe(F.col("__old"))).drop("__old")


class Generations:
    """Counters of sources, registry, intents, index and cache; a result computed under other counters is stale."""

    NAMES = ("sources", "registry", "intents", "index", "cache")

    def __init__(self) -> None:
        self._lock, self._n = threading.Lock(), dict.fromkeys(self.NAMES, 0)

    def bump(self, name: str) -> int:
        with self._lock:
            self._n[name] += 1
            return self._n[name]

    def token(self) -> tuple[int, ...]:
        with self._lock:
            return tuple(self._n[n] for n in self.NAMES)

    def current(self, token: tuple[int, ...]) -> bool:
        return token == self.token()


class SingleFlight:
    """Runs one build a key at a time; callers that come meanwhile get its result. A build whose sources changed under it is run again, ``attempts`` times."""

    def __init__(self, generations: Generations, attempts: int = 5) -> None:
        self._gen, self._attempts, self._locks, self._done, self._guard = generations, attempts, {}, {}, threading.Lock()

    def run(self, key: str, build: Callable[[], object]) -> object:
        with self._guard:
            lock = self._locks.setdefault(key, threading.Lock())
        before = self._done.get(key)
        with lock:
            after = self._done.get(key)
            if after is not before and after and self._gen.current(after[0]):
                return after[1]
            for _ in range(self._attempts):
                token = self._gen.token()
                value = build()
                if self._gen.current(token):
                    self._done[key] = (token, value)
                    return value
            raise RuntimeError(f"the sources of {key} kept changing")


def subscribe(updates: DataFrame, rebuild: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a query that hands each batch of grammar updates to ``rebuild``; batch ids make a repeated batch recognisable."""
    return updates.writeStream.foreachBatch(rebuild).option("checkpointLocation", checkpoint).start()


def upserted(table: DataFrame, updates: DataFrame, *keys: str, version: str = "version") -> DataFrame:
    """The latest row of each key of both; the keys are matched in lower case."""
    both = table.unionByName(updates, allowMissingColumns=True)
    order = Window.partitionBy(*[F.lower(k) for k in keys]).orderBy(F.desc(version))
    return both.withColumn("__rn", F.row_number().over(order)).where("__rn = 1").drop("__rn")


def drain(spark: SparkSession) -> int:
    """Stops every running stream and clears the caches; returns how many streams it stopped."""
    running = spark.streams.active
    for q in running:
        q.stop()
    spark.catalog.clearCache()
    return len(running)
