"""Exact n-gram Jaccard join with set-relation skipping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiform.llm.common import components, documents, drop_written, settle, slices, written, written_alone
from lexiform.llm.words import mixed, shingles, word_hashes

#: Words of a shingle; similarity from which two sets link, in hundredths.
SHINGLE, PERCENT = 5, 75
#: Keys by which a set finds a set like it before the index is built.
KEYS = 16
#: Keys of KEYS that two sets have in common before they're compared ahead of the index; sets of a random cell, in which each meets its neighbour; rounds of that.
ALIKE, CELL, ROUNDS = 8, 64, 2
#: Positions by which later common shingles of a pair may lie deeper than its first one may.
SLACK = 1
#: Ids that are broadcast to the texts at most (16 bytes each).
SMALL = 1 << 20
#: Most frequent shingles that go last in the order of a set's shingles; the bound of what is broadcast (16 bytes each).
FREQUENT = 1 << 17
#: Sets from which on a shingle's list is long: such shingles go last too, whatever the tasks' own counts say.
LONG_LIST = 5000
#: Pairs of one set that are compared in one place.
SALT = 512
#: A block of an index list holds sets of sizes [BLOCK^b, BLOCK^(b+1)), sizes that can link with one size stand in two, at like positions:
#: the share of its shingles that a set has before the entry is 0, up to 1/14, or up to 1/7. Beyond 1/7 an entry can't be the smaller set's.
BLOCK = 4 / 3

_CUTS = np.arange(KEYS, dtype=np.uint64) * np.uint64((1 << 64) // KEYS)


def lower_ascii(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased and nothing else."""
    return (text or "").encode().lower()


def set_key(s: np.ndarray) -> int:
    """A 64-bit name of a shingle set: equal sets have equal keys."""
    with np.errstate(over="ignore"):
        x = np.add.reduce(mixed(s ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64) + np.uint64(len(s)) * np.uint64(0x2545F4914F6CDD1D)
        return int(mixed(np.array([x], np.uint64)).view(np.int64)[0])


def _sets(batch_texts: pa.Array) -> Iterator[np.ndarray]:
    for words, _, _ in word_hashes([lower_ascii(t.as_py()) for t in batch_texts]):
        yield shingles(words, SHINGLE)


def survey(docs: DataFrame) -> DataFrame:
    """One pass over the texts: a row (doc_id, n, k, m) for each document, and rows (t, c) of shingles that a task met in several sets.

    n is the set's size, k its key (null for an empty set), m KEYS shingles of it: the first hash from each of KEYS equal cuts of the
    range of hashes on, around its end. Two sets have one of them in common about as often as their similarity says. Shingles that a task
    meets once aren't told, so one that is rare in every task but not in all is only found out by its index list (see ``index_lists``).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "k", "m", "t", "c"]
        many = pa.list_(pa.int64())
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0

        def counted() -> pa.RecordBatch:
            x, c = np.unique(np.concatenate(held), return_counts=True)
            x, c = x[c > 1], c[c > 1]
            none = pa.nulls(len(x), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, pa.nulls(len(x), many), pa.array(x.view(np.int64)), pa.array(c.astype(np.int64))], names)

        for b in slices(batches):
            n, k, m = [], [], []
            for s in _sets(b.column(1)):
                n.append(len(s))
                k.append(set_key(s) if len(s) else None)
                m.append(s[np.searchsorted(s, _CUTS) % len(s)].view(np.int64) if len(s) else [])
                if len(s) and k[-1] not in seen:
                    seen.add(k[-1])
                    held.append(s)
                    size += len(s)
                if size >= 4_000_000:
                    yield counted()
                    held, size = [], 0
            none = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(m, many), none, none], names)
        if held:
            yield counted()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, k long, m array<long>, t long, c long")


def frequent_shingles(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The FREQUENT most frequent shingles of the tasks' counts (t, c), and their sums, sorted by shingle.

    The order of a set's shingles only steers how many candidates there are, never which links are found.
    """
    found = counts.groupBy("t").agg(F.sum("c").alias("c")).where("c >= 3").orderBy(F.desc("c"), "t").limit(FREQUENT)
    table = found.toArrow()  # at most FREQUENT rows of two numbers
    t, c = table.column("t").to_numpy().view(np.uint64), table.column("c").to_numpy()
    at = np.argsort(t)
    return t[at], c[at]


def prefix_index(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(t, k, n, p, hot): each set's first n - ceil(0.75 n) + 1 shingles, rarest first, with their positions.

    Two sets that link share one of them. ``hot`` marks frequent shingles.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ft, fc = shared.value
        seen: set[int] = set()
        for b in slices(batches):
            out: list[tuple] = []
            for s in _sets(b.column(0)):
                n = len(s)
                if not n or (k := set_key(s)) in seen:
                    continue
                seen.add(k)
                rank = np.zeros(n, np.int64)
                if len(ft):
                    at = np.minimum(np.searchsorted(ft, s), len(ft) - 1)
                    rank = np.where(ft[at] == s, fc[at], 0)
                order = np.lexsort((s, rank))[: n + (-n * PERCENT) // 100 + 1]
                out.append((s[order].view(np.int64), k, n, rank[order] > 0))
            if out:
                size = [len(o[0]) for o in out]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([o[0] for o in out])),
                        pa.array(np.repeat(np.array([o[1] for o in out], np.int64), size)),
                        pa.array(np.repeat(np.array([o[2] for o in out], np.int32), size)),
                        pa.array(np.concatenate([np.arange(x, dtype=np.int32) for x in size])),
                        pa.array(np.concatenate([o[3] for o in out])),
                    ],
                    ["t", "k", "n", "p", "hot"],
                )

    return docs.select("text").mapInArrow(run, "t long, k long, n int, p int, hot boolean")


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those (a, b) of ``pairs`` of set keys whose sets link, from ``sets`` (k, s) with each key's sorted shingles.

    The pairs of one ``a`` meet in places of about SALT pairs each; there ``a``'s shingles come once, before those of every ``b``.
    """
    many = pairs.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > SALT)
    salted = pairs.join(many, "a", "left").select("a", "b", F.when(F.col("n").isNull(), 0).otherwise(F.expr(f"pmod(xxhash64(b), cast(ceil(n / {SALT}) as int))")).cast("int").alias("salt"))
    salted = written(salted, "salted")
    heads = salted.select("a", "salt").distinct().join(sets, F.col("a") == F.col("k")).select("a", "salt", F.lit(None).cast("long").alias("b"), "s")
    tails = salted.join(sets, F.col("b") == F.col("k")).select("a", "salt", "b", "s")
    both = heads.union(tails).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = np.zeros(0, np.int64)
        for batch in slices(batches):
            at, flat = batch.column(3).offsets.to_numpy(), batch.column(3).values.to_numpy()
            good = []
            for i, b in enumerate(batch.column(2).is_valid().to_pylist()):
                u = flat[at[i] : at[i + 1]]
                if not b:
                    s = u.copy()
                    good.append(False)
                    continue
                both = len(np.intersect1d(s, u, assume_unique=True))
                good.append(100 * both >= PERCENT * (len(s) + len(u) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(run, "a long, b long").distinct()


def index_lists(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(t, k, n, p, hot): the prefix index's lists of shingles that two sets have, written.

    Shingles go by their counts, the tasks' own in ``frequent`` to begin with. Where lists of LONG_LIST sets and more turn up of shingles that weren't counted as frequent,
    those take their places among the frequent ones with their lengths as counts, and the index is made again.
    """
    while True:
        index = prefix_index(docs, frequent)
        # a frequent shingle is in several sets for certain: its entries are spread by set, and only rare ones are gathered to see whether two sets have them
        lists = index.withColumn("u", F.when(F.col("hot"), F.col("k")))
        w = Window.partitionBy("t", "u")
        lists = lists.withColumns({"lo": F.min("k").over(w), "hi": F.max("k").over(w), "c": F.count("*").over(w)}).where("hot or lo < hi")
        held = written(lists.select("t", "k", "n", "p", "hot", "c"), "lists")
        del index, lists
        settle(docs.sparkSession)  # the entries' shuffle isn't read again
        long = held.where(f"not hot and c >= {LONG_LIST}").groupBy("t").agg(F.count_distinct("k").alias("c")).where(f"c >= {LONG_LIST}").orderBy(F.desc("c"), "t").limit(max(0, FREQUENT - len(frequent[0]))).toArrow()  # at most FREQUENT rows of two numbers
        if not long.num_rows:
            return held.drop("c")
        drop_written(held)
        t, c = np.append(frequent[0], long.column("t").to_numpy().view(np.uint64)), np.append(frequent[1], long.column("c").to_numpy())
        at = np.argsort(t)
        frequent = t[at], c[at]


def candidates(index: DataFrame, relation: DataFrame) -> DataFrame:
    """(a, b, ca, cb, shared): pairs of sets of different components ca, cb that may link, from ``index_lists`` and (k, component).

    An index list is cut into blocks by size and by position. As two sets that link have 0.75 / 1.75 of both sizes in common, an entry asks only the blocks in
    which sizes and positions leave that much after both entries, less SLACK; the others are skipped unread. Within a block single entries are skipped by the same rule.
    A list whose sets already have one component is skipped whole: what one of them links with, they all reach.

    ``shared`` counts the shingles in which a pair meets. A pair that links meets in its first common shingle without any slack, and in its
    first SLACK + 1 with it, or in all of its common prefix shingles if they are fewer. Those are as many as its least overlap is
    over the rest of the set whose prefix ends last. Pairs that meet in less go.
    """
    lists = held = written(index.select("t", "k", "n", "p").distinct().join(relation, "k").select("t", "k", "n", "p", "component"), "index")
    several = lists.groupBy("t").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("t")
    lists = written(lists.join(several, "t"), "open-lists")
    drop_written(held)
    held = lists
    settle(index.sparkSession)
    size_block = lambda x: F.floor(F.log(x.cast("double")) / F.log(F.lit(BLOCK)) + 1e-9).cast("int")
    place = f"case when p <= {SLACK} then 0 when 14 * (p - {SLACK}) <= n then 1 when 7 * (p - {SLACK}) <= n then 2 end"
    low, high = f"greatest(0.75D * n, pow({BLOCK}D, size) * 0.999999D)", f"least(cast(n as double), pow({BLOCK}D, size + 1) * 1.000001D)"
    reach = f"least(case when 7 * (n - p + {SLACK}) < 3 * (n + {low}) then -1 when 7 * {high} > 6 * n then 2 when 4 * {high} > 3 * n then 1 else 0 end, 2)"  # the last place of a block of sizes that may link
    # a pair's larger set asks, its smaller set answers; of equal sizes the larger key asks
    asks = lists.select("t", "k", "n", "p", "component", F.explode(F.sequence(size_block(F.ceil(F.col("n") * F.lit(0.75))), size_block(F.col("n")))).alias("size")).withColumn("reach", F.expr(reach)).where("reach >= 0")
    asks = asks.select("t", F.col("k").alias("x"), F.col("n").alias("nx"), F.col("p").alias("px"), F.col("component").alias("cx"), "size", F.explode(F.sequence(F.lit(0), F.col("reach"))).alias("place"))
    answers = lists.select("t", F.col("k").alias("y"), F.col("n").alias("ny"), F.col("p").alias("py"), F.col("component").alias("cy"), size_block(F.col("n")).alias("size"), F.expr(place).alias("place")).where("place is not null")
    pairs = asks.join(answers, ["t", "size", "place"]).where(f"cx <> cy and (ny < nx or ny = nx and y < x) and 4 * ny >= 3 * nx and 7 * (least(nx - px, ny - py) + {SLACK}) >= 3 * (nx + ny)")
    need = f"cast(least({SLACK} + 1, ceil(3 * (nx + ny) / 7D - 1e-9) - greatest(ceil(0.75D * nx), ceil(0.75D * ny)) + 1) as int)"
    starts = "cast(7 * least(nx - px, ny - py) >= 3 * (nx + ny) as int)"  # the pair's first common shingle passes this
    pairs = pairs.selectExpr("x as a", "y as b", f"2 * {need} + {starts} as m").groupBy("a", "b").agg(F.count("*").alias("shared"), F.max("m").alias("m"))
    pairs = written(pairs.where("m % 2 <> 0 and shared >= floor(m / 2D)").select("a", "b", "shared"), "candidates")
    drop_written(held)
    settle(index.sparkSession)
    of = lambda c, name: relation.select(F.col("k").alias(c), F.col("component").alias(name))
    pairs = pairs.join(of("a", "ca"), "a").join(of("b", "cb"), "b")
    # told in the order of the components, so that those of one pair of components stand alike
    swap = F.col("ca") > F.col("cb")
    pick = lambda u, v: F.when(swap, F.col(v)).otherwise(F.col(u))
    return pairs.select(pick("a", "b").alias("a"), pick("b", "a").alias("b"), pick("ca", "cb").alias("ca"), pick("cb", "ca").alias("cb"), "shared")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text).

    Two documents link when 100 * |intersection| >= 75 * |union| of their sets of distinct 5-word shingles of the lower-cased text;
    component_id is the smallest doc_id reachable by links. Texts without words link with nothing. Rows without doc_id have no
    component (null) and take part in no link; rows that repeat a doc_id are one node, so their texts' links join. An empty table gives an empty result.

    Equal sets are one node from the start. Sets that share one of KEYS shingle keys are tested against the key's most central set;
    the links found are relations, whose components answer for all their members; components that a key still has then meet in rounds. The exact index join then finds every link between components.
    Sets are compared by 64-bit hashes of their shingles. Columns other than the two are ignored.
    """
    return written_alone(lambda: _components_of(docs), "components")


def _components_of(docs: DataFrame) -> DataFrame:
    """``jaccard_components`` before it's written."""
    seen = written(survey(docs), "survey")
    frequent = frequent_shingles(seen.where("c IS NOT NULL").select("t", "c"))
    sig = written(seen.where("n IS NOT NULL").select("doc_id", "n", "k"), "documents")
    known = sig.where("doc_id IS NOT NULL AND k IS NOT NULL")
    nodes = written(known.groupBy("k").agg(F.min("doc_id").alias("rep")), "nodes")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    repeated = not known.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").isEmpty()

    def chosen(pairs: DataFrame) -> DataFrame:
        """(k, s) of the sets in ``pairs``: only their documents' texts are read again; a repeated doc_id is told by its set."""
        need = pairs.select(F.col("a").alias("k")).union(pairs.select(F.col("b").alias("k"))).distinct()
        rep = written(nodes.join(need, "k").select("k", F.col("rep").alias("doc_id")), "wanted")
        # up to a checked size the wanted ids go to the texts; beyond, both are shuffled
        found = with_key(texts.join(F.broadcast(rep) if rep.count() <= SMALL else rep, "doc_id").select("k", "text"))
        out = written(found.dropDuplicates(["k"]) if repeated else found, "pair-sets")
        drop_written(rep)
        return out

    def with_key(found: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                same, out = [], []
                for s, k in zip(_sets(b.column(1)), b.column(0), strict=True):
                    same.append(len(s) > 0 and set_key(s) == k.as_py())
                    if same[-1]:
                        out.append(s.view(np.int64))
                at = np.cumsum([0] + [len(x) for x in out]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(out) if out else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(same, pa.bool_())), lists], ["k", "s"])

        return found.mapInArrow(run, "k long, s array<long>")

    sets = written(seen.where("doc_id IS NOT NULL AND k IS NOT NULL").groupBy("k").agg(F.first("m").alias("m")), "sets")
    drop_written(seen)
    keys = sets.select("k", F.posexplode("m").alias("i", "v"))
    size = keys.groupBy("i", "v").agg(F.count("*").alias("c")).where("c > 1")
    keys = keys.join(size, ["i", "v"])
    central = keys.groupBy("k").agg(F.sum("c").alias("score"))  # the set that most others are like has the most common keys
    keys = written(keys.join(central.join(sets, "k"), "k"), "keys")
    first = keys.groupBy("i", "v").agg(F.max_by(F.struct("k", "m"), F.struct("score", "k")).alias("pivot"))
    alike = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: (u == v).cast("int")), F.lit(0), lambda r, z: r + z) >= ALIKE
    stars = keys.join(first, ["i", "v"]).where((F.col("k") != F.col("pivot.k")) & alike(F.col("m"), F.col("pivot.m")))
    stars = written(stars.select(F.col("pivot.k").alias("a"), F.col("k").alias("b")).distinct(), "stars")
    del first, size, central
    settle(docs.sparkSession)
    near = written(linked(stars, pool := chosen(stars)), "near")
    drop_written(pool)
    part = written(components(near), "relation")
    other = lambda c, name: part.select(F.col("node").alias(c), F.col("component").alias(name))
    # of the components that a key has after that, one set each meets another: in turn a neighbour in a small random cell, and a random set of the key's largest component
    for turn in range(ROUNDS):
        owned = keys.select("i", "v", "k", "c").join(other("k", "component"), "k", "left").withColumn("component", F.coalesce("component", "k"))
        one = owned.groupBy("i", "v", "c", "component").agg(F.count("*").alias("n"), F.min_by("k", F.xxhash64(F.lit(turn), "i", "k")).alias("k"))
        if turn % 2:
            largest = one.groupBy("i", "v").agg(F.max_by(F.struct("component", "k"), F.struct("n", "component")).alias("p"))
            met = one.join(largest, ["i", "v"]).where("component <> p.component").select("k", F.col("p.k").alias("o"))
        else:
            cell = F.expr(f"pmod(xxhash64(component, i, {turn}), cast(ceil(c / {CELL}) as int))")
            met = one.select("k", F.lag("k").over(Window.partitionBy("i", "v", cell).orderBy(F.xxhash64(F.lit(turn), "i", "k"), "k")).alias("o")).where("o is not null")
        met = met.select(F.least("k", "o").alias("a"), F.greatest("k", "o").alias("b")).distinct()
        m = lambda c, name: sets.select(F.col("k").alias(c), F.col("m").alias(name))
        met = written(met.join(m("a", "ma"), "a").join(m("b", "mb"), "b").where(alike(F.col("ma"), F.col("mb"))).select("a", "b"), "neighbours")
        fresh = written(linked(met, pool := chosen(met)), "near")
        drop_written(pool)
        drop_written(met)
        if fresh.isEmpty():
            break
        near = written(near.union(fresh), "near")
        part = written(components(near), "relation")
        del owned, one, met, fresh
        settle(docs.sparkSession)
    for done in (keys, stars, sets):
        drop_written(done)
    settle(docs.sparkSession)
    twice = known.select("doc_id", "k").distinct()
    same = twice.groupBy("doc_id").agg(F.min("k").alias("a"), F.max("k").alias("z")).where("a < z").select("doc_id", "a")
    same = twice.join(same, "doc_id").where("k <> a").select("a", F.col("k").alias("b"))  # texts of one doc_id
    near = near.union(same)
    part = written(components(near), "relation")
    relation = nodes.join(part, nodes.k == part.node, "left").select("k", F.coalesce("component", "k").alias("component"))

    index = index_lists(docs.select("text"), frequent)
    pairs = written(candidates(index, relation), "candidates")
    drop_written(index)
    # first the likeliest pair of each two components: where it links, the answer holds for both and their other pairs are settled
    best = pairs.groupBy("ca", "cb").agg(F.max_by(F.struct("a", "b"), F.struct("shared", "a", "b")).alias("p")).select("p.a", "p.b")
    best = written(best, "likeliest")
    near = written(near.union(linked(best, chosen(best))), "near")
    part = written(components(near), "relation")
    left = pairs.join(best, ["a", "b"], "left_anti").join(other("a", "pa"), "a", "left").join(other("b", "pb"), "b", "left").where("coalesce(pa, a) <> coalesce(pb, b)").select("a", "b")
    left = written(left, "left")
    exact = linked(left, chosen(left))
    part = written(components(near.union(exact)), "relation")
    label = nodes.join(part, nodes.k == part.node, "left").select("k", "rep", F.coalesce("component", "k").alias("component"))
    low = label.groupBy("component").agg(F.min("rep").alias("component_id"))
    ids = label.join(low, "component").select("k", "component_id")
    out = sig.join(ids, "k", "left")
    low_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), low_id.alias("component_id"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of every document; nulls and odd rows as in ``jaccard_components``."""
    return jaccard_components(documents(spark, sf_dir))
