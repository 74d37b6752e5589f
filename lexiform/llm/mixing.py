"""Mixing to target weights: domain posteriors from labelled rows, and document rates between 0 and 1 by projected gradient."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiform.llm.common import documents, drop_written, give_back, shielded, slices, written
from lexiform.llm.quality import held_out
from lexiform.llm.words import word_hashes

#: The domains, as the labelled table tells them apart.
DOMAINS = ("clean", "toxic", "low")
#: Production weights of the domains' tokens.
WEIGHTS = (0.95, 0.015, 0.035)
#: Bounds of the labelled sample: rows a domain, characters of a row; words of the classifier.
SAMPLE_ROWS, SAMPLE_CHARS, FEATURES = 3000, 8192, 1500
BUCKET_BITS = 18
#: Posteriors are rounded to multiples of 1/GRID, so that documents fall into a bounded number of cells.
GRID = 256
#: Steps at most; the share of all tokens that a domain's may be off its target by when they end; times that targets are scaled down at most.
STEPS, ENOUGH, SCALINGS = 120, 1e-4, 20
#: Beyond this share of the whole targets count as out of reach at any scale.
LOST = 0.05
#: The same for the tokens of the documents drawn, and steps towards it.
DRAWN_ENOUGH, DRAWN_STEPS = 2e-3, 8


def domain(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, 1).when(quality == 0, 2).otherwise(0)


def _buckets(words: np.ndarray) -> np.ndarray:
    return np.unique((words >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))


@dataclass
class DomainModel:
    """Softmax regression on which of some hashed words a text has; at most FEATURES rows of weights."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: np.ndarray


def train(texts: list[bytes], y: np.ndarray, share: np.ndarray) -> DomainModel:
    """Word presence, the FEATURES buckets most unevenly spread over the domains, proximal steps for an L1 penalty."""
    k, n = len(share), len(texts)
    found = [_buckets(w) for w, _, _ in word_hashes(texts)]
    row = np.repeat(np.arange(n), [len(f) for f in found])
    col = np.concatenate(found) if found else np.zeros(0, np.int64)
    size = 1 << BUCKET_BITS
    total, own = np.bincount(col, minlength=size), np.bincount(y, minlength=k) / n
    uneven = np.zeros(size)
    for d in range(k):
        expected = total * own[d]
        uneven = np.maximum(uneven, (np.bincount(col[(y == d)[row]], minlength=size) - expected) / np.sqrt(expected + 1))
    top = np.sort(np.argsort(-uneven, kind="stable")[:FEATURES])
    at = np.minimum(np.searchsorted(top, col), len(top) - 1)
    has = top[at] == col
    row, col = row[has], at[has]
    weight = (share / np.maximum(own, 1e-12))[y]  # the sample has as many rows of each domain as it can; the labels' shares count
    weight = weight / weight.mean()
    w, b, sq, one = np.zeros((len(top), k)), np.log(np.maximum(share, 1e-6)), np.zeros((len(top), k)), np.eye(k)[y]
    for _ in range(150):
        z = np.stack([np.bincount(row, w[col, d], minlength=n) for d in range(k)], 1) + b
        p = np.exp(z - z.max(1, keepdims=True))
        e = (p / p.sum(1, keepdims=True) - one) * weight[:, None] / n
        g = np.stack([np.bincount(col, e[row, d], minlength=len(top)) for d in range(k)], 1)
        sq += g * g
        step = 0.1 / (np.sqrt(sq) + 1e-6)
        w -= step * g
        w = np.sign(w) * np.maximum(0, np.abs(w) - step * 2e-4)
        b = b - 0.5 * e.sum(0)
    used = (w != 0).any(1)
    return DomainModel(top[used], w[used], b)


def fit_domains(docs: DataFrame, labels: DataFrame) -> DomainModel:
    """The classifier of the labelled rows that aren't held out: at most SAMPLE_ROWS a domain, those of smallest hash.

    Rows without an id or a label are not used; a doc_id with several labels has its lowest quality and highest toxicity.
    Domains without a labelled row get almost no posterior; without any row all domains are alike.
    """
    known = labels.select("doc_id", "quality", "toxic").where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).where(~held_out(F.col("doc_id")))
    known = known.select("doc_id", domain(F.col("quality"), F.col("toxic")).alias("y"))
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = None
    for d in range(len(DOMAINS)):
        some = known.where(F.col("y") == d).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
        picked = some if picked is None else picked.union(some)
    texts = docs.select("doc_id", "text").where(F.length("text").between(1, SAMPLE_CHARS))
    rows = texts.join(F.broadcast(picked), "doc_id")  # broadcast: SAMPLE_ROWS rows of a domain at most
    rows = sorted((r.o, r.y, r.text.encode().lower()) for r in rows.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select(F.xxhash64("doc_id").alias("o"), "y", "text").collect())
    if not rows:
        return DomainModel(np.zeros(0, np.int64), np.zeros((0, len(DOMAINS))), np.zeros(len(DOMAINS)))
    share = np.array([counts.get(d, 0) for d in range(len(DOMAINS))], float)
    model = train([t for _, _, t in rows], np.array([y for _, y, _ in rows]), share / share.sum())
    give_back()
    return model


def with_posteriors(docs: DataFrame, model: DomainModel, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with n_tokens (words of the whole text) and p, the domains' posteriors in multiples of 1/GRID that sum to 1."""
    need = list(dict.fromkeys([*keep, "text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n, z = [], []
            for w, _, _ in word_hashes([(t.as_py() or "").encode().lower() for t in b.column(need.index("text"))]):
                n.append(len(w))
                own = np.searchsorted(model.buckets, x := _buckets(w))
                hit = own < len(model.buckets)
                own = own[hit][model.buckets[own[hit]] == x[hit]]
                z.append(model.weights[own].sum(0) + model.bias)
            z = np.array(z).reshape(-1, len(model.bias))
            p = np.exp(z - z.max(1, keepdims=True))
            p = p / p.sum(1, keepdims=True) * GRID
            q = np.floor(p)
            for _ in range(q.shape[1]):  # largest remainders first
                short = GRID - q.sum(1) >= 1
                q[short, np.argmax((p - q)[short], 1)] += 1
            yield pa.RecordBatch.from_arrays([*(b.column(need.index(c)) for c in keep), pa.array(n, pa.int64()), pa.array((q / GRID).tolist(), pa.list_(pa.float64()))], [*keep, "n_tokens", "p"])

    from pyspark.sql import types as T

    return docs.select(*need).mapInArrow(run, docs.select(*keep).schema.add("n_tokens", "long").add("p", T.ArrayType(T.DoubleType())))


def rate(p: Column, moves: list[list[float]]) -> Column:
    """The rate of a document with posteriors ``p`` after the gradient steps ``moves``: from 1, each step projected onto [0, 1]."""
    if not moves:
        return F.lit(1.0)
    steps = F.array(*[F.array(*[F.lit(float(x)) for x in m]) for m in moves])
    dot = lambda m: sum((p[d] * m[d] for d in range(1, len(moves[0]))), p[0] * m[0])
    return F.aggregate(steps, F.lit(1.0), lambda r, m: F.least(F.lit(1.0), F.greatest(F.lit(0.0), r - dot(m))))


@dataclass
class Fit:
    """The gradient steps whose replay by ``rate`` gives each document its rate, and what they come to in tokens by domain.

    ``wanted`` are the targets as asked for, ``target`` those scaled down to what thinning can reach, ``off`` the largest difference from ``target`` as a share of its sum.
    """

    moves: list[list[float]]
    expected: list[float]
    wanted: list[float]
    target: list[float]
    reached: list[float]
    off: float
    inverse: np.ndarray


def targets(expected: np.ndarray, weights: tuple[float, ...]) -> np.ndarray:
    """Tokens wanted of each domain: the first domain whole and the others in proportion to it by ``weights``; a domain that has less is taken whole."""
    return np.minimum(np.array(weights) / weights[0] * expected[0], expected)


def fit_rates(rows: DataFrame, weights: tuple[float, ...]) -> Fit:
    """Rates in [0, 1] at which the expected tokens of rows (n_tokens, p) come to ``targets`` by domain.

    Minimises the squared distance of the expected tokens from the targets by projected gradient from rates of 1. The distance is measured by the inverse of the
    domains' Gram matrix, so that a step of 1 is the right length whatever the corpus: without the bounds one step would do. The step from a document's
    rate depends on its posteriors only, so documents of one cell of posteriors have one rate for ever: the corpus is summed into cells once, and each iteration is an
    aggregation over the cells. It ends when no target is off by more than ENOUGH of the whole. As a document belongs to several domains in part, thinning one
    domain also takes from others: where the steps end short of the targets, the target of a domain taken whole becomes what is left of it, and the others are scaled
    down alike, to what was reached of the first and from then on to where the last two scales' differences lead, SCALINGS times at most.
    Targets that no scale comes within LOST of aren't scaled, as that would only empty the corpus: the fit to ``targets`` themselves counts. Where all rows have the
    same posteriors, thinning changes no proportion, and every rate is 1.
    A row without tokens or posteriors' weight changes nothing; without any tokens every rate is 1.
    """
    k = len(weights)
    cells = written(rows.groupBy("p").agg(F.sum("n_tokens").cast("double").alias("n")).coalesce(8), "cells")
    grams = cells.agg(*[F.coalesce(F.sum(F.col("n") * F.col("p")[i] * F.col("p")[j]), F.lit(0.0)).alias(f"g{i}_{j}") for i in range(k) for j in range(k)], *[F.coalesce(F.sum(F.col("n") * F.col("p")[i]), F.lit(0.0)).alias(f"e{i}") for i in range(k)]).first()
    gram = np.array([[grams[f"g{i}_{j}"] for j in range(k)] for i in range(k)])
    expected = np.array([grams[f"e{i}"] for i in range(k)])
    inverse = np.linalg.pinv(gram, rcond=1e-9, hermitian=True)
    wanted = targets(expected, weights)
    if expected[0] > 0 and np.linalg.matrix_rank(gram, tol=1e-9 * gram.trace(), hermitian=True) < 2:
        drop_written(cells)
        return Fit([], expected.tolist(), wanted.tolist(), expected.tolist(), expected.tolist(), 0.0, np.zeros_like(inverse))
    target, now, moves = wanted, expected, []
    scale, last, first = 1.0, None, None
    off = lambda: float(np.abs(now - target).max() / max(target.sum(), 1.0))
    for _ in range(SCALINGS + 1):
        before = np.inf
        while len(moves) < STEPS and off() > ENOUGH and off() < 0.97 * before:
            before = off()
            moves.append((inverse @ (now - target)).tolist())
            got = cells.select("n", "p", rate(F.col("p"), moves).alias("r")).agg(*[F.sum(F.col("n") * F.col("r") * F.col("p")[d]).alias(f"s{d}") for d in range(k)]).first()
            now = np.array(got, float)
        if off() <= ENOUGH or len(moves) >= STEPS:
            break
        first = first or (off(), wanted, now, list(moves))
        short = wanted >= expected  # what is taken whole yields what thinning the others leaves of it
        short[0] = False
        factor = min(1.0, now[0] / max(target[0], 1e-9)) * (1 - ENOUGH)
        if last and off() < last[1]:
            factor = min(factor, max(0.5, 1 - off() * (last[0] / scale - 1) / (last[1] - off())))
        last, scale = (scale, off()), scale * factor
        target = np.where(short, np.minimum(target, now), target * factor)
    if first and off() > min(LOST, first[0]):
        _, target, now, moves = first
    drop_written(cells)
    return Fit(moves, expected.tolist(), wanted.tolist(), target.tolist(), now.tolist(), off(), inverse)


def mixed_rates(docs: DataFrame, labels: DataFrame, keep: list[str], weights: tuple[float, ...] = WEIGHTS, labelled: DataFrame | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` with n_tokens, one posterior column ``p_<domain>`` for each domain, rate (rounded to 9 digits) and off (``Fit.off``, one value for all rows).

    Every row gives one row. A null or empty text has 0 tokens, the domains' prior as posteriors, and the rate that follows from them. Rows
    that repeat count each. An empty table gives an empty result. Columns named like the new ones are replaced; columns of ``docs`` beyond ``keep`` are ignored.
    ``labelled`` has the texts of the labels' rows (``docs`` by default): where ``docs`` has been filtered, the table before the filter.
    """
    model = fit_domains(docs if labelled is None else labelled, labels)
    new = {"n_tokens": F.col("n_tokens"), **{f"p_{d}": F.col("p")[i] for i, d in enumerate(DOMAINS)}}
    inner, back = shielded(docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, "text"])]), ("text",), (*new, "rate", "off"))
    rows = written(with_posteriors(inner, model, [c for c in inner.columns if c != "text" or "text" in keep]), "posteriors")
    fit = fit_rates(rows, weights)
    out = back(rows.withColumns({**({} if "text" in keep else {"text": F.lit(None)}), **new, "rate": F.round(rate(F.col("p"), fit.moves), 9), "off": F.lit(round(fit.off, 9))}))
    return out if "text" in keep else out.drop("text")


def draw_of(rows: DataFrame, columns: list[str]) -> Column:
    """A number in [0, 1) from the values of ``columns``: a run repeats exactly, and rows that agree in them share it."""
    return F.pmod(F.xxhash64(F.lit("mix"), *columns), F.lit(1 << 30)) / F.lit(float(1 << 30))


def mixed(docs: DataFrame, labels: DataFrame, weights: tuple[float, ...] = WEIGHTS, labelled: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, …) that are left when each stays with its rate as probability.

    A row's draw is a hash of its doc_id and text, so equal rows stay or go together and none is repeated. After the fit, further
    steps move the rates until the tokens of the rows drawn, and not only those expected, are within DRAWN_ENOUGH of the targets, DRAWN_STEPS at most;
    the best of them counts. Nulls, empty texts and empty tables as in ``mixed_rates``: a text without tokens stays by the domains' prior.
    """
    model = fit_domains(docs if labelled is None else labelled, labels)
    inner, back = shielded(docs, ("doc_id", "text"))
    rows = written(with_posteriors(inner.withColumn("__u", draw_of(inner, ["doc_id", "text"])), model, [*inner.columns, "__u"]), "posteriors")
    fit = fit_rates(rows, weights)
    k, target = len(weights), np.array(fit.target)
    moves, best = fit.moves, (np.inf, fit.moves)
    for _ in range(DRAWN_STEPS + 1):
        got = rows.where(F.col("__u") < rate(F.col("p"), moves)).agg(*[F.coalesce(F.sum(F.col("n_tokens") * F.col("p")[d]), F.lit(0.0)).alias(f"s{d}") for d in range(k)]).first()
        now = np.array(got, float)
        best = min(best, (float(np.abs(now - target).max() / max(target.sum(), 1.0)), moves), key=lambda x: x[0])
        if best[0] <= DRAWN_ENOUGH:
            break
        moves = [*moves, (fit.inverse @ (now - target)).tolist()]
    return back(rows.where(F.col("__u") < rate(F.col("p"), best[1])))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, posteriors and rate of every document; nulls and odd rows as in ``mixed_rates``."""
    return mixed_rates(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), ["doc_id"]).drop("off")
