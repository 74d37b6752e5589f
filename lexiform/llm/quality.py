"""Compression classifier of text quality: zstandard dictionaries of good and bad labelled text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiform.llm.common import documents, give_back, shielded, slices

#: Texts are compressed in pieces of so many bytes, so that the dictionary counts throughout a long text.
PIECE = 1024
#: Bound of the labelled sample: rows a class, and characters of a row (longer rows aren't chosen).
SAMPLE_ROWS, SAMPLE_CHARS = 4000, 8192
#: Pieces a class from which a dictionary is trained, taken in turn from all of a class's rows; bytes of a dictionary.
DICT_PIECES, DICT_BYTES = 8000, 65_536
LEVEL = 3
#: Bytes below which a text says little; sets how fast the prior takes over.
SHORT = 200
GOOD_FROM = 0.7
#: Lengths in bytes of the heads by which the calibration also sees short texts, the empty one among them.
HEADS = (0, 16, 64, 160)


def pieces(data: bytes) -> list[bytes]:
    return [data[i : i + PIECE] for i in range(0, len(data), PIECE)]


@dataclass
class Model:
    """Two dictionaries and the calibration; picklable, at most 2 * DICT_BYTES and a few numbers."""

    bad: bytes
    good: bytes
    coef: tuple[float, ...]

    def compressors(self):
        out = []
        for data in (self.bad, self.good):
            d = zstandard.ZstdCompressionDict(data)
            d.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        return out


def features(data: bytes, bad, good) -> list[float]:
    """The difference of the sizes compressed with either dictionary over the text's size; how short it is; their product."""
    gain = sum(len(bad.compress(p)) - len(good.compress(p)) for p in pieces(data)) / max(len(data), 64)
    short = float(np.exp(-len(data) / SHORT))
    return [gain, short, gain * short]


def dictionary(texts: list[bytes]) -> bytes:
    """A dictionary of pieces taken in turn from all texts; without any, a space."""
    turns = [pieces(t) for t in texts]
    took: list[bytes] = []
    for k in range(max(map(len, turns), default=0)):
        took += [t[k] for t in turns if k < len(t)]
        if len(took) >= DICT_PIECES:
            break
    took = took[:DICT_PIECES]
    try:
        return zstandard.train_dictionary(DICT_BYTES, took).as_bytes()
    except zstandard.ZstdError:  # too few samples for the trainer: the text itself is the dictionary
        return (b"\n".join(took) or b" ")[-DICT_BYTES:]


def calibrated(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, ...]:
    """Coefficients of a slightly regularised logistic regression on standardised features, as (mean, sd, slope)*, intercept."""
    mean, sd = x.mean(0), x.std(0) + 1e-9
    a, th = np.c_[(x - mean) / sd, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ th, -30, 30)))
        w = weight * (p * (1 - p) + 1e-9)
        th = th - np.linalg.solve((a * w[:, None]).T @ a + 1e-2 * np.eye(len(th)), a.T @ (weight * (p - y)) + 1e-2 * th)
    return tuple(map(float, [*mean, *sd, *th]))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4; a null id counts as the empty text, which leaves 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from labelled rows that aren't held out: at most SAMPLE_ROWS a class, those of smallest hash.

    Rows without an id or a quality are not used; a doc_id with several labels has its lowest. Two of three rows make the
    dictionaries, the third calibrates, each row as a whole and by a head of one of HEADS; class weights restore the classes' shares in
    all labels. So an empty text, which says nothing, has about the share of good labels. Without both classes, or
    with a class of under three rows, the model gives everything the share of good labels (0.5 with no labels at all).
    """
    known = labels.select("doc_id", "quality").where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality")).where(~held_out(F.col("doc_id")))
    share = {r.quality: r.n for r in known.groupBy("quality").agg(F.count("*").alias("n")).where("quality IN (0, 1)").collect()}
    total = sum(share.values())
    picked = None
    for q in (0, 1):
        some = known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
        picked = some if picked is None else picked.union(some)
    texts = docs.select("doc_id", "text").where(F.length("text").between(1, SAMPLE_CHARS))
    rows = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))  # broadcast: 2 * SAMPLE_ROWS rows at most
    rows = sorted(rows.select(F.xxhash64("doc_id").alias("o"), "doc_id", "quality", "text").collect())
    by = {q: [r.text.encode() for r in rows if r.quality == q] for q in (0, 1)}
    if min(map(len, by.values())) < 3:
        p = share.get(1, 0) / total if total else 0.5
        p = min(max(p, 1e-6), 1 - 1e-6)
        return Model(b" ", b" ", (0.0,) * 3 + (1.0,) * 3 + (0.0,) * 3 + (float(np.log(p / (1 - p))),))
    made = {q: dictionary([t for i, t in enumerate(by[q]) if i % 3 < 2]) for q in (0, 1)}
    model = Model(made[0], made[1], ())
    pair = model.compressors()
    fresh = [(q, t) for q in (0, 1) for i, t in enumerate(by[q]) if i % 3 == 2]
    fresh += [(q, t[: HEADS[i % len(HEADS)]]) for q in (0, 1) for i, t in enumerate(t for j, t in enumerate(by[q]) if j % 3 == 2)]
    y = np.array([q for q, _ in fresh], float)
    n = {q: (y == q).sum() for q in (0, 1)}
    weight = np.array([share[q] / total / n[q] * len(y) for q in y.astype(int)])
    model.coef = calibrated(np.array([features(t, *pair) for _, t in fresh]), y, weight)
    give_back()
    return model


def scored(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) of ``docs`` with score and predicted, from column ``text`` alone.

    A null text is scored as an empty one. Whole texts are read; every row gives one row, equal texts equal scores. An empty table gives an
    empty result; columns of ``docs`` named like the new ones are replaced.
    """
    keep = docs.columns if keep is None else keep
    inner, back = shielded(docs.select(*[F.col(f"`{c}`") for c in keep]) if "text" in keep else docs.select(*[F.col(f"`{c}`") for c in keep], "text"), ("text",), ("score", "predicted"))
    need = inner.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad, good = model.compressors()
        mean, sd, th = (np.array(model.coef[i : i + 3]) for i in (0, 3, 6))
        for b in slices(batches):
            texts = b.column(b.schema.get_field_index("text"))
            x = np.array([features((t.as_py() or "").encode(), bad, good) for t in texts]).reshape(-1, 3)
            score = 1 / (1 + np.exp(-np.clip((x - mean) / sd @ th + model.coef[9], -30, 30)))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(need))), pa.array(score), pa.array((score >= GOOD_FROM).astype(np.int32))], [*need, "score", "predicted"])

    out = back(inner.mapInArrow(run, inner.select("*").schema.add("score", "double").add("predicted", "integer")))
    return out if "text" in keep else out.drop("text")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document. A null doc_id isn't held out; odd rows as in ``fit`` and ``scored``."""
    docs = documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = scored(docs.select("doc_id", "text"), model, ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
