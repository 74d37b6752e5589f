"""A training-data pipeline: quality, line dedup, near duplicates, mixing, byte-level BPE; each stage reads what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiform.llm import bpe, jaccard, line_dedup, mixing, quality
from lexiform.llm.common import drop_written, shielded, written_alone

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go.

    Empty and null texts are scored as such: they have the share of good labels, and stay where that is over the threshold. Equal texts stay or go alike.
    """
    model = quality.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    inner, back = shielded(docs, COLUMNS)
    return back(quality.scored(inner, model).where("predicted = 1"))


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go from all documents but their first; a document that had text and has none left goes too.

    Null and empty texts stay as they are; rows without a doc_id keep no boilerplate line; rows that repeat a doc_id lose the same lines.
    """
    inner, back = shielded(docs, COLUMNS)
    out = line_dedup.line_dedup(inner)
    blank = F.length(F.trim(F.regexp_replace("clean_text", r"[\x09-\x0D]+", " "))) == 0
    out = out.where(F.col("text").isNull() | ~blank | (F.col("n_removed") == 0))
    return back(out.withColumns({"text": F.col("clean_text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("clean_text").cast("long")).otherwise(F.col("n_chars"))}))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the one with the smallest doc_id stays.

    Rows without doc_id and texts without words stay; rows that repeat a doc_id stay or go together.
    """
    found = jaccard.jaccard_components(docs)
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    inner, back = shielded(docs, COLUMNS)
    return back(inner.join(gone.hint("merge"), "doc_id", "left_anti"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document stays with its rate as probability; the draw is a hash of its doc_id and text, so a run repeats exactly and no row is repeated.

    The domains are learnt from all labelled documents, those among them that earlier stages rejected. Toxic and low documents are thinned to their weights; a
    domain that has less than its weight isn't. Null and empty texts have no tokens and stay by the domains' prior.
    """
    return mixing.mixed(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), labelled=spark.read.parquet(f"{sf_dir}/documents.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, digests and the token ids of the texts that are left; a null text has no tokens."""
    return bpe.encoded(docs.select("doc_id", "lang", "source", "text"), *bpe.public_ranks(), ids=True)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", cut_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing to target weights", mix),
    ("byte-level BPE", tokens),
]

#: The classifier, the mixing and the tokenizer can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; each result is written to the shared folder, and what only an earlier stage needed is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: DataFrame | None = None
    for _, stage in STAGES[:-1]:
        out = written_alone(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), "stage")
        if before is not None:
            drop_written(before)
        docs = before = out
    return STAGES[-1][1](spark, docs, sf_dir)
