from pyspark.sql import functions as F

import corpus_pipeline as cp
from lexiform.llm.common import written

SF = "/root/testdata/sf0.01"


def check_mix(spark, before, after):
    """The rows kept have the target shares of tokens, clean documents stay and most toxic ones go."""
    from lexiform.llm import mixing

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = mixing.mixed_rates(before, labels, ["doc_id"], labelled=spark.read.parquet(f"{SF}/documents.parquet")).toPandas()
    kept = rows[rows.doc_id.isin({r.doc_id for r in after.select("doc_id").collect()})]
    p = ["p_clean", "p_toxic", "p_low"]
    total = lambda x: x[p].mul(x.n_tokens, axis=0).sum().to_numpy()
    have, want = total(kept), mixing.targets(total(rows), mixing.WEIGHTS)
    assert abs(have / have.sum() - want / want.sum()).max() < 0.01
    assert have[0] > 0.9 * total(rows)[0]
    known = before.join(labels, "doc_id")
    clean, toxic = known.where("quality = 1 and toxic = 0"), known.where("toxic = 1")
    assert clean.join(after, "doc_id", "left_semi").count() > 0.95 * clean.count()
    assert toxic.join(after, "doc_id", "left_semi").count() < 0.4 * toxic.count()


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in cp.STAGES[:-1]:
        docs = written(stage(spark, before, SF), "test-stage")
        assert docs.columns == list(cp.COLUMNS), name
        assert docs.join(before, "doc_id", "left_anti").count() == 0
        assert 0 < docs.count() <= before.count()
        if name == "n-gram Jaccard join":
            from lexiform.llm.jaccard import jaccard_components

            assert jaccard_components(docs).where("component_id <> doc_id").count() == 0
        if name == "quality classifier":
            labels = spark.read.parquet(f"{SF}/labels.parquet")
            clean = before.join(labels.where("quality = 1"), "doc_id")
            assert clean.join(docs, "doc_id", "left_semi").count() > 0.97 * clean.count()
        if name == "mixing to target weights":
            check_mix(spark, before, docs)
        before = docs
    last = cp.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count() and last.where(F.size("ids") != F.col("n_tokens")).count() == 0


def test_run_over_odd_rows(spark, tmp_path):
    rows = [(1, None, "en", "s", None), (2, "", "en", "s", 0), (None, "text without an id", "en", "s", 5), (3, "some words here " * 40, "en", None, 9), (3, "some words here " * 40, "en", "s", 9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert cp.run(spark, str(tmp_path)).count() <= len(rows)
    clash = spark.read.parquet(str(tmp_path / "documents.parquet")).withColumns({c: F.lit("old") for c in ("score", "Rate", "n_lines", "p", "n_tokens", "component_id", "__x0")})
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, clash, str(tmp_path)).columns == clash.columns
        assert {r.score for r in stage(spark, clash, str(tmp_path)).select("score").collect()} <= {"old"}
    assert cp.STAGES[-1][1](spark, clash, str(tmp_path)).count() == len(rows)
    empty = tmp_path / "none"
    spark.read.parquet(str(tmp_path / "documents.parquet")).limit(0).write.parquet(str(empty / "documents.parquet"))
    spark.read.parquet(str(tmp_path / "labels.parquet")).limit(0).write.parquet(str(empty / "labels.parquet"))
    assert cp.run(spark, str(empty)).count() == 0
