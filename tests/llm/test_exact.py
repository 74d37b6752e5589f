import hashlib
import random
import re

import pytest

from lexiform.llm import common, exact_dedup, line_dedup, sharding
from lexiform.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
ODD = [(5, "a  b"), (3, "a\tb"), (9, "a b"), (4, None), (6, ""), (7, " "), (8, "é" * 9000 + "x"), (2, "é" * 9000 + "x"), (1, "é" * 9000 + "y"), (10, "a b"), (10, "a b"), (None, "a b"), (None, "zz"), (11, "x" * 50_000)]


@pytest.mark.parametrize("name", ["op1_line_dedup", "op3_substring_dedup", "op4_exact_dedup", "op9_sharding"])
def test_queries_agree_with_sql(spark, agrees, name):
    assert agrees(QUERIES[name](spark, SF), ORACLE_SQL[name], SF)


@pytest.mark.parametrize("block", [7, 64, 4096])
def test_exact_dedup_against_dictionary(spark, block):
    got = exact_dedup.exact_dedup(spark.createDataFrame(ODD, DOCS), block).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in ODD:
        groups.setdefault(norm(t), []).append(i)
    want = []
    for i, t in ODD:
        g = groups[norm(t)]
        keep = min((x for x in g if x is not None), default=None)
        want.append((i, keep, len(g), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, r[4])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_hash_collisions_are_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.lit(7).cast("long") + F.length(c[0]) * 0)
    rows = [(i, t) for i, t in enumerate(["aa", "bb", "aa", "cc", "aabb", "aabb", "bbaa"])]
    got = {r.doc_id: r.keep_id for r in exact_dedup.exact_dedup(spark.createDataFrame(rows, DOCS), 2).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 3, 4: 4, 5: 4, 6: 6}


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS + ", source string")
    assert exact_dedup.exact_dedup(none).count() == 0
    assert line_dedup.line_dedup(none).count() == 0
    assert sharding.shard(none).count() == 0


def test_line_dedup_cases(spark):
    rows = [(i, "Menu  here\nown %d\n\nMenu here " % i, f"s{i}") for i in range(10)] + [(10, None, "s0"), (11, "", "s0"), (None, "Menu here", "s1"), (12, "Menu here", None), (0, "Menu here", "s0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as h", "2 as line")
    got = line_dedup.line_dedup(docs, 8).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.text): r for r in got}
    assert by[0, rows[0][1]].clean_text == rows[0][1] and by[0, "Menu here"].n_removed == 0
    assert by[3, rows[3][1]].clean_text == "own 3\n" and by[3, rows[3][1]].n_removed == 2
    assert (by[10, None].clean_text, by[11, ""].clean_text, by[None, "Menu here"].clean_text) == (None, "", "")
    assert by[12, "Menu here"].clean_text == "" and by[3, rows[3][1]].h == 1
    assert all(r.n_removed == 0 for r in line_dedup.line_dedup(docs, 11).collect())
    clash = line_dedup.line_dedup(docs.withColumnRenamed("h", "N_lines").withColumnRenamed("line", "__x0"))
    assert clash.columns == ["doc_id", "text", "source", "__x0", "n_lines", "n_removed", "clean_text"] and sum(r.n_lines for r in clash.collect()) == sum(r.n_lines for r in got)
    assert line_dedup.line_dedup(docs.limit(0)).count() == 0


def test_rows_without_ids_lose_boilerplate(spark):
    rows = [(None, f"Menu here\nown {i}\nMenu  here", f"s{i}") for i in range(10)] + [(5, "Menu\n" + "a line of its own\n" * 20_000 + "Menu here", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = line_dedup.line_dedup(docs, 8).collect()
    assert sorted(r.clean_text for r in got if r.doc_id is None) == sorted(f"own {i}" for i in range(10))
    assert [(r.n_lines, r.n_removed) for r in got if r.doc_id] == [(20_002, 0)]
    assert {r.n_removed for r in line_dedup.line_dedup(docs.where("doc_id IS NULL"), 8).collect()} == {2}


def test_exact_counts_near_the_threshold(spark):
    rows = [(i, "at\nbelow" if i < 7 else "at", f"s{i % 40}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert [r.n_removed for r in line_dedup.line_dedup(docs, 40).orderBy("doc_id").collect()] == [0] + [1] * 39
    assert sum(r.n_removed for r in line_dedup.line_dedup(docs, 41).collect()) == 0


def test_sharding_fits_and_splits_only_what_is_too_large(spark, tmp_path):
    rows = [(i, "x" * (i % 50)) for i in range(500)] + [(None, "abc"), (None, None), (7, None)]
    docs = spark.createDataFrame(rows, DOCS)
    got = sharding.shard(docs, 900).collect()
    assert len(got) == len(rows)
    size = {}
    for r in got:
        size[r.shard] = size.get(r.shard, 0) + r.n_bytes
    assert all(v <= 900 for v in size.values()) and all(size[r.shard] == r.shard_bytes for r in got)
    for s in size:  # the parent bucket was too large
        assert not s or sum(v for k, v in size.items() if k.startswith(s[:-1])) > 900
    sharding.write_shards(docs, str(tmp_path / "out"), 900)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)


def test_one_key_cannot_split(spark):
    docs = spark.createDataFrame([(1, "x" * 100)] * 5 + [(2, "y")], DOCS)
    got = {r.doc_id: r.shard_bytes for r in sharding.shard(docs, 50).collect()}
    assert got == {1: 500, 2: 1}


def test_components_against_union_find(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=4, deadline=None)
    @given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
    def run(edges):
        got = {r.node: r.component for r in common.components(spark.createDataFrame(edges + [(50 + i, 51 + i) for i in range(12)], "a long, b long")).collect()}
        par = {}

        def find(x):
            while par.setdefault(x, x) != x:
                x = par[x]
            return x

        for a, b in edges + [(50 + i, 51 + i) for i in range(12)]:
            if a != b:
                a, b = find(a), find(b)
                par[max(a, b)] = min(a, b)
        assert got == {x: find(x) for x in par}

    run()


def test_few_edges_need_no_rounds(spark, monkeypatch):
    """Up to GATHERED edges one table is written; the rounds beyond give the same."""
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(-(1 << 62) + i, -(1 << 62) + i + 1) for i in range(40)] + [(5, 5), (None, 1)]
    frame = spark.createDataFrame(edges, "a long, b long")
    names = []
    monkeypatch.setattr(common, "written", lambda df, name, f=common.written: names.append(name) or f(df, name))
    few = sorted(map(tuple, common.components(frame).collect()))
    assert names == ["cc"] and common.components(frame.limit(0)).count() == 0
    monkeypatch.setattr(common, "GATHERED", 10)
    assert few == sorted(map(tuple, common.components(frame).collect())) and len(names) > 3
