import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiform.llm import jaccard, substring_dedup, words

DOCS = "doc_id long, text string"


def plain_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def brute_components(rows):
    sets = [set(zip(*[w[k:] for k in range(5)], strict=False)) if len(w) >= 5 else ({tuple(w)} if w else set()) for w in (plain_words(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in rows)]
    par = {i: i for i, _ in rows if i is not None}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for a, (i, _) in enumerate(rows):
        for b, (j, _) in enumerate(rows[:a]):
            n = len(sets[a] & sets[b])
            if i is not None and j is not None and n and 100 * n >= 75 * len(sets[a] | sets[b]):
                x, y = find(i), find(j)
                par[max(x, y)] = min(x, y)
    return sorted(((i, len(s), find(i) if i is not None else None) for (i, _), s in zip(rows, sets, strict=True)), key=str)


def corpus(seed, n, vocab=3000):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(vocab)}"
    base = [[word() for _ in range(r.choice([5, 30, 80, 200]))] for _ in range(n // 4)]
    shared = [word() for _ in range(60)]
    rows = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 1, 2, 4])):
            w[r.randrange(len(w))] = word()
        if r.random() < 0.2:
            w = w[: len(w) // 2] + shared + w[len(w) // 2 :]
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_all_pairs(spark, seed):
    rows = corpus(seed, 160) + [(1000, None), (1001, ""), (1002, " \n"), (1003, "Two Words"), (1004, "two  words"), (1005, "two words more"), (None, "two words")]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(map(tuple, got), key=str) == brute_components(rows)


def test_index_alone_finds_every_link(spark, monkeypatch):
    """Without the relations found ahead, and without an order by frequency, the index join still loses nothing."""
    monkeypatch.setattr(jaccard, "ALIKE", 99)
    monkeypatch.setattr(jaccard, "FREQUENT", 1)
    rows = corpus(3, 120)
    got = jaccard.jaccard_components(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(map(tuple, got), key=str) == brute_components(rows)


def test_lists_that_no_task_knew_to_be_long(spark, monkeypatch):
    """Shingles that are rare in every task and not in all go last once their lists turn out long; no link is lost by it, nor by salted comparisons."""
    monkeypatch.setattr(jaccard, "LONG_LIST", 6)
    monkeypatch.setattr(jaccard, "SALT", 2)
    made = []
    index = jaccard.prefix_index
    monkeypatch.setattr(jaccard, "prefix_index", lambda docs, frequent: made.append(len(frequent[0])) or index(docs, frequent))
    rows = corpus(4, 120)
    got = jaccard.jaccard_components(spark.createDataFrame(rows, DOCS).repartition(40)).collect()
    assert sorted(map(tuple, got), key=str) == brute_components(rows) and len(made) > 1 and made[1] > made[0]


@pytest.mark.parametrize("words_", [5, 8, 12, 40])
def test_small_sets_of_all_sizes(spark, monkeypatch, words_):
    """Sets whose sizes and first common places lie on every border of the index's blocks."""
    monkeypatch.setattr(jaccard, "ALIKE", 99)
    r = random.Random(words_)
    base = [f"w{i}" for i in range(words_ * 2)]
    rows = [(i, " ".join(base[r.randrange(3) : r.randrange(words_, 2 * words_)] + [f"x{r.randrange(9)}"] * r.randrange(2))) for i in range(90)]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(map(tuple, got), key=str) == brute_components(rows)


def test_pairs_are_salted_once(spark, monkeypatch):
    """The sets of one hub meet in several places, and its pairs are joined with their salts once."""
    names = []
    monkeypatch.setattr(jaccard, "SALT", 4)
    monkeypatch.setattr(jaccard, "written", lambda df, name, f=jaccard.written: names.append(name) or f(df, name))
    sets = spark.createDataFrame([(k, list(range(20 + (k > 0 and k % 3)))) for k in range(30)], "k long, s array<long>")
    pairs = spark.createDataFrame([(0, k) for k in range(1, 30)], "a long, b long")
    assert jaccard.linked(pairs, sets).count() == 29 and names == ["salted"]


def test_very_long_text_and_other_columns(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, long, "x"), (2, long.replace("w7 ", "v "), "x"), (3, long[: len(long) // 2], "x")]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, DOCS + ", k string").withColumn("component_id", F.col("k"))).collect()
    assert [(r.doc_id, r.n_shingles, r.component_id) for r in sorted(got)] == [(1, 59_996, 1), (2, 59_996, 1), (3, jaccard.shingles(next(words.word_hashes([rows[2][1].encode()]))[0]).size, 3)]


def test_link_at_exactly_three_quarters(spark):
    a = [f"a{i}" for i in range(11)]  # 7 shingles; six kept and one new of each gives 6 / 8
    rows = [(1, " ".join(a)), (2, " ".join([*a[:10], "z"])), (3, " ".join([*a[:9], "y", "z"]))]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(map(tuple, got), key=str) == brute_components(rows) == [(1, 7, 1), (2, 7, 1), (3, 7, 3)]


def test_repeated_ids_join_and_empty_table(spark):
    rows = [(1, "a b c d e f"), (1, "q r s t u v"), (2, "a b c d e f"), (3, "q r s t u v")]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.component_id for r in got} == {1} and len(got) == 4
    assert jaccard.jaccard_components(spark.createDataFrame([], DOCS)).count() == 0


def test_word_hashes_do_not_depend_on_place():
    texts = [b"", b"a bb  ccc", b"\tbb", b"x" * 3_000_000 + b" a", b"a " * 1_500_000, "é ü".encode()]
    got = [(list(h[:3]), len(h), [t[i:j] for i, j in zip(s[:3], e[:3], strict=True)]) for t, (h, s, e) in zip(texts, words.word_hashes(texts), strict=True)]
    assert [g[1] for g in got] == [0, 3, 1, 2, 1_500_000, 2]
    assert got[1][2] == [b"a", b"bb", b"ccc"] and got[1][0][1] == got[2][0][0] and got[1][0][0] == got[3][0][1] == got[4][0][2]


def brute_substrings(rows):
    first = {}
    for i, t in rows:
        w = plain_words(t)
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = plain_words(t)
        gone = set()
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k : k + 50])] < i:
                gone |= set(range(k, k + 50))
        left = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(left).encode()).hexdigest()))
    return sorted(out, key=str)


def passages(seed, n=60, vocab=400):
    r = random.Random(seed)
    word = lambda: f"v{r.randrange(vocab)}"
    pool = [[word() for _ in range(r.choice([49, 50, 51, 75, 120]))] for _ in range(6)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(r.randrange(4)):
            w += r.choice(pool) if r.random() < 0.6 else [word() for _ in range(r.randrange(80))]
        rows.append((i, " ".join(w).replace(" ", "\n", 3)))
    return rows


@pytest.mark.parametrize("seed", [4, 5])
def test_substrings_against_all_windows(spark, seed):
    rows = passages(seed) + [(100, None), (101, ""), (102, " "), (None, " ".join(f"v{i}" for i in range(60))), (103, "same " * 200), (104, "same " * 120)]
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, DOCS))
    assert sorted((tuple(r)[:4] for r in got.collect()), key=str) == brute_substrings(rows)


def test_several_shards_of_one_anchor(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 150)
    rows = passages(6)
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, DOCS), with_text=False)
    assert sorted(map(tuple, got.collect()), key=str) == brute_substrings(rows)


def test_contexts_of_a_hot_anchor_meet_by_their_windows(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT", 2)
    rows = passages(7)
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, DOCS), with_text=False)
    assert sorted(map(tuple, got.collect()), key=str) == brute_substrings(rows)


def test_near_copies_of_a_hot_anchor_are_not_cut_into_all_their_windows(spark, monkeypatch):
    """Near copies with an edit each part by longer grams: all rows made of them are far fewer than their windows, and no window is lost."""
    made = {}

    def counted(df, name, f=substring_dedup.written):
        out = f(df, name)
        made.setdefault(name, []).append(out)
        return out

    monkeypatch.setattr(substring_dedup, "HOT", 40)
    monkeypatch.setattr(substring_dedup, "written", counted)
    r = random.Random(11)
    base, rows = [f"b{i}" for i in range(160)], []
    for i in range(300):
        w = list(base)
        for _ in range(r.choice([1, 2, 5])):
            w[r.randrange(len(w))] = f"e{r.randrange(1000)}"
        rows.append((i, " ".join(w)))
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, DOCS), with_text=False)
    assert sorted(map(tuple, got.collect()), key=str) == brute_substrings(rows)
    around = made["contexts"][0]
    hot = around.join(around.groupBy("h").count().where("count > 40"), "h", "left_semi")
    windows = hot.agg(F.sum(F.size(F.split("context", " ")) - 49)).first()[0]
    assert windows > 5000
    assert sum(x.count() for name in ("cuts", "windows") for x in made.get(name, [])) < windows / 2


@pytest.mark.parametrize("gram", substring_dedup.LONGER)
def test_cuts_have_each_window_once(spark, gram):
    r = random.Random(gram)
    texts = [" ".join(f"v{r.randrange(v)}" for _ in range(n)) for v, n in ((1, 90), (2, 92), (500, 92), (500, 50))]
    contexts = spark.createDataFrame([(k, k, 9, t, k) for k, t in enumerate(texts)], "c1 long, c2 long, h long, context string, doc long")
    got, keys = {k: [] for k in range(len(texts))}, {}
    for x in sorted(substring_dedup.cut_rows(contexts, gram).collect(), key=lambda x: x["first"]):
        w = x.context.split(" ")
        assert len(got[x.c1]) == x["first"]
        for k in range(len(w) - 49):
            got[x.c1].append(w[k : k + 50])
            assert keys.setdefault(tuple(w[k : k + 50]), x.h) == x.h
    assert got == {k: [t.split(" ")[i : i + 50] for i in range(len(t.split(" ")) - 49)] for k, t in enumerate(texts)}


def test_windows_of_one_document_are_not_joined(spark):
    text = [" ".join(f"{k}w{i}" for i in range(70)) for k in range(3)]
    contexts = spark.createDataFrame([(1, 1, text[0], 5), (2, 2, "x " + text[0], 7), (3, 3, text[1], 6), (4, 4, text[2], 9)], "c1 long, c2 long, context string, doc long")
    rows = substring_dedup.window_rows(contexts)
    assert rows.count() == 21 * 4 + 1
    got = sorted(map(tuple, substring_dedup.earlier(rows).collect()))
    assert got == [(2, 2, i + 1, 5) for i in range(21)]


def test_broadcast_shards_of_a_reference(spark, monkeypatch):
    """The corpus as its own reference gives the same as the routed form; another reference loses its spans from every document."""
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 300)
    monkeypatch.setattr(substring_dedup, "ROUND_WORDS", 900)
    rows = passages(8) + [(100, None), (101, ""), (None, " ".join(f"v{i}" for i in range(60)))]
    docs = spark.createDataFrame(rows, DOCS).withColumn("starts", F.lit("x"))
    got = substring_dedup.without_reference(docs, docs, smaller=True).collect()
    assert sorted((tuple(r)[:4] for r in got), key=str) == brute_substrings(rows)
    r = random.Random(9)
    refs = [(i, " ".join(t for _, t in r.sample(rows[:60], 3))) for i in range(5)] + [(7, "too short"), (None, rows[3][1]), (8, None)]
    have = {tuple(w[k : k + 50]) for _, t in refs for w in [plain_words(t)] for k in range(len(w) - 49)}
    for row in substring_dedup.without_reference(docs, spark.createDataFrame(refs, DOCS)).collect():
        w = next(plain_words(t) for i, t in rows if i == row.doc_id)
        gone = {j for k in range(len(w) - 49) if tuple(w[k : k + 50]) in have for j in range(k, k + 50)}
        assert (row.n_words, row.n_removed, row.kept_text) == (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    assert substring_dedup.without_reference(docs.limit(0), docs).count() == 0
    assert {x.n_removed for x in substring_dedup.without_reference(docs, docs.limit(0)).collect()} == {0}


def test_long_repetitive_text(spark):
    rows = [(1, "again and " * 20_000), (2, "again and " * 30_000 + "end"), (3, "x")]
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, DOCS).withColumn("shared", F.lit(1)), with_text=False).collect()
    assert {r.doc_id: (r.n_words, r.n_removed) for r in got} == {1: (40_000, 0), 2: (60_001, 60_000), 3: (1, 0)}


def test_automaton_against_search():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=60, deadline=None)
    @given(st.lists(st.lists(st.integers(0, 2), max_size=14), min_size=1, max_size=4), st.lists(st.integers(0, 2), max_size=20), st.integers(1, 4))
    def run(refs, text, window):
        a = substring_dedup.SuffixAutomaton()
        for d, r in enumerate(refs):
            a.add(r, d)
        a.finish()
        want = [min((d for d, r in enumerate(refs) if any(r[j : j + window] == text[k : k + window] for j in range(len(r) - window + 1))), default=1 << 62) for k in range(len(text) - window + 1)]
        assert list(a.matches(text, window)) == want

    run()


def test_anchor_of_a_window_depends_on_its_words_alone():
    r = np.random.default_rng(1)
    w = words.mixed(r.integers(0, 50, 400).astype(np.uint64))
    g, lo, hi = substring_dedup.anchors(w)
    assert lo[0] == 0 and hi[-1] == len(w) - 50 and (lo[1:] == hi[:-1] + 1).all()
    for h, a, b in zip(g, lo, hi, strict=True):
        for k in (a, b):
            assert substring_dedup.anchors(w[k : k + 50])[0].tolist() == [h]
    assert Counter(map(len, substring_dedup.anchors(w[:49]))) == {0: 3}


def test_repeated_id_loses_by_its_own_words(spark):
    p, q = " ".join(f"p{i}" for i in range(50)), " ".join(f"q{i}" for i in range(50))
    rows = [(1, p), (2, p + " end"), (2, q)]
    got = {(r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {(50, 0), (51, 50)}
