import hashlib
import html
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiform.llm import bpe, html_text, media, mixing, quality
from lexiform.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
TEXTS = [(1, "Hello world, it's 12:30!\n\nTwo  spaces"), (2, None), (3, ""), (4, "é日本\u0000‍🙂"), (5, " " * 70_000 + "x"), (6, "a" * 2000 + " b\tc"), (7, "word, 7's " * 30_000), (7, "again"), (None, "no id")]


def test_bpe_round_trip(spark):
    ranks, pattern = bpe.public_ranks()
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("names", F.lit(1))
    got = bpe.encoded(docs, ranks, pattern, ids=True)
    enc, _ = bpe.encoder(ranks, pattern)
    want = {}
    for i, t in TEXTS:
        ids = enc.encode_ordinary(t or "")
        want[i, len(ids)] = (hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    rows = got.collect()
    assert {(r.doc_id, r.n_tokens): (r.ids_sha256, r.decoded_sha256) for r in rows} == want and rows[0].names == 1
    clash = bpe.encoded(docs.withColumn("N_TOKENS", F.lit("old")), ranks, pattern)
    assert clash.columns == ["doc_id", "names", "n_tokens", "ids_sha256", "decoded_sha256"] and {(r.doc_id, r.n_tokens) for r in clash.collect()} == set(want)
    assert bpe.encoded(docs.limit(0), ranks, pattern).count() == 0
    back = bpe.decoded(got.select("doc_id", "n_tokens", "ids"), ranks, pattern).collect()
    assert {hashlib.sha256(r.bytes).hexdigest() for r in back} == {w[1] for w in want.values()}
    raw = spark.createDataFrame([(1, [255 - 0]), (2, None)], "i int, ids array<int>")
    assert [len(r.bytes) if r.bytes is not None else None for r in bpe.decoded(raw, ranks, pattern).orderBy("i").collect()] == [len(enc.decode_bytes([255])), None]


def test_safe_parts_do_not_change_ids():
    ranks, pattern = bpe.public_ranks()
    enc, _ = bpe.encoder(ranks, pattern)
    r = random.Random(7)
    for _ in range(150):
        t = "".join(r.choice(["a", "'s", " ", "\x1c", "\x1f", "  ", "\n", "7", "é", ".", "\t", "word", " ", "　", "'ll"]) for _ in range(60))
        assert bpe.encode(t, enc, 5) == enc.encode_ordinary(t)
        assert "".join(bpe.safe_parts(t, 5)) == t


def test_quality_on_held_out_rows(spark):
    got = QUERIES["op7_quality_classifier"](spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    assert len(got) == 1000 and got.score.between(0, 1).all()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    m = got.merge(labels, on="doc_id")
    m = m[m.held_out]
    assert (m.predicted == m.quality).mean() > 0.93
    model = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "a")], "doc_id long, text string")
    assert all(abs(r.score - labels.quality.mean()) < 0.1 for r in quality.scored(odd, model).collect())


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([*TEXTS, *[(100 + i, f"good text number {i} about ordinary things") for i in range(40)], *[(200 + i, f"###$$$ %%%{i}&&& !!!") for i in range(40)]], "doc_id long, text string").withColumn("quality", F.lit("x"))
    labels = spark.createDataFrame([(100 + i, 1, 0) for i in range(40)] + [(200 + i, 0, 0) for i in range(40)] + [(None, 1, 0), (3, None, 0), (100, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    got = quality.scored(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.quality == "x" for r in got)
    again = {(r.doc_id, r.text): r.score for r in quality.scored(docs.repartition(7), model).collect()}
    assert again == {(r.doc_id, r.text): r.score for r in got}
    nothing = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.scored(docs, nothing).collect()} == {0.5}
    clash = quality.scored(docs.withColumn("score", F.lit("old")), nothing)
    assert clash.columns == ["doc_id", "text", "quality", "score", "predicted"] and clash.first().score == 0.5
    assert quality.scored(docs.limit(0), model).count() == 0


def article(page):
    a = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    found = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", x)))).strip() for x in re.split(r"</?(?:p|h1)>", a)]
    return "\n".join(x for x in found if x)


def test_html_of_the_pages(spark):
    got = {r.page_id: r for r in QUERIES["op8_html_extraction"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        assert got[r.page_id].text == article(r.html) and got[r.page_id].n_chars == len(got[r.page_id].text)


LONG = "It is the story of a man who went to the sea and of what he saw there, for he had been at home in the hills for all of his life until then. "
PAGES = [
    ("", ""), ("plain words", "plain words"), ("<p>a&amp;b &lt;c&gt; &eacute;&#233;", "a&b <c> éé"), ("<script>x<p>y</script><style>z</style>", ""),
    (f"<nav>Home</nav><p>{LONG}</p><p>Short.</p><p>{LONG}</p><footer>Legal</footer>", f"{LONG.strip()}\nShort.\n{LONG.strip()}"),
    (f"<article><h2>Title</h2><p>{LONG}<aside>Buy now</aside><p>End.</article><div class='comments'><p>{LONG}</div>", f"Title\n{LONG.strip()}\nEnd."),
    (f"<div class=cookie-notice>We use</div><div><p>{LONG}<br>next</div><ul><li><a href=x>One</a><li><a href=y>Two</a></ul>", f"{LONG.strip()} next"),
    (f"<form><p>{LONG}</form><!-- <p>no --><p>{LONG}<unknown>tail</unknown>", f"{LONG}tail"),
]


@pytest.mark.parametrize(("page", "want"), PAGES)
def test_html_rules(page, want):
    assert html_text.main_text(page) == want


@pytest.mark.parametrize("around", ['<ol class="comment-list"><li><article><p>{0}</p></article></li></ol>', "<aside><article><h3>More</h3><p>{0}</p></article></aside>"])
def test_html_articles_in_surroundings(around):
    body = "The body of the page is in a plain div and it is as long as the text of an article that the reader came for on this page of the site. " * 2
    other = "This is what one of the readers has to say of it and it is as long as the body is, so that it can not be told by its length or words. " * 2
    page = f"<html><body><div><p>{body}</p></div>{around.format(other)}</body></html>"
    assert html_text.main_text(page) == body.strip()


@pytest.mark.parametrize("tag", ["noscript", "button", "select", "object", "svg", "audio", "video", "iframe", "canvas"])
def test_html_unclosed_dropped_elements(tag):
    for page in (f"<{tag}>Menu<article><p>{LONG}</p></article>", f"<body><span><{tag}>Menu</span><article><p>{LONG}</p></article></body>", f"<{tag}><script>'<p>'</script>Menu<article><p>{LONG}</p></article><p>"):
        assert html_text.main_text(page) == LONG.strip()
    assert html_text.main_text(f"<p>{LONG}</p><{tag}>Menu</{tag}>") == LONG.strip()


def test_html_unclosed_elements_before_closed_ones():
    assert html_text.main_text(f"<button>Menu<article><p>{LONG}</p></article><button>Up</button>") == LONG.strip()
    assert html_text.main_text(f"<p>{LONG}</p><script>a<p>b") == LONG.strip()
    assert html_text.main_text(f"<noscript><p>{LONG}</p></noscript><p>{LONG}</p>") == LONG.strip()


def test_html_without_the_article_element(spark):
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        assert html_text.main_text(re.sub(r"<(/?)article\b", r"<\1div", r.html)) == article(r.html)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<p title=Bob's>{LONG}<p>{LONG}it's", f"{LONG.strip()}\n{LONG}it's"),
        (f"<article><form><p>{LONG}</form></article>", LONG.strip()),
        (f"<form><p>Your name</form><p>{LONG}", LONG.strip()),
        (f"<div><p>{LONG}<p>{LONG}</div><article class=teaser><p>{LONG}</article>", f"{LONG.strip()}\n{LONG.strip()}"),
        (f"<title>Title</title><p>{LONG}", LONG.strip()),
        (f"<article><header><h1>Title</h1></header><p>{LONG}</article>", LONG.strip()),
        (f"<nav>Home</nav><div><h1>Title</h1><p>{LONG}<p>And.</div><footer>Legal</footer>", f"Title\n{LONG.strip()}\nAnd."),
        (f"<article><p>{LONG}<p>{LONG}<p>And.</article><div><p>{LONG}</div>", f"{LONG.strip()}\n{LONG.strip()}\nAnd."),
        ("<nav>Home</nav><p>short<footer>Legal</footer>", "short"),
        (f"<p>{LONG * 3000}</p>", (LONG * 3000).strip()),
    ],
)
def test_html_faults(page, want):
    assert html_text.main_text(page) == want


@pytest.mark.parametrize("page", ["<div>" * 20_000 + "</p>" * 20_000, "<p><div>" + "<b>" * 20_000 + "<p></p>" * 20_000, "<button>x" * 20_000, "<a href='" * 20_000, "<button><b>" * 20_000 + "</button>"])
def test_html_time_grows_with_length(page):
    began = time.perf_counter()
    html_text.main_text(page)
    assert time.perf_counter() - began < 5


def test_html_odd_rows(spark):
    rows = spark.createDataFrame([(1, None), (2, "<p>" * 3000 + "x"), (3, "<" * 1000), (4, "<a href='" + "x" * 50_000), (None, "<p>y")], "page_id long, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extracted(rows).collect()}
    assert html_text.extracted(rows.limit(0)).count() == 0 and html_text.extracted(rows.union(rows)).count() == 10
    assert got[1] == ("", 0) and got[2] == ("x", 1) and got[None] == ("y", 1) and len(got) == 5
    clash = html_text.extracted(rows.withColumn("text", F.lit(1)).withColumn("__x0", F.lit(2)))
    assert clash.columns == ["page_id", "__x0", "text", "n_chars"] and {r.text for r in clash.collect()} == {t for t, _ in got.values()}


def test_media_round_trip(spark):
    docs = spark.createDataFrame(TEXTS, "name long, text string")
    from lexiform.llm.common import new_path

    folder = new_path(spark, "media")
    media.write_archives(docs.repartition(3), folder)
    spark.dataSource.register(media.MediaArchives)
    rows = spark.read.format("media_archives").option("rangeBytes", 500).load(folder)
    got = media.described(rows).collect()
    assert sorted((r.name, r.n_bytes) for r in got if r.name) == sorted((str(i), len((t or "").encode())) for i, t in TEXTS if i)
    by = {(r.name, r.n_bytes): r for r in got}
    for i, t in TEXTS:
        data = (t or "").encode()
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        r = by[None if i is None else str(i), len(data)]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])) and r.error is None
    empty = new_path(spark, "media")
    media.write_archives(docs.limit(0), empty)
    assert spark.read.format("media_archives").load(empty).count() == 0


def test_a_bad_member_does_not_hurt_the_others(spark, tmp_path):
    media.write_archives(spark.createDataFrame([(i, f"text {i}" * 50) for i in range(6)], "name long, text string").coalesce(1), f"file://{tmp_path}/m")
    archive = next((tmp_path / "m").glob("*.zip"))
    data = bytearray(archive.read_bytes())
    at = data.find(b"IDAT", len(data) // 3)
    data[at + 6] ^= 255
    archive.write_bytes(bytes(data))
    spark.dataSource.register(media.MediaArchives)
    got = media.described(spark.read.format("media_archives").load(f"file://{tmp_path}/m")).collect()
    assert sum(r.error is not None for r in got) == 1 and len(got) == 6


def test_members_are_read_again(tmp_path):
    class Broken:
        def read_at(self, n, at):
            raise OSError("gone")

    from pyarrow import fs

    (tmp_path / "a.zip").write_bytes(b"")
    import zipfile

    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("0/1", b"abc")
    files = fs.LocalFileSystem()
    with files.open_input_file(str(tmp_path / "b.zip")) as f:
        ((name, offset, size, crc),) = media.members(f, (tmp_path / "b.zip").stat().st_size)
    assert media.read_member(files, str(tmp_path / "b.zip"), Broken(), offset, size, crc) == (b"abc", None)
    assert media.read_member(files, str(tmp_path / "a.zip"), Broken(), offset, size, crc)[0] is None
    assert name == "0/1"


def tokens_by_domain(rows, rate=1.0):
    p = rows[["p_clean", "p_toxic", "p_low"]].to_numpy()
    return (p * (rows.n_tokens * rate).to_numpy()[:, None]).sum(0)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
@pytest.mark.parametrize("weights", [mixing.WEIGHTS, (0.6, 0.1, 0.3)])
def test_mixing_reaches_the_targets(spark, sf, weights):
    docs, labels = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"), spark.read.parquet(f"/root/testdata/{sf}/labels.parquet")
    got = mixing.mixed_rates(docs, labels, ["doc_id"], weights).toPandas()
    assert len(got) == docs.count() and got.rate.between(0, 1).all()
    assert np.allclose(got[["p_clean", "p_toxic", "p_low"]].to_numpy().sum(1), 1)
    expected, reached = tokens_by_domain(got), tokens_by_domain(got, got.rate)
    want = mixing.targets(expected, weights)
    # the asked proportions, but for what thinning one domain takes of another
    assert np.abs(reached / reached.sum() - want / want.sum()).max() < 0.01 and got.off.iloc[0] < 0.005
    assert reached[0] > 0.9 * expected[0]
    left = mixing.mixed(docs, labels, weights).select("doc_id", F.lit(1).alias("n")).toPandas()
    assert left.doc_id.is_unique
    drawn = tokens_by_domain(got[got.doc_id.isin(left.doc_id)])
    assert np.abs(drawn - reached).max() < 0.01 * reached.sum()
    assert abs(len(left) - got.rate.sum()) < 5 * np.sqrt((got.rate * (1 - got.rate)).sum()) + 0.01 * len(got) + 5


def test_posteriors_against_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = mixing.mixed_rates(docs, labels, ["doc_id"]).join(labels, "doc_id").where(quality.held_out(F.col("doc_id"))).toPandas()
    y = np.where(got.toxic == 1, 1, np.where(got.quality == 0, 2, 0))
    p = got[["p_clean", "p_toxic", "p_low"]].to_numpy()
    assert (p.argmax(1) == y).mean() > 0.9
    assert np.abs(p.mean(0) - np.bincount(y, minlength=3) / len(y)).max() < 0.03  # about two standard errors of the held-out shares


def test_rates_against_numpy(spark):
    r = np.random.default_rng(3)
    p = np.round(r.dirichlet([1, 1, 1], 80) * 256) / 256
    p[:, 0] = 1 - p[:, 1] - p[:, 2]
    n = r.integers(0, 500, 80)
    rows = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p, strict=True)], "n_tokens long, p array<double>")
    fit = mixing.fit_rates(rows, (0.6, 0.1, 0.3))
    rate = np.ones(80)
    for m in fit.moves:
        rate = np.clip(rate - p @ np.array(m), 0, 1)
    assert np.allclose((rate * n) @ p, fit.reached, rtol=1e-6) and fit.off < 0.01
    got = [x.r for x in rows.select(mixing.rate(F.col("p"), fit.moves).alias("r")).collect()]
    assert np.allclose(got, rate)
    # no rates in [0, 1] come closer to the targets: projected gradient in plain numpy from a random start
    other, step = r.random(80), 0.5 / (np.linalg.norm(p.T * np.sqrt(n)) ** 2)
    for _ in range(20_000):
        other = np.clip(other - step * p @ ((other * n) @ p - np.array(fit.target)), 0, 1)
    assert np.abs((other * n) @ p - np.array(fit.target)).max() > np.abs(np.array(fit.reached) - np.array(fit.target)).max() - 0.005 * sum(fit.target)


def test_rates_that_thinning_cannot_reach(spark):
    rows = lambda ps: spark.createDataFrame([(100 + i, [x / 256 for x in p]) for i, p in enumerate(ps)], "n_tokens long, p array<double>")
    alike = mixing.fit_rates(rows([(86, 85, 85)] * 9), mixing.WEIGHTS)
    assert alike.moves == [] and alike.reached == alike.expected
    # no row is as clean as the targets ask: scaling them down would only empty the corpus
    far = mixing.fit_rates(rows([(150 - i, 60, 46 + i) for i in range(40)]), mixing.WEIGHTS)
    assert far.target == far.wanted and far.reached[0] > 0.2 * far.expected[0] and far.off > mixing.LOST


def test_mixing_odd_rows(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("n", F.lit(1))
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0), (7, 0, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    assert mixing.mixed_rates(docs, labels, ["doc_id", "n"]).count() == len(TEXTS)
    assert mixing.mixed_rates(docs, labels.limit(0), ["doc_id"]).count() == len(TEXTS)
    assert mixing.mixed_rates(docs.limit(0), labels, ["doc_id"]).count() == 0
    assert mixing.mixed(docs.limit(0), labels).count() == 0 and mixing.mixed(docs.withColumn("rate", F.lit(1)), labels.limit(0)).count() == len(TEXTS)
    twice = mixing.mixed(docs.union(docs), labels).groupBy("doc_id", "text").count()
    assert twice.where("`count` <> 2").count() == 0
    clash = docs.withColumns({c: F.lit("old") for c in ("rate", "p", "n_tokens", "off", "p_clean")})
    got = mixing.mixed_rates(clash, labels, ["doc_id", "text", "rate", "p", "off"])
    assert got.columns == ["doc_id", "text", "p", "n_tokens", "p_clean", "p_toxic", "p_low", "rate", "off"] and got.first().p == "old" and got.first().rate <= 1
    assert mixing.mixed(clash, labels).columns == clash.columns
