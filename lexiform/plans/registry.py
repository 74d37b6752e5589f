"""The registered queries of the engine over the driver's tables, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiform import api
from lexiform.functions import similarity as S
from lexiform.functions import text as T
from lexiform.operators import decide, evaluate, grammar, index, merge, rehydrate, retrieve, route, score
from lexiform.sources import stores
from lexiform.streaming import refresh

QUERIES: dict = {}
ORACLE_SQL: dict = {}
FLAGSHIP = "prefilter_topk"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def parts(spark: SparkSession, d: str) -> DataFrame:
    """Candidates: part names; the brand is the area, the type the intent."""
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("cid"), F.col("p_name").alias("text"), F.col("p_type").alias("intent"), F.create_map(F.lit("name"), F.split_part("p_name", F.lit(" "), F.lit(2))).alias("slots"), F.col("p_name").alias("literal_text"))
    return index.candidates(rows)


def spoken(spark: SparkSession, d: str, typo: bool = False) -> DataFrame:
    """Queries: each distinct part name once, with a word more or one letter less."""
    text = F.concat(F.substring("p_name", 1, 2), F.expr("substr(p_name, 4)")) if typo else F.concat(F.lit("the "), F.col("p_name"))
    rows = table(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("qid")).select("qid", text.alias("text"))
    return api.prepared_queries(rows)


def worded(df: DataFrame, key: str, alias: str) -> DataFrame:
    return df.select(F.col(key).alias(alias), F.expr(r"regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+', 0)").alias("tokens"))


C = """c AS (SELECT p_partkey AS cid, lower(p_name) AS norm, string_split(lower(p_name), ' ') AS tokens, p_type AS intent FROM part)"""
QT = """q AS (SELECT min(p_partkey) AS qid, 'the ' || lower(p_name) AS norm, ['the'] || string_split(lower(p_name), ' ') AS tokens FROM part GROUP BY p_name)"""
QY = """q AS (SELECT min(p_partkey) AS qid, substr(lower(p_name), 1, 2) || substr(lower(p_name), 4) AS norm FROM part GROUP BY p_name)"""
GRAMS = "list_distinct(list_transform(range(1, greatest(1, len(replace({t}, ' ', '')) - 2) + 1), lambda i: substr(replace({t}, ' ', ''), i::INT, 3)))"
TF = """tf AS (SELECT cid, term, len, count(*) AS tf FROM (SELECT cid, len(tokens) AS len, unnest(tokens) AS term FROM c) GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM c), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT tf.term, cid, ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.5 * tf / (tf + 1.5 * (0.25 + 0.75 * len / avgdl)) AS w FROM tf JOIN df USING (term), st)"""
RAW = """raw AS (SELECT qid, cid, sum(w) AS raw FROM (SELECT DISTINCT qid, unnest(tokens) AS term FROM q) JOIN w USING (term) GROUP BY ALL)"""
CG = f"cg AS (SELECT cid, unnest(g) AS gram, len(g) AS n FROM (SELECT cid, {GRAMS.format(t='norm')} AS g FROM c))"
QG = f"qg AS (SELECT qid, unnest(g) AS gram, len(g) AS n FROM (SELECT qid, {GRAMS.format(t='norm')} AS g FROM q))"
OV = "ov AS (SELECT qid, cid, qg.n AS n_query, cg.n AS n_grams, count(*) AS common FROM qg JOIN cg USING (gram) GROUP BY ALL)"
PRE = f"""WITH {C}, {QT}, {TF}, {RAW}, {CG}, {QG}, {OV},
b AS (SELECT qid, cid, raw / max(raw) OVER (PARTITION BY qid) AS bm25 FROM raw),
j AS (SELECT qid, cid, common / (n_query + n_grams - common) AS char FROM ov),
p AS (SELECT qid, cid, coalesce(bm25, 0) AS bm25, coalesce(char, 0) AS char FROM b FULL JOIN j USING (qid, cid)),
k AS (SELECT *, round(0.32 * char + 0.2 * bm25, 12) AS key FROM p)"""


# --- text -----------------------------------------------------------------


@query("""SELECT o_orderkey, trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', ' ', 'g')) || ' key ' || o_orderkey || ' at 12:30 for -' || (o_orderkey % 90) || '.5 %' AS norm FROM orders""")
def normalize_ascii(spark, d):
    text = F.concat("o_orderpriority", F.lit("!! KEY "), "o_orderkey", F.lit(", at (12:30) for -"), F.col("o_orderkey") % 90, F.lit(".5 %"))
    return table(spark, d, "orders").select("o_orderkey", T.normalize(text).alias("norm"))


@query("""SELECT conv_id, turn, md5(strip_accents(replace(replace(replace(replace(replace(replace(replace(replace(replace(lower(text), 'đ', 'd'), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'), 'ø', 'o'), 'ł', 'l'), 'ı', 'i'), 'ð', 'd'), 'þ', 'th'))) AS plain,
md5(strip_accents(replace(replace(replace(replace(lower(text), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'))) AS german FROM conversations""")
def fold_latin(spark, d):
    """Every text without diacritics, by the general rules and by the German ones."""
    low = F.lower("text")
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(T.fold(low).cast("binary")).alias("plain"), F.md5(T.fold(low, "de").cast("binary")).alias("german"))


@query("SELECT c_custkey, unnest(['customer', substr(c_name, 10)]) AS token, unnest([0, 1]) AS pos FROM customer")
def tokenize(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.posexplode(T.tokens(T.normalize(F.col("c_name")))).alias("pos", "token"))


@query(f"WITH {C} SELECT cid, unnest({GRAMS.format(t='norm')}) AS gram FROM c")
def char_ngrams(spark, d):
    return parts(spark, d).select("cid", F.explode("grams").alias("gram"))


@query("SELECT o_orderkey, round(o_totalprice, 6) AS a, (o_orderkey % 50)::DOUBLE AS b, NULL::DOUBLE AS c FROM orders")
def parse_number(spark, d):
    o = table(spark, d, "orders")
    a = T.parse_float(F.replace(F.format_string("%.2f", "o_totalprice"), F.lit("."), F.lit(",")))
    return o.select("o_orderkey", F.round(a, 6).alias("a"), T.parse_float(F.concat((F.col("o_orderkey") % 50).cast("string"), F.lit(" %"))).alias("b"), T.parse_float(F.lit("none")).alias("c"))


@query("SELECT l_orderkey, l_linenumber, l_quantity % 5 = 0 AS fives, round(l_extendedprice * 100) % 50 = 0 AS halves FROM lineitem")
def range_grid(spark, d):
    rows = table(spark, d, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", T.on_grid(F.col("l_quantity"), F.lit(0.0), F.lit(5.0)).alias("fives"), T.on_grid(F.round(F.col("l_extendedprice") * 100), F.lit(0.0), F.lit(50.0)).alias("halves"))


@query(r"""WITH b AS (SELECT DISTINCT item_id, trim(regexp_replace(unnest(string_split(lower(text), chr(10))), '\s+', ' ', 'g')) AS phrase FROM benchmark), d AS (SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS t FROM documents)
SELECT DISTINCT item_id, doc_id, phrase FROM d JOIN b ON contains(' ' || t || ' ', ' ' || phrase || ' ') WHERE len(string_split(phrase, ' ')) >= 3""")
def phrase_in_text(spark, d):
    """Every line of three words and more of an item that a document has at word borders; a line's first three words nominate documents, the whole line decides."""
    even = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    three = lambda w, i: F.concat_ws(" ", w[i], w[i + 1], w[i + 2])
    lines = table(spark, d, "benchmark").select("item_id", F.explode(F.split("text", "\n")).alias("line")).select("item_id", even("line").alias("phrase")).distinct()
    lines = lines.withColumn("w", F.split("phrase", " ")).where(F.size("w") >= 3).select("item_id", "phrase", three(F.col("w"), 0).alias("head"))
    docs = table(spark, d, "documents").select("doc_id", even("text").alias("t")).withColumn("w", F.split("t", " "))
    heads = docs.select("doc_id", "t", F.explode(F.array_distinct(F.when(F.size("w") >= 3, F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: three(F.col("w"), i))).otherwise(F.array().cast("array<string>")))).alias("head"))
    return heads.join(lines, "head").where(T.has_phrase(F.col("t"), F.col("phrase"))).select("item_id", "doc_id", "phrase").distinct()


@query("SELECT DISTINCT t AS token, unnest(list_distinct(list_transform(range(1, len(t) + 1), lambda i: substr(t, 1, (i - 1)::INT) || substr(t, (i + 1)::INT)))) AS deletion FROM (SELECT unnest(string_split(p_name, ' ')) AS t FROM part)")
def deletions(spark, d):
    words = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("token")).distinct()
    return words.select("token", F.explode(T.deletions(F.col("token"))).alias("deletion"))


@query("SELECT DISTINCT p_name, unnest(list_distinct([replace('the ' || split_part(p_name, ' ', 1), ' ', ''), replace(p_name, ' ', ''), 'the' || replace(p_name, ' ', '')])) AS span FROM part")
def compound_spans(spark, d):
    words = F.concat(F.array(F.lit("the")), F.split("p_name", " "))
    return table(spark, d, "part").select("p_name").distinct().select("p_name", F.explode(T.compound_spans(words)).alias("span"))


@query("SELECT DISTINCT p_name, CASE WHEN len(replace(p_name, ' ', '')) >= 4 THEN replace(p_name, ' ', '') ELSE '' END AS compact, p_name || '!' AS cleaned, len(string_split(p_name, ' '))::INT AS words FROM part")
def compact_and_clean(spark, d):
    rows = table(spark, d, "part").select("p_name").distinct()
    messy = F.concat(F.lit("  "), F.replace("p_name", F.lit(" "), F.lit(" \n ")), F.lit("! "))
    return rows.select("p_name", T.compact_key(F.col("p_name")).alias("compact"), T.clean_expanded(messy).alias("cleaned"), T.length_key(F.col("p_name"))["words"].alias("words"))


@query("SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k FROM events")
def json_metadata(spark, d):
    return table(spark, d, "events").select("event_id", F.element_at(T.json_map(F.col("props")), "k").cast("long").alias("k"))


@query(r"""SELECT n_nationkey, replace(lower(n_name), '_', '-') AS code, regexp_replace(['...', '  ', '(!', '$ ^ '][n_nationkey % 4 + 1] || ['', 'a.', '42', '('][n_nationkey % 3 + 1] || n_name, '^[\s\p{P}$+<=>^`|~]+', '') AS bare FROM nation""")
def language_and_punctuation(spark, d):
    pick = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (F.col("n_nationkey") % n + 1).cast("int"))
    text = F.concat(pick(("...", "  ", "(!", "$ ^ "), 4), pick(("", "a.", "42", "("), 3), F.col("n_name"))
    return table(spark, d, "nation").select("n_nationkey", T.language_code(F.concat(F.lit(" "), "n_name", F.lit(" "))).alias("code"), T.strip_leading_punctuation(text).alias("bare"))


# --- index ----------------------------------------------------------------


@query(r"""WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+')) AS term FROM documents), n AS (SELECT count(*) AS n FROM documents)
SELECT term, count(*) AS df, round(ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM t, n GROUP BY term""")
def term_stats(spark, d):
    return index.term_stats(worded(table(spark, d, "documents"), "doc_id", "cid")).select("term", "df", F.round("idf", 6).alias("idf"))


DOCS = r"c AS (SELECT doc_id AS cid, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS tokens FROM documents)"


@query(f"WITH {C}, {TF} SELECT term, cid, round(w, 6) AS w FROM w")
def postings(spark, d):
    return index.postings(parts(spark, d)).select("term", "cid", F.round("w", 6).alias("w"))


@query(rf"""WITH {DOCS}, q AS (SELECT item_id AS qid, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS tokens FROM benchmark), {TF}, {RAW}
SELECT qid, cid, round(raw / max(raw) OVER (PARTITION BY qid), 6) AS bm25 FROM raw""")
def bm25_sparse(spark, d):
    docs, q = worded(table(spark, d, "documents"), "doc_id", "cid"), worded(table(spark, d, "benchmark"), "item_id", "qid")
    return retrieve.bm25_sparse(q, index.postings(docs)).select("qid", "cid", F.round("bm25", 6).alias("bm25"))


@query(f"WITH {C}, {QT}, {TF}, {RAW} SELECT q.qid, c.cid, coalesce(round(raw / max(raw) OVER (PARTITION BY q.qid), 6), 0) AS bm25 FROM q CROSS JOIN c LEFT JOIN raw USING (qid, cid)")
def bm25_dense(spark, d):
    docs = parts(spark, d)
    return retrieve.bm25_dense(spoken(spark, d), docs, index.postings(docs)).select("qid", "cid", F.round("bm25", 6).alias("bm25"))


FOREIGN = f"""WITH {C}, {QT}, {TF}, {RAW},
o AS (SELECT s_suppkey AS sid, ['the', 'bolt', lower(s_name)] AS tokens FROM supplier), ot AS (SELECT sid, len(tokens) AS len, unnest(tokens) AS term FROM o),
f AS (SELECT qid, sid, sum(coalesce(ln(1 + (n - df + 0.5) / (df + 0.5)), ln(1 + (n + 0.5) / 0.5)) * 2.5 * 1 / (1 + 1.5 * (0.25 + 0.75 * len / avgdl))) AS raw
      FROM (SELECT DISTINCT qid, unnest(tokens) AS term FROM q) JOIN ot USING (term) LEFT JOIN df USING (term), st GROUP BY ALL)"""


def foreign(spark, d):
    others = table(spark, d, "supplier").select(F.col("s_suppkey").alias("sid"), F.array(F.lit("the"), F.lit("bolt"), F.lower("s_name")).alias("tokens"))
    return retrieve.bm25_foreign(spoken(spark, d), others, parts(spark, d), "sid")


@query(f"{FOREIGN} SELECT qid, sid, round(raw, 6) AS raw FROM f")
def bm25_foreign(spark, d):
    return foreign(spark, d).select("qid", "sid", F.round("raw", 6).alias("raw"))


@query(f"{FOREIGN}, t AS (SELECT qid, max(raw) AS top FROM raw GROUP BY qid) SELECT qid, sid, round(raw / greatest(max(raw) OVER (PARTITION BY qid), coalesce(top, 0)), 6) AS bm25 FROM f LEFT JOIN t USING (qid)")
def bm25_rescaled(spark, d):
    docs = parts(spark, d)
    return retrieve.rescaled(foreign(spark, d), retrieve.bm25_raw(spoken(spark, d), index.postings(docs)), "sid").select("qid", "sid", F.round("bm25", 6).alias("bm25"))


@query(f"WITH {C}, {QT}, {CG}, {QG}, {OV} SELECT * FROM ov")
def ngram_intersections(spark, d):
    return retrieve.ngram_overlaps(spoken(spark, d), index.gram_postings(parts(spark, d)))


@query(f"WITH {C}, {QT}, {CG}, {QG}, {OV} SELECT qid, cid, round(common / (n_query + n_grams - common), 6) AS char FROM ov")
def ngram_jaccard(spark, d):
    return retrieve.ngram_jaccard(spoken(spark, d), index.gram_postings(parts(spark, d))).select("qid", "cid", F.round("char", 6).alias("char"))


def registry(spark, d):
    """Entities are parts (brand as domain), areas nations, floors regions."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.col("p_type").alias("domain"), F.array().cast("array<string>").alias("aliases"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name"), F.array(F.replace("n_name", F.lit("_"), F.lit(" "))).alias("aliases"))
    r = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("key"), F.col("r_name").alias("name"), F.array().cast("array<string>").alias("aliases"))
    return stores.registry(p, n, r)


REG = """e AS (SELECT p_partkey * 1000 AS position, p_name AS text, unnest(['name', 'entity', 'entity_name', 'name:' || p_type, 'entity:' || p_type, 'entity_name:' || p_type]) AS slot FROM part
UNION ALL SELECT n_nationkey * 1000 + p, t, unnest(['area', 'area_name']) FROM (SELECT n_nationkey, unnest([replace(n_name, '_', ' '), n_name]) AS t, unnest([0, 1]) AS p FROM nation)
UNION ALL SELECT r_regionkey * 1000, r_name, unnest(['floor', 'floor_name']) FROM region),
r AS (SELECT slot, text, min(position) AS position, replace(any_value(lower(text)), '_', '_') AS norm FROM e GROUP BY slot, text)"""


@query(f"WITH {REG} SELECT slot, text, position, norm FROM r")
def registry_records(spark, d):
    return registry(spark, d).select("slot", "text", "position", "norm")


@query(f"WITH {REG} SELECT slot, position, unnest(list_distinct(string_split(norm, ' ') || CASE WHEN len(replace(norm, ' ', '')) >= 4 THEN [replace(norm, ' ', '')] ELSE []::VARCHAR[] END)) AS key FROM r")
def inverted_index(spark, d):
    return index.registry_postings(registry(spark, d))


@query("WITH p AS (SELECT DISTINCT p_type AS slot, p_name AS value FROM part) SELECT * FROM p UNION ALL SELECT slot, value FROM (VALUES ('PROMO', 'x'), ('OTHER', 'y'), ('OTHER', 'z')) f(slot, value) WHERE slot NOT IN (SELECT slot FROM p)")
def merged_slot_values(spark, d):
    """The values of each slot: those of the parts where they have any, else the fallback's."""
    p = table(spark, d, "part").groupBy(F.col("p_type").alias("slot")).agg(F.collect_set("p_name").alias("values"))
    f = spark.createDataFrame([("PROMO", ["x"]), ("OTHER", ["y", "z"])], "slot string, values array<string>")
    return stores.merge_slot_values(p, f).select("slot", F.explode("values").alias("value"))


# --- match ----------------------------------------------------------------


@query(f"WITH {C}, x AS (SELECT min(p_partkey) AS qid, lower(p_name) AS norm FROM part GROUP BY p_name) SELECT qid, cid, row_number() OVER (PARTITION BY qid ORDER BY cid)::INT AS rank FROM x JOIN c USING (norm) QUALIFY rank <= 20")
def exact_match(spark, d):
    q = table(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("qid")).select("qid", F.concat("p_name", F.lit("!")).alias("text"))
    return retrieve.exact(api.prepared_queries(q), parts(spark, d))


@query("SELECT any_value(qid) AS qid, cid FROM (SELECT p_partkey AS cid, min(p_partkey) OVER (PARTITION BY p_name) AS qid, p_name FROM part) JOIN (SELECT p_name FROM part GROUP BY p_name HAVING count(DISTINCT p_type) = 1) USING (p_name) GROUP BY cid")
def exact_folded_unambiguous(spark, d):
    q = table(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("qid")).select("qid", F.replace("p_name", F.lit("o"), F.lit("ø")).alias("text"))
    return retrieve.exact_folded(api.prepared_queries(q), parts(spark, d))


EDIT = """CASE WHEN substr(a, 1, 1) <> substr(b, 1, 1) OR least(len(a), len(b)) < 4 OR a = b THEN FALSE
WHEN {prefix} THEN TRUE WHEN len(a) = len(b) THEN damerau_levenshtein(a, b) = 1 WHEN abs(len(a) - len(b)) = 1 THEN levenshtein(a, b) = 1 ELSE FALSE END"""


@query(f"""WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS t FROM part), x AS (SELECT t AS a, substr(t, 1, 2) || substr(t, 4) AS b FROM w UNION SELECT t, substr(t, 1, 1) || substr(t, 3, 1) || substr(t, 2, 1) || substr(t, 4) FROM w UNION SELECT t, substr(t, 1, 4) FROM w),
p AS (SELECT DISTINCT x.a, y.b FROM x CROSS JOIN x y) SELECT a, b, {EDIT.format(prefix="len(b) < len(a) AND starts_with(a, b)")} AS slot, {EDIT.format(prefix="FALSE")} AS registry FROM p""")
def bounded_token_match(spark, d):
    w = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("t")).distinct()
    forms = w.select(F.col("t").alias("a"), F.explode(F.array(F.concat(F.substring("t", 1, 2), F.expr("substr(t, 4)")), F.concat(F.substring("t", 1, 1), F.substring("t", 3, 1), F.substring("t", 2, 1), F.expr("substr(t, 4)")), F.substring("t", 1, 4))).alias("b"))
    # a fixed vocabulary of a few words: every pair of them is the test
    pairs = forms.select("a").crossJoin(forms.select("b")).distinct()
    return pairs.select("a", "b", S.slot_token_match(F.col("a"), F.col("b")).alias("slot"), S.registry_token_match(F.col("a"), F.col("b")).alias("registry"))


@query(f"""WITH {QY}, s AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS a FROM part), t AS (SELECT DISTINCT qid, unnest(string_split(norm, ' ')) AS b FROM q)
SELECT qid, a AS token, max(CASE WHEN a = b THEN 'exact' ELSE 'edit' END) AS how FROM t CROSS JOIN s WHERE a = b OR {EDIT.format(prefix="len(b) < len(a) AND starts_with(a, b) AND len(a) - len(b) = 1")} GROUP BY ALL""")
def one_edit_tokens(spark, d):
    return retrieve.slot_tokens_of_queries(spoken(spark, d, typo=True), index.slot_index(parts(spark, d)))


@query("""WITH n AS (SELECT DISTINCT p_name AS a FROM part), p AS (SELECT a, substr(a, 1, 2) || substr(a, 4) AS b, TRUE AS inserted FROM n UNION ALL SELECT a, substr(a, 1, 2) || '#' || substr(a, 4), FALSE FROM n UNION ALL SELECT a, substr(a, 3), FALSE FROM n UNION ALL SELECT a, 'x' || a, TRUE FROM n UNION ALL SELECT substr(a, 1, 1), substr(a, 1, 2), FALSE FROM n)
SELECT DISTINCT a, b, round(len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: substr(a, i::INT, 1) = substr(b, i::INT, 1))) / greatest(len(a), len(b)), 6) AS sim, CASE WHEN least(len(a), len(b)) <= 2 THEN 0.75 WHEN least(len(a), len(b)) <= 3 THEN 0.66 WHEN least(len(a), len(b)) <= 5 THEN 0.6 ELSE 0.5 END::DOUBLE AS need, inserted FROM p""")
def positional_similarity(spark, d):
    """Names against themselves with a letter less, another letter, two letters less, a letter more, and heads too short to tell."""
    n = table(spark, d, "part").select(F.col("p_name").alias("a")).distinct()
    a, b = F.col("a"), F.col("b")
    others = [(a, F.concat(F.substring("a", 1, 2), F.expr("substr(a, 4)"))), (a, F.concat(F.substring("a", 1, 2), F.lit("#"), F.expr("substr(a, 4)"))), (a, F.expr("substr(a, 3)")), (a, F.concat(F.lit("x"), a)), (F.substring("a", 1, 1), F.substring("a", 1, 2))]
    p = n.select(F.explode(F.array(*[F.struct(x.alias("a"), y.alias("b")) for x, y in others])).alias("p")).select("p.*").distinct()
    return p.select("a", "b", F.round(S.positional(a, b), 6).alias("sim"), S.positional_threshold(a, b).alias("need"), S.one_insertion(a, b).alias("inserted"))


@query(f"WITH {C}, {QT}, x AS (SELECT DISTINCT norm, tokens FROM c) SELECT q.qid, x.norm, round((len(list_intersect(q.tokens, x.tokens)) / len(q.tokens)) ** 2, 6) AS coverage FROM q CROSS JOIN x")
def query_coverage(spark, d):
    names = parts(spark, d).select("norm", F.col("tokens").alias("own")).distinct()
    return spoken(spark, d).select("qid", "tokens").crossJoin(names).select("qid", "norm", F.round(S.query_coverage(F.col("tokens"), F.col("own")), 6).alias("coverage"))


@query(f"WITH {C}, {QT}, x AS (SELECT DISTINCT norm, tokens FROM c) SELECT q.qid, x.norm, round(greatest(len(list_intersect(q.tokens, x.tokens)) / 2, len(list_intersect(q.tokens, ['the', 'red', 'one'])) / 3), 6) AS share FROM q CROSS JOIN x")
def exact_intent(spark, d):
    names = parts(spark, d).select("norm").distinct().withColumn("v", T.literal_variants(F.concat("norm", F.lit("|the red, one| "))))
    return spoken(spark, d).select("qid", "tokens").crossJoin(names).select("qid", "norm", F.round(S.exact_intent(F.col("v"), F.col("tokens")), 6).alias("share"))


@query("""WITH w AS (SELECT DISTINCT c_mktsegment AS a FROM customer), p AS (SELECT x.a, y.a || 'S' AS b FROM w x, w y UNION ALL SELECT a, substr(a, 1, 6) FROM w),
l AS (SELECT a, b, len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: substr(a, 1, i::INT) = substr(b, 1, i::INT))) AS n FROM p)
SELECT a, b, n::INT AS n, least(len(a), len(b)) >= 6 AND n >= 4 AND 3 * n >= 2 * least(len(a), len(b)) AS stem FROM l""")
def shared_stem(spark, d):
    w = table(spark, d, "customer").select(F.col("c_mktsegment").alias("a")).distinct()
    p = w.crossJoin(w.select(F.concat("a", F.lit("S")).alias("b"))).union(w.select("a", F.substring("a", 1, 6)))
    return p.select("a", "b", S.shared_prefix(F.col("a"), F.col("b")).alias("n"), S.shared_stem(F.col("a"), F.col("b")).alias("stem"))


@query(f"""WITH {C}, {QT}, x AS (SELECT DISTINCT norm, tokens FROM c) SELECT q.qid, x.norm, (q.norm = x.norm)::INT AS equal, (contains(q.norm, x.norm) OR contains(x.norm, q.norm))::INT AS inside,
round(len(list_intersect(q.tokens, x.tokens)) / len(list_distinct(q.tokens || x.tokens)), 6) AS jaccard, -abs(len(q.norm) - len(x.norm))::INT AS near FROM q CROSS JOIN x""")
def relevance_key(spark, d):
    names = parts(spark, d).select("norm", F.col("tokens").alias("own")).distinct()
    q = spoken(spark, d).select("qid", F.col("norm").alias("query"), "tokens")
    k = q.crossJoin(names).select("qid", "norm", S.relevance_key(F.col("norm"), F.col("query"), F.col("own"), F.col("tokens")).alias("k"))
    return k.select("qid", "norm", "k.equal", "k.inside", F.round("k.jaccard", 6).alias("jaccard"), "k.near")


# --- rank -----------------------------------------------------------------


@query(f"{PRE} SELECT qid, cid, round(bm25, 6) AS bm25, round(char, 6) AS char, round(key, 6) AS key, row_number() OVER (PARTITION BY qid ORDER BY key DESC, cid)::INT AS rank FROM k QUALIFY rank <= 500")
def prefilter_topk(spark, d):
    docs = parts(spark, d)
    out = retrieve.prefilter(spoken(spark, d), index.postings(docs), index.gram_postings(docs))
    return out.select("qid", "cid", *[F.round(c, 6).alias(c) for c in ("bm25", "char", "key")], "rank")


@query(f"""{PRE}, f AS (SELECT qid, cid FROM k QUALIFY row_number() OVER (PARTITION BY qid ORDER BY key DESC, cid) <= 10),
h AS (SELECT q.qid, c.cid FROM q, c WHERE list_contains(q.tokens, c.tokens[2]) AND NOT EXISTS (SELECT 1 FROM f WHERE f.qid = q.qid AND f.cid = c.cid))
SELECT qid, cid FROM h QUALIFY row_number() OVER (PARTITION BY qid ORDER BY cid) <= 32""")
def slot_rescue(spark, d):
    """With a window of 10, so that candidates are left to be rescued."""
    docs, q = parts(spark, d), spoken(spark, d)
    found = retrieve.prefilter(q, index.postings(docs), index.gram_postings(docs), 10)
    exact = retrieve.slot_tokens_of_queries(q, index.slot_index(docs)).where("how = 'exact'")
    return retrieve.slot_rescue(q, docs, exact, found)


@query(f"WITH {C}, {QT} SELECT q.qid, c.cid, 1.0::DOUBLE AS coverage, 2::BIGINT AS matched FROM q JOIN c ON len(list_intersect(q.tokens, c.tokens)) >= 2")
def wildcard_prefilter(spark, d):
    return retrieve.wildcard_pass(parts(spark, d), spoken(spark, d))


@query("""WITH c AS (SELECT p_partkey AS cid, p_name AS norm, CASE WHEN p_size % 3 = 0 THEN 'custom_sentence' WHEN p_size % 3 = 1 THEN 'built_in' ELSE 'generated_sample' END AS source, p_size % 3 AS r, p_type AS intent FROM part)
SELECT norm, intent, source, cid FROM c QUALIFY row_number() OVER (PARTITION BY norm, intent ORDER BY r, cid) = 1""")
def dedupe_candidates(spark, d):
    source = F.element_at(F.array(F.lit("custom_sentence"), F.lit("built_in"), F.lit("generated_sample")), (F.col("p_size") % 3 + 1).cast("int"))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("cid"), F.col("p_name").alias("text"), F.col("p_type").alias("intent"), source.alias("source"))
    return index.dedupe(index.candidates(rows)).select("norm", "intent", "source", "cid")


RANKED = """r AS (SELECT o_custkey AS qid, o_orderkey AS cid, round(o_totalprice / 500000, 1) AS final, o_orderkey % 2 AS n_slots, CASE WHEN o_orderkey % 3 = 0 THEN 'HassTurnOff' ELSE 'HassTurnOn' END AS intent FROM orders)"""


def orders_ranked(spark, d):
    i = F.when(F.col("o_orderkey") % 3 == 0, "HassTurnOff").otherwise("HassTurnOn")
    return table(spark, d, "orders").select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("cid"), F.round(F.col("o_totalprice") / 500000, 1).alias("final"), (F.col("o_orderkey") % 2).alias("n_slots"), i.alias("intent"), F.col("o_orderkey").alias("pos"), F.round(F.col("o_orderkey") % 7 / 7, 6).alias("intent_score"))


@query(f"""WITH {RANKED}, t AS (SELECT *, count(DISTINCT intent) OVER (PARTITION BY qid, final, n_slots) AS k FROM r)
SELECT qid, cid, row_number() OVER (PARTITION BY qid ORDER BY final DESC, n_slots DESC, CASE WHEN k = 2 AND intent = 'HassTurnOn' THEN 1 ELSE 0 END DESC, cid)::INT AS rank FROM t""")
def tie_preference(spark, d):
    return decide.ordered(orders_ranked(spark, d)).select("qid", "cid", "rank")


@query("""WITH r AS (SELECT p_type AS qid, p_partkey AS cid, p_name AS norm, p_brand AS intent, round(p_retailprice / 2000, 3) AS final, p_partkey % 2 AS dyn FROM part)
SELECT qid, norm, intent, cid FROM r QUALIFY row_number() OVER (PARTITION BY qid, norm, intent ORDER BY final DESC, CASE WHEN dyn = 1 THEN 2 ELSE 1 END, cid) = 1""")
def merge_static_dynamic(spark, d):
    rows = table(spark, d, "part").select(F.col("p_type").alias("qid"), F.col("p_partkey").alias("cid"), F.col("p_name").alias("norm"), F.col("p_brand").alias("intent"), F.round(F.col("p_retailprice") / 2000, 3).alias("final"), F.col("p_partkey").alias("pos"), F.when(F.col("p_partkey") % 2 == 1, "generated_sample").otherwise("built_in").alias("source"))
    return merge.merged(rows.where("pos % 2 = 0"), rows.where("pos % 2 = 1")).select("qid", "norm", "intent", "cid")


@query("""WITH t AS (SELECT p_type AS intent, p_brand AS item, p_partkey AS cid, row_number() OVER (PARTITION BY p_type, p_brand ORDER BY p_partkey) AS turn FROM part)
SELECT intent, item, cid FROM t QUALIFY row_number() OVER (PARTITION BY intent ORDER BY turn, item, cid) <= 40""")
def cap_round_robin(spark, d):
    """With a cap of 40 an intent, so that it takes effect."""
    rows = table(spark, d, "part").select(F.col("p_type").alias("intent"), F.col("p_brand").alias("item"), F.col("p_partkey").alias("cid"), F.col("p_partkey").alias("pos"), F.lit("built_in").alias("source"))
    return index.capped(rows, per_intent=40, item="item").select("intent", "item", "cid")


@query("SELECT l_orderkey, l_linenumber, round(0.33 * l_discount * 10 + 0.32 * l_tax * 10 + 0.2 * l_quantity / 50 + 0.15, 6) AS score FROM lineitem")
def weighted_score(spark, d):
    s = S.weighted_score(F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_quantity") / 50, F.lit(1.0))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(s, 6).alias("score"))


# --- decide ---------------------------------------------------------------


def gate_rows(spark, d):
    r = decide.ordered(orders_ranked(spark, d))
    empty = F.array().cast("array<string>")
    r = r.withColumns({
        "text": F.col("cid").cast("string"), "norm": F.col("cid").cast("string"), "slots": F.create_map().cast("map<string,string>"), "static_slots": empty, "query_slots": empty, "slot_tokens": empty,
        "literal_variants": F.array().cast("array<array<string>>"), "fuzzy": F.lit(0.5), "char": F.lit(0.5), "tokens": empty, "q_tokens": empty,
    })
    return r


FIRST = f"""WITH {RANKED}, t AS (SELECT *, count(DISTINCT intent) OVER (PARTITION BY qid, final, n_slots) AS k FROM r),
o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY final DESC, n_slots DESC, CASE WHEN k = 2 AND intent = 'HassTurnOn' THEN 1 ELSE 0 END DESC, cid) AS rank, round(cid % 7 / 7, 6) AS s FROM t),
a AS (SELECT qid, cid AS top, intent, final, n_slots, s FROM o WHERE rank = 1), b AS (SELECT o.qid, o.cid AS rival, o.intent AS ri, o.final AS rf, o.n_slots AS rn, o.s AS rs FROM o JOIN a USING (qid) WHERE o.intent <> a.intent QUALIFY row_number() OVER (PARTITION BY o.qid ORDER BY rank) = 1),
e AS (SELECT *, final - rf AS margin FROM a LEFT JOIN b USING (qid))"""

ORDERED = FIRST.partition(",\na AS (")[0]


@query(f"{FIRST} SELECT qid, top, rival, round(margin, 6) AS margin FROM e")
def first_competitor(spark, d):
    e = decide.evidence(decide.with_competition(gate_rows(spark, d)))
    return e.select("qid", F.col("top.cid").alias("top"), F.col("rival.cid").alias("rival"), F.round("margin", 6).alias("margin"))


@query(f"""{FIRST}, p AS (SELECT *, CASE WHEN final < 0.5 THEN 'hard_min_confidence' WHEN rival IS NULL THEN 'no_competitor'
WHEN n_slots = 0 AND rn = 0 AND ((final >= 0.6 AND margin >= 0.035) OR (round(s - rs, 12) >= 0.09 AND final >= 0.57 AND final < 0.74)) THEN 'safe_empty_slot_relaxation'
WHEN round(s - rs, 12) >= 0.09 AND final >= 0.57 AND final < 0.74 THEN 'safe_intent_evidence_relaxation'
WHEN final >= 0.8 AND margin >= 0.005 THEN 'high_confidence_relaxation' WHEN s <= 0 AND final < 0.7 AND margin <= 0.07 THEN 'weak_zero_intent_evidence' ELSE 'opposing_action_base_margin' END AS policy FROM e)
SELECT qid, policy AS margin_policy, CASE WHEN policy = 'opposing_action_base_margin' THEN margin >= 0.04 ELSE policy NOT IN ('hard_min_confidence', 'weak_zero_intent_evidence') END AS accepted,
CASE WHEN policy IN ('hard_min_confidence', 'weak_zero_intent_evidence') THEN 'low_confidence' WHEN policy = 'opposing_action_base_margin' AND margin < 0.04 THEN 'low_margin' END AS rejection_reason FROM p""")
def gate_score_policies(spark, d):
    e = decide.evidence(decide.with_competition(gate_rows(spark, d)))
    return decide.decision(e, lexical=False).select("qid", "margin_policy", "accepted", "rejection_reason")


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'fallback' WHEN event_type = 'signup' THEN 'native' WHEN event_type = 'view' AND value < 10 THEN 'fallback' WHEN value < 50 THEN 'fallback' ELSE 'execute' END AS route,
CASE WHEN event_type = 'error' THEN 'hotword_matched' WHEN event_type = 'signup' THEN NULL WHEN event_type = 'view' AND value < 10 THEN 'empty_index' WHEN value < 50 THEN 'low_margin' END AS reason FROM events""")
def route_reason(spark, d):
    t, v = F.col("event_type"), F.col("value")
    where, why = route.route(t == "error", t == "signup", ~((t == "view") & (v < 10)), v >= 50, F.lit("low_margin"), F.lit(True))
    return table(spark, d, "events").select("event_id", where.alias("route"), why.alias("reason"))


@query(f"WITH {QT} SELECT qid, CASE WHEN norm LIKE 'the red%' THEN 'The Red' WHEN norm LIKE 'the blue%' THEN 'the, blue' END AS hotword, norm LIKE 'the red%' OR norm LIKE 'the blue%' AS matched FROM q")
def hotword_exact(spark, d):
    out = route.hotword_similarity(spoken(spark, d), ["The Red", "the, blue", " "], 1.0)
    return out.select("qid", F.when(F.col("matched"), F.col("hotword")).alias("hotword"), "matched")


# --- grammar --------------------------------------------------------------


@query("""WITH n AS (SELECT DISTINCT p_name FROM part), h AS (SELECT unnest(['turn ', 'turn the ']) AS h), s AS (SELECT unnest([' on', ' off']) AS s)
SELECT 0 AS t, h || p_name || s AS sentence, p_name AS name FROM n, h, s UNION ALL SELECT 1, p_name || x, p_name FROM n, (VALUES (' now please'), (' please now')) v(x)
UNION ALL SELECT 2, 'show ' || p_name || x, p_name FROM n, (VALUES (''), (' in red'), (' in blue')) v(x) UNION ALL SELECT 3, p_name || ' is ' || p_name, p_name FROM n""")
def expand_template(spark, d):
    """An optional word and a choice; any order; a rule in an optional part; and a slot twice, which must agree."""
    names = table(spark, d, "part").select("p_name").distinct()
    forms = spark.createDataFrame([(0, "turn [the] {name} (on|off)"), (1, "{name} (now;please)"), (2, "show {name} [<colour>]"), (3, "{name} is {other:name}")], "t int, template string")
    rows = names.crossJoin(F.broadcast(forms)).select("t", "template", F.create_map(F.lit("name"), F.array("p_name"), F.lit("other"), F.array("p_name", F.lit("else"))).alias("slots"), F.create_map(F.lit("colour"), F.lit("in (red|blue)")).alias("rules"))  # broadcast: four templates
    return grammar.expanded(rows).select("t", "sentence", F.element_at("bindings", "name").alias("name"))


@query("""WITH r AS (SELECT * FROM (VALUES (1, 0.0, 50.0, 5.0, 2.0), (2, 10.0, 90.0, 1.0, 1.0)) t(range_id, lo, hi, step, m))
SELECT DISTINCT o_orderkey AS qid, range_id, (o_orderkey % 97)::DOUBLE AS value, ((o_orderkey % 97) * m)::BIGINT::VARCHAR AS output FROM orders, r WHERE o_orderkey % 97 BETWEEN lo AND hi AND (o_orderkey % 97 - lo) % step = 0""")
def range_binding(spark, d):
    rows = spark.createDataFrame([(1, 50.0, 0.0, 5.0, 2.0, None), (2, 10.0, 90.0, None, None, None)], "range_id int, from double, to double, step double, multiplier double, fractions string")
    rows = rows.withColumns({"from": F.least("from", "to"), "to": F.greatest("from", "to")})
    q = table(spark, d, "orders").select(F.col("o_orderkey").alias("qid"), F.array(F.lit("set"), F.concat((F.col("o_orderkey") % 97).cast("string"), F.lit("%"))).alias("tokens"))
    return grammar.bind_ranges(q, grammar.compiled_ranges(rows))


@query(f"WITH {C}, {QT}, x AS (SELECT DISTINCT norm, tokens FROM c) SELECT q.qid, x.norm, len(list_intersect(q.tokens, x.tokens)) >= 1 AS open, len(list_intersect(q.tokens, x.tokens)) = 2 AS full FROM q CROSS JOIN x")
def literal_gate(spark, d):
    names = parts(spark, d).select("norm", "literal_variants").distinct()
    both = spoken(spark, d).select("qid", "tokens").crossJoin(names)
    return both.select("qid", "norm", grammar.literal_gate(F.col("literal_variants"), F.col("tokens")).alias("open"), T.full_literal(F.col("literal_variants"), F.col("tokens")).alias("full"))


# --- evaluate -------------------------------------------------------------

CASES = """k AS (SELECT doc_id, lang, source, quality = 1 AS baseline_ok, toxic = 0 AS direct_ok, n_chars > 1000 AS slots_ok, n_chars < 300 AS fallback, doc_id % 11 = 0 AS drift FROM labels JOIN documents USING (doc_id))"""


def cases(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    return rows.select("doc_id", "lang", "source", (F.col("quality") == 1).alias("baseline_ok"), (F.col("toxic") == 0).alias("direct_ok"), (F.col("toxic") == 0).alias("intent_ok"), (F.col("n_chars") > 1000).alias("slots_ok"), (F.col("n_chars") < 300).alias("fallback"), (F.col("doc_id") % 11 == 0).alias("drift"))


@query(f"""WITH {CASES}, g AS (SELECT lang, count(*) AS total, count_if(direct_ok) AS intent, count_if(slots_ok) AS slots, count_if(direct_ok AND slots_ok) AS correct, count_if(fallback) AS fallback, count_if(drift) AS drift FROM k GROUP BY lang)
SELECT *, total - correct - fallback - drift AS mismatch, round(correct / (total - drift), 6) AS accuracy, round(fallback / (total - drift), 6) AS fallback_rate, round((total - correct - fallback - drift) / (total - drift), 6) AS mismatch_rate FROM g""")
def category_stats(spark, d):
    return evaluate.category_stats(cases(spark, d), "lang")


@query(f"""WITH {CASES}, g AS (SELECT lang, count(*) AS total, count_if(baseline_ok OR direct_ok) AS effective, count_if(baseline_ok) AS baseline, count_if(NOT baseline_ok AND direct_ok) AS recovered, count_if(baseline_ok AND NOT direct_ok) AS protected, count_if(baseline_ok AND direct_ok) AS both,
count_if(NOT baseline_ok AND NOT direct_ok) AS neither, count_if(NOT baseline_ok AND NOT direct_ok AND fallback) AS fallback, count_if(NOT baseline_ok AND NOT direct_ok AND NOT fallback) AS mismatch FROM k GROUP BY lang)
SELECT *, round(effective / total, 6) AS accuracy, round((effective - baseline) / total, 6) AS uplift FROM g""")
def outcome_partition(spark, d):
    return evaluate.outcome_partition(cases(spark, d), "lang")


@query(f"WITH {CASES} SELECT lang, source, count(*) AS total, count_if(baseline_ok OR direct_ok) AS effective, count_if(NOT baseline_ok AND direct_ok) AS recovered, grouping_id(lang, source) AS set_id FROM k GROUP BY GROUPING SETS ((), (lang), (source))")
def breakdown_sets(spark, d):
    return evaluate.breakdowns(cases(spark, d), "lang", "source")


@query("SELECT l_shipmode, count(*) AS n, min(v) AS min, round(avg(v), 6) AS mean, median(v) AS median, quantile_disc(v, 0.95) AS p95, max(v) AS max, round(1000 / avg(v), 6) AS rps FROM (SELECT l_returnflag AS l_shipmode, l_extendedprice / 1000 AS v FROM lineitem) GROUP BY 1".replace("min(v)", "round(min(v), 6)").replace("median(v)", "round(median(v), 6)").replace("quantile_disc(v, 0.95)", "round(quantile_disc(v, 0.95), 6)").replace("max(v)", "round(max(v), 6)"))
def latency_summary(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("l_shipmode"), (F.col("l_extendedprice") / 1000).alias("v"))
    return evaluate.latency(rows, "v", "l_shipmode")


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(stddev_samp(value), 6) AS stdev, round(stddev_samp(value) / avg(value), 6) AS cov FROM events GROUP BY 1")
def profile_stats(spark, d):
    return evaluate.profile(table(spark, d, "events"), "value", "event_type")


@query("""WITH r AS (SELECT l_orderkey AS qid, l_linenumber::BIGINT AS cid, l_returnflag AS intent, l_extendedprice AS final, l_discount AS fuzzy, l_tax AS char, l_quantity AS bm25 FROM lineitem),
u AS (SELECT qid, cid, intent, final, 'fuzzy' AS component, fuzzy AS score FROM r UNION ALL SELECT qid, cid, intent, final, 'char', char FROM r UNION ALL SELECT qid, cid, intent, final, 'bm25', bm25 FROM r)
SELECT qid, component, score, final FROM u QUALIFY row_number() OVER (PARTITION BY qid, component ORDER BY score DESC, final DESC, cid) = 1""")
def ablation(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("qid"), F.col("l_linenumber").cast("long").alias("cid"), F.col("l_returnflag").alias("intent"), F.col("l_extendedprice").alias("final"), F.col("l_discount").alias("fuzzy"), F.col("l_tax").alias("char"), F.col("l_quantity").alias("bm25"))
    return evaluate.ablation(rows, "fuzzy", "char", "bm25").select("qid", "component", "score", "final")


@query("""WITH m AS (SELECT o_orderpriority AS k, avg(CASE WHEN o_orderdate >= TIMESTAMP '1999-01-01' THEN o_totalprice END) AS a, avg(CASE WHEN o_orderdate < TIMESTAMP '1999-01-01' THEN o_totalprice END) AS b FROM orders GROUP BY 1)
SELECT k, 'mean' AS metric, round((a - b) / abs(b) * 100, 6) AS change_pct FROM m WHERE round((a - b) / abs(b) * 100, 6) > -5""")
def regressions(spark, d):
    o = table(spark, d, "orders").withColumn("new", F.col("o_orderdate") >= F.lit("1999-01-01").cast("timestamp"))
    m = lambda x: o.where(x).groupBy(F.col("o_orderpriority").alias("k")).agg(F.avg("o_totalprice").alias("value")).withColumn("metric", F.lit("mean"))
    return evaluate.regressions(m("new"), m("not new"), "k", percent=-5.0).select("k", "metric", "change_pct")


@query("SELECT 'p_type' AS dimension, p_type AS value, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'p_brand', p_brand, count(*) FROM part GROUP BY 2")
def counts(spark, d):
    return evaluate.counts(table(spark, d, "part"), "p_type", "p_brand")


@query(f"""WITH {CASES}, g AS (SELECT lang, count_if(direct_ok AND slots_ok) / count_if(NOT drift) AS a, count_if(fallback) / count_if(NOT drift) AS f FROM k GROUP BY lang)
SELECT lang, 'accuracy' AS gate, round(a, 6) AS value, 0.9::DOUBLE AS lim FROM g WHERE round(a, 6) < 0.9 UNION ALL SELECT lang, 'fallback_rate', round(f, 6), 0.01::DOUBLE FROM g WHERE round(f, 6) > 0.01""")
def threshold_gates(spark, d):
    s = evaluate.category_stats(cases(spark, d), "lang")
    return evaluate.threshold_gates(s, 0.9, 0.01).select("lang", "gate", "value", F.col("limit").alias("lim"))


# --- state ----------------------------------------------------------------


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_ts FROM s GROUP BY user_id, k""")
def debounce_sessions(spark, d):
    out = refresh.sessions(table(spark, d, "events"), "2 hours", "user_id")
    return out.select("user_id", "n", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) for c in ("first_ts", "last_ts")])


@query("SELECT DISTINCT text FROM conversations WHERE role = 'user' AND sha256(text) NOT IN (SELECT sha256(text) FROM conversations WHERE role = 'user' AND turn > 0)")
def cache_misses(spark, d):
    t = table(spark, d, "conversations").where("role = 'user'").withColumn("key", F.sha2("text", 256))
    memo = t.where("turn > 0").select("key", F.lit(3).alias("generation")).union(t.select("key", F.lit(2)))
    return refresh.cache_misses(t, memo, 3).select("text")


# --- more of ranking, routing and evaluation --------------------------------


@query(f"""{PRE}, f AS (SELECT qid, cid, row_number() OVER (PARTITION BY qid ORDER BY key DESC, cid) AS rn FROM k QUALIFY rn <= 700),
z AS (SELECT cid FROM c QUALIFY row_number() OVER (ORDER BY cid) <= 700), a AS (SELECT qid, cid, key FROM k QUALIFY row_number() OVER (PARTITION BY qid ORDER BY key DESC, cid) <= 700
UNION ALL SELECT q.qid, z.cid, 0 FROM q CROSS JOIN z WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.qid = q.qid AND f.cid = z.cid))
SELECT qid, cid, round(key, 6) AS key, row_number() OVER (PARTITION BY qid ORDER BY key DESC, cid)::INT AS rank FROM a QUALIFY rank <= 700""")
def prefilter_filled(spark, d):
    docs, q = parts(spark, d), spoken(spark, d)
    found = retrieve.prefilter(q, index.postings(docs), index.gram_postings(docs), 700)
    return retrieve.filled(found, q, docs, 700).select("qid", "cid", F.round("key", 6).alias("key"), "rank")


@query(f"""WITH {C}, {QT}, h AS (SELECT q.qid, c.cid, c.norm FROM q JOIN c ON len(list_intersect(q.tokens, c.tokens)) >= 2)
SELECT qid, cid FROM h WHERE cid % 2 = 1 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY cid) <= 64""")
def wildcard_rescue(spark, d):
    passed = retrieve.wildcard_pass(parts(spark, d), spoken(spark, d))
    return retrieve.wildcard_rescue(passed, passed.where("cid % 2 = 0"))


@query(f"""{ORDERED}, t1 AS (SELECT qid, intent AS i, s AS s1, final AS f1 FROM o WHERE rank = 1), r1 AS (SELECT o.qid, min(rank) AS r FROM o JOIN t1 USING (qid) WHERE intent <> i GROUP BY o.qid),
w AS (SELECT o.qid, r FROM o JOIN r1 ON o.qid = r1.qid AND o.rank = r JOIN t1 ON t1.qid = o.qid WHERE final = f1 AND s > s1)
SELECT o.qid, o.cid, CASE WHEN o.rank = w.r THEN 1 WHEN o.rank = 1 AND w.r IS NOT NULL THEN w.r ELSE o.rank END::INT AS rank FROM o LEFT JOIN w USING (qid)""")
def disambiguation(spark, d):
    return decide.disambiguated(decide.ordered(orders_ranked(spark, d))).select("qid", "cid", "rank")


@query(f"""{ORDERED}, t1 AS (SELECT qid, intent AS i FROM o WHERE rank = 1), c1 AS (SELECT o.qid, min(rank) AS c FROM o JOIN t1 USING (qid) WHERE intent <> i GROUP BY o.qid)
SELECT o.qid, o.cid, least(o.rank, 3)::INT AS rank FROM o LEFT JOIN c1 USING (qid) WHERE CASE WHEN c > 3 THEN rank < 3 OR rank = c ELSE rank <= 3 END""")
def limit_with_competitor(spark, d):
    """With a limit of 3, so that it takes effect."""
    return decide.limited(decide.with_competition(gate_rows(spark, d)), 3).select("qid", "cid", "rank")


@query("SELECT o_custkey AS qid FROM orders GROUP BY 1 HAVING count_if(o_orderkey % 5 = 0) > 0 AND min(o_orderkey) % 5 = 0 AND count(DISTINCT CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority END) = 1")
def perfect_queries(spark, d):
    one = (F.col("o_orderkey") % 5 == 0).cast("double")
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("qid"), F.col("o_orderpriority").alias("intent"), *[one.alias(c) for c in ("fuzzy", "char", "bm25", "intent_score", "final")], "o_orderkey")
    rows = rows.withColumn("rank", (F.col("o_orderkey") == F.min("o_orderkey").over(Window.partitionBy("qid"))).cast("int"))
    return merge.perfect(rows)


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'none' WHEN o_orderkey % 2 = 0 THEN 'literal' ELSE 'wildcard' END AS kind FROM orders")
def rescue_kinds(spark, d):
    text = F.when(F.col("o_orderkey") % 2 == 0, F.lit("set to 5")).otherwise("set it")
    return table(spark, d, "orders").select("o_orderkey", merge.rescue_kind(F.col("o_orderstatus") == "F", text).alias("kind"))


@query("""WITH i AS (SELECT unnest(['HassListAddItem', 'HassShoppingListAddItem', 'HassListCompleteItem', 'HassShoppingListCompleteItem', 'HassListRemoveItem', 'HassTurnOn']) AS i)
SELECT p_partkey, i, p_type = i OR (p_size % 2 = 0 AND i LIKE '%ListAddItem') OR (p_size % 2 = 1 AND (i LIKE '%ListCompleteItem' OR i = 'HassListRemoveItem')) AS alike FROM part, i""")
def intent_equivalence(spark, d):
    """A part's own kind is no intent; even ones stand for adding to a shopping list and odd ones for completing its items."""
    names = ("HassListAddItem", "HassShoppingListAddItem", "HassListCompleteItem", "HassShoppingListCompleteItem", "HassListRemoveItem", "HassTurnOn")
    own = F.when(F.col("p_size") % 2 == 0, "HassShoppingListAddItem").otherwise("HassShoppingListCompleteItem")
    rows = table(spark, d, "part").select("p_partkey", own.alias("own"), F.explode(F.array(*map(F.lit, names))).alias("i"))
    return rows.select("p_partkey", "i", evaluate.equivalent(F.col("own"), F.col("i")).alias("alike"))


@query("""SELECT p_partkey, p_size % 3 < 2 AS by_alias, p_size % 2 = 0 AS by_number, p_size % 3 = 0 AS joined, p_size % 2 = 0 AS missing FROM part""")
def slot_equality(spark, d):
    """A name under an alias, under another slot, or another name; a number written otherwise; a name said with its area; and a slot that may be missing."""
    p = table(spark, d, "part")
    m, k = F.create_map, F.col("p_size") % 3
    two, one = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    alias = F.when(k == 0, m(F.lit("entity"), F.col("p_name"))).when(k == 1, m(F.lit("name:light"), F.upper("p_name"))).otherwise(m(F.lit("colour"), F.lit("none")))
    number = m(F.lit("n"), F.when(F.col("p_size") % 2 == 0, F.format_string("%d.0", "p_size")).otherwise(F.format_string("%d.5", "p_size")))
    parts_ = F.when(k == 0, m(F.lit("area"), two, F.lit("name"), one)).otherwise(m(F.lit("area"), two, F.lit("name"), F.lit("none")))
    bare = m(F.lit("name"), F.col("p_name"), F.lit("area"), F.lit("hall"))
    less = F.when(F.col("p_size") % 2 == 0, bare).otherwise(m(F.lit("name"), F.col("p_name")))
    return p.select(
        "p_partkey", evaluate.slots_equal(m(F.lit("name"), F.lower("p_name")), alias).alias("by_alias"), evaluate.slots_equal(m(F.lit("n"), F.col("p_size").cast("string")), number).alias("by_number"),
        evaluate.slots_equal(m(F.lit("name"), F.col("p_name")), parts_).alias("joined"), evaluate.slots_equal(bare, less).alias("missing"),
    )


@query("""WITH a AS (SELECT DISTINCT p_type AS intent FROM part), b AS (SELECT DISTINCT p_type AS intent FROM part WHERE p_size > 60), c AS (SELECT DISTINCT o_orderpriority AS intent FROM orders)
SELECT intent, 'candidates' AS missing_from FROM a WHERE intent NOT IN (SELECT intent FROM b) UNION ALL SELECT intent, 'dataset' FROM a WHERE intent NOT IN (SELECT intent FROM c) UNION ALL SELECT intent, 'grammar' FROM c WHERE intent NOT IN (SELECT intent FROM a)""")
def intent_coverage(spark, d):
    p = table(spark, d, "part").withColumnRenamed("p_type", "intent")
    return evaluate.coverage(p, p.where("p_size > 60"), table(spark, d, "orders").withColumnRenamed("o_orderpriority", "intent"))


@query("SELECT user_id AS conversation_id, event_type AS agent_id, arg_max(value, event_id) FILTER (event_id % 3 = 0) AS last_tool, count_if(event_id % 2 = 0) AS attempts FROM events GROUP BY 1, 2")
def correlated_traces(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("conversation_id"), F.col("event_type").alias("agent_id"), F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("tool"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 2 == 0, "attempt").alias("kind"))
    return evaluate.correlated(e)


@query("SELECT p_type AS language, p_brand AS target, min(p_size) AS mentions, arg_min(p_partkey, p_size * 1000000 + p_partkey) AS sentence_pos FROM part GROUP BY 1, 2")
def smoke_samples(spark, d):
    rows = table(spark, d, "part").select(F.col("p_type").alias("language"), F.col("p_brand").alias("target"), F.col("p_size").alias("mentions"), F.col("p_partkey").alias("sentence_pos"))
    return evaluate.smoke_samples(rows)


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'intent_and_slots' WHEN 1 THEN 'intent' WHEN 2 THEN 'slots' END AS divergence FROM orders")
def metadata_divergence(spark, d):
    k = F.col("o_orderkey") % 4
    m = lambda v: F.create_map(F.lit("name"), v)
    out = route.divergence(F.when(k.isin(0, 1), "B").otherwise("A"), m(F.when(k.isin(0, 2), "lamp").otherwise("Kitchen, Lamp")), F.lit("A"), m(F.lit("kitchen lamp")))
    return table(spark, d, "orders").select("o_orderkey", out.alias("divergence"))


@query("SELECT c_custkey, 'order ' || c_name AS stripped, CASE WHEN c_custkey % 2 = 0 THEN 'canon' ELSE 'raw' END AS delegated, sha256(c_name) AS delegated_sha256 FROM customer")
def strip_and_delegate(spark, d):
    c = table(spark, d, "customer")
    even = F.col("c_custkey") % 2 == 0
    return c.select("c_custkey", route.strip_hotword(F.concat(F.lit("hey you,  order "), "c_name"), F.lit(2)).alias("stripped"), route.delegated(F.lit("raw"), F.lit("canon"), F.when(even, "execute").otherwise("fallback")).alias("delegated"), F.sha2("c_name", 256).alias("delegated_sha256"))


@query("""WITH p AS (SELECT DISTINCT p_name, len(p_name) % 4 AS k FROM part) SELECT p_name, k IN (0, 3) AS fixed, CASE WHEN k < 2 THEN p_name END AS span, CASE WHEN k = 0 THEN 'own' WHEN k = 1 THEN 'intent' ELSE 'source' END AS winner FROM p""")
def template_tests(spark, d):
    """Sentences with an option, a slot or neither; spans whose frame fits or doesn't; lists that an item, its intent or only the source has."""
    p = table(spark, d, "part").select("p_name").distinct().withColumn("k", F.length("p_name") % 4)
    k = F.col("k")
    form = F.when(k == 1, F.concat("p_name", F.lit(" [now]"))).when(k == 2, F.concat("p_name", F.lit(" {place}"))).otherwise(F.col("p_name"))
    said = F.when(k < 2, F.concat(F.lit("turn on "), "p_name", F.lit(" now"))).when(k == 2, F.concat(F.lit("turn off "), "p_name", F.lit(" now"))).otherwise(F.lit("turn on now"))
    none = F.create_map().cast("map<string,array<string>>")
    one = lambda who, when: F.when(when, F.create_map(F.lit("l"), F.array(F.lit(who)))).otherwise(none)
    found = grammar.effective_lists(one("source", F.lit(True)), one("intent", k < 2), one("own", k == 0))
    return p.select("p_name", grammar.is_fixed_sentence(form).alias("fixed"), grammar.anchored_window(said, F.lit("turn on "), F.lit(" now")).alias("span"), F.element_at(F.element_at(found, "l"), 1).alias("winner"))


@query("SELECT event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) = 1")
def latest_sources(spark, d):
    e = table(spark, d, "events").select("event_type", "event_id", "value")
    return refresh.upserted(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "event_type", version="event_id")


@query("SELECT p_type AS language, count(*) AS n FROM part GROUP BY 1 HAVING count(*) % 2 = 1 OR p_type = 'PROMO'")
def changed_languages(spark, d):
    now = table(spark, d, "part").groupBy(F.col("p_type").alias("language")).agg(F.count("*").alias("n"), F.sha2(F.count("*").cast("string"), 256).alias("fingerprint"))
    old = now.where("language <> 'PROMO'").withColumn("fingerprint", F.when(F.col("n") % 2 == 1, "x").otherwise(F.col("fingerprint")))
    return refresh.changed(now, old, "language").select("language", "n")


# --- rows only ------------------------------------------------------------


@query()
def fuzzy_similarity(spark, d):
    q, names = spoken(spark, d, typo=True).select("qid", F.col("norm").alias("query")), parts(spark, d).select("norm").distinct()
    return q.crossJoin(names).select("qid", "norm", F.round(S.fuzzy("query", "norm"), 6).alias("fuzzy"))


@query()
def positional_intent(spark, d):
    names = parts(spark, d).select("norm", "literal_variants", F.col("tokens").alias("own")).distinct()
    both = spoken(spark, d, typo=True).select("qid", "tokens").crossJoin(names)
    return both.select("qid", "norm", F.round(S.positional_intent("literal_variants", "tokens", F.array().cast("array<string>")), 6).alias("intent"))


@query("""SELECT p_partkey AS cid, 'add ' || p_name || ' to list' AS rehydrated, len(string_split(p_name, ' '))::BIGINT AS replacement_words FROM part WHERE p_partkey % 5 > 0""")
def rehydrate_placeholders(spark, d):
    """Templates filled from queries that have their words; a fifth of the queries end too early and fill nothing."""
    said = F.when(F.col("p_partkey") % 5 > 0, F.concat(F.lit("Add "), "p_name", F.lit(" to list"))).otherwise(F.lit("Add to"))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("cid"), F.split(F.lit("add item to list"), " ").alias("tokens"), F.array(F.lit("item")).alias("wildcard_slots"), said.alias("query"))
    return rehydrate.rehydrate(rows).select("cid", "rehydrated", "replacement_words")


@query()
def rank_full(spark, d):
    out = api.rank(spoken(spark, d), parts(spark, d))
    return out.select("qid", "rank", "cid", *[F.round(c, 6).alias(c) for c in ("fuzzy", "char", "bm25", "intent_score", "final")])


@query()
def gate_full(spark, d):
    return api.decisions(api.rank(spoken(spark, d), parts(spark, d)))


@query()
def query_registry_candidates(spark, d):
    return retrieve.registry_hits(spoken(spark, d, typo=True), registry(spark, d))


@query()
def adjusted_scores(spark, d):
    docs = parts(spark, d)
    q = spoken(spark, d)
    found = retrieve.prefilter(q, index.postings(docs), index.gram_postings(docs))
    return score.scored(found.select("qid", "cid", "bm25", "char"), q, docs).select("qid", "cid", F.round("weighted", 6).alias("weighted"), F.round("final", 6).alias("final"))




from lexiform.plans import rules  # noqa: E402, F401  registers more queries
