"""Registered queries of the ranking rules and of query-time candidates, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiform import api
from lexiform.functions import similarity as S
from lexiform.functions import text as T
from lexiform.operators import decide, dynamic, evaluate, route, score
from lexiform.plans.registry import query, table
from lexiform.sources import stores

WORDS = "w AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS w FROM part)"
LESS = "substr(w, 1, 2) || substr(w, 4)"


def less(c="w"):
    """A word without its third letter."""
    return F.concat(F.substring(c, 1, 2), F.expr(f"substr({c}, 4)"))


def part_words(spark, d):
    return table(spark, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("w")).distinct()


# --- tokens -----------------------------------------------------------------


@query(f"""WITH {WORDS}, p AS (SELECT w AS a, {LESS} AS b, 200.0 * (len(w) - 1) / (2 * len(w) - 1) AS r FROM w UNION ALL SELECT w, w || w, 200.0 / 3 FROM w
UNION ALL SELECT w, substr(w, 1, 2), 400.0 / (len(w) + 2) FROM w UNION ALL SELECT w, w, 100.0 FROM w) SELECT DISTINCT a, b, r >= 75 AS alike FROM p""")
def slot_ratio(spark, d):
    """Words against themselves with a letter less, doubled, cut to two letters, and unchanged."""
    w = part_words(spark, d)
    pairs = [w.select(F.col("w").alias("a"), b.alias("b")) for b in (less(), F.concat("w", "w"), F.substring("w", 1, 2), F.col("w"))]
    both = pairs[0].union(pairs[1]).union(pairs[2]).union(pairs[3]).distinct()
    return both.select("a", "b", F.when(S.may_match(F.col("a"), F.col("b")), S.slot_fuzzy("a", "b")).otherwise(False).alias("alike"))


@query(f"WITH {WORDS} SELECT w, len(w) % 2 = 0 AS short, TRUE AS long, FALSE AS tiny FROM w WHERE len(w) >= 4")
def registry_ratio(spark, d):
    """A registry word's first three letters against two (only where the query's short word is known to be no literal), its own letters but one, and a slot word of two."""
    w = part_words(spark, d).where("length(w) >= 4")
    none, two, three = F.array().cast("array<string>"), F.substring("w", 1, 2), F.substring("w", 1, 3)
    return w.select("w", S.registry_fuzzy(three, two, F.when(F.length("w") % 2 == 0, F.array(two)).otherwise(none)).alias("short"), S.registry_fuzzy(F.col("w"), less(), none).alias("long"), S.registry_fuzzy(two, two, none).alias("tiny"))


@query("""WITH p AS (SELECT DISTINCT split_part(lower(p_name), ' ', 1) AS a, split_part(lower(p_name), ' ', 2) AS b FROM part)
SELECT a, b, (len(a) >= 5)::INT + 1 AS both_said, (len(a) >= 5)::INT AS one_said_twice FROM p WHERE a <> b AND a[1] <> b[1]""")
def one_to_one_count(spark, d):
    """A slip of the first word and the second; and the slip twice, which counts once."""
    p = table(spark, d, "part").select(F.split_part(F.lower("p_name"), F.lit(" "), F.lit(1)).alias("a"), F.split_part(F.lower("p_name"), F.lit(" "), F.lit(2)).alias("b")).distinct()
    p = p.where((F.col("a") != F.col("b")) & (F.substring("a", 1, 1) != F.substring("b", 1, 1)))
    slip = less("a")
    return p.select("a", "b", S.registry_count(F.array("a", "b"), F.array(slip, F.col("b"))).alias("both_said"), S.registry_count(F.array("a", "b"), F.array(slip, slip)).alias("one_said_twice"))


@query("""SELECT c_custkey, k AS key, list_sort(list(DISTINCT v)) AS vals FROM (
SELECT c_custkey, unnest(['name', 'name:' || lower(c_mktsegment), 'device']) AS k, unnest([c_name, 'no ' || c_nationkey, c_name]) AS v FROM customer UNION ALL
SELECT c_custkey, unnest(['name', 'device']), unnest(['no ' || c_nationkey, 'no ' || c_nationkey]) FROM customer) GROUP BY ALL""")
def alias_values(spark, d):
    c = table(spark, d, "customer")
    slots = F.create_map(F.lit("name"), F.col("c_name"), F.concat(F.lit("name:"), F.lower("c_mktsegment")), F.concat(F.lit("no "), "c_nationkey"))
    return T.slot_alias_values(c.select("c_custkey", slots.alias("slots")), "c_custkey", {"name": ("device",)}).select("c_custkey", "key", F.sort_array("vals").alias("vals"))


# --- context ----------------------------------------------------------------


@query("""SELECT c_custkey, (CASE WHEN c_custkey % 5 = 0 THEN 0 WHEN c_custkey % 2 = 0 THEN CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE -1 END WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END
+ CASE WHEN c_nationkey = 3 THEN 1 ELSE -1 END)::INT AS votes FROM customer""")
def context_votes(spark, d):
    """An area by its floor's slot, by what the grammar takes from the context, or not at all, some silenced; and a colour."""
    c = table(spark, d, "customer")
    colour = F.create_map(F.lit("colour"), F.concat(F.lit("no "), F.col("c_nationkey")))
    slots = F.when(F.col("c_custkey") % 2 == 0, F.map_concat(colour, F.create_map(F.lit("floor"), F.col("c_mktsegment")))).otherwise(colour)
    context = F.create_map(F.lit("area"), F.array(F.lit("building")), F.lit("colour"), F.array(F.lit("3"), F.lit("no")))
    none = F.array().cast("array<string>")
    given, silent = F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("area"))).otherwise(none), F.when(F.col("c_custkey") % 5 == 0, F.array(F.lit("area"))).otherwise(none)
    return c.select("c_custkey", score.context_agreement(slots, given, context, silent).alias("votes"))


@query("""SELECT c_custkey AS qid, CASE WHEN c_nationkey % 4 = 0 THEN ['area', 'floor'] WHEN c_nationkey % 4 = 1 THEN ['colour'] ELSE ['area', 'floor'] END AS silent FROM customer WHERE c_nationkey % 4 < 3""")
def stated_context(spark, d):
    """A spoken name or place silences places, a spoken colour colours; a value that isn't spoken whole silences nothing."""
    c = table(spark, d, "customer")
    k = F.col("c_nationkey") % 4
    slots = F.when(k == 0, F.create_map(F.lit("name"), F.lit("desk lamp"))).when(k == 1, F.create_map(F.lit("colour"), F.lit("red"))).when(k == 2, F.create_map(F.lit("area_name"), F.lit("hall"))).otherwise(F.create_map(F.lit("name"), F.lit("desk fan")))
    context = F.create_map(*[x for n in ("area", "floor", "colour") for x in (F.lit(n), F.array(F.lit("x")))])
    rows = c.select(F.col("c_custkey").alias("qid"), slots.alias("slots"), context.alias("context"), F.array(*[F.lit(w) for w in ("desk", "lamp", "red", "hall")]).alias("c_anchor"))
    return score.explicit_context_keys(rows).select("qid", F.sort_array("silent").alias("silent"))


@query("""SELECT c_custkey AS qid, r_name AS area, ['' || lower(r_name)] AS tokens FROM customer JOIN nation ON n_nationkey = CASE WHEN c_custkey % 3 = 0 THEN (c_nationkey + 1) % 25 ELSE c_nationkey END JOIN region ON r_regionkey = n_regionkey WHERE c_custkey % 7 > 0 AND r_name NOT LIKE '% %'""")
def area_context(spark, d):
    """The area of a request's satellite, else of its device, by name; requests whose device has none get no context."""
    c = table(spark, d, "customer").where("c_custkey % 7 >= 0")
    requests = c.select(F.col("c_custkey").alias("qid"), F.when((F.col("c_custkey") % 3 == 0) & (F.col("c_custkey") % 7 > 0), (F.col("c_nationkey") + 1) % 25).alias("satellite"), F.when(F.col("c_custkey") % 7 > 0, F.col("c_nationkey")).alias("device"))
    devices = table(spark, d, "nation").select(F.col("n_nationkey").alias("device"), F.col("n_regionkey").alias("area"))
    areas = table(spark, d, "region").select(F.col("r_regionkey").alias("area"), F.col("r_name").alias("name"))
    out = route.area_context(requests, devices, areas).where("context is not null")
    return out.select("qid", F.col("area_name").alias("area"), F.element_at("context", "area").alias("tokens")).where("area not like '% %'")


# --- competition -------------------------------------------------------------


def rival_rows(spark, d):
    """Two candidates a part: its own two words, or its first and another; the query has either."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("qid"), F.split(F.lower("p_name"), " ").alias("w"))
    rows = p.select("qid", "w", F.explode(F.array(F.lit(1), F.lit(2))).alias("rank"))
    own = F.when(F.col("rank") == 1, F.col("w")).otherwise(F.array(F.col("w")[0], F.lit("zzqqvv")))
    intent = F.when((F.col("rank") == 2) & (F.col("qid") % 3 == 0), "HassTurnOff").otherwise("HassTurnOn")
    said = F.when(F.col("qid") % 2 == 0, F.col("w")).otherwise(F.array(F.col("w")[0], F.lit("zzqqvv")))
    return rows.select(
        "qid", "rank", (F.col("qid") * 2 + F.col("rank")).alias("cid"), intent.alias("intent"), own.alias("slot_tokens"), F.array_join(own, " ").alias("norm"), F.create_map(F.lit("name"), F.array_join(own, " ")).alias("slots"),
        F.concat(F.array(F.lit("the")), said).alias("q_tokens"), F.array(F.array(F.lit("the"))).alias("literal_variants"),
    )


@query("SELECT p_partkey AS qid, unnest([1, 2]) AS rank, unnest([FALSE, p_partkey % 3 = 0 OR p_partkey % 2 = 1]) AS competes FROM part")
def competition_by_support(spark, d):
    """A row of rank 1's intent competes unless the query names what rank 1 has and not what the row has."""
    return decide.with_competition(rival_rows(spark, d)).select("qid", "rank", "competes")


@query("SELECT p_partkey AS qid, r AS rank, p_partkey * 2 + r + CASE WHEN p_partkey % 2 = 1 AND p_partkey % 3 > 0 THEN 1 ELSE 0 END AS cid FROM part, (VALUES (1), (2)) t(r) WHERE r = 1 OR p_partkey % 2 = 0 OR p_partkey % 3 = 0")
def unsupported_leaders(spark, d):
    """A leader goes where the query names the other row of its intent."""
    return decide.drop_unsupported_leaders(rival_rows(spark, d)).select("qid", "rank", F.col("cid"))


@query("""WITH p AS (SELECT unnest(['HassListAddItem', 'HassListCompleteItem', 'HassListRemoveItem', 'HassShoppingListAddItem', 'HassShoppingListCompleteItem', 'HassTurnOn', 'HassTurnOff', 'HassPauseTimer', 'HassUnpauseTimer', 'HassMediaNext', 'HassMediaPrevious']) AS i)
SELECT a.i AS a, b.i AS b, (a.i LIKE 'Hass%List%' AND b.i LIKE 'Hass%List%' AND ((a.i LIKE '%Add%' AND b.i LIKE '%Add%') OR (a.i NOT LIKE '%Add%' AND b.i NOT LIKE '%Add%' AND (a.i = b.i OR a.i = 'HassShoppingListCompleteItem' OR b.i = 'HassShoppingListCompleteItem')))) AS alike,
coalesce((a.i, b.i) IN (('HassTurnOn', 'HassTurnOff'), ('HassTurnOff', 'HassTurnOn'), ('HassPauseTimer', 'HassUnpauseTimer'), ('HassUnpauseTimer', 'HassPauseTimer'), ('HassMediaNext', 'HassMediaPrevious'), ('HassMediaPrevious', 'HassMediaNext')), FALSE) AS opposing FROM p a, p b""")
def intent_pairs(spark, d):
    names = ("HassListAddItem", "HassListCompleteItem", "HassListRemoveItem", "HassShoppingListAddItem", "HassShoppingListCompleteItem", "HassTurnOn", "HassTurnOff", "HassPauseTimer", "HassUnpauseTimer", "HassMediaNext", "HassMediaPrevious")
    a = spark.createDataFrame([(x, y) for x in names for y in names], "a string, b string")
    return a.select("a", "b", decide.equivalent_intents(F.col("a"), F.col("b")).alias("alike"), decide.opposing(F.col("a"), F.col("b")).alias("opposing"))


# --- placeholders -------------------------------------------------------------


@query("""WITH s AS (SELECT DISTINCT c_mktsegment AS v FROM customer UNION SELECT DISTINCT p_name FROM part)
SELECT 'add ' || v || ' to list' AS rehydrated, v AS item, 1.0::DOUBLE AS char, 1.0::DOUBLE AS fuzzy, 1.0::DOUBLE AS bm25, 1.0::DOUBLE AS intent_score, round((1 - 0.015 * len(string_split(v, ' ')))::DOUBLE, 6) AS final FROM s""")
def placeholder_ranking(spark, d):
    """What customers and parts are called, added to a list: the template is filled, scored as the text it then is, and loses a little for each word filled in."""
    said = table(spark, d, "customer").select(F.col("c_mktsegment").alias("v")).union(table(spark, d, "part").select("p_name")).distinct()
    queries = api.prepared_queries(said.select(F.xxhash64("v").alias("qid"), F.concat(F.lit("add "), "v", F.lit(" to list")).alias("text")))
    kinds = "cid long, text string, intent string, slots map<string,string>, wildcard_slots array<string>, literal_text string"
    docs = api.index.candidates(spark.createDataFrame([(1, "add item to list", "HassListAddItem", {"item": "item"}, ["item"], "add to list"), (2, "show the list", "HassListShow", {}, [], "show the list")], kinds))
    rows = api.rank(queries, docs).where("cid = 1")
    return rows.select("rehydrated", F.element_at("replacements", "item").alias("item"), *[F.round(c, 6).alias(c) for c in ("char", "fuzzy", "bm25", "intent_score", "final")])


# --- candidates made for a query ----------------------------------------------

GRAMMAR = {"x": {"lists": {"level": {"range": {"from": 50, "to": 0, "step": 5, "multiplier": 2}}}, "intents": {"Show": {"data": [{"sentences": ["show [all] {name} orders"]}]}, "Set": {"data": [{"sentences": ["set {name} to {level}"], "slots": {"domain": "r1"}}]}}}}


def nations(spark, d):
    """The nations by names that have no more than a letter in common."""
    return table(spark, d, "nation").withColumn("name", F.concat(F.lit("N "), F.upper(F.substring(F.md5(F.col("n_nationkey").cast("string").cast("binary")), 1, 8))))


def nation_queries(spark, d):
    n = nations(spark, d)
    show = n.select(F.col("n_nationkey").alias("qid"), F.concat(F.lit("show "), F.lower("name"), F.lit(" orders")).alias("text"))
    return api.prepared_queries(show.union(n.select(F.col("n_nationkey") + 100, F.concat(F.lit("set "), F.lower("name"), F.lit(" to "), F.col("n_nationkey") * 3))))


def nation_records(spark, d):
    n = nations(spark, d).select(F.col("n_nationkey").alias("key"), "name", F.concat(F.lit("r"), "n_regionkey").alias("domain"), F.array().cast("array<string>").alias("aliases"))
    none = spark.createDataFrame([], "key long, name string, aliases array<string>")
    return stores.registry(n, none, none)


NATIONS = "n AS (SELECT *, 'N ' || upper(substr(md5(n_nationkey::VARCHAR), 1, 8)) AS name FROM nation)"


@query(f"""WITH {NATIONS} SELECT n_nationkey::BIGINT AS qid, 'show ' || a || name || ' orders' AS text, 'Show' AS intent, name, NULL AS level FROM n, (VALUES (''), ('all ')) t(a)
UNION ALL SELECT n_nationkey + 100, 'set ' || name || ' to ' || n_nationkey * 3, 'Set', name, (n_nationkey * 6)::VARCHAR FROM n WHERE n_regionkey = 1 AND n_nationkey * 3 <= 50 AND n_nationkey * 3 % 5 = 0""")
def query_candidates(spark, d):
    """Sentences for the nations that queries name, and with numbers on a range's grid for those of one domain."""
    rows = dynamic.query_candidates(nation_queries(spark, d), dynamic.template_rows(spark, GRAMMAR), nation_records(spark, d))
    return rows.select(F.col("qid").cast("long").alias("qid"), "text", "intent", F.element_at("slots", "name").alias("name"), F.element_at("slots", "level").alias("level"))


@query(f"WITH {NATIONS} SELECT n_nationkey::BIGINT AS qid, lower(name) AS span FROM n")
def slot_windows(spark, d):
    q, t = nation_queries(spark, d), dynamic.template_rows(spark, GRAMMAR)
    return dynamic.windows(q, t, dynamic.opened(q, t)).select(F.col("qid").cast("long").alias("qid"), "span")


@query("SELECT n_nationkey::BIGINT AS qid, 0::BIGINT AS tid FROM nation UNION ALL SELECT n_nationkey + 100, 1 FROM nation")
def template_gate(spark, d):
    q, t = nation_queries(spark, d), dynamic.template_rows(spark, GRAMMAR)
    return dynamic.opened(q, t).select(F.col("qid").cast("long").alias("qid"), F.col("tid").cast("long").alias("tid"))


@query("""WITH p AS (SELECT DISTINCT lower(p_name) AS norm, p_type AS intent FROM part), k AS (SELECT n_nationkey AS qid, norm, intent, abs(len(norm) - 12) AS off FROM nation, p)
SELECT qid::BIGINT AS qid, norm, intent FROM k QUALIFY row_number() OVER (PARTITION BY qid ORDER BY off, norm, intent) <= 200""")
def closest_candidates(spark, d):
    """The 200 candidates of a query by relevance; here only lengths differ."""
    p = table(spark, d, "part").select(F.lower("p_name").alias("norm"), F.col("p_type").alias("intent")).distinct()
    none = F.array().cast("array<string>")
    key = S.relevance_key(F.col("norm"), F.lit("qqqqqqqqqqqq"), none, none)
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("qid")).join(p.withColumn("near", key))
    return dynamic.top_candidates(rows).select(F.col("qid").cast("long").alias("qid"), "norm", "intent")


@query("""WITH s AS (SELECT p_partkey, lower(p_name) AS norm, p_type AS intent, p_size % 2 = 0 AS custom FROM part), q AS (SELECT DISTINCT lower(p_name) AS norm FROM part WHERE p_partkey % 2 = 0)
SELECT norm, p_partkey AS cid, intent FROM q JOIN s USING (norm) QUALIFY row_number() OVER (PARTITION BY norm ORDER BY (NOT custom)::INT, p_partkey) = 1""")
def native_parses(spark, d):
    """The best of a query's exact parses over an expanded grammar: the user's own sentences first, then the first."""
    p = table(spark, d, "part")
    sentences = p.select(F.col("p_partkey").alias("cid"), F.lower("p_name").alias("norm"), F.col("p_type").alias("intent"), F.when(F.col("p_size") % 2 == 0, "custom_sentence").otherwise("built_in").alias("source"), F.col("p_partkey").alias("pos"))
    queries = p.where("p_partkey % 2 = 0").select(F.lower("p_name").alias("norm")).distinct().withColumn("qid", F.xxhash64("norm"))
    return evaluate.native_parses(queries, sentences, best=True).select("norm", "cid", "intent")
