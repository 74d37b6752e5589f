"""Retrieval: BM25 and n-gram joins, exact lookups, typo-tolerant token joins, prefilters and rescues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiform.config import BM25_B, BM25_K1, CAP_NOMINATED, CAP_SCORED, CAP_SLOT_VALUES, PREFILTER, SLOT_RESCUE, W_BM25, W_CHAR, WILDCARD_COVERAGE, WILDCARD_RESCUE
from lexiform.functions import similarity as S
from lexiform.functions import text as T
from lexiform.operators import index as ix


def query_terms(queries: DataFrame) -> DataFrame:
    return queries.select("qid", F.explode(F.array_distinct("tokens")).alias("term"))


def bm25_raw(queries: DataFrame, posts: DataFrame, key: str = "cid") -> DataFrame:
    """(qid, key, raw): summed weights of the distinct query terms, touched documents only."""
    return query_terms(queries).join(posts, "term").groupBy("qid", key).agg(F.sum("w").alias("raw"))


def relative(raw: DataFrame) -> DataFrame:
    """Scores over the best of their query."""
    return raw.withColumn("bm25", F.col("raw") / F.max("raw").over(Window.partitionBy("qid"))).drop("raw")


def bm25_sparse(queries: DataFrame, posts: DataFrame, key: str = "cid") -> DataFrame:
    return relative(bm25_raw(queries, posts, key))


def bm25_dense(queries: DataFrame, docs: DataFrame, posts: DataFrame, key: str = "cid") -> DataFrame:
    """Every (query, document) with its score, 0 where no term meets. The pairs are the result; queries are a stated, small set."""
    pairs = queries.select("qid").crossJoin(docs.select(key))
    return pairs.join(bm25_sparse(queries, posts, key), ["qid", key], "left").withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))


def bm25_foreign(queries: DataFrame, others: DataFrame, docs: DataFrame, key: str = "cid", own: str = "cid", k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """(qid, key, raw) of ``others`` by the weights and mean length of the corpus ``docs``; terms it lacks weigh log(1 + (n + .5) / .5)."""
    ix.check_bm25(k1, b)
    stats = F.broadcast(ix.corpus_stats(docs))  # broadcast: one row
    tf = query_terms(queries).join(ix.term_frequencies(others, key), "term").join(ix.term_stats(docs, own).select("term", "idf"), "term", "left").crossJoin(stats)
    weight = F.coalesce("idf", F.log1p((F.col("n") + 0.5) / 0.5))
    return tf.groupBy("qid", key).agg(F.sum(ix.bm25_weight(weight, F.col("tf"), F.col("len"), F.col("avgdl"), k1, b)).alias("raw"))


def rescaled(dynamic: DataFrame, static: DataFrame, key: str = "cid") -> DataFrame:
    """Dynamic raw scores over the stronger of both corpora's best, per query."""
    top = static.groupBy("qid").agg(F.max("raw").alias("__static"))
    best = F.greatest(F.max("raw").over(Window.partitionBy("qid")), F.coalesce("__static", F.lit(0.0)))
    return dynamic.join(top, "qid", "left").select("qid", key, (F.col("raw") / best).alias("bm25"))


def rehydrated_bm25(raw: Column, top: Column) -> Column:
    return F.when(top <= 0, F.when(raw > 0, 1.0).otherwise(0.0)).otherwise(F.least(F.lit(1.0), raw / top))


def ngram_overlaps(queries: DataFrame, grams: DataFrame, key: str = "cid") -> DataFrame:
    """(qid, key, common, n_query, n_grams) for every pair with a gram in common."""
    q = queries.select("qid", F.size("grams").alias("n_query"), F.explode("grams").alias("gram"))
    return q.join(grams, "gram").groupBy("qid", key, "n_query", "n_grams").agg(F.count("*").alias("common"))


def ngram_jaccard(queries: DataFrame, grams: DataFrame, key: str = "cid") -> DataFrame:
    o = ngram_overlaps(queries, grams, key)
    return o.select("qid", key, (F.col("common") / (F.col("n_query") + F.col("n_grams") - F.col("common"))).alias("char"))


def exact(queries: DataFrame, docs: DataFrame, limit: int = 20) -> DataFrame:
    """(qid, cid, rank): candidates whose normalised text is the query, in order of pos, ``limit`` at most."""
    hits = queries.select("qid", "norm").join(docs.select("norm", "cid", "pos"), "norm")
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("pos"))).where(F.col("rank") <= limit).select("qid", "cid", "rank")


def exact_folded(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """As ``exact`` on folded texts, for queries whose hits agree in intent and slots."""
    hits = queries.select("qid", "norm_nd").join(docs.select("norm_nd", "cid", "pos", "intent", "slots"), "norm_nd")
    slots = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("slots"))))
    hits = hits.withColumn("__s", slots)
    sure = hits.groupBy("qid").agg(F.countDistinct("intent").alias("i"), F.countDistinct("__s").alias("s")).where("i = 1 and s = 1").select("qid")
    return hits.join(sure, "qid", "left_semi").select("qid", "cid")


def touched(queries: DataFrame, posts: DataFrame, grams: DataFrame, raw: DataFrame | None = None) -> DataFrame:
    """(qid, cid, bm25, char, key) of every pair with a term or gram in common; two sparse joins meet in a full outer one. ``raw`` is ``bm25_raw`` where it's at hand."""
    both = relative(bm25_raw(queries, posts) if raw is None else raw).join(ngram_jaccard(queries, grams), ["qid", "cid"], "full").fillna(0.0, ["bm25", "char"])
    return both.withColumn("key", F.round(W_CHAR * F.col("char") + W_BM25 * F.col("bm25"), 12))


def first(pairs: DataFrame, k: int = PREFILTER) -> DataFrame:
    """``pairs`` with rank, the k best of each query by key, ties by cid."""
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("key"), "cid"))).where(F.col("rank") <= k)


def prefilter(queries: DataFrame, posts: DataFrame, grams: DataFrame, k: int = PREFILTER) -> DataFrame:
    """(qid, cid, bm25, char, key, rank): the k best by weighted n-gram and BM25 evidence, ties by cid."""
    return first(touched(queries, posts, grams), k)


def with_evidence(pairs: DataFrame, scores: DataFrame | None) -> DataFrame:
    """``pairs`` (qid, cid, …) with bm25, char and key from ``scores`` (see ``touched``), 0 for pairs without any."""
    if scores is None:
        return pairs.withColumns({c: F.lit(0.0) for c in ("bm25", "char", "key")})
    return pairs.join(scores.select("qid", "cid", "bm25", "char", "key"), ["qid", "cid"], "left").fillna(0.0, ["bm25", "char", "key"])


def filled(found: DataFrame, queries: DataFrame, docs: DataFrame, k: int = PREFILTER) -> DataFrame:
    """``found`` filled up to k rows a query with the first untouched candidates, whose evidence is 0."""
    first = docs.orderBy("cid").limit(k).select("cid")  # k more rows suffice, whichever are touched
    rest = queries.select("qid").crossJoin(F.broadcast(first)).join(found.select("qid", "cid"), ["qid", "cid"], "left_anti")  # broadcast: k rows
    zero = F.lit(0.0)
    all_ = found.drop("rank").unionByName(rest.select("qid", "cid", zero.alias("bm25"), zero.alias("char"), zero.alias("key")))
    return all_.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("key"), "cid"))).where(F.col("rank") <= k)


def slot_tokens_of_queries(queries: DataFrame, slots: DataFrame, literals: DataFrame | None = None) -> DataFrame:
    """(qid, token, how): slot tokens that a query has exactly or one edit away.

    A join on deletion neighbourhoods nominates, the bounded match decides; literal words of the grammar count exactly only.
    """
    q = queries.select("qid", F.explode(F.array_distinct("tokens")).alias("q"))
    if literals is not None:
        q = q.join(literals.select(F.col("token").alias("q"), F.lit(True).alias("lit")), "q", "left")
    else:
        q = q.withColumn("lit", F.lit(None).cast("boolean"))
    tokens = slots.select("token").distinct()
    same = q.join(tokens, q.q == tokens.token).select("qid", "token", F.lit("exact").alias("how"))
    keys = q.where("lit is null and length(q) >= 4").select("qid", "q", F.explode(F.array_union(F.array("q"), T.deletions(F.col("q")))).alias("key_token"))
    near = keys.join(slots.select("key_token", "token").distinct(), "key_token").where(S.slot_token_match(F.col("token"), F.col("q"))).select("qid", "token", F.lit("edit").alias("how"))
    return same.union(near).groupBy("qid", "token").agg(F.max("how").alias("how"))


def slot_rescue(queries: DataFrame, docs: DataFrame, matched: DataFrame, found: DataFrame, k: int = SLOT_RESCUE, scores: DataFrame | None = None) -> DataFrame:
    """(qid, cid): up to k more candidates whose every slot token is matched, most tokens first, then best evidence in ``scores``, then cid."""
    need = docs.select("cid", F.size("slot_tokens").alias("n"), F.explode("slot_tokens").alias("token"))
    full = need.join(matched.select("qid", "token"), "token").groupBy("qid", "cid", "n").agg(F.count("*").alias("have")).where("have = n")
    full = full.join(found.select("qid", "cid"), ["qid", "cid"], "left_anti")
    full = with_evidence(full, scores)
    return full.withColumn("rn", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("n"), F.desc("key"), "cid"))).where(F.col("rn") <= k).select("qid", "cid")


def wildcard_pass(docs: DataFrame, queries: DataFrame, share: float = WILDCARD_COVERAGE) -> DataFrame:
    """(qid, cid, coverage, matched): candidates with a literal variant whose words the query has to the asked share; empty variants always pass.

    The variants' words are joined with the queries' words, so pairs without a word in common are never made.
    """
    v = docs.select("cid", F.posexplode("literal_variants").alias("v", "words")).select("cid", "v", F.size("words").alias("n"), "words")
    hit = v.select("cid", "v", "n", F.explode("words").alias("term")).join(query_terms(queries), "term").groupBy("qid", "cid", "v", "n").agg(F.count("*").alias("matched"))
    hit = hit.where(F.col("matched") >= F.ceil(F.col("n") * share)).groupBy("qid", "cid").agg(F.max(F.struct((F.col("matched") / F.col("n")).alias("coverage"), "matched")).alias("m")).select("qid", "cid", "m.coverage", "m.matched")
    free = docs.where(F.exists("literal_variants", lambda x: F.size(x) == 0)).select("cid").crossJoin(queries.select("qid")).select("qid", "cid", F.lit(1.0).alias("coverage"), F.lit(0).cast("long").alias("matched"))
    return hit.union(free).groupBy("qid", "cid").agg(F.max("coverage").alias("coverage"), F.max("matched").alias("matched"))


def wildcard_rescue(passed: DataFrame, found: DataFrame, k: int = WILDCARD_RESCUE, scores: DataFrame | None = None) -> DataFrame:
    """(qid, cid): up to k more candidates that passed, by coverage, matched words, then best evidence in ``scores``, then cid."""
    rest = with_evidence(passed.join(found.select("qid", "cid"), ["qid", "cid"], "left_anti"), scores)
    order = Window.partitionBy("qid").orderBy(F.desc("coverage"), F.desc("matched"), F.desc("key"), "cid")
    return rest.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k).select("qid", "cid")


def registry_hits(queries: DataFrame, records: DataFrame, nominated: int = CAP_NOMINATED, kept: int = CAP_SLOT_VALUES) -> DataFrame:
    """(qid, slot, position, exact, phrase, full, matched, n): registry values a query speaks of, ``kept`` a slot at most.

    Tokens met exactly and tokens one edit away nominate ``nominated`` values a slot and CAP_SCORED a query by their count; the match key (exact, phrase, full, matched, fewer tokens)
    decides, for which tokens are matched one to one. A value needs two matched tokens, or all it has; one short token counts exactly only. Where a value of four characters and more is
    met exactly and whole, edits nominate nothing in its slot.
    """
    q = queries.select("qid", "norm", F.explode(F.array_distinct("tokens")).alias("q"))
    rec = records.select("slot", "position", "norm", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    same = q.join(rec.drop("norm"), q.q == rec.token).select("qid", "slot", "position", "n", "token", F.lit(1).alias("hit"))
    near = q.where("length(q) >= 4").select("qid", "q", F.explode(F.array_union(F.array("q"), T.deletions(F.col("q")))).alias("key"))
    near = near.join(ix.registry_fuzzy(records), "key").where(S.registry_token_match(F.col("token"), F.col("q"))).select("qid", "slot", "position", "token").distinct()
    near = near.join(rec.select("slot", "position", "n").distinct(), ["slot", "position"]).select("qid", "slot", "position", "n", "token", F.lit(0).alias("hit"))
    sure = same.groupBy("qid", "slot", "position", "n").agg(F.count_distinct("token").alias("have")).where("have = n").join(records.select("slot", "position", F.col("norm").alias("own")), ["slot", "position"]).where("length(own) >= 4").select("qid", "slot").distinct()
    near = near.join(sure, ["qid", "slot"], "left_anti")
    hits = same.union(near).groupBy("qid", "slot", "position", "n", "token").agg(F.max("hit").alias("hit")).groupBy("qid", "slot", "position", "n").agg(F.count("*").alias("matched"), F.sum("hit").alias("sure"))
    hits = hits.where((F.col("matched") >= F.least(F.lit(2), F.col("n"))))
    cheap = Window.partitionBy("qid", "slot").orderBy(F.desc("sure"), F.desc("matched"), "n", "position")
    hits = hits.withColumn("rn", F.row_number().over(cheap)).where(F.col("rn") <= nominated)
    budget = Window.partitionBy("qid").orderBy("rn", F.desc("sure"), F.desc("matched"), "n", "slot", "position")
    hits = hits.withColumn("rn", F.row_number().over(budget)).where(F.col("rn") <= max(CAP_SCORED, nominated)).drop("rn")
    hits = hits.join(records.select("slot", "position", F.col("norm").alias("value"), F.col("tokens").alias("own")), ["slot", "position"]).join(queries.select("qid", F.col("norm").alias("query"), F.col("tokens").alias("said")), "qid")
    hits = hits.withColumn("matched", F.when(F.col("sure") == F.col("n"), F.col("matched")).otherwise(S.registry_count("own", "said").cast("long"))).where((F.col("matched") >= F.least(F.lit(2), F.col("n")))).drop("own", "said")
    key = {"exact": (F.col("value") == F.col("query")).cast("int"), "phrase": T.has_phrase(F.col("query"), F.col("value")).cast("int"), "full": (F.col("matched") == F.col("n")).cast("int")}
    hits = hits.withColumns(key).where((F.col("n") > 1) | (F.length("value") > 3) | (F.col("phrase") == 1))
    best = Window.partitionBy("qid", "slot").orderBy(F.desc("exact"), F.desc("phrase"), F.desc("full"), F.desc("matched"), "n", "position", "value")
    return hits.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= kept).select("qid", "slot", "position", "exact", "phrase", "full", "matched", "n")
