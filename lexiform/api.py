"""The engine: candidates in, ranked rows and decisions out, for whole batches of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiform.config import CAP_TEMPLATE, RANK_CACHE, SOURCES, STORE_VERSION, Options
from lexiform.functions import similarity
from lexiform.functions import text as T
from lexiform.operators import decide, evaluate, grammar, index, merge, rehydrate, retrieve, route, score
from lexiform.shipping import ship
from lexiform.streaming import refresh
from lexiform.streaming.refresh import Generations, SingleFlight, drain
from lexiform.tables import release, result, scratch, settled, written


class EngineError(RuntimeError):
    """A request that the engine can't serve."""


def prepared_queries(queries: DataFrame, language: str | None = None) -> DataFrame:
    """Queries (qid, text, …) with norm, norm_nd (folded by ``language``'s rules), tokens and grams; blank ones go."""
    q = queries.withColumn("norm", T.normalize_any(F.col("text"))).where("norm <> ''")
    return q.withColumns({"norm_nd": T.fold(F.col("norm"), language), "tokens": T.tokens(F.col("norm")), "grams": T.char_ngrams(F.col("norm"))})


def with_vocabulary(queries: DataFrame, vocabulary: DataFrame, slot_words: DataFrame) -> DataFrame:
    """``queries`` with q_slot_tokens, q_other (words that no literal has, exactly or by position) and q_short (words of one or two characters that no literal has).

    ``vocabulary`` has the literals' words (token), ``slot_words`` the queries' slot words (qid, token).
    """
    spoken = slot_words.groupBy("qid").agg(F.collect_set("token").alias("q_slot_tokens"))  # at most a query's own words and their variations
    terms = retrieve.query_terms(queries)
    unknown = terms.join(vocabulary.select(F.col("token").alias("term")), "term", "left_anti")
    short = unknown.where("length(term) < 3").groupBy("qid").agg(F.collect_set("term").alias("q_short"))
    placed = similarity.positional_lookup(vocabulary, unknown).select("qid", "term").distinct()
    other = unknown.groupBy("qid").agg(F.collect_set("term").alias("__unknown")).join(placed.groupBy("qid").agg(F.collect_set("term").alias("__placed")), "qid", "left")
    out = queries.join(spoken, "qid", "left").join(short, "qid", "left").join(other, "qid", "left")
    none = F.array().cast("array<string>")
    unknown_ = F.coalesce("__unknown", none)
    return out.withColumns({"q_slot_tokens": F.coalesce("q_slot_tokens", none), "q_short": F.coalesce("q_short", none), "q_other": F.array_except(unknown_, F.coalesce("__placed", none))}).drop("__unknown", "__placed")


def ranked(rows: DataFrame, o: Options) -> DataFrame:
    """Scored rows in order, with ties, competition and limit."""
    if "preferences" in rows.columns:
        rows = rows.withColumn("preference", decide.slot_preference(F.coalesce("replacements", F.create_map().cast("map<string,string>")), F.col("preferences")))
    return decide.limited(decide.with_competition(decide.disambiguated(decide.ordered(rows))), o.max_candidates)


def rank(queries: DataFrame, docs: DataFrame, options: Options | None = None, fill: bool = True, reference: DataFrame | None = None) -> DataFrame:
    """Ranked candidates of every query: exact matches with full scores, else prefilter, rescues, placeholders filled, scores, order, ties, competition, limit.

    ``queries`` is from ``prepared_queries`` (a ``context`` map and ``preferences`` are used where they are), ``docs`` from ``index.candidates`` or ``index.build``. With ``fill`` a window that
    evidence doesn't fill takes the first candidates without any. ``reference`` is the corpus whose word weights count (``docs`` by default).
    What several branches read is written once; those tables are deleted again, and the result is a written table itself.
    """
    o = options or Options()
    with scratch(queries.sparkSession):
        queries, docs = settled(queries, "queries"), settled(docs, "candidates")
        hits = retrieve.exact(queries, docs, o.max_candidates)
        folded = retrieve.exact_folded(queries.join(hits.select("qid").distinct(), "qid", "left_anti"), docs)
        whole = written(hits.select("qid", "cid").union(folded), "exact")
        rest = written(queries.join(whole.select("qid").distinct(), "qid", "left_anti"), "rest")
        raw = written(retrieve.bm25_raw(rest, index.postings(docs)), "bm25")
        scores = written(retrieve.touched(rest, None, index.gram_postings(docs), raw), "touched")  # the rescues need those beyond the window too
        found = retrieve.first(scores)
        found = written(retrieve.filled(found, rest, docs) if fill else found, "window")
        vocabulary = written(index.literal_vocabulary(docs), "vocabulary")
        matched = written(retrieve.slot_tokens_of_queries(rest, index.slot_index(docs), vocabulary), "slot-words")
        extra = written(retrieve.slot_rescue(rest, docs, matched, found, scores=scores), "rescued")
        passed = written(retrieve.wildcard_pass(docs.where(F.size("wildcard_slots") > 0), rest), "passed")
        wild = retrieve.wildcard_rescue(passed, found.unionByName(extra, allowMissingColumns=True), scores=scores)
        more = retrieve.with_evidence(extra.union(wild).distinct(), scores).select("qid", "cid", "bm25", "char")
        pairs = written(found.select("qid", "cid", "bm25", "char").union(more), "pairs")
        asked = written(with_vocabulary(rest, vocabulary, matched.select("qid", "token")), "asked")
        rows = score.paired(pairs, asked, docs)
        open_ = pairs.join(passed.select("qid", "cid"), ["qid", "cid"], "left_semi").join(docs.where(F.size("wildcard_slots") > 0).select("cid"), "cid", "left_semi")
        if open_.isEmpty():
            rows = rows.where(F.size("wildcard_slots") == 0)
        else:
            corpus = docs if reference is None else reference
            tops = raw.groupBy("qid").agg(F.max("raw").alias("top"))
            filled = written(rehydrate.rescored(score.paired(open_, asked, docs), index.term_stats(corpus), index.corpus_stats(corpus), tops), "filled")
            rows = rows.where(F.size("wildcard_slots") == 0).unionByName(filled, allowMissingColumns=True)
        rows = score.finished(rows, "context" in queries.columns, o.min_confidence)
        one = F.lit(1.0)
        sure = whole.join(docs, "cid").join(queries.select("qid", F.col("text").alias("query"), F.col("norm").alias("q_norm"), F.col("tokens").alias("q_tokens")), "qid")
        sure = sure.withColumns({c: one for c in ("bm25", "char", "fuzzy", "intent_score", "weighted", "final")}).withColumns({"concrete_tokens": F.col("slot_tokens"), "replacement_words": F.lit(0).cast("long")})
        return result(ranked(written(rows.unionByName(sure, allowMissingColumns=True), "scored"), o), "ranked")


def decisions(rows: DataFrame, options: Options | None = None, queries: DataFrame | None = None) -> DataFrame:
    """One decision for each query of ranked ``rows``; those of ``queries`` (qid) without a row are rejected for want of a candidate.

    Leaders whose target the query doesn't name go first, where it names that of a lower row.
    """
    o = options or Options()
    rows = written(decide.with_competition(decide.drop_unsupported_leaders(settled(rows, "ranked")).drop("competes")), "leaders")
    found = decide.evidence(rows)
    if queries is not None:
        found = queries.select("qid").distinct().join(found, "qid", "left")
    return decide.decision(found, o.min_confidence, o.min_margin)


def rank_own(queries: DataFrame, candidates: DataFrame, docs: DataFrame, options: Options | None = None, language: str | None = None) -> DataFrame:
    """Ranked candidates that each belong to one query (qid, cid, text, intent, …); words weigh as in ``docs``, and raw scores are set against the better of both corpora's best."""
    o = options or Options()
    queries = settled(queries, "queries")
    own = written(index.candidates(candidates.join(queries.select("qid"), "qid", "left_semi"), language), "own")
    stats, corpus = index.term_stats(docs), index.corpus_stats(docs)
    terms = own.select("qid", "cid", "tokens", F.explode(F.array_distinct("tokens")).alias("term")).join(retrieve.query_terms(queries), ["qid", "term"])
    terms = terms.join(stats.select("term", "idf"), "term", "left").crossJoin(F.broadcast(corpus))  # broadcast: one row
    weight = index.bm25_weight(F.coalesce("idf", F.log1p((F.col("n") + 0.5) / 0.5)), F.size(F.filter("tokens", lambda t: t == F.col("term"))), F.size("tokens"), F.col("avgdl"))
    raw = terms.groupBy("qid", "cid").agg(F.sum(weight).alias("raw"))
    bm25 = retrieve.rescaled(raw, retrieve.bm25_raw(queries, index.postings(docs)))
    both = own.join(queries.select("qid", F.col("grams").alias("q_grams"), F.col("norm").alias("__q")), "qid").select("qid", "cid", similarity.jaccard(F.col("grams"), F.col("q_grams")).alias("char"), (F.col("norm") == F.col("__q")).alias("whole"))
    pairs = both.join(bm25, ["qid", "cid"], "left").select("qid", "cid", F.coalesce("bm25", F.lit(0.0)).alias("bm25"), "char", "whole")
    slots = own.select("qid", F.explode("slot_tokens").alias("token")).join(retrieve.query_terms(queries).withColumnRenamed("term", "token"), ["qid", "token"]).distinct()
    asked = with_vocabulary(queries, index.literal_vocabulary(docs.select("literal_variants").union(own.select("literal_variants"))), slots)
    rows = score.finished(score.paired(pairs.drop("whole"), asked, own.drop("qid")), "context" in queries.columns, o.min_confidence)
    whole = pairs.where("whole").select("qid", "cid", F.lit(True).alias("__whole"))
    rows = rows.join(whole, ["qid", "cid"], "left")
    rows = rows.withColumns({c: F.when(F.col("__whole"), 1.0).otherwise(F.col(c)) for c in ("bm25", "char", "fuzzy", "intent_score", "weighted", "final")}).drop("__whole")
    return result(ranked(written(rows, "scored"), o), "ranked")


class Engine:
    """Holds candidates by language and serves ranking, matching, diagnostics and evaluation."""

    def __init__(self, spark: SparkSession, options: Options | None = None):
        ship(spark)
        self.spark, self.options = spark, options or Options()
        self.generations = Generations()
        self._flight = SingleFlight(self.generations)
        self._index: dict[str, DataFrame] = {}
        self._memo: DataFrame | None = None
        self._snapshots: dict[str, tuple[tuple[int, ...], object]] = {}
        self.wildcards: dict[str, frozenset[str]] = {}
        self.closed = False

    def load_candidates(self, rows: DataFrame, language: str) -> DataFrame:
        """Builds a language's index from candidate rows; concurrent calls share one build."""
        if self.closed:
            raise EngineError("the engine is closed")
        code = language.strip().lower().replace("_", "-")
        if not code:
            raise EngineError("a language must not be blank")

        def build() -> DataFrame:
            return result(index.build(rows, code), "index")

        self._index[code] = self._flight.run(code, build)
        return self._index[code]

    def load_grammar(self, templates: DataFrame, language: str) -> DataFrame:
        """Builds an index from grammar rows (see ``sources.stores.grammar_rows``)."""
        names = templates.select(F.explode("wildcards").alias("w")).distinct().collect()  # a grammar's placeholders
        self.wildcards = {**self.wildcards, language.strip().lower().replace("_", "-"): frozenset(r.w for r in names)}
        sentences = grammar.expanded(templates, CAP_TEMPLATE)
        value = lambda k, v: F.coalesce(F.element_at(F.element_at(F.col("outputs"), k), v), v)
        slots = F.map_concat(F.transform_values("bindings", value), F.map_filter("static", lambda k, v: ~F.map_contains_key("bindings", k)))
        # a candidate is told by its template and its place among that one's sentences, of which there are at most CAP_TEMPLATE
        rows = sentences.select(
            (F.col("pos") * CAP_TEMPLATE + F.col("sentence_pos")).alias("cid"), F.col("sentence").alias("text"), "intent", "source", slots.alias("slots"), F.col("bindings").alias("slots_raw"),
            F.map_keys("static").alias("static_slots"), F.map_keys("context").alias("context_slots"), F.filter("wildcards", lambda w: F.map_contains_key("bindings", w)).alias("wildcard_slots"), "literal_text", F.concat_ws("/", "source_key", "intent", "item").alias("item"),
        )
        return self.load_candidates(rows, language)

    def index_of(self, language: str) -> DataFrame:
        try:
            return self._index[language.strip().lower().replace("_", "-")]
        except KeyError:
            raise EngineError(f"no index for {language}") from None

    def rank(self, queries: DataFrame, language: str) -> DataFrame:
        return rank(prepared_queries(queries, language), self.index_of(language), self.options)

    def rank_and_evaluate(self, queries: DataFrame, language: str, dynamic: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """(ranked, decisions); ``dynamic`` are query-time candidates (see ``dynamic.query_candidates``), ranked for the queries that the static pass doesn't settle."""
        q = written(prepared_queries(queries, language), "queries")
        docs = self.index_of(language)
        rows = rank(q, docs, self.options)
        if dynamic is not None:
            more = rank_own(written(merge.dynamic_queries(q, rows), "open"), dynamic, docs, self.options, language)
            both = merge.merged(rows.drop("rank", "competes"), more.drop("rank", "competes"))
            rows = ranked(both, self.options)
        return rows, decisions(rows, self.options, q)

    def evaluate(self, queries: DataFrame, language: str) -> DataFrame:
        """The decision of each query (qid, text, context if any). Requests that are alike are ranked once, and accepted decisions are kept for later calls.

        They hold as long as the index, the options and the sources don't change; the RANK_CACHE last used ones stay.
        """
        q = prepared_queries(queries, language)
        key = refresh.request_key(F.lit(language), F.col("norm"), F.col("context") if "context" in q.columns else None)
        q = written(q.withColumn("key", key), "requests")
        generation = sum(self.generations.token())
        fresh = refresh.cache_misses(q, self._memo, generation) if self._memo is not None else q.dropDuplicates(["key"])
        fresh = written(fresh, "misses")
        found = None
        if not fresh.isEmpty():
            decided = self.rank_and_evaluate(fresh.drop("norm", "norm_nd", "tokens", "grams"), language)[1]
            found = written(fresh.select("qid", "key").join(decided, "qid").drop("qid"), "decided")
        now = F.current_timestamp()
        old = None if self._memo is None else self._memo.join(q.select("key").distinct(), "key", "left_semi").where(F.col("generation") == generation)
        used = [x for x in (old, found) if x is not None]
        rows = used[0] if len(used) == 1 else used[0].unionByName(used[1], allowMissingColumns=True)
        out = written(q.select("qid", "key").join(rows.drop("generation", "used_at"), "key").drop("key"), "decisions")
        fresh_rows = rows.drop("generation").withColumn("used_at", now)
        empty = fresh_rows.withColumn("generation", F.lit(generation)).limit(0)
        self._memo = written(refresh.remembered(empty if self._memo is None else self._memo, fresh_rows, generation, RANK_CACHE), "memo")
        return out

    def prepare(self, languages: list[str]) -> DataFrame:
        """(language, candidates, generation) of each language's index, read through once so that its files are at hand."""
        stamp = sum(self.generations.token())
        rows = [(code, self.index_of(code).count(), stamp) for code in languages]
        return self.spark.createDataFrame(rows, "language string, candidates long, generation long")

    def snapshot(self, language: str, make: Callable[[], object]) -> object:
        """What ``make`` gives for a language (templates, registry records, …), made again only after a generation has changed; concurrent calls share one."""
        code = language.strip().lower().replace("_", "-")
        have = self._snapshots.get(code)
        if have is None or have[0] != self.generations.token():
            value = self._flight.run(f"snapshot {code}", make)
            have = self._snapshots[code] = (self.generations.token(), value)
        return have[1]

    def test_match(self, text: str, language: str) -> DataFrame:
        """The ranked rows of one text, lexical scores only."""
        return self.rank(self.spark.createDataFrame([(0, text)], "qid long, text string"), language).orderBy("rank")

    def route(self, queries: DataFrame, language: str, recognise: Callable[[str], tuple[str, str | None]] | None = None, shortcut: Callable[[Column], Column] | None = None) -> DataFrame:
        """qid, route, reason, delegated for requests (qid, text).

        ``recognise`` maps a text to (kind, intent): accepted texts are then validated by it, a few in order of rank. ``shortcut`` tells the texts that the
        native path takes. A text is handed on with its placeholders filled; where one stays open the original goes.
        """
        q = route.hotword_similarity(prepared_queries(queries, language), list(self.options.hotwords), self.options.hotword_confidence)
        docs = self.index_of(language)
        rows, found = self.rank_and_evaluate(queries, language)
        text = F.coalesce("rehydrated", F.when(F.size("wildcard_slots") == 0, F.col("text"))) if "rehydrated" in rows.columns else F.col("text")
        out = q.join(found.select("qid", "accepted", "accepted_cid", "rejection_reason"), "qid", "left")
        best = rows.select("qid", F.col("cid").alias("accepted_cid"), text.alias("canonical"))
        out = out.join(best, ["qid", "accepted_cid"], "left").withColumn("valid", F.lit(True))
        if recognise is not None:
            tried = rows.join(found.where("accepted").select("qid"), "qid", "left_semi").select("qid", F.col("rank").cast("int").alias("rank"), text.alias("text"), "intent", F.lit(True).alias("accepted")).where("text is not null")
            seen = route.preflight(tried, recognise).select("qid", F.col("text").alias("__valid"))
            out = out.drop("valid").join(seen, "qid", "left").withColumns({"valid": F.col("__valid").isNotNull(), "canonical": F.coalesce("__valid", "canonical")})
        native = F.lit(False) if shortcut is None else shortcut(F.col("text"))
        where, why = route.route(F.col("matched"), native, F.lit(not docs.isEmpty()), F.coalesce("accepted", F.lit(False)), F.col("rejection_reason"), F.col("valid"))
        return out.select("qid", where.alias("route"), why.alias("reason"), route.delegated(F.col("text"), F.col("canonical"), where).alias("delegated"))

    def dump_candidates(self, language: str, sample: int = 50) -> tuple[DataFrame, DataFrame]:
        """Counts by source and intent, and a sample of the rows."""
        rows = self.index_of(language)
        return evaluate.counts(rows, "source", "intent"), rows.orderBy("pos").limit(sample)

    def diagnostics(self) -> DataFrame:
        """One row a language: candidates by source, intents, slots, placeholders, words of its literals, n-grams, its fingerprint, version and generation, and what is remembered."""
        kinds = "language string, candidates long, custom long, built_in long, generated long, intents long, slots long, wildcards long, wildcard_names long, static_rows long, context_rows long, literal_words long, tokens long, grams long, fingerprint string, index_version int, generation long, remembered long"
        kept = 0 if self._memo is None else self._memo.count()
        rows = []
        for code, docs in self._index.items():
            by = [F.count_if(F.col("source") == x) for x in SOURCES]
            some = lambda c: F.count_if(F.size(c) > 0)
            counts = docs.agg(F.count("*"), *by, F.countDistinct("intent"), F.coalesce(F.sum("n_slots"), F.lit(0)), some("wildcard_slots")).first()
            more = docs.agg(some("static_slots"), some("context_slots")).first()
            sizes = docs.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0)), F.coalesce(F.sum("n_grams"), F.lit(0))).first()
            rows.append((code, *counts, len(self.wildcards.get(code, ())), *more, index.literal_vocabulary(docs).count(), *sizes, index.fingerprint(docs, "norm", "intent", "slots", "source").first()[0], STORE_VERSION, sum(self.generations.token()), kept))
        return self.spark.createDataFrame(rows, kinds)

    def clear_index(self, language: str | None = None) -> int:
        """Forgets one language's index, or all; returns how many there were."""
        gone = [k for k in self._index if language is None or k == language.strip().lower().replace("_", "-")]
        for k in gone:
            self._index.pop(k)
        self.generations.bump("index")
        self._memo = None
        return len(gone)

    def register_functions(self) -> None:
        """Makes the engine's functions usable from SQL."""
        self.spark.udf.register("lex_normalize", T.normalize_arrow)
        self.spark.udf.register("lex_fuzzy", similarity.fuzzy)
        self.spark.udf.register("lex_ratio", similarity.indel_ratio)
        self.spark.udtf.register("expand_template", grammar.ExpandTemplate)

    def close(self) -> None:
        """Refuses new work, drops indexes, stops streams."""
        self.closed = True
        self.clear_index()
        release(self.spark)
        drain(self.spark)


__all__ = ["Engine", "EngineError", "Options", "decisions", "prepared_queries", "rank", "rehydrate"]
