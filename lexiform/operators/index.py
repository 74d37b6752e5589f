"""Index build: candidate rows, corpus statistics, postings, slot and registry indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiform.config import BM25_B, BM25_K1, CAP_INTENT, CAP_LANGUAGE, SOURCES
from lexiform.functions import text as T
from lexiform.tables import written

#: The columns of a candidate that the index needs; all but cid, text and intent may be missing.
OPTIONAL = {
    "source": "string", "language": "string", "slots": "map<string,string>", "slots_raw": "map<string,string>", "static_slots": "array<string>",
    "context_slots": "array<string>", "wildcard_slots": "array<string>", "query_slots": "array<string>", "literal_text": "string", "pos": "long",
}


def candidates(rows: DataFrame, language: str | None = None) -> DataFrame:
    """Candidate rows with every derived column; rows with a blank text or intent go. Texts are folded by ``language``'s rules.

    Missing optional columns and nulls in them become their empty value; ``pos`` defaults to cid and orders ties.
    """
    rows = rows.where((F.trim("text") != "") & (F.trim("intent") != ""))
    for name, kind in OPTIONAL.items():
        if name not in rows.columns:
            empty = F.col("cid").cast("long") if name == "pos" else F.lit("built_in") if name == "source" else F.create_map().cast(kind) if kind[:3] == "map" else F.array().cast(kind) if kind[:5] == "array" else F.lit(None).cast(kind)
            rows = rows.withColumn(name, empty)
        elif kind[:3] == "map" or kind[:5] == "array":
            rows = rows.withColumn(name, F.coalesce(F.col(name).cast(kind), (F.create_map() if kind[:3] == "map" else F.array()).cast(kind)))
    rows = rows.withColumn("norm", T.normalize_any(F.col("text"))).where("norm <> ''")
    rows = rows.withColumns({"norm_nd": T.fold(F.col("norm"), language), "tokens": T.tokens(F.col("norm")), "grams": T.char_ngrams(F.col("norm"))})
    slot_tokens = F.array_distinct(F.flatten(F.transform(F.map_values("slots"), lambda v: T.slot_value_tokens(v))))
    variants = F.when(F.col("literal_text").isNull(), F.array().cast("array<array<string>>")).otherwise(T.literal_variants(F.col("literal_text")))
    return rows.withColumns({"n_grams": F.size("grams"), "slot_tokens": slot_tokens, "literal_variants": variants, "n_slots": F.size("slots")})


def source_rank(source):
    out = F.lit(len(SOURCES))
    for i, s in enumerate(SOURCES):
        out = F.when(source == s, i).otherwise(out)
    return out


def source_of(key):
    """The candidate source of a grammar source's key."""
    return F.when(F.lower(key).isin("config", "trigger", "custom_sentence"), SOURCES[0]).otherwise(SOURCES[1])


def dedupe(rows: DataFrame) -> DataFrame:
    """One row for each (normalised text, intent): the best source, then a location with a domain, then a generic entity, then no domain, then the first.

    Needs norm, intent, source, slots, pos. The result is ordered by (source, text) in column ``pos``.
    """
    location = F.exists(F.map_keys("slots"), lambda k: k.isin("area", "floor")) & F.map_contains_key("slots", "domain")
    generic = F.exists(F.map_keys("slots"), lambda k: k.isin("name", "entity"))
    order = [source_rank(F.col("source")), location.cast("int").desc(), generic.cast("int").desc(), F.map_contains_key("slots", "domain").cast("int"), "pos"]
    first = F.row_number().over(Window.partitionBy("norm", "intent").orderBy(*order))
    return rows.withColumn("__rn", first).where("__rn = 1").drop("__rn")


def capped(rows: DataFrame, per_intent: int = CAP_INTENT, total: int = CAP_LANGUAGE, group: str = "intent", item: str = "pos") -> DataFrame:
    """Fair caps: each group takes one row of each item in turn up to ``per_intent``; then the best sources up to ``total``.

    Needs columns ``group``, ``item``, source, pos; rows of one item are ordered by whether they name an entity (where there are slots), then by pos.
    """
    named = [F.exists(F.map_keys("slots"), lambda k: k.isin("name", "entity", "entity_name")).desc()] if "slots" in rows.columns else []
    turn = F.row_number().over(Window.partitionBy(group, item).orderBy(*named, "pos"))
    rows = rows.withColumn("__turn", turn)
    rows = rows.withColumn("__rn", F.row_number().over(Window.partitionBy(group).orderBy("__turn", item, "pos"))).where(F.col("__rn") <= per_intent)
    return rows.orderBy(source_rank(F.col("source")), group, "__rn").limit(total).drop("__turn", "__rn")


def build(rows: DataFrame, language: str | None = None, total: int = CAP_LANGUAGE) -> DataFrame:
    """Candidates of one language (those without one fit all), deduplicated and capped fairly.

    Data items are told by column ``item`` where there is one, else each row is its own.
    """
    if language is not None and "language" in rows.columns:
        rows = rows.where(F.col("language").isNull() | (F.col("language") == language))
    rows = dedupe(candidates(rows, language))
    return capped(rows, total=total, item="item" if "item" in rows.columns else "pos")


def term_frequencies(docs: DataFrame, key: str = "cid") -> DataFrame:
    """(key, term, tf, len) of a frame with ``tokens``; documents without tokens have no row."""
    return docs.select(key, F.size("tokens").alias("len"), F.explode("tokens").alias("term")).groupBy(key, "term", "len").agg(F.count("*").alias("tf"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row: n documents, their mean length."""
    return docs.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avgdl"))


def idf(n, df):
    return F.log1p((n - df + 0.5) / (df + 0.5))


def term_stats(docs: DataFrame, key: str = "cid") -> DataFrame:
    """(term, df, idf): document frequencies of the distinct terms and their weight."""
    df = docs.select(key, F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(docs.agg(F.count("*").alias("n")))).select("term", "df", idf(F.col("n"), F.col("df")).alias("idf"))  # broadcast: one row


def bm25_weight(idf_, tf, length, avgdl, k1: float = BM25_K1, b: float = BM25_B):
    """What a term adds to the score of a document of ``length`` words that has it ``tf`` times."""
    return idf_ * (k1 + 1) * tf / (tf + k1 * (1 - b + b * length / avgdl))


def check_bm25(k1: float, b: float) -> None:
    if k1 <= 0 or not 0 <= b <= 1:
        raise ValueError("k1 must be above 0 and b between 0 and 1")


def postings(docs: DataFrame, key: str = "cid", k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """(term, key, w): what each term adds to a document's score. Frequencies are counted once and written; documents' frequencies are derived from them."""
    check_bm25(k1, b)
    tf = written(term_frequencies(docs, key), "frequencies")
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    tf = tf.join(df, "term").crossJoin(F.broadcast(corpus_stats(docs))).withColumn("idf", idf(F.col("n"), F.col("df")))  # broadcast: one row
    return tf.select("term", key, bm25_weight(F.col("idf"), F.col("tf"), F.col("len"), F.col("avgdl"), k1, b).alias("w"))


def gram_postings(docs: DataFrame, key: str = "cid") -> DataFrame:
    return docs.select(key, "n_grams", F.explode("grams").alias("gram"))


def slot_index(rows: DataFrame) -> DataFrame:
    """(key_token, token, cid): each slot token under itself and under its one-character deletions."""
    one = rows.select("cid", F.explode("slot_tokens").alias("token"))
    return one.select("cid", "token", F.explode(F.array_union(F.array("token"), F.when(F.length("token") >= 4, T.deletions(F.col("token"))).otherwise(F.array().cast("array<string>")))).alias("key_token"))


def registry_records(values: DataFrame) -> DataFrame:
    """Registry rows (slot, text, position, …) with norm, norm_nd, tokens; first of equal texts of a slot, by position."""
    first = F.row_number().over(Window.partitionBy("slot", F.lower("text")).orderBy("position"))
    rows = values.withColumn("__rn", first).where("__rn = 1").drop("__rn").withColumn("norm", T.normalize(F.col("text")))
    return rows.withColumns({"norm_nd": T.fold(F.col("norm")), "tokens": F.array_distinct(T.tokens(F.col("norm")))})


def registry_postings(records: DataFrame) -> DataFrame:
    """(key, slot, position): each record under its tokens, its folded tokens and its compact form."""
    keys = F.array_distinct(F.concat("tokens", T.tokens(F.col("norm_nd")), F.filter(F.array(T.compact_key(F.col("norm"))), lambda x: x != "")))
    return records.select(F.explode(keys).alias("key"), "slot", "position")


def registry_fuzzy(records: DataFrame) -> DataFrame:
    """(key, token, slot, position): tokens of four characters and more under their deletions and themselves."""
    one = records.select("slot", "position", F.explode("tokens").alias("token")).where("length(token) >= 4")
    return one.select("slot", "position", "token", F.explode(F.array_union(F.array("token"), T.deletions(F.col("token")))).alias("key"))


def literal_vocabulary(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode(F.flatten("literal_variants")).alias("token")).distinct()


def fingerprint(rows: DataFrame, *columns: str) -> DataFrame:
    """One row: a digest of a frame's content; each row's own digest is summed in parts, so no list of rows is gathered.

    Rows have no order of their own: those of a sequence carry their position in a column, and so another order gives another digest.
    """
    d = F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in columns or rows.columns]), {"ignoreNullFields": "false"}), 256)
    parts = [F.coalesce(F.sum(F.conv(F.substring(d, a, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string") for a in (1, 16, 31, 46)]
    return rows.agg(F.sha2(F.concat_ws("|", F.count("*").cast("string"), *parts), 256).alias("fingerprint"))
