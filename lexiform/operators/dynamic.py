"""Candidates made for a query: templates that its words open, filled with what it says of registries, lists and ranges."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiform import config as C
from lexiform.functions import similarity as S
from lexiform.functions import text as T
from lexiform.operators import grammar, retrieve
from lexiform.operators.index import source_rank

#: Literal frames of a template's slot that are kept, and windows of a query that are tried.
FRAMES, WINDOWS = 64, 8
#: Expansions of a template for one query before the closest CAP_TEMPLATE of them are kept; words between a number and its anchor.
EXPANSIONS, ANCHOR_REACH = 200, 3
GATE_SHARE = 0.5
_MARK = "\ue0f0"

TEMPLATE = (
    "tid long, intent string, source string, item int, template string, rules map<string,string>, lists map<string,array<string>>, outputs map<string,map<string,string>>, refs array<struct<list:string,output:string>>, "
    "registry array<string>, domains array<string>, wildcards array<string>, ranges array<struct<output:string,list:string,from:double,to:double,step:double,multiplier:double,fractions:string,anchors:array<string>>>, "
    "literal_variants array<array<string>>, frames array<struct<prefix:string,suffix:string>>, static map<string,string>, context_slots array<string>"
)


def frames(template: str, name: str, rules: dict[str, str], limit: int = FRAMES) -> list[tuple[str, str]]:
    """The literal words before and after the only slot ``name`` of a template's expansions, normalised, longest first; () where neither has a word."""
    out: dict[tuple[str, str], None] = {}
    for text, _ in grammar.expand(grammar.parse(template), {name: [_MARK]}, rules, limit * 4, fair=True):
        before, mark, after = text.partition(_MARK)
        if mark and _MARK not in after:
            out.setdefault((T.normalize_py(before) or "", T.normalize_py(after) or ""))
    found = [f for f in out if any(f)]
    return sorted(found, key=lambda f: (-len(f[0]) - len(f[1]), f))[:limit]


def template_rows(spark: SparkSession, sources: dict[str, dict], registry: tuple[str, ...] = (*C.ENTITY_SLOTS, *C.LOCATION_SLOTS), literal_only: bool = True, area_only: bool = True) -> DataFrame:
    """The query-independent part of every sentence template: its slots by kind, domains, ranges, literal words and frames. Grammars are small configuration.

    A template without slots of a registry, list or range is left out where it has no literal words or is one fixed sentence (the static index has it), or if
    ``literal_only`` is off; one whose only registry slots are places is left out if ``area_only`` is off, unless it has a domain.
    """
    from lexiform.sources.stores import list_outputs

    rows: list[tuple[Any, ...]] = []
    for key in sorted(sources, key=lambda k: (k.lower() not in C.CUSTOM_KEYS, k)):
        src = sources[key]
        for intent, body in (src.get("intents") or {}).items():
            for i, item in enumerate(body.get("data") or []):
                lists, rules = {}, {}
                for level in (src, body, item):
                    lists |= level.get("lists") or {}
                    rules |= level.get("expansion_rules") or {}
                static = {k: str(v) for k, v in (item.get("slots") or {}).items()}
                needs = item.get("requires_context") or {}
                domains = [str(x) for d in (static.get("domain"), needs.get("domain")) if d for x in (d if isinstance(d, list) else [d])]
                for template in item.get("sentences") or []:
                    tree = grammar.parse(template)
                    refs = list(dict.fromkeys(grammar.slot_references(tree, rules)))
                    kind = {name: lists.get(name) if isinstance(lists.get(name), dict) else {"values": lists.get(name) or []} for name, _ in refs}
                    wild = [o for n, o in refs if kind[n].get("wildcard")]
                    named = [n for n, _ in refs if n in registry and not kind[n].get("values") and not kind[n].get("wildcard")]
                    ranges = []
                    for n, o in refs:
                        if r := kind[n].get("range"):
                            near = {w for f in frames(template, n, rules) for w in (*f[0].split()[-1:], *f[1].split()[:1])}
                            ranges.append((o, n, float(min(r["from"], r["to"])), float(max(r["from"], r["to"])), float(r["step"]) if r.get("step") else None, float(r.get("multiplier") or 1), r.get("fractions"), sorted(near | set(o.split("_")) | set(n.split("_")))))
                    spoken = {n: list_outputs(kind[n], rules) for n, _ in refs if kind[n].get("values")}
                    variants = grammar.literal_variants(template, rules)
                    entity = [n for n in named if n in C.ENTITY_SLOTS]
                    if named and not entity and not area_only and not domains:
                        continue
                    if not refs and (not literal_only or not any(variants) or not set(template) & set("[](|)<>;")):
                        continue
                    frame = frames(template, refs[0][0], rules) if len(named) == 1 and len(refs) == 1 else []
                    rows.append((
                        len(rows), intent, "custom_sentence" if key.lower() in C.CUSTOM_KEYS else "built_in", i, template, rules, {n: list(v) for n, v in spoken.items()}, {o: dict(spoken[n]) for n, o in refs if n in spoken}, refs,
                        named, domains, wild, ranges, variants, frame, static, sorted(needs),
                    ))
    return spark.createDataFrame(rows, TEMPLATE)


def opened(queries: DataFrame, templates: DataFrame, share: float = GATE_SHARE) -> DataFrame:
    """(qid, tid): the templates that a query may expand: it has half of a literal variant's words, plainly or folded, or the variant has none."""
    both = queries.withColumn("tokens", F.array_union("tokens", T.tokens(F.col("norm_nd"))))
    return retrieve.wildcard_pass(templates.select(F.col("tid").alias("cid"), "literal_variants"), both, share).select("qid", F.col("cid").alias("tid"))


def windows(queries: DataFrame, templates: DataFrame, gates: DataFrame, limit: int = WINDOWS) -> DataFrame:
    """(qid, tid, span): what stands in a query between the literal words before and after a template's only slot, those of the longest frames first, ``limit`` at most."""
    f = gates.join(templates.select("tid", F.explode("frames").alias("f")), "tid").join(queries.select("qid", "norm"), "qid")
    span = grammar.anchored_window(F.col("norm"), F.when(F.col("f.prefix") != "", F.concat("f.prefix", F.lit(" "))).otherwise(F.lit("")), F.when(F.col("f.suffix") != "", F.concat(F.lit(" "), "f.suffix")).otherwise(F.lit("")))
    spans = f.select("qid", "tid", span.alias("span"), (F.length("f.prefix") + F.length("f.suffix")).alias("n")).where("span <> ''").groupBy("qid", "tid", "span").agg(F.max("n").alias("n"))
    order = Window.partitionBy("qid", "tid").orderBy(F.desc("n"), "span")
    return spans.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= limit).select("qid", "tid", "span")


def scoped(slot: Column, domains: Column) -> Column:
    """The registry lists that a slot of a template with ``domains`` takes its values from: those of its domains, else its own."""
    own = F.transform(domains, lambda d: F.concat(slot, F.lit(":"), d))
    return F.when((F.size(domains) > 0) & slot.isin(*C.ENTITY_SLOTS), own).otherwise(F.array(slot))


def registry_values(queries: DataFrame, templates: DataFrame, gates: DataFrame, records: DataFrame) -> DataFrame:
    """(qid, tid, list, vals, how): the registry values that a query speaks of, best first, for each registry slot of the templates it opens.

    A template with one slot looks at the words that its literals frame first, and where those name a value (``how`` is anchored) at nothing else; then at the whole query.
    Values of several domains' lists count once, by the first list that has them.
    """
    need = gates.join(templates.select("tid", "domains", F.explode("registry").alias("list")), "tid").select("qid", "tid", "list", F.posexplode(scoped(F.col("list"), F.col("domains"))).alias("turn", "slot"))
    spans = windows(queries, templates, gates).withColumn("sid", F.xxhash64("qid", "tid", "span"))
    asked = queries.select(F.col("qid").cast("long").alias("sid"), "norm", "tokens", F.lit("fuzzy").alias("how"), "qid", F.lit(None).cast("long").alias("tid"))
    framed = spans.select("sid", F.col("span").alias("norm"), T.tokens(F.col("span")).alias("tokens"), F.lit("anchored").alias("how"), "qid", "tid")
    every = asked.unionByName(framed).withColumn("key", F.xxhash64("sid", "how"))
    hits = retrieve.registry_hits(every.select(F.col("key").alias("qid"), "norm", "tokens"), records).withColumnRenamed("qid", "key")
    hits = hits.join(records.select("slot", "position", "text"), ["slot", "position"]).join(every.select("key", "qid", "tid", "how"), "key")
    score = F.struct(F.col("exact"), F.col("phrase"), F.col("full"), F.col("matched"), (-F.col("n")).alias("n"), (-F.col("turn")).alias("turn"), (-F.col("position")).alias("position"))
    mine = need.join(hits.withColumnsRenamed({"tid": "__tid"}), ["qid", "slot"]).where("__tid is null or __tid = tid")
    mine = mine.groupBy("qid", "tid", "list", "how", F.lower("text").alias("low")).agg(F.max(F.struct(score.alias("s"), F.col("text"))).alias("b"))
    rank = Window.partitionBy("qid", "tid", "list", "how").orderBy(F.desc("b.s"), "b.text")
    best = mine.withColumn("rn", F.row_number().over(rank)).where(F.col("rn") <= C.CAP_SLOT_VALUES)
    lists = best.groupBy("qid", "tid", "list", "how").agg(F.sort_array(F.collect_list(F.struct("rn", "b.text"))).alias("v"))  # CAP_SLOT_VALUES at most
    first = Window.partitionBy("qid", "tid", "list").orderBy("how")  # anchored before fuzzy
    return lists.withColumn("rn", F.row_number().over(first)).where("rn = 1").select("qid", "tid", "list", F.col("v.text").alias("vals"), "how")


def numbers(queries: DataFrame, templates: DataFrame, gates: DataFrame) -> DataFrame:
    """(qid, tid, list, output, pairs): the query's numbers within a range and on its grid, as (said, meant) pairs.

    With several numbers in the query one counts only if an anchor of the range (a word of its name, or a literal next to it) stands within ANCHOR_REACH words.
    """
    said = queries.select("qid", "tokens", F.posexplode("tokens").alias("at", "said")).withColumn("value", T.parse_float(F.col("said"))).where("value is not null")
    said = said.withColumn("many", F.size(F.collect_set("value").over(Window.partitionBy("qid"))) > 1)  # a query's own numbers
    ranges = grammar.compiled_ranges(templates.select("tid", F.explode("ranges").alias("r")).select("tid", "r.*"))
    hit = said.join(gates, "qid").join(ranges, "tid").where("value between low and high")
    near = F.slice("tokens", F.greatest(F.lit(1), F.col("at") + 1 - ANCHOR_REACH), F.lit(2 * ANCHOR_REACH + 1))
    step = F.coalesce("step", F.lit(1.0))
    grid = F.exists("offsets", lambda o: F.abs((F.col("value") - F.col("from") - o) / step - F.round((F.col("value") - F.col("from") - o) / step)) <= C.RANGE_TOLERANCE)
    hit = hit.where(grid & (~F.col("many") | F.arrays_overlap(near, "anchors")))
    pair = F.struct(F.col("at"), F.col("said"), T.output_value(F.col("value") * F.col("multiplier")).alias("meant"))
    return hit.groupBy("qid", "tid", "list", "output").agg(F.sort_array(F.collect_set(pair)).alias("pairs"))


def query_candidates(queries: DataFrame, templates: DataFrame, records: DataFrame, cap: int = C.CAP_DYNAMIC) -> DataFrame:
    """(qid, cid, text, intent, source, slots, slots_raw, static_slots, context_slots, wildcard_slots, literal_text, registry_retrieval): at most ``cap`` candidates a query.

    ``queries`` is from ``prepared_queries``, ``templates`` from ``template_rows``, ``records`` from ``stores.registry``. A template's lists take the values that the query says first; one whose slot
    nothing in the query fills gives only the sentences without it. The closest CAP_TEMPLATE sentences of a template and ``cap`` of a query stay: a
    cap of the engine's own. Templates without a word in common with a query are never paired with it, unless they have none.
    """
    gates = opened(queries, templates)
    found = registry_values(queries, templates, gates, records)
    named = found.groupBy("qid", "tid").agg(F.map_from_entries(F.collect_list(F.struct("list", "vals"))).alias("named"), F.min("how").alias("how"))
    counted = numbers(queries, templates, gates)
    counted = counted.groupBy("qid", "tid").agg(F.map_from_entries(F.collect_list(F.struct("list", F.col("pairs.said")))).alias("counted"), F.map_from_entries(F.collect_list(F.struct("output", F.map_from_entries(F.transform("pairs", lambda p: F.struct(p["said"], p["meant"])))))).alias("meant"))
    rows = gates.join(templates, "tid").join(queries.select("qid", F.col("norm").alias("q_norm"), F.col("tokens").alias("q_tokens")), "qid").join(named, ["qid", "tid"], "left").join(counted, ["qid", "tid"], "left")
    none = F.create_map().cast("map<string,array<string>>")
    said = lambda v: T.has_phrase(F.col("q_norm"), T.normalize(v))
    own = F.transform_values("lists", lambda k, vs: F.concat(F.filter(vs, said), F.filter(vs, lambda v: ~said(v))))
    wild = F.map_from_entries(F.transform(F.filter("refs", lambda r: F.array_contains("wildcards", r["output"])), lambda r: F.struct(r["list"], F.array(r["output"]))))
    rows = rows.withColumn("slots", F.map_concat(own, wild, F.coalesce("named", none), F.coalesce("counted", none)))
    # a slot that nothing fills has no values, so sentences with it aren't made
    bare = F.array_except(F.array_distinct(F.transform("refs", lambda r: r["list"])), F.map_keys("slots"))
    rows = rows.withColumn("slots", F.map_concat("slots", F.map_from_entries(F.transform(bare, lambda n: F.struct(n, F.array().cast("array<string>"))))))
    sentences = grammar.expanded(rows.select("qid", "tid", "template", "slots", "rules"), EXPANSIONS, fair=True)
    made = sentences.select("qid", "tid", F.col("sentence").alias("text"), "bindings", "sentence_pos").join(rows.drop("template", "slots", "rules"), ["qid", "tid"])
    made = made.withColumn("norm", T.normalize_any(F.col("text"))).where("norm <> ''")
    out_of = lambda k, v: F.coalesce(F.element_at(F.element_at(F.col("meant"), k), v), F.element_at(F.element_at(F.col("outputs"), k), v), v)
    made = made.withColumn("values", F.transform_values("bindings", out_of))
    made = made.withColumn("near", S.relevance_key(F.col("norm"), F.col("q_norm"), T.tokens(F.col("norm")), F.col("q_tokens")))
    made = made.withColumn("rn", F.row_number().over(Window.partitionBy("qid", "tid").orderBy(F.desc("near"), "sentence_pos"))).where(F.col("rn") <= C.CAP_TEMPLATE)
    slots = F.map_concat("values", F.map_filter("static", lambda k, v: ~F.map_contains_key("values", k)))
    made = made.withColumns({"slots": slots, "slots_raw": F.col("bindings")})
    made = made.withColumn("rn", F.row_number().over(Window.partitionBy("qid", "norm", "intent").orderBy(source_rank(F.col("source")), "how", "tid", "sentence_pos"))).where("rn = 1")
    made = top_candidates(made, cap)
    words = lambda v: F.array_join(v, " ")
    return made.select(
        "qid", F.xxhash64("norm", "intent").alias("cid"), "text", "intent", "source", "slots", "slots_raw", F.map_keys("static").alias("static_slots"), "context_slots", F.col("wildcards").alias("wildcard_slots"),
        F.array_join(F.transform("literal_variants", words), "|").alias("literal_text"), F.when(F.col("how") == "anchored", "anchored").when(F.col("how") == "fuzzy", "fuzzy").alias("registry_retrieval"),
    )


def top_candidates(rows: DataFrame, cap: int = C.CAP_DYNAMIC) -> DataFrame:
    """The ``cap`` candidates of each query with the best relevance ``near``; ties by text, then by intent. Needs qid, near, norm, intent."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("near"), "norm", "intent"))).where(F.col("rn") <= cap).drop("rn")
