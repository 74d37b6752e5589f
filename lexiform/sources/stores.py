"""Sources and sinks: grammar files, registry tables, label corpora, versioned index stores."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiform.config import CUSTOM_KEYS, STORE_VERSION
from lexiform.operators.index import fingerprint, registry_records


class StoreError(ValueError):
    """A store that can't be used."""


def object_of(text: str) -> dict[str, Any]:
    """A JSON object with string keys; anything else is an empty one."""
    try:
        value = json.loads(text)
    except ValueError:
        return {}
    return value if isinstance(value, dict) and all(isinstance(k, str) for k in value) else {}


def deep_merge(a: dict, b: dict) -> dict:
    """``a`` with ``b`` over it: mappings merge, lists of data are joined, everything else is replaced."""
    out = dict(a)
    for k, v in b.items():
        if isinstance(v, dict) and isinstance(out.get(k), dict):
            out[k] = deep_merge(out[k], v)
        elif k == "data" and isinstance(v, list) and isinstance(out.get(k), list):
            out[k] = out[k] + v
        else:
            out[k] = v
    return out


def read_grammar(spark: SparkSession, path: str, kind: str = "json") -> dict[str, Any]:
    """The files under ``path`` (``*.json`` or ``*.yaml``, in the order of their paths) merged into one grammar source. Grammars are small configuration.

    Read through Spark, so any store works; files that aren't mappings are skipped. YAML needs the PyYAML library.
    """
    files = spark.read.text(path, wholetext=True, pathGlobFilter=f"*.{kind}", recursiveFileLookup=True).select("value", F.input_file_name().alias("f")).orderBy("f").collect()
    if kind == "yaml":
        try:
            import yaml
        except ImportError as e:
            raise StoreError("reading YAML grammars needs PyYAML") from e
        load = lambda t: yaml.safe_load(t)
    else:
        load = object_of
    out: dict[str, Any] = {}
    for r in files:
        value = load(r.value)
        if isinstance(value, dict):
            out = deep_merge(out, value)
    return out


def grammar_rows(spark: SparkSession, sources: dict[str, dict]) -> DataFrame:
    """One row for each sentence template of the sources: source key, intent, item position, template, lists, what their values mean by output, wildcards, literal words, rules, slots, context. Custom sources come first."""
    from lexiform.operators import grammar

    custom = CUSTOM_KEYS
    rows = []
    for key in sorted(sources, key=lambda k: (k.lower() not in custom, k)):
        src = sources[key]
        for intent, body in (src.get("intents") or {}).items():
            for i, item in enumerate(body.get("data") or []):
                lists, rules = {}, {}
                for level in (src, body, item):
                    lists |= level.get("lists") or {}
                    rules |= level.get("expansion_rules") or {}
                for template in item.get("sentences") or []:
                    context = {k: (v if isinstance(v, list) else [str(v)]) for k, v in (item.get("requires_context") or {}).items()}
                    refs = grammar.slot_references(grammar.parse(template), rules)
                    spoken = {k: list_values(v, rules, next((o for n, o in refs if n == k), k)) for k, v in lists.items()}
                    means = {o: meanings(lists[n], rules) for n, o in refs if n in lists}
                    wild = [o for n, o in refs if isinstance(lists.get(n), dict) and lists[n].get("wildcard")]
                    literal = "|".join(" ".join(v) for v in grammar.literal_variants(template, rules))
                    static = {k: str(v) for k, v in (item.get("slots") or {}).items()}
                    rows.append((len(rows), key, "custom_sentence" if key.lower() in custom else "built_in", intent, i, template, spoken, means, wild, literal, rules, static, {k: [str(x) for x in v] for k, v in context.items()}))
    kinds = "pos long, source_key string, source string, intent string, item int, template string, slots map<string,array<string>>, outputs map<string,map<string,string>>, wildcards array<string>, literal_text string, rules map<string,string>, static map<string,string>, context map<string,array<string>>"
    return spark.createDataFrame(rows, kinds)


def list_outputs(spec: Any, rules: dict[str, str]) -> dict[str, str]:
    """What each spoken value of a list means: itself, or the output of its in/out entry, whose templates are expanded; the first entry of a value wins."""
    from lexiform.operators.grammar import cleaned

    if isinstance(spec, list):
        spec = {"values": spec}
    out: dict[str, str] = {}
    for v in spec.get("values") or []:
        for template in [v] if isinstance(v, str) else v["in"] if isinstance(v.get("in"), list) else [v.get("in", "")]:
            for t, _ in cleaned(template, {}, rules):
                out.setdefault(t, str(v["out"]) if isinstance(v, dict) and "out" in v else t)
    return out


def list_values(spec: Any, rules: dict[str, str], name: str = "") -> list[str]:
    """The spoken values of a list: strings or in/out entries (templates expanded), a range's ends, or a wildcard's own name."""
    if isinstance(spec, dict) and spec.get("wildcard"):
        return [name] if name else []
    if isinstance(spec, dict) and "range" in spec:
        r = spec["range"]
        return [str(x) for x in sorted((r["from"], r["to"]))]
    return list(list_outputs(spec, rules))


def meanings(spec: Any, rules: dict[str, str]) -> dict[str, str]:
    """What each of a list's ``list_values`` means; a range's ends are multiplied."""
    if isinstance(spec, dict) and spec.get("wildcard"):
        return {}
    if isinstance(spec, dict) and "range" in spec:
        r = spec["range"]
        by = float(r.get("multiplier") or 1)
        return {str(x): f"{x * by:g}" for x in (r["from"], r["to"])}
    return list_outputs(spec, rules)


def registry(entities: DataFrame, areas: DataFrame, floors: DataFrame) -> DataFrame:
    """Registry records of every slot: entities (name, aliases, domain, exposed) by name and domain, areas and floors by name; aliases before names, first of equal texts wins."""

    def spoken(rows: DataFrame, *slots: str, domain: bool = False) -> DataFrame:
        one = rows.select("key", *(["domain"] if domain else []), F.posexplode(F.array_append(F.coalesce("aliases", F.array().cast("array<string>")), F.col("name"))).alias("p", "text"))
        names = F.array(*[F.lit(s) for s in slots], *([F.concat(F.lit(f"{s}:"), F.col("domain")) for s in slots] if domain else []))
        return one.where(F.trim("text") != "").select(F.explode(names).alias("slot"), "text", (F.col("key") * 1000 + F.col("p")).alias("position"))

    entities = entities.where("exposed") if "exposed" in entities.columns else entities
    return registry_records(spoken(entities, "name", "entity", "entity_name", domain=True).unionByName(spoken(areas, "area", "area_name")).unionByName(spoken(floors, "floor", "floor_name")))


def merge_slot_values(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """(slot, values): a slot's list is the primary's if it has one, else the fallback's."""
    p, f = primary.select("slot", F.col("values").alias("__p")), fallback.select("slot", F.col("values").alias("__f"))
    return p.join(f, "slot", "full").select("slot", F.coalesce("__p", "__f").alias("values"))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Labelled cases of one JSON file a language under ``path``; a case that breaks the schema raises an error.

    Columns: language, case_id, query, expected_intent, expected_canonical, category, expected_slots, context, expected_fallback, drift.
    """
    case = "struct<query:string,expected_intent:string,expected_canonical:string,category:string,language:string,expected_slots:map<string,string>,context:map<string,string>,expected_fallback:boolean,drift:string>"
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.json").select("value", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("language"))
    rows = files.select(F.col("language").alias("file_language"), F.posexplode(F.from_json("value", f"struct<test_cases:array<{case}>>")["test_cases"]).alias("case_id", "c"))
    rows = rows.select("file_language", "case_id", "c.*")
    blank = F.exists(F.array("query", "expected_intent", "expected_canonical", "category"), lambda x: x.isNull() | (F.trim(x) == ""))
    bad = blank | (F.col("language").isNotNull() & (F.col("language") != F.col("file_language")))
    if not rows.where(bad).isEmpty():
        raise StoreError("a case has a blank field or another language than its file")
    key = F.lower(F.trim(F.regexp_replace("query", r"\s+", " ")))
    if not rows.groupBy("file_language", key).count().where("count > 1").isEmpty():
        raise StoreError("a query is repeated")
    return rows.withColumn("language", F.col("file_language")).drop("file_language").withColumns({"expected_fallback": F.coalesce("expected_fallback", F.lit(False)), "drift": F.col("drift").isNotNull()})


def save_index(rows: DataFrame, path: str, language: str, epoch: str, inputs: DataFrame | None = None) -> dict[str, Any]:
    """Writes candidates as Parquet under ``path`` and, last, a one-row manifest of version, language, fingerprint, epoch and count."""
    rows.write.mode("overwrite").parquet(f"{path}/{language}/candidates")
    spark = rows.sparkSession
    manifest = {"build_version": STORE_VERSION, "language": language, "fingerprint": fingerprint(inputs if inputs is not None else rows).first()[0], "cache_epoch": epoch, "candidate_count": spark.read.parquet(f"{path}/{language}/candidates").count()}
    spark.createDataFrame([tuple(manifest.values())], "build_version int, language string, fingerprint string, cache_epoch string, candidate_count long").coalesce(1).write.mode("overwrite").json(f"{path}/{language}/manifest")
    return manifest


def load_index(spark: SparkSession, path: str, language: str, fingerprint_: str, epoch: str) -> DataFrame | None:
    """The stored candidates if version, language, fingerprint, epoch and count all agree; None otherwise, and for a store that isn't there or is damaged."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import AnalysisException

    try:
        m = spark.read.schema("build_version int, language string, fingerprint string, cache_epoch string, candidate_count long").json(f"{path}/{language}/manifest").first()
        rows = spark.read.parquet(f"{path}/{language}/candidates")
        good = m is not None and (m.build_version, m.language, m.fingerprint, m.cache_epoch) == (STORE_VERSION, language, fingerprint_, epoch) and rows.count() == m.candidate_count and rows.where("norm IS NULL OR norm = '' OR trim(text) = '' OR trim(intent) = ''").isEmpty()
    except (AnalysisException, Py4JJavaError):
        return None
    return rows if good else None


def clear_index(spark: SparkSession, path: str, language: str | None = None) -> int:
    """Deletes one language's store, or all; returns how many there were."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(conf)
    if not store.exists(root):
        return 0
    found = [s.getPath() for s in store.listStatus(root) if language is None or s.getPath().getName() == language]
    for p in found:
        store.delete(p, True)
    return len(found)


def latest(rows: DataFrame, key: str, version: str) -> DataFrame:
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version)))).where("__rn = 1").drop("__rn")
