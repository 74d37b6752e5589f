"""Template grammar: parsing and expansion as table-generating functions, ranges, literal gates."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiform.config import CAP_TEMPLATE
from lexiform.functions import text as tx

#: Groups nested this deep are an error.
DEPTH = 25


class GrammarError(ValueError):
    """A template that can't be parsed."""


@dataclass(frozen=True)
class Node:
    """kind: text, slot, rule, optional, choice, order or sequence; value: text, or slot with its output name; parts: what it's made of."""

    kind: str
    value: str = ""
    output: str = ""
    parts: tuple = ()


def parse(template: str) -> Node:
    """The tree of a template: ``{list}``, ``{list:output}``, ``<rule>``, ``[optional]``, ``(a|b)``, ``(a;b)``.

    In a group the first separator met is the group's; the other kind is text there. Stray closers and unclosed braces are text.
    """
    pos = 0

    def group(closer: str, depth: int) -> Node:
        nonlocal pos
        if depth >= DEPTH:
            raise GrammarError(f"groups nested {DEPTH} deep")
        rows: list[list[Node]] = [[]]
        sep = ""
        buf: list[str] = []

        def text() -> None:
            if buf:
                rows[-1].append(Node("text", "".join(buf)))
                buf.clear()

        while pos < len(template):
            c = template[pos]
            pos += 1
            if c == closer:
                break
            if c in "{<" and (end := template.find("}" if c == "{" else ">", pos)) >= 0:
                name = template[pos:end]
                pos = end + 1
                text()
                head, _, out = name.partition(":")
                rows[-1].append(Node("slot", head.strip(), (out or head).strip()) if c == "{" else Node("rule", name.strip()))
            elif c in "[(":
                text()
                inner = group("]" if c == "[" else ")", depth + 1)
                rows[-1].append(Node("optional", parts=(inner,)) if c == "[" else inner)
            elif c in "|;" and closer and sep in ("", c):
                sep = c
                text()
                rows.append([])
            else:
                buf.append(c)
        text()
        items = tuple(Node("sequence", parts=tuple(r)) for r in rows)
        return items[0] if len(items) == 1 else Node("choice" if sep == "|" else "order", parts=items)

    return group("", 0)


def diagonals(n: int, m: int):
    """The pairs (i, k) of range(n) and range(m) by their sum, then by i, one after the other."""
    for total in range(n + m - 1 if n and m else 0):
        for i in range(max(0, total - m + 1), min(n, total + 1)):
            yield i, total - i


def expand(node: Node, slots: dict[str, list[str]], rules: dict[str, str], cap: int, fair: bool = False, depth: int = 0) -> list[tuple[str, tuple]]:
    """(text, bindings) of a tree, distinct, ``cap`` at most, in order: optional parts empty first, later parts of a sequence fastest.

    ``fair`` takes choices in turn instead of one after the other. Two uses of one output must agree. Unknown rules and lists give empty text, a list without values no text at all.
    """

    def distinct(items):
        seen: dict = {}
        for i in items:
            if i not in seen:
                seen[i] = None
                if len(seen) >= cap:
                    break
        return list(seen)

    if node.kind == "text":
        return [(node.value, ())]
    if node.kind == "slot":
        return distinct((v, ((node.output, v),)) for v in slots[node.value]) if node.value in slots else [("", ())]
    if node.kind == "rule":
        body = rules.get(node.value)
        return [("", ())] if body is None or depth >= DEPTH else expand(parse(body), slots, rules, cap, fair, depth + 1)
    inner = lambda n: expand(n, slots, rules, cap, fair, depth)
    if node.kind == "optional":
        return distinct(itertools.chain([("", ())], inner(node.parts[0])))
    if node.kind == "choice":
        each = [inner(p) for p in node.parts]
        if fair:
            return distinct(x for row in itertools.zip_longest(*each) for x in row if x is not None)
        return distinct(itertools.chain.from_iterable(each))
    if node.kind == "order":
        orders = (Node("sequence", parts=tuple(x for p in perm for x in (p, Node("text", " ")))) for perm in itertools.permutations(node.parts))
        each = [inner(o) for o in orders]
        return distinct(x for x in itertools.chain.from_iterable(each))

    def join(a, b):
        have = dict(a[1])
        if any(have.get(k, v) != v for k, v in b[1]):
            return None
        return a[0] + b[0], tuple(sorted({**have, **dict(b[1])}.items()))

    out: list[tuple[str, tuple]] = [("", ())]
    for p in node.parts:
        more = inner(p)
        pairs = diagonals(len(out), len(more)) if fair else itertools.product(range(len(out)), range(len(more)))
        out = distinct(j for i, k in pairs if (j := join(out[i], more[k])) is not None)
    return out


def cleaned(template: str, slots: dict, rules: dict, cap: int = CAP_TEMPLATE, fair: bool = False) -> list[tuple[str, dict]]:
    """Expanded texts with white space collapsed, distinct, blank ones dropped."""
    seen: dict[tuple, None] = {}
    tree, room = parse(template), cap
    while True:  # several expansions may clean to one sentence: then more are asked for, until there are none
        made = expand(tree, slots, rules, room, fair)
        for t, b in made:
            t = " ".join(t.split())
            if t:
                seen.setdefault((t, b))
            if len(seen) >= cap:
                break
        if len(seen) >= cap or len(made) < room:
            break
        room *= 4
    return [(t, dict(b)) for t, b in seen]


def required_slots(node: Node, rules: dict[str, str], depth: int = 0) -> frozenset[str]:
    """Output names that every expansion has."""
    if node.kind == "slot":
        return frozenset([node.output])
    if node.kind == "rule":
        return required_slots(parse(rules[node.value]), rules, depth + 1) if node.value in rules and depth < DEPTH else frozenset()
    each = [required_slots(p, rules, depth) for p in node.parts]
    if node.kind == "choice":
        return frozenset.intersection(*each)
    return frozenset().union(*each) if node.kind in ("sequence", "order") else frozenset()


def slot_references(node: Node, rules: dict[str, str], depth: int = 0) -> list[tuple[str, str]]:
    """(list, output) of every slot, in order, through rules."""
    if node.kind == "slot":
        return [(node.value, node.output)]
    if node.kind == "rule":
        return slot_references(parse(rules[node.value]), rules, depth + 1) if node.value in rules and depth < DEPTH else []
    return [x for p in node.parts for x in slot_references(p, rules, depth)]


def literal_variants(template: str, rules: dict[str, str], cap: int = 200) -> list[list[str]]:
    """The normalised words of a template's expansions without its slots, taken fairly."""
    seen: dict[tuple, None] = {}
    for t, _ in expand(parse(template), {}, rules, cap, fair=True):
        seen.setdefault(tuple(dict.fromkeys((tx.normalize_py(t) or "").split())))
    return [list(v) for v in seen]


@F.udtf(returnType=T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("sentence", T.StringType()), T.StructField("bindings", T.MapType(T.StringType(), T.StringType()))]))
class ExpandTemplate:
    """``expand_template(template, slots, rules, cap, fair)``: one row for each sentence, in order."""

    def eval(self, template: str, slots: dict, rules: dict, cap: int, fair: bool):
        for i, (t, b) in enumerate(cleaned(template, {k: list(v) for k, v in (slots or {}).items()}, dict(rules or {}), cap, fair)):
            yield i, t, b


def expanded(templates: DataFrame, cap: int = CAP_TEMPLATE, fair: bool = False) -> DataFrame:
    """``templates`` (template, slots map<string,array<string>>, rules map<string,string>, …) joined laterally with their sentences."""
    spark = templates.sparkSession
    spark.udtf.register("expand_template", ExpandTemplate)
    view = f"templates_{abs(hash((id(templates), cap, fair)))}"
    templates.createOrReplaceTempView(view)
    return spark.sql(f"SELECT t.*, e.pos AS sentence_pos, e.sentence, e.bindings FROM {view} t, LATERAL expand_template(t.template, t.slots, t.rules, {int(cap)}, {str(fair).lower()}) e")


def effective_lists(source: Column, intent: Column, item: Column) -> Column:
    """Lists of a data item: its own win over the intent's, those over the source's; whole lists at a time."""
    pick = lambda a, b: F.map_zip_with(a, b, lambda k, x, y: F.coalesce(y, x))
    return pick(pick(source, intent), item)


def is_fixed_sentence(text: Column) -> Column:
    return (F.trim(text) != "") & ~text.rlike(r"[{}\[\]<>\\|();]")


def literal_gate(variants: Column, query: Column, share: float = 0.5) -> Column:
    """Whether a template may be expanded for a query: an empty variant, or half of a variant's words spoken."""
    return F.exists(variants, lambda v: (F.size(v) == 0) | (F.size(F.array_intersect(v, query)) >= share * F.size(v)))


def compiled_ranges(rows: DataFrame) -> DataFrame:
    """Ranges (from, to, step, multiplier, fractions) with ordered bounds, a positive step and the offsets of the fractions."""
    return rows.withColumns({
        "low": F.least("from", "to"), "high": F.greatest("from", "to"), "step": F.when(F.col("step") > 0, F.col("step")), "multiplier": F.coalesce("multiplier", F.lit(1.0)),
        "offsets": F.when(F.col("fractions") == "halves", F.array(F.lit(0.0), F.lit(0.5))).when(F.col("fractions") == "tenths", F.array(*[F.lit(i / 10) for i in range(10)])).otherwise(F.array(F.lit(0.0))),
    })


def bind_ranges(queries: DataFrame, ranges: DataFrame) -> DataFrame:
    """(qid, range_id, value, output): numbers of a query within a range's bounds and on its grid; the output is the value times the multiplier.

    ``queries`` has qid and tokens; ``ranges`` is from ``compiled_ranges`` with range_id, and is small configuration.
    """
    n = queries.select("qid", F.explode("tokens").alias("t")).select("qid", tx.parse_float(F.col("t")).alias("value")).where("value IS NOT NULL").distinct()
    hit = n.join(ranges, (n.value >= ranges.low) & (n.value <= ranges.high))
    step = F.coalesce("step", F.lit(1.0))
    grid = F.exists("offsets", lambda o: F.abs((F.col("value") - F.col("from") - o) / step - F.round((F.col("value") - F.col("from") - o) / step)) <= 1e-9)
    return hit.where(grid).select("qid", "range_id", "value", tx.output_value(F.col("value") * F.col("multiplier")).alias("output"))


def anchored_window(query: Column, prefix: Column, suffix: Column) -> Column:
    """The span of a query between a template's literal prefix and suffix; null where they don't frame it."""
    fits = F.startswith(query, prefix) & F.endswith(query, suffix) & (F.length(query) > F.length(prefix) + F.length(suffix))
    return F.when(fits, F.trim(F.substr(query, F.length(prefix) + 1, F.length(query) - F.length(prefix) - F.length(suffix))))
