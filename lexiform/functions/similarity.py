"""Similarity of tokens and texts: native columns where the rule allows, Arrow UDFs for alignments."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

from lexiform.config import SLOT_MIN_LENGTH, SLOT_RATIO, W_BM25, W_CHAR, W_FUZZY, W_INTENT
from lexiform.functions.text import deletions


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for c in b:
        both = row & where.get(c, 0)
        row = (row + both | row - both) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """200 * common subsequence / both lengths, from 0 to 100; two empty texts have 100."""
    n = len(a) + len(b)
    return 200.0 * lcs(a, b) / n if n else 100.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text with a part of the longer no longer than itself."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    return max(ratio(a, b[max(0, i) : i + len(a)]) for i in range(1 - len(a), len(b)))


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and not (left and right):
        return 100.0
    one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
    found = [ratio(one, two)]
    if both:
        found += [ratio(both, one), ratio(both, two)]
    return max(found)


def partial_token_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if x & y:
        return 100.0
    return max(partial_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), partial_ratio(" ".join(sorted(x)), " ".join(sorted(y))))


def weighted_ratio(a: str, b: str) -> float:
    """The largest of the plain and the scaled token and partial ratios; partial ones count from a length ratio of 1.5 on, and less from 8 on."""
    if not a or not b:
        return 0.0
    size = max(len(a), len(b)) / min(len(a), len(b))
    whole = ratio(a, b)
    if size < 1.5:
        return max(whole, 0.95 * max(token_sort_ratio(a, b), token_set_ratio(a, b)))
    scale = 0.9 if size <= 8 else 0.6
    return max(whole, scale * partial_ratio(a, b), 0.95 * scale * partial_token_ratio(a, b))


def combined_fuzzy(a: str, b: str) -> float:
    """Mean of the weighted, sorted and set ratios in [0, 1]; the set ratio counts by the ratio of the token counts."""
    x, y = len(a.split()), len(b.split())
    if not x or not y:
        return 0.0
    return (weighted_ratio(a, b) + token_sort_ratio(a, b) + token_set_ratio(a, b) * min(x, y) / max(x, y)) / 300.0


@F.pandas_udf(DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def fuzzy(a: pd.Series, b: pd.Series) -> pd.Series:
    seen: dict[tuple, float] = {}
    for pair in set(zip(a, b, strict=True)):
        seen[pair] = None if None in pair else combined_fuzzy(*pair)
    return pd.Series([seen[pair] for pair in zip(a, b, strict=True)], dtype="float64")


def may_match(a: Column, b: Column, least: int = SLOT_RATIO) -> Column:
    """The length bound of the ratio: false where it can't reach ``least``."""
    return 200 * F.least(F.length(a), F.length(b)) >= least * (F.length(a) + F.length(b))


def count_ratio(a: Column, b: Column) -> Column:
    """Ratio of two token counts, 0 where one is 0."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.least(F.size(a), F.size(b)) / F.greatest(F.size(a), F.size(b)))


def weighted_score(fuzzy_: Column, char: Column, bm25: Column, intent: Column) -> Column:
    return W_FUZZY * fuzzy_ + W_CHAR * char + W_BM25 * bm25 + W_INTENT * intent


def _chars(x: Column) -> Column:
    return F.filter(F.split(x, ""), lambda c: c != "")


def same_positions(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(_chars(a), _chars(b), lambda x, y: x == y), lambda z: z))


def positional(a: Column, b: Column) -> Column:
    """Share of the longer text's positions with the same character."""
    long = F.greatest(F.length(a), F.length(b))
    return F.when(long == 0, F.lit(0.0)).when(a == b, F.lit(1.0)).otherwise(same_positions(a, b) / long)


def positional_threshold(a: Column, b: Column) -> Column:
    n = F.least(F.length(a), F.length(b))
    return F.when(n <= 2, 0.75).when(n <= 3, 0.66).when(n <= 5, 0.60).otherwise(0.50)


def one_insertion(a: Column, b: Column) -> Column:
    """Whether one text is the other with one character more; the shorter has two at least and they differ by a ratio of 1.6 at most."""
    short, long = F.when(F.length(a) < F.length(b), a).otherwise(b), F.when(F.length(a) < F.length(b), b).otherwise(a)
    fits = (F.length(long) - F.length(short) == 1) & (F.length(short) >= 2) & (F.length(long) <= 1.6 * F.length(short))
    return fits & F.array_contains(deletions(long), short)


def swapped(a: Column, b: Column) -> Column:
    """Whether two texts of one length differ by one swap of neighbours."""
    at = F.filter(F.transform(F.zip_with(_chars(a), _chars(b), lambda x, y: x != y), lambda d, i: F.when(d, i)), lambda i: i.isNotNull())
    i, j = F.get(at, F.lit(0)), F.get(at, F.lit(1))
    here = (F.size(at) == 2) & (j == i + 1)
    return (F.length(a) == F.length(b)) & F.coalesce(here & (F.substr(a, i + 1, F.lit(1)) == F.substr(b, j + 1, F.lit(1))) & (F.substr(a, j + 1, F.lit(1)) == F.substr(b, i + 1, F.lit(1))), F.lit(False))


def _bounded(a: Column, b: Column) -> Column:
    return (F.substring(a, 1, 1) == F.substring(b, 1, 1)) & (F.least(F.length(a), F.length(b)) >= SLOT_MIN_LENGTH) & (a != b)


def _mark_codes() -> tuple[str, str, str, str]:
    """The precomposed Latin letters, their bases, and a letter for the first and for the second of their marks ("" has "0")."""
    import unicodedata

    letters = [c for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if 2 <= len(unicodedata.normalize("NFD", c)) <= 3 and c.islower()]
    parts = [unicodedata.normalize("NFD", c) for c in letters]
    marks = sorted({m for p in parts for m in p[1:]})
    code = lambda p, k: chr(0x4E00 + marks.index(p[k])) if len(p) > k else "0"
    return "".join(letters), "".join(p[0] for p in parts), "".join(code(p, 1) for p in parts), "".join(code(p, 2) for p in parts)


_MARKED, _BASES, _FIRST, _SECOND = _mark_codes()


def mark_conflict(x: Column, y: Column) -> Column:
    """Whether two letters have one base and marks, and no mark in common: different words and no slip."""
    first, second = (lambda c: F.translate(c, _MARKED, _FIRST)), (lambda c: F.translate(c, _MARKED, _SECOND))
    marked = lambda c: F.translate(c, _MARKED, _BASES) != c
    shared = (first(x) == first(y)) | (first(x) == second(y)) | (second(x) == first(y)) | ((second(x) == second(y)) & (second(x) != "0"))
    return marked(x) & marked(y) & (F.translate(x, _MARKED, _BASES) == F.translate(y, _MARKED, _BASES)) & ~shared


def one_edit(a: Column, b: Column) -> Column:
    """One substitution that isn't a conflict of marks, one swap of neighbours, or one insertion."""
    clash = F.exists(F.zip_with(_chars(a), _chars(b), lambda x, y: (x != y) & mark_conflict(x, y)), lambda z: z)
    substituted = (F.length(a) == F.length(b)) & (F.length(a) - same_positions(a, b) == 1) & (a.rlike(r"^[\x00-\x7F]*$") | ~clash)
    return substituted | swapped(a, b) | one_insertion(a, b)


def slot_token_match(slot: Column, query: Column) -> Column:
    """A query token that is a proper prefix or one edit away from a slot token; both have four characters and the first in common."""
    return _bounded(slot, query) & ((F.startswith(slot, query) & (F.length(query) < F.length(slot))) | one_edit(slot, query))


def registry_token_match(a: Column, b: Column) -> Column:
    """As ``slot_token_match`` without the rule for prefixes."""
    return _bounded(a, b) & one_edit(a, b)


def shared_prefix(a: Column, b: Column) -> Column:
    n = F.least(F.length(a), F.length(b))
    return F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), n)), lambda i: (i <= n) & (F.substr(a, F.lit(1), i) == F.substr(b, F.lit(1), i))))


def shared_stem(a: Column, b: Column) -> Column:
    n = F.least(F.length(a), F.length(b))
    p = shared_prefix(a, b)
    return (n >= 6) & (p >= 4) & (3 * p >= 2 * n)


def close(literal: Column, query: Column) -> Column:
    """``close_tokens`` of columns."""
    alike = (positional(literal, query) >= positional_threshold(literal, query)) | one_insertion(literal, query)
    clash = ~literal.rlike(r"^[\x00-\x7F]*$") & ~query.rlike(r"^[\x00-\x7F]*$") & F.exists(F.zip_with(_chars(literal), _chars(query), lambda x, y: (x != y) & mark_conflict(x, y)), lambda z: z)
    return (F.substring(literal, 1, 1) == F.substring(query, 1, 1)) & alike & ~F.coalesce(clash, F.lit(False))


def positional_lookup(literals: DataFrame, terms: DataFrame) -> DataFrame:
    """(qid, token, term): the literal words (token) that words of queries (qid, term) stand for by position, other words of one first character being told apart in the JVM."""
    first = lambda c: F.substring(c, 1, 1).alias("first")
    words = terms.select("term").distinct().select("term", first("term"))
    pairs = literals.select("token").distinct().select("token", first("token")).join(words, "first").where(F.col("token") != F.col("term"))
    return pairs.where(close(F.col("token"), F.col("term"))).select("token", "term").join(terms, "term").select("qid", "token", "term")


def query_coverage(query: Column, candidate: Column) -> Column:
    """Square of the share of distinct query tokens that the candidate has; 1 for an empty query."""
    share = F.size(F.array_intersect(query, candidate)) / F.size(F.array_distinct(query))
    return F.when(F.size(query) == 0, F.lit(1.0)).otherwise(share * share)


def exact_intent(variants: Column, query: Column) -> Column:
    """The best share of a literal variant's words in the query; 1 without variants."""
    best = F.array_max(F.transform(variants, lambda v: F.when(F.size(v) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(v, query)) / F.size(v))))
    return F.when(F.size(variants) == 0, F.lit(1.0)).otherwise(best)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def coverage_blend(score: Column, query: Column, candidate: Column, blend: float = 0.05) -> Column:
    return score * ((1 - blend) + blend * query_coverage(query, candidate))


def relevance_key(text: Column, query: Column, text_tokens: Column, query_tokens: Column) -> Column:
    """Sort key (larger is closer): equal, one inside the other, Jaccard of tokens, minus the difference of lengths."""
    inside = F.contains(text, query) | F.contains(query, text)
    return F.struct((text == query).cast("int").alias("equal"), inside.cast("int").alias("inside"), jaccard(text_tokens, query_tokens).alias("jaccard"), (-F.abs(F.length(text) - F.length(query))).alias("near"))


def marks_conflict(a: str, b: str) -> bool:
    """Whether aligned characters have one base but marks with nothing in common: different words and no slip."""
    import unicodedata

    if a.isascii() or b.isascii():
        return False
    for x, y in zip(a, b, strict=False):
        if x != y:
            p, q = unicodedata.normalize("NFD", x), unicodedata.normalize("NFD", y)
            if len(p) > 1 and len(q) > 1 and p[0] == q[0] and not set(p[1:]) & set(q[1:]):
                return True
    return False


def close_tokens(literal: str, query: str) -> bool:
    """One first character, and enough equal positions or one insertion, without conflicting marks."""
    if not literal or not query or literal[0] != query[0]:
        return False
    low = min(len(literal), len(query))
    need = 0.75 if low <= 2 else 0.66 if low <= 3 else 0.60 if low <= 5 else 0.50
    share = sum(x == y for x, y in zip(literal, query, strict=False)) / max(len(literal), len(query))
    short, long = sorted((literal, query), key=len)
    insert = len(long) - len(short) == 1 and len(short) >= 2 and len(long) <= 1.6 * len(short) and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))
    return (share >= need or insert) and not marks_conflict(literal, query)


def matching(left: list[str], right: list[str], fits) -> int:
    """Size of a largest one-to-one assignment of ``left`` to ``right`` tokens that fit (augmenting paths)."""
    taken: dict[int, int] = {}

    def place(i: int, seen: set[int]) -> bool:
        for j, r in enumerate(right):
            if j not in seen and fits(left[i], r):
                seen.add(j)
                if j not in taken or place(taken[j], seen):
                    taken[j] = i
                    return True
        return False

    return sum(place(i, set()) for i in range(len(left)))


def positional_intent_py(variants: list[list[str]], query: list[str], own: list[str]) -> float:
    """Best over variants of (exact words + half of the further ones aligned one to one) / words; the candidate's own words are no evidence."""
    if not len(variants):
        return 1.0
    q, best = set(query), 0.0
    for v in variants:
        v = list(dict.fromkeys(v))
        if not v:
            return 1.0
        exact = [w for w in v if w in q]
        rest = [w for w in v if w not in q]
        free = sorted(q - set(exact) - set(own))
        best = max(best, (len(exact) + 0.5 * matching(rest, free, close_tokens)) / len(v))
    return best


@F.pandas_udf(DoubleType())
def positional_intent(variants: pd.Series, query: pd.Series, own: pd.Series) -> pd.Series:
    out, seen = [], {}
    for x, y, z in zip(variants, query, own, strict=True):
        if x is None:
            out.append(None)
            continue
        key = (tuple(tuple(v) for v in x), tuple(y), tuple(z))
        if key not in seen:
            seen[key] = positional_intent_py([list(v) for v in key[0]], list(y), list(z))
        out.append(seen[key])
    return pd.Series(out, dtype="float64")


def one_edit_py(a: str, b: str) -> bool:
    """``one_edit`` for two strings."""
    short, long = sorted((a, b), key=len)
    if len(long) > len(short):
        return len(long) == len(short) + 1 and len(short) >= 2 and len(long) <= 1.6 * len(short) and short in {long[:i] + long[i + 1 :] for i in range(len(long))}
    off = [(i, x, y) for i, (x, y) in enumerate(zip(a, b, strict=True)) if x != y]
    if len(off) == 2:
        (i, x, y), (j, u, v) = off
        return j == i + 1 and (x, y) == (v, u)
    return len(off) == 1 and not marks_conflict(off[0][1], off[0][2])


@lru_cache(maxsize=65_536)
def slot_match_py(slot: str, query: str) -> bool:
    """``slot_token_match`` for two strings."""
    if slot == query or slot[:1] != query[:1] or min(len(slot), len(query)) < SLOT_MIN_LENGTH:
        return False
    return slot.startswith(query) or one_edit_py(slot, query)


@lru_cache(maxsize=65_536)
def slot_fuzzy_py(a: str, b: str, least: int = SLOT_RATIO) -> bool:
    """Whether two tokens' ratio reaches ``least``; lengths that can't reach it are told without comparing."""
    return 200 * min(len(a), len(b)) >= least * (len(a) + len(b)) and ratio(a, b) >= least


def registry_fuzzy_py(slot: str, query: str, short: frozenset[str] = frozenset()) -> bool:
    """``slot_fuzzy_py`` for a registry value's token: it has three characters at least, and so has the query's unless it's one of ``short``."""
    return len(slot) >= 3 and (len(query) >= 3 or query in short) and slot_fuzzy_py(slot, query)


@F.pandas_udf(BooleanType())
def slot_fuzzy(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else slot_fuzzy_py(x, y) for x, y in zip(a, b, strict=True)], dtype="boolean")


@F.pandas_udf(BooleanType())
def registry_fuzzy(slot: pd.Series, query: pd.Series, short: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else registry_fuzzy_py(x, y, frozenset(z)) for x, y, z in zip(slot, query, short, strict=True)], dtype="boolean")


def registry_count_py(record: list[str], query: list[str]) -> int:
    """How many of a record's tokens have a query token of their own, exactly or one edit away."""
    return matching(record, query, lambda r, q: r == q or (r[:1] == q[:1] and min(len(r), len(q)) >= SLOT_MIN_LENGTH and one_edit_py(r, q)))


@F.pandas_udf(IntegerType())
def registry_count(record: pd.Series, query: pd.Series) -> pd.Series:
    return pd.Series([registry_count_py(list(dict.fromkeys(r)), list(dict.fromkeys(q))) for r, q in zip(record, query, strict=True)], dtype="int32")


def shared_stem_py(a: str, b: str) -> bool:
    """``shared_stem`` for two strings."""
    n = min(len(a), len(b))
    p = next((i for i in range(n) if a[i] != b[i]), n)
    return n >= 6 and p >= 4 and 3 * p >= 2 * n


@lru_cache(maxsize=65_536)
def anchored_py(token: str, query: tuple[str, ...]) -> bool:
    """Whether a payload's token stands in the query: itself, without diacritics, as a bounded variation, by a shared stem or by its ratio."""
    from lexiform.functions.text import fold_py

    return token in query or fold_py(token) in {fold_py(q) for q in query} or any(slot_match_py(token, q) or shared_stem_py(token, q) or slot_fuzzy_py(token, q) for q in query)


def payload_py(own: list[str], other: list[str], query: list[str]) -> bool:
    """Whether what distinguishes the payload ``own`` from ``other`` is in the query: every token of it, or all but one slip in a word of three letters among two shared words."""
    mine, theirs, q = sorted(set(own) - set(other)), set(other) - set(own), tuple(query)
    if mine and all(anchored_py(t, q) for t in mine):
        return True
    both = set(own) & set(other)
    if len(mine) != 1 or not theirs or len(both) < 2 or len(mine[0]) != 3 or not all(anchored_py(t, q) for t in both):
        return False
    return any(len(w) == 3 and w[0] == mine[0][0] and sum(x != y for x, y in zip(w, mine[0], strict=True)) == 1 for w in q)


@F.pandas_udf(BooleanType())
def payload_support(own: pd.Series, other: pd.Series, query: pd.Series) -> pd.Series:
    """``payload_py`` of columns; a null payload gives null."""
    return pd.Series([None if x is None or y is None else payload_py(list(x), list(y), list(z)) for x, y, z in zip(own, other, query, strict=True)], dtype="boolean")


NEAR = StructType([StructField(n, ArrayType(StringType())) for n in ("q_near", "q_near_text", "c_near", "c_entity", "c_anchor")])


@F.pandas_udf(NEAR)
def near_tokens(query: pd.Series, text: pd.Series, slots: pd.Series, short: pd.Series) -> pd.DataFrame:
    """What a query and a candidate have of each other's tokens, exactly or alike.

    q_near: tokens of the query that the candidate's text or slots have (by ratio); q_near_text: those that its text has; c_near: the candidate's tokens that
    the query has (by ratio); c_entity: those with evidence for a registry value; c_anchor: those with that or a bounded variation.
    """
    out, seen = [], {}
    for q, t, s, few in zip(query, text, slots, short, strict=True):
        key = (tuple(q), tuple(t), tuple(s), tuple(few))
        if key not in seen:
            q, t, s, few = key
            both, few = list(dict.fromkeys([*t, *s])), frozenset(few)
            like = lambda a, others: a in others or any(slot_fuzzy_py(a, o) for o in others)
            named = [x for x in both if x in q or any(registry_fuzzy_py(x, w, few) for w in q)]
            seen[key] = ([x for x in q if like(x, both)], [x for x in q if like(x, t)], [x for x in both if like(x, q)], named, [x for x in both if x in named or any(slot_match_py(x, w) for w in q)])
        out.append(seen[key])
    return pd.DataFrame(out, columns=NEAR.names)
