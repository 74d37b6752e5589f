"""Text functions: normalisation, folding, tokens, n-grams, numbers, phrases. Columns in, columns out."""

from __future__ import annotations

import math
import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lexiform.config import BY_LANGUAGE, HOTWORD_CONFIDENCE, LATIN, NGRAM, RANGE_TOLERANCE

#: Private-use characters that stand for punctuation to be kept while the rest goes.
_KEEP = {c: chr(0xE000 + i) for i, c in enumerate(".,:-°%")}
_MINUS = "[−‐‑‒–﹣－]"
_WORD = r"[\p{L}\p{M}\p{N}_]"
_STEPS = (
    (rf"(?<!{_WORD})\.(?=\p{{Nd}})|(?<=\p{{Nd}})\.(?=\p{{Nd}})", _KEEP["."]),
    (rf"(?<!{_WORD}),(?=\p{{Nd}})|(?<=\p{{Nd}}),(?=\p{{Nd}})", _KEEP[","]),
    (r"(?<=\p{Nd}):(?=\p{Nd})", _KEEP[":"]),
    (r"(?<=\p{Nd})-(?=\p{Nd})", _KEEP["-"]),
    (rf"(?<!{_WORD})-(?=[{_KEEP['.']}{_KEEP[',']}]?\p{{Nd}})", _KEEP["-"]),
)
_KEPT = "".join(_KEEP.values())


def normalize(text: Column) -> Column:
    """Lower case, punctuation to spaces but for that of numbers, white space collapsed; wholly in the JVM.

    Exact for text whose compatibility and case-folded forms are its lower case (plain and most accented Latin text);
    ``normalize_any`` covers the rest. Null gives null.
    """
    t = F.lower(text)
    number = F.regexp_replace(t, rf"(?<!{_WORD}){_MINUS}(?=[.,]?\p{{Nd}})", "-")
    for pattern, mark in _STEPS:
        number = F.regexp_replace(number, pattern, mark)
    for sign in "°%":
        number = F.regexp_replace(number, rf"(?<=\p{{Nd}})(\s*){sign}", "$1" + _KEEP[sign])
    t = F.when(t.rlike(r"\p{Nd}"), number).otherwise(t)
    t = F.regexp_replace(t, "[\u200c\u200d]", "")
    t = F.regexp_replace(t, rf"[^\p{{L}}\p{{M}}\p{{N}}_\s{_KEPT}]" + "|[\ufe00-\ufe0f\u20e3]", " ")
    t = F.regexp_replace(t, r"(?<![\p{L}\p{M}\p{N}_])\p{M}+", "")
    t = F.trim(F.regexp_replace(t, "[\\s\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000]+", " "))
    return F.translate(t, _KEPT, "".join(_KEEP))


def normalize_py(text: str | None) -> str | None:
    """The same with compatibility forms and full case folding."""
    if text is None:
        return None
    t = unicodedata.normalize("NFKC", text).casefold()
    if regex.search(r"\p{Nd}", t):
        t = regex.sub(rf"(?<!{_WORD}){_MINUS}(?=[.,]?\p{{Nd}})", "-", t)
        for pattern, mark in _STEPS:
            t = regex.sub(pattern, mark, t)
        for sign in "°%":
            t = regex.sub(rf"(?<=\p{{Nd}})(\s*){sign}", r"\1" + _KEEP[sign], t)
    t = regex.sub("[\u200c\u200d]", "", t)
    t = regex.sub(rf"[^\p{{L}}\p{{M}}\p{{N}}_\s{_KEPT}]" + "|[\ufe00-\ufe0f\u20e3]", " ", t)
    t = regex.sub(r"(?<![\p{L}\p{M}\p{N}_])\p{M}+", "", t)
    t = regex.sub(r"\s+", " ", t).strip()
    return t.translate({ord(v): k for k, v in _KEEP.items()})


@F.pandas_udf(StringType())
def normalize_arrow(text: pd.Series) -> pd.Series:
    return text.map(normalize_py, na_action="ignore")


def normalize_any(text: Column) -> Column:
    """``normalize`` for any script: the JVM path for ASCII text, an Arrow UDF for what isn't."""
    plain = text.isNull() | text.rlike(r"^[\x00-\x7F]*$")
    return F.when(plain, normalize(text)).otherwise(normalize_arrow(F.when(~plain, text)))


_ACCENTED = "".join(c for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if len(d := unicodedata.normalize("NFD", c)) > 1 and d[0].isascii() and c.islower())
_BARE = "".join(unicodedata.normalize("NFD", c)[0] for c in _ACCENTED)


def fold(normalized: Column, language: str | None = None) -> Column:
    """Normalised text without Latin diacritics: the language's own replacements, then the general ones, then marks on Latin letters."""
    t = normalized
    for table in (BY_LANGUAGE.get((language or "").split("-")[0], {}), LATIN):
        for a, b in table.items():
            t = F.replace(t, F.lit(a), F.lit(b))
    t = F.translate(t, _ACCENTED, _BARE)
    return F.regexp_replace(t, "(?<=[a-z])[\u0300-\u036f]+", "")


def fold_py(text: str, language: str | None = None) -> str:
    t = normalize_py(text) or ""
    for table in (BY_LANGUAGE.get((language or "").split("-")[0], {}), LATIN):
        for a, b in table.items():
            t = t.replace(a, b)
    out = []
    for c in unicodedata.normalize("NFD", t):
        if unicodedata.combining(c) and out and "LATIN" in unicodedata.name(next((x for x in reversed(out) if not unicodedata.combining(x)), " "), ""):
            continue
        out.append(c)
    return unicodedata.normalize("NFC", "".join(out))


def tokens(normalized: Column) -> Column:
    """The words of normalised text; empty text has none."""
    return F.filter(F.split(normalized, " "), lambda x: x != "")


def char_ngrams(normalized: Column, size: int = NGRAM) -> Column:
    """The distinct character n-grams of the text without spaces; a text of at most ``size`` characters is its own only one."""
    if size < 1:
        raise ValueError("size must be at least 1")
    c = F.replace(normalized, F.lit(" "), F.lit(""))
    many = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - size + 1)), lambda i: F.substr(c, i, F.lit(size))))
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(many)


def literal_variants(text: Column) -> Column:
    """Alternatives parted by ``|`` as arrays of distinct words; blank ones dropped."""
    return F.filter(F.transform(F.split(text, r"\|"), lambda v: F.array_distinct(tokens(normalize(v)))), lambda v: F.size(v) > 0)


def literal_tokens(text: Column) -> Column:
    return tokens(normalize(text))


def parse_float(text: Column) -> Column:
    """A number with an optional unit sign and either decimal mark; null if there is none."""
    t = F.trim(F.regexp_replace(F.trim(text), r"[°%\s]+$", ""))
    return F.when(t.rlike(r"\d"), F.expr("1D") * F.replace(t, F.lit(","), F.lit(".")).try_cast("double"))


def on_grid(value: Column, start: Column, step: Column, offsets: tuple[float, ...] = (0.0,)) -> Column:
    """Whether ``value`` is start + k * step + one of the offsets, for an integer k; a null step is 1, a step of 0 has no grid."""
    s = F.coalesce(step, F.lit(1.0))
    hit = F.lit(False)
    for o in offsets:
        d = (value - start - F.lit(o)) / s
        hit = hit | (F.abs(d - F.round(d)) <= RANGE_TOLERANCE)
    return F.when(s == 0, F.lit(False)).otherwise(hit)


def output_value(value: Column) -> Column:
    """A number as text, whole numbers without a decimal point."""
    return F.when(value == F.floor(value), value.cast("long").cast("string")).otherwise(value.cast("string"))


def slot_value_tokens(value: Column) -> Column:
    """Distinct words of a slot value; null has none."""
    return F.coalesce(F.array_distinct(tokens(normalize(value))), F.array().cast("array<string>"))


def language_code(text: Column) -> Column:
    t = F.lower(F.replace(F.trim(text), F.lit("_"), F.lit("-")))
    return F.when(t == "", F.raise_error(F.lit("a language must not be blank"))).otherwise(t)


def json_map(text: Column) -> Column:
    """A JSON object as a map of strings; anything else is an empty map."""
    return F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))


def slot_alias_values(rows: DataFrame, key: str, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """(key, "key", vals) of rows (key, slots): the values that each slot name may stand for: its own, that of a slot ``name:scope`` for ``name``, and those of the names it's an alias of."""
    one = rows.select(key, F.explode("slots").alias("own", "val")).where("val is not null")
    names = F.array_distinct(F.array(F.col("own"), F.split_part("own", F.lit(":"), F.lit(1))))
    one = one.select(key, F.explode(names).alias("name"), "val")
    table = F.create_map(*[x for k, v in aliases.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]) if aliases else F.create_map().cast("map<string,array<string>>")
    also = F.concat(F.array("name"), F.coalesce(F.element_at(table, F.col("name")), F.array().cast("array<string>")))
    return one.select(key, F.explode(also).alias("key"), "val").groupBy(key, "key").agg(F.collect_set("val").alias("vals"))  # a row's own slots


def csv_names(text: Column) -> Column:
    return F.coalesce(F.filter(F.split(text, ","), lambda x: x != ""), F.array().cast("array<string>"))


def compact_key(text: Column) -> Column:
    """The text without spaces if that leaves at least four characters, else empty."""
    t = F.replace(text, F.lit(" "), F.lit(""))
    return F.when(F.length(t) >= 4, t).otherwise("")


_COMPACT = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsBopomofo}]"


def is_compact_script(text: Column) -> Column:
    """Whether the text has letters of scripts written without spaces and no others beyond ASCII."""
    rest = F.regexp_replace(F.regexp_replace(text, r"[\x00-\x7F]", ""), r"[^\p{L}\p{M}\p{N}]", "")
    return (F.length(rest) > 0) & (F.length(F.regexp_replace(rest, _COMPACT + r"|\p{M}", "")) == 0)


def compound_spans(words: Column) -> Column:
    """Joined runs of two to four consecutive words that have at least four characters; for one word of a compact script its substrings of 2 to 16."""
    n = F.size(words)
    runs = F.flatten(F.transform(F.sequence(F.lit(2), F.lit(4)), lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - k + 1)), lambda i: F.array_join(F.slice(words, i, k), ""))).otherwise(F.array().cast("array<string>"))))
    one = F.element_at(words, 1)
    parts = F.flatten(F.transform(F.sequence(F.lit(2), F.lit(16)), lambda k: F.when(F.length(one) >= k, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(one) - k + 1)), lambda i: F.substr(one, i, k))).otherwise(F.array().cast("array<string>"))))
    return F.array_distinct(F.when((n == 1) & is_compact_script(one), parts).otherwise(F.filter(runs, lambda s: F.length(s) >= 4)))


def has_phrase(text: Column, phrase: Column) -> Column:
    """Whether ``phrase`` stands in ``text`` at word borders; phrases of compact scripts also anywhere in the text without spaces."""
    plain = F.instr(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" "))) > 0
    return plain | (is_compact_script(phrase) & F.contains(F.replace(text, F.lit(" "), F.lit("")), F.replace(phrase, F.lit(" "), F.lit(""))))


def deletions(token: Column) -> Column:
    """The distinct strings left by deleting one character."""
    n = F.length(token)
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n)), lambda i: F.concat(F.substr(token, F.lit(1), i - 1), F.substr(token, i + 1)))))


def strip_leading_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s\p{P}$+<=>^`|~]+", "")


def clean_expanded(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def length_key(text: Column) -> Column:
    """Sort key of expanded texts: words, then characters."""
    return F.struct(F.size(tokens(clean_expanded(text))).alias("words"), F.length(text).alias("chars"))


def clean_hotwords(words: Column) -> Column:
    return F.filter(F.transform(words, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))


def clamp_threshold(value: float | None) -> float:
    return min(1.0, max(0.0, value)) if isinstance(value, (int, float)) and math.isfinite(value) else HOTWORD_CONFIDENCE


def full_literal(variants: Column, query: Column) -> Column:
    """Whether some variant's words all stand in the query; true where there are no variants."""
    return (F.size(variants) == 0) | F.exists(variants, lambda v: F.size(F.array_except(v, query)) == 0)
