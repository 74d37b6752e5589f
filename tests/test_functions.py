import pytest
from pyspark.sql import functions as F

from lexiform.functions import similarity as S
from lexiform.functions import text as T

GOLDEN = [
    ("  Bật, ĐÈN!!  Phòng   Khách  ", "bật đèn phòng khách"), ("kitchen-light", "kitchen light"), ("minus - 5 spaced", "minus 5 spaced"), ("set timer for 12:30", "set timer for 12:30"),
    ("−5 degrees", "-5 degrees"), ("27.5° is 50 %!", "27.5° is 50 %"), (".5 and -.5, a-5", ".5 and -.5 a 5"), ("", ""), ("a‌b", "ab"),
]


def one(spark, *cols):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def test_normalize(spark):
    rows = spark.createDataFrame(GOLDEN, "t string, want string").select("t", "want", T.normalize("t").alias("n"), T.normalize_any(F.col("t")).alias("a")).collect()
    for r in rows:
        assert r.n == r.want == r.a == T.normalize_py(r.t)
    assert spark.createDataFrame([(None,)], "t string").select(T.normalize("t")).first()[0] is None


def test_full_case_folding_needs_the_general_path(spark):
    assert one(spark, T.normalize_any(F.lit("STRAßE ﬁn"))) == ("strasse fin",)


@pytest.mark.parametrize(("text", "language", "want"), [("Bật ĐÈN phòng khách", "vi", "bat den phong khach"), ("Küche", "de", "kueche"), ("ü", "en", "u"), ("नमस्ते", "hi", "नमस्ते")])
def test_fold(spark, text, language, want):
    assert T.fold_py(text, language) == want
    if language != "hi":
        assert one(spark, T.fold(T.normalize(F.lit(text)), language)) == (want,)


def test_char_ngrams(spark):
    got = one(spark, *[T.char_ngrams(F.lit(x)) for x in ("abc def", "ab", "")])
    assert [sorted(x) for x in got] == [["abc", "bcd", "cde", "def"], ["ab"], []]
    with pytest.raises(ValueError):
        T.char_ngrams(F.lit("a"), 0)


def test_numbers_and_grids(spark):
    assert one(spark, T.parse_float(F.lit("20,5")), T.parse_float(F.lit("50 %")), T.parse_float(F.lit("x")), T.parse_float(F.lit("1.2.3"))) == (20.5, 50.0, None, None)
    half = F.lit(20.5), F.lit(0.0), F.lit(None).cast("double")
    assert one(spark, T.on_grid(*half), T.on_grid(*half, (0.0, 0.5)), T.on_grid(F.lit(3.0), F.lit(0.0), F.lit(0.0))) == (False, True, False)
    assert one(spark, T.output_value(F.lit(3.0)), T.output_value(F.lit(3.5))) == ("3", "3.5")


def test_small_text_functions(spark):
    empty = F.array().cast("array<string>")
    assert one(spark, T.compact_key(F.lit("a b")), T.compact_key(F.lit("ab cd"))) == ("", "abcd")
    assert one(spark, T.is_compact_script(F.lit("東京 a")), T.is_compact_script(F.lit("abc")), T.is_compact_script(F.lit("東京 é"))) == (True, False, False)
    assert one(spark, T.has_phrase(F.lit("turn on the light"), F.lit("the light")), T.has_phrase(F.lit("turn on the lights"), F.lit("the light")), T.has_phrase(F.lit("打開 東京燈"), F.lit("東京"))) == (True, False, True)
    assert one(spark, T.full_literal(F.array().cast("array<array<string>>"), empty)) == (True,)
    assert one(spark, T.strip_leading_punctuation(F.lit(" ,.$ ok!")), T.language_code(F.lit(" de_DE "))) == ("ok!", "de-de")
    assert one(spark, T.json_map(F.lit("[1]")), T.json_map(F.lit('{"a": "b"}'))) == ({}, {"a": "b"})
    assert one(spark, T.csv_names(F.lit("a,,b")), T.literal_variants(F.lit("Turn on|| switch"))) == (["a", "b"], [["turn", "on"], ["switch"]])
    assert T.clamp_threshold(float("nan")) == 0.85 and T.clamp_threshold(2) == 1 and T.clamp_threshold(None) == 0.85


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            row[j], prev = (prev + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1]


def test_lcs_against_the_table():
    from hypothesis import given
    from hypothesis import strategies as st

    @given(st.text("abc", max_size=12), st.text("abc", max_size=12))
    def run(a, b):
        assert S.lcs(a, b) == brute_lcs(a, b)

    run()


def test_fuzzy():
    assert S.combined_fuzzy("turn on light", "turn on light") == 1.0
    assert S.combined_fuzzy("", "a") == 0.0
    assert S.combined_fuzzy("turn on the kitchen light", "turn on light") < 0.95
    assert S.token_set_ratio("a b c", "a b") == 100.0


def test_bounded_matches(spark):
    m = lambda a, b: (S.slot_token_match(F.lit(a), F.lit(b)), S.registry_token_match(F.lit(a), F.lit(b)))
    assert one(spark, *m("kitchen", "kitc")) == (True, False)
    assert one(spark, *m("kitchen", "kitcehn")) == (True, True)
    assert one(spark, *m("kitchen", "kitchem")) == (True, True)
    assert one(spark, *m("kitchen", "xitchen")) == (False, False)
    assert one(spark, *m("lamp", "lam")) == (False, False)
    assert one(spark, S.shared_stem(F.lit("lighting"), F.lit("lights")), S.one_insertion(F.lit("ab"), F.lit("abc"))) == (True, True)
    assert S.marks_conflict("ó", "ộ") and not S.marks_conflict("á", "ắ")


def test_positional_intent():
    assert S.positional_intent_py([], ["a"], []) == 1.0
    assert S.positional_intent_py([["turn", "on"]], ["turn", "lamp"], []) == 0.5
    assert S.positional_intent_py([["switch"]], ["swicth"], []) == 0.5
    assert S.positional_intent_py([["switch"]], ["swicth"], ["swicth"]) == 0.0
