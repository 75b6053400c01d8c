import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.functions import labels as L
from weftline.functions import text as T


def col(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_flatten_and_words(spark):
    values = ["a\n\nb", " x ", "a\tb", "a　b", "", "  ", "NaN", None, "nan x"]
    assert col(spark, values, T.flatten("c")) == ["a b", "x", "a b", "a b", "", "", "NaN", "", "nan x"]
    assert col(spark, values, T.clean("c")) == ["a b", "x", "a b", "a b", "", "", "", "", "nan x"]
    assert col(spark, values, T.n_words("c")) == [2, 1, 2, 2, 0, 0, 1, 0, 2]
    assert [list(x) for x in col(spark, values, T.words("c"))] == [["a", "b"], ["x"], ["a", "b"], ["a", "b"], [], [], ["NaN"], [], ["nan", "x"]]
    assert col(spark, ["", "none", "NULL", "x", None], T.is_nan_like("c")) == [True, True, True, False, True]


def test_scripts(spark):
    p = col(spark, ["اَ ab 12 ؟ क", "", None], T.script_counts("c"))
    assert tuple(p[0]) == (5, 2, 1, 2, 0) and tuple(p[1]) == (0, 0, 0, 0, 0) == tuple(p[2])
    one = "اﭘ a ۔"
    assert col(spark, [one], T.arabic_share("c", "basic"))[0] == pytest.approx(1 / 3)
    assert col(spark, [one], T.arabic_share("c", "wide"))[0] == pytest.approx(2 / 3)
    assert col(spark, [one], T.arabic_share("c", "all"))[0] == pytest.approx(2 / 6)
    assert col(spark, ["12", ""], T.arabic_share("c")) == [0.0, 0.0]
    assert col(spark, ["अ", "a", None], T.has_devanagari("c")) == [True, False, False]


def test_marks_and_keys(spark):
    assert col(spark, ["کِتَاُبٕ"], T.strip_key("c")) == ["کتابٕ"]
    assert col(spark, ["کِتَاُبٕ"], T.mark_count("c")) == [3] and col(spark, ["کِتَاُبٕ"], T.mark_count("c", True)) == [4]
    assert col(spark, ["کِ", ""], T.density("c")) == [50.0, 0.0]
    assert col(spark, ["A, b.  کِ", None], T.loose_key("c")) == ["a b ک", ""]
    assert col(spark, ["Straße É", None], T.loose_key_exact("c")) == ["strasse e", None]
    assert col(spark, ["a.b,c?d;e%"], T.map_punctuation("c")) == ["a۔b،c؟d؛e٪"]
    assert col(spark, ["é"], T.normal_form("c", "NFC")) == ["é"]
    assert [sorted(x) for x in col(spark, ["abcdef", "abc", "", "aaaaaaa"], T.grams("c"))] == [["abcde", "bcdef"], ["abc"], [], ["aaaaa"]]
    assert col(spark, ["ہے، x", ""], T.marker_fraction("c")) == [0.5, 0.0]
    assert col(spark, [" a‍  b. ", "NaN", None], T.normalize("c", strip_joiner=True, punctuation=True)) == ["a b۔", "", ""]
    assert tuple(col(spark, ["ؤؤؤ"], T.composition_counts("c", [("ؤ", "ؤ")]))[0]) == (2, 1)


def test_labels(spark):
    values = ["کِتَب", "ِا", "ا ِب", "اَُب", "", "a\nَb"]
    assert col(spark, values, L.base_text("c")) == ["کتب", "ا", "ا ب", "اب", "", "a\nb"]
    assert [list(x) for x in col(spark, values, L.labels("c"))] == [[1, 3, 0], [0], [0, 0, 0], [3, 0], [], [0, 0, 0]]
    back = L.apply_labels(L.base_text("c"), L.labels("c"))
    assert col(spark, values, back) == ["کِتَب", "ا", "ا ب", "اَب", "", "a\nb"]
    assert all(col(spark, values, L.insertion_only(F.col("c"), back)))
    with pytest.raises(Exception, match="differ in number"):
        col(spark, ["ab"], L.apply_labels(F.col("c"), F.array(F.lit(0))))


@given(st.lists(st.text(alphabet="ab  ", max_size=60), min_size=1, max_size=20), st.integers(1, 12))
@settings(max_examples=15, deadline=None)
def test_chunks_join(spark, texts, most):
    for text, parts in zip(texts, col(spark, texts, L.chunk("c", most))):
        assert "".join(p["before"] + p["piece"] for p in parts) == text
        assert all(len(p["piece"]) <= most for p in parts)


def test_decisions(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0, 0.0, 0.0]), (2, [2.0, 1.0, 0.0, 1.0]), (3, [0.0, 0.0, 3.0, 0.0])], "i int, x array<double>")
    rows = df.orderBy("i").select(
        L.decide(L.softmax("x")), L.decide(L.softmax("x"), threshold=0.3), L.decide(L.softmax("x"), per_mark=[0.9, 0.9, 0.2]), L.decide(L.softmax("x", -5.0))
    ).collect()
    assert [tuple(r) for r in rows] == [(0, 1, 3, 1), (0, 1, 0, 1), (2, 2, 0, 2)]  # the last: 0.87 is less than 0.9, 0.04 less than 0.2


@given(st.lists(st.text(alphabet="aÉßﬁ ِؤئآ_-.,각가क़ाো\n ٣½Ⅳ😀", max_size=12), max_size=6))
@settings(max_examples=300, deadline=None)
def test_exact_keys_of_many_texts(texts):
    got = T.loose_key_exact.func(T.pa.array([*texts, None], T.pa.string())).to_pylist()
    assert got == [*map(T.exact_key, texts), None]
