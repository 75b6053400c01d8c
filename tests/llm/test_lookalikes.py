from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import lookalikes as K


def pairs(spark, rows):
    df = spark.createDataFrame(rows, "tbl string, id long, text string, look int, n string")
    return {tuple(r) for r in K.lookalike_pairs(df).collect()}


def test_cases(spark):
    rows = [(i, t) for i, t in enumerate([
        "کتاب A-1 آب", "كتاب A-1 آب", "کتاب Ａ-１ آب", "کتاب‌ A-1 آب", "کتاب A-1 آب",  # 0-4 look the same
        "کتاب  A-1 آب\n", "کتاب a-1 آب", "کتاب A-1 آب!", "گتاب A-1 آب", "کتَاب A-1 آب",  # 5: blanks only; 6-9: visible differences
    ])]
    got = pairs(spark, [("x", i, t, 0, None) for i, t in rows] + [("y", 0, "کتاب A-1 آب", 0, "")])
    same = {0, 1, 2, 3, 4, 5}
    assert got == {("x", a, b) for a in same for b in same if a < b and {a, b} != {0, 5}}


def test_order_of_marks_and_ligatures(spark):
    got = pairs(spark, [("x", 1, "بَّ لا", 0, ""), ("x", 2, "بَّ ﻻ", 0, ""), ("x", 3, "بَ ﻻ", 0, "")])
    assert got == {("x", 1, 2)}


def test_void_repeated_long_empty(spark):
    long = "abc " * 60_000
    rows = [("x", 1, None, 0, ""), ("x", 2, "", 0, ""), ("x", 3, "nan", 0, ""), ("x", 4, long, 0, ""), ("x", 5, long + "​", 0, ""), ("x", 5, long + "​", 0, "")]
    df = spark.createDataFrame(rows, "tbl string, id long, text string, look int, n string").where(K.has_text("text"))
    assert {tuple(r) for r in K.lookalike_pairs(df).collect()} == {("x", 4, 5)}
    assert pairs(spark, []) == set()


def test_classes_are_transitive_and_frequent():
    counts = {"ي": 5, "ی": 9, "ى": 1, "ﻱ": 2, " ": 3, " ": 7, "Α": 4, "A": 1}
    table = K.rewrites(counts)
    assert {table[x] for x in ("ي", "ى", "ﻱ")} == {"ی"} and table[" "] == " " and table["A"] == "Α"
    assert K.rewrites(counts | {"ي": 50})["ی"] == "ي"


@given(st.text(alphabet="کكيیىﻻلاAΑَّٓ‍  x", max_size=30))
@settings(max_examples=200, deadline=None)
def test_rewriting_is_idempotent(text):
    c = K.Canonicaliser(K.rewrites({x: i + 1 for i, x in enumerate("کكيیىﻻلاAΑَّٓ‍  x")}))
    once = c.rewrite(text)
    assert c.rewrite(once) == once


def test_parts_around_an_invisible_character():
    c = K.Canonicaliser(K.rewrites({"ﻻ": 9, "ل": 1, "ا": 1, "‍": 1}))
    assert c.rewrite("ل‍ا") == c.rewrite("لا") == c.rewrite("ﻻ")


def test_composed_characters_that_hold_a_member(spark):
    texts = ["\u0626\u0627\u0628 A1", "\u0626\u0627\u0628\u00a0A1", "\u0626\u0627\u0628 A\uff11", "\u06cc\u0654\u0627\u0628 A1", "\u06cc\u06cc", "\u06cc\u06cc\u06cc", "\u064a"]
    got = pairs(spark, [("x", i, t, 0, "") for i, t in enumerate(texts)])
    assert got == {("x", a, b) for a in range(4) for b in range(4) if a < b}


def test_fast_path_agrees_with_rewriting():
    c = K.Canonicaliser(K.rewrites({"\u06cc": 9, "\u064a": 1, " \u064c\u0651": 1, "\ufc5e": 9, " ": 9}))
    for text in ("\u0626\u0627", "a\t\u064c\u0651", "\u00e9 \u0622", "plain"):
        assert c.many(K.pa.array([text])) == [" ".join(c.rewrite(text).split())]


def test_joined_letters_numerals_and_hyphens(spark):
    rows = ["of\ufb01ce A-1", "office A\u20101", "office A\u20111", "IV\u2026", "\u2163...", "\u2160\u2164...", "0l1", "OI1", "\u03d1", "\u03b8", "s", "\u017f"]
    got = pairs(spark, [("x", i, t, 0, "") for i, t in enumerate(rows)])
    assert got == {("x", 0, 1), ("x", 0, 2), ("x", 1, 2), ("x", 3, 4), ("x", 3, 5), ("x", 4, 5)}


def test_a_hot_group_is_cut_into_parts(spark):
    """Many rows of one text and a few of another: every pair comes out once, by parts of few rows."""
    from weftline.llm.common import unlike_pairs

    rows = [("g", "one", i) for i in range(100)] + [("g", "two", 100 + i) for i in range(7)] + [("g", "three", 200)] + [("h", "one", 300), ("h", "one", 301)]
    df = spark.createDataFrame(rows, "k string, kind string, id long")
    got = sorted(tuple(sorted((r["a_id"], r["b_id"]))) for r in unlike_pairs(df, ["k"], "kind", "id", hot=9).collect())
    kind = {i: k for _, k, i in rows}
    assert got == sorted((a, b) for a in range(300) for b in range(a + 1, 300) if a in kind and b in kind and kind[a] != kind[b])
