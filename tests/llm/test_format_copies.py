import numpy as np

from weftline.llm import bloom
from weftline.llm import format_copies as C


def found(spark, rows, **kw):
    df = spark.createDataFrame(rows, "tbl string, id long, s string, t string, h int, digest string")
    return {tuple(r) for r in C.copies(df, **kw).collect()}


def test_copies_cases(spark):
    rows = [
        ("a", 5, "Foo, bar", "x y", 0, ""), ("a", 2, "foo BAR!", "xy.", 0, ""), ("a", 9, "X Y", "foobar", 0, None),  # sides exchanged
        ("b", 2, "foo bar", "x y", 0, ""),  # other table
        ("a", 3, "foo1", "xy", 0, ""), ("a", 4, None, "xy", 0, ""), ("a", 6, "", "xy", 0, ""), ("a", 7, " NaN ", "xy", 0, ""),
        ("a", 8, "ﻙَ", "q", 0, ""), ("a", 10, "ﻙ", "q", 0, ""),  # a vowel mark counts
        ("a", 11, "z" * 200_000, "q", 0, ""), ("a", 12, "Z " * 200_000, "q", 0, ""), ("a", 12, "z" * 200_000, "q!", 0, ""),
    ]
    want = {
        ("a", 5, 2, 3), ("a", 2, 2, 3), ("a", 9, 2, 3), ("b", 2, 2, 1), ("a", 3, 3, 1), ("a", 8, 8, 1), ("a", 10, 10, 1),
        ("a", 11, 11, 3), ("a", 12, 11, 3),
    }
    assert found(spark, rows) == want


def test_many_small_filters_give_the_same_and_pass_little(spark, monkeypatch):
    """A table 60 times what one filter of the bound holds: the filters grow in number, not in what they let pass."""
    rows = [("a", i, f"text {i % 2900}", "t", 0, "") for i in range(3000)]
    want = found(spark, rows)
    monkeypatch.setattr(bloom, "BLOCK_RECORDS", 64)
    df = spark.createDataFrame(rows, "tbl string, id long, s string, t string, h int, digest string")
    again, alone = C.split_repeats(df, max_bits=1 << 7)
    assert 200 <= again.count() < 400 and again.count() + alone.count() == 3000
    assert found(spark, rows, max_bits=1 << 7) == want
    assert sum(r[3] == 2 for r in want) == 200


def test_empty(spark):
    assert found(spark, []) == set()


def test_serialised(spark):
    rows = [
        (1, None, '{"t":"b","s":"a","config":"c"}', "s"), (2, None, '{"s":"a","t":"b', ""), (3, "tgt\tsrc", "b\ta", ""), (4, "tgt\tsrc", "b", ""),
        (5, None, None, ""), (6, None, "", ""), (7, "src\ttgt", None, ""), (8, None, '{"s":"\\u0061"}', ""), (9, "src\ttgt\tx", "a\tb\t", ""),
    ]
    df = spark.createDataFrame(rows, "line_id long, head_line string, payload string, s string")
    got = {tuple(r) for r in C.read_serialised(df).collect()}
    assert got - {(6, None, None)} == {(1, "a", "b"), (3, "a", "b"), (8, "a", None), (9, "a", "b")}
    assert {r[0] for r in C.keyed(C.read_serialised(df).selectExpr("'x' tbl", "line_id id", "s", "t")).select("id").collect()} == {1, 3, 9}


def test_filter_never_misses(spark, monkeypatch):
    rng = np.random.default_rng(1)
    h = rng.integers(-(2**62), 2**62, 5000)
    df = spark.createDataFrame([(int(x),) for x in np.concatenate([h, h[:200]])] + [(None,)], "h long").repartition(5)
    for records, bits in ((bloom.BLOCK_RECORDS, bloom.MAX_BITS), (100, 1 << 12), (100, 1 << 9)):
        monkeypatch.setattr(bloom, "BLOCK_RECORDS", records)
        monkeypatch.setattr(bloom, "FLUSH", 300)
        seen, again = list(bloom.fit(df, bits)), list(bloom.fit(df, bits, repeated=True))
        passes = lambda fs, x: np.any([f.passes(x) for f in fs], axis=0)
        assert passes(seen, h).all() and passes(again, h[:200]).all()
        assert passes(again, h[200:]).mean() < 0.05 and passes(seen, rng.integers(-(2**62), 2**62, 5000)).mean() < 0.1
        one = bloom.fit_one(df, bits)
        assert one.passes(h).all() and len(one.packed) * 8 <= max(bits, 64 << one.width)
