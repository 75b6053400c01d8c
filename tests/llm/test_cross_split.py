import random

from hypothesis import given, settings
from hypothesis import strategies as st
import numpy as np
import pyarrow as pa

from weftline.llm import cross_split as C

SCHEMA = "row_id long, split_name string, s string, t string, fld string, hi int, size int"


def found(spark, rows):
    df = spark.createDataFrame([(*r, "", 0, 0) for r in rows], SCHEMA)
    return {(r["row_id_a"], r["row_id_b"]) for r in C.cross_pairs(df).select("row_id_a", "row_id_b").collect()}


def grams(text):
    t = "".join(chr(C.fold_table()[ord(c)]) for c in text if C.fold_table()[ord(c)])
    return {t[i : i + 5] for i in range(max(1, len(t) - 4))} if t else set()


def test_against_brute_force(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(3, 9))) for _ in range(400)]
    rows = []
    for i in range(480):
        text = " ".join(rng.choices(words, k=rng.randrange(4, 22)))
        rows.append([i, rng.choice(["train", "train", "eval", "r0"]), text, " ".join(rng.choices(words, k=12))])
        if i % 3 == 0:  # an edited copy
            copy = list(text.title())
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice("xyz ")
            rows.append([1000 + i, rng.choice(["train", "eval"]), "".join(copy) + "!", " ".join(rng.choices(words, k=12))])
    want = set()
    sets = [(r[0], r[1] == "train", grams(r[2]), grams(r[3])) for r in rows]
    for a in sets:
        for b in sets:
            if a[1] and not b[1] and any(len(x & y) >= 0.8 * len(x | y) - 1e-9 for x, y in ((a[2], b[2]), (a[3], b[3]))):
                want.add((min(a[0], b[0]), max(a[0], b[0])))
    assert len(want) > 20 and found(spark, rows) == want


def test_cases(spark):
    same = "the quick brown fox jumps over"
    rows = [
        (1, "train", same, None), (2, "eval", same.upper() + "!", None), (2, "eval", same, None), (3, "r0", None, same), (4, None, same, None), (5, "train", "nan", "nan"), (6, "eval", "nan", ""),
        (7, "train", "...", None), (8, "eval", "...", None), (9, "train", "ab", None), (10, "eval", "AB", None), (11, "train", "x" * 100_000, None), (12, "eval", "x" * 99_000, None),
        (13, "other", same, None), (None, "train", same, None), (None, "eval", same, None),
    ]
    assert found(spark, rows) == {(1, 2), (9, 10), (11, 12)}


def test_empty_and_hot(spark):
    assert found(spark, []) == set()
    rows = [(i, "train", "one and the same text again", f"t{i}") for i in range(300)] + [(1000 + i, "eval", "One and the same text, again", f"e{i}") for i in range(3)]
    assert found(spark, rows) == {(i, 1000 + k) for i in range(300) for k in range(3)}


@given(st.lists(st.text(alphabet="abcdef ", max_size=60), min_size=1, max_size=5))
@settings(max_examples=100, deadline=None)
def test_chunks_cover_and_depend_on_content_only(texts):
    both = C.Texts(pa.array(texts, pa.large_string()), np.zeros(len(texts), bool))
    flags = C.cuts(both.starts, both.least)
    assert flags[both.starts].all()
    for i, t in enumerate(texts):
        one = C.Texts(pa.array([t], pa.large_string()), np.zeros(1, bool))
        alone = C.cuts(one.starts, one.least)
        assert (np.flatnonzero(alone)[:-1] == np.flatnonzero(flags[both.starts[i] : both.starts[i + 1]])).all() or not len(one.cps)


@given(st.text(alphabet="abcdefgh", min_size=20, max_size=80), st.text(alphabet="abcdefgh", max_size=20), st.text(alphabet="abcdefgh", max_size=20))
@settings(max_examples=200, deadline=None)
def test_a_span_is_found_in_any_text_that_holds_it(text, before, after):
    keys = lambda x: np.concatenate([k[3] for k in C.Texts(pa.array([x], pa.large_string()), np.zeros(1, bool)).spans])
    assert set(keys(text)) <= set(keys(before + text + after))


def edited(rng, text, n, alphabet):
    for k in sorted(rng.sample(range(len(text)), min(n, len(text))), reverse=True):
        text = text[:k] + rng.choice([rng.choice(alphabet), "", rng.choice(alphabet) * 2]) + text[k + 1 :]
    return text


def test_edits_of_any_text_against_brute_force(spark):
    """Short and long texts, edits evenly spread or anywhere, as many as the similarity allows and more."""
    rng, rows, want = random.Random(4), [], set()
    letters = "abcdefghijklmnop"
    for i in range(6000):
        alphabet = letters if i % 5 else "abc"
        a = "".join(rng.choices(alphabet, k=rng.choice([rng.randrange(9, 40), rng.randrange(40, 100), rng.randrange(100, 300)])))
        e = max(1, len(a) // 45)
        if i % 3 == 0:
            b = list(a)
            for k in range(e):
                b[min(len(b) - 1, int((k + 0.5) * len(b) / e) + rng.randrange(-3, 4))] = rng.choice(letters)
            b = "".join(b)
        elif i % 3 == 1:
            b = edited(rng, a, rng.randrange(1, e + 2), alphabet)
        else:
            k = rng.randrange(0, len(a))
            b = (a[k:] + a[:k], a[: -max(1, len(a) // 6)], a[len(a) // 6 :], a[:k] + a[k + len(a) // 7 :])[rng.randrange(4)]
        rows += [(2 * i, "eval", a, None), (2 * i + 1, "train", b, None)]
        if len(grams(a) & grams(b)) >= 0.8 * len(grams(a) | grams(b)):
            want.add((2 * i, 2 * i + 1))
    assert len(want) > 2000
    got = found(spark, rows)
    assert {p for p in got if p[1] == p[0] + 1 and p[0] % 2 == 0} == want
