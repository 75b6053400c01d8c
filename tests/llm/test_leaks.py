import random

import numpy as np

from weftline.llm import leaks as K

LINES = [(1, "one two three four five six seven eight nine ten"), (2, "A b c d e f g h"), (3, "short line"), (4, None), (5, "nan"), (6, "")]


def found(spark, texts, lines=LINES, **kw):
    t = spark.createDataFrame(texts, "tbl string, rec_id long, text string, item_id int, words int")
    ln = spark.createDataFrame(lines, "item_id long, line string, longest int" if lines and len(lines[0]) > 2 else "item_id long, line string")
    return {(r["rec_id"], r["item_id"]) for r in K.leaks(t, ln, **kw).where(K.is_case()).collect()}


def test_cases(spark):
    texts = [
        "x One, two THREE\nfour five y", "one two three four x six seven", "one two X four five six Y eight nine ten",  # half; less; two replaced
        "one two X four five Z Y eight nine ten", "a short-line b", "short line", "a  SHORT\tline!", "six seven eight nine ten one two three four five",
        None, "", "nan", "b c d e", "b c d", "z " * 50_000 + "five six seven eight nine " + "z " * 50_000,
    ]
    got = found(spark, [("t", i, t, 0, 0) for i, t in enumerate(texts)])
    assert got == {(0, 1), (2, 1), (5, 3), (6, 3), (7, 1), (11, 2), (13, 1)}
    assert got == found(spark, [("t", i, t, 0, 0) for i, t in enumerate(texts)], block_lines=2)


def test_null_ids(spark):
    got = found(spark, [(None, 1, "short line", 0, 0), ("t", None, "short line", 0, 0)], LINES + [(None, "short line")])
    assert got == {(1, 3), (None, 3)}


def test_empty(spark):
    assert found(spark, []) == set()
    assert found(spark, [("t", 1, "one two three", 0, 0)], lines=[(4, None)]) == set()


def brute_longest(a, b):
    return max((k for i in range(len(a)) for j in range(len(b)) for k in [next((n for n in range(min(len(a) - i, len(b) - j) + 1) if n == min(len(a) - i, len(b) - j) or a[i + n] != b[j + n]))]), default=0)


def test_tiling_against_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        a = np.array([rng.randrange(5) for _ in range(rng.randrange(3, 14))], np.uint64)
        b = np.array([rng.randrange(5) for _ in range(rng.randrange(3, 30))], np.uint64)
        tiles = K.greedy_tiles(a, b, 2)
        want = brute_longest(a.tolist(), b.tolist())
        assert max((t[2] for t in tiles), default=0) == (want if want >= 2 else 0)
        assert all((a[i : i + n] == b[j : j + n]).all() for i, j, n in tiles)
        used_a, used_b = [x for i, _, n in tiles for x in range(i, i + n)], [x for _, j, n in tiles for x in range(j, j + n)]
        assert len(used_a) == len(set(used_a)) and len(used_b) == len(set(used_b))
        assert [t[2] for t in tiles] == sorted((t[2] for t in tiles), reverse=True)


def test_coverage_finds_reordered(spark):
    t = spark.createDataFrame([("t", 1, "six seven eight nine ten and one two three four five")], "tbl string, rec_id long, text string")
    r = K.leaks(t, spark.createDataFrame(LINES[:1], "item_id long, line string")).first()
    assert r["coverage"] == 1.0 and r["longest"] == 5


def is_case(line, text):
    """Half of the words in one run, or the line in its place with two words replaced (one at least its own)."""
    n, m = len(line), len(text)
    if any(line[i : i + -(-n // 2)] == text[j : j + -(-n // 2)] for i in range(n) for j in range(m) if i + -(-n // 2) <= n):
        return True
    return any(sum(a == b for a, b in zip(line, text[j : j + n])) >= max(1, n - 2) for j in range(m - n + 1))


def test_lines_of_any_length_against_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(60)]
    lines = [(i, rng.choices(words, k=1 + i % 14)) for i in range(42)]
    texts = []
    for i in range(300):
        text = rng.choices(words, k=rng.randrange(0, 30))
        own = list(rng.choice(lines)[1])
        for _ in range(rng.randrange(0, 4)):
            own[rng.randrange(len(own))] = "other"
        at = rng.randrange(len(text) + 1)
        texts.append((i, text[:at] + own + text[at:] if i % 2 else text))
    want = {(i, k) for i, t in texts for k, ln in lines if is_case(ln, t)}
    rows = [("t", i, " ".join(t), 0, 0) for i, t in texts]
    own = [(k, " ".join(ln)) for k, ln in lines]
    assert len(want) > 200 and found(spark, rows, own) == want
    index = K.LineIndex([k for k, _ in own], [x for _, x in own])
    tokens, starts = K.words(K.pa.array([r[2] for r in rows], K.pa.large_string()))
    whole = [x.tolist() for x in index.candidates(tokens, starts, None)]
    monkeypatch.setattr(K, "HITS", 7)
    monkeypatch.setattr(K, "CELLS", 11)
    assert [x.tolist() for x in index.candidates(tokens, starts, None)] == whole
