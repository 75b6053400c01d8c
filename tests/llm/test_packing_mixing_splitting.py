import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import mixing as X
from weftline.llm import packing as P
from weftline.llm import splitting as S
from weftline.llm.tokens import tokenizer


def packed(spark, rows, capacity=100):
    df = spark.createDataFrame(rows, "doc_id long, tokens long, part int, rank int")
    return P.pack(df, capacity).collect()


def test_packing_holds_everything_once(spark):
    rng = random.Random(1)
    sizes = [(i, rng.choice([3, 7, 20, 33, 48, 51, 99, 250]) if i % 3 else 40, 0, 0) for i in range(3000)]  # a third of one length
    sizes += [(9001, 0, 0, 0), (9002, None, 0, 0), (5, 7, 0, 0)]
    rows = packed(spark, sizes)
    boxes: dict = {}
    for r in rows:
        boxes.setdefault(r["container_id"], []).append(r)
    assert all(sum(r["tokens"] for r in b) == b[0]["filled"] <= 100 for b in boxes.values())
    assert sum(r["tokens"] for r in rows) == sum(t or 0 for _, t, _, _ in sizes)
    whole = [r for r in rows if r["doc_id"] == 5]
    assert len(whole) == 2  # the repeated row
    split = {r["doc_id"] for r in rows if r["part"] > 0}
    assert split == {i for i, t, _, _ in sizes if (t or 0) > 100}
    assert len(boxes) <= -(-sum(r["tokens"] for r in rows) // 100) * 1.03 + 1


def test_ranks_in_several_buckets(spark, monkeypatch):
    monkeypatch.setattr(P, "RANKED", 50)
    rows = packed(spark, [(i, 40 if i % 3 else 20, 0, 0) for i in range(900)])
    boxes: dict = {}
    for r in rows:
        boxes.setdefault(r["container_id"], []).append(r["tokens"])
    assert len(rows) == 900 and all(sum(b) <= 100 for b in boxes.values()) and len(boxes) <= 304


def test_packing_empty(spark):
    assert packed(spark, []) == []


@given(st.lists(st.integers(1, 64), max_size=80))
@settings(max_examples=60, deadline=None)
def test_solve_uses_the_histogram(lengths):
    h = np.bincount(lengths, minlength=65) if lengths else np.zeros(65, np.int64)
    out = P.solve(h.astype(np.int64), 64)
    used = np.zeros(65, np.int64)
    for sizes, times in out:
        assert sum(sizes) <= 64 and times > 0
        for s in sizes:
            used[s] += times
    assert (used == h).all()


DOCS = "doc_id long, source string, tokens long, quality double, rest int, key int"


def test_mixing_shares(spark):
    rng = random.Random(2)
    docs = [(i, "big" if i % 3 else rng.choice("abc"), rng.randrange(5, 60), rng.uniform(0.1, 1), 0, 0) for i in range(6000)] + [(7000 + i, "tiny", 30, 1.0, 0, 0) for i in range(20)]
    targets = [("big", 0.5, 1), ("a", 0.2, 2), ("b", 0.1, 1), ("tiny", 0.1, 4), ("none", 0.1, 2)]
    sizes = spark.createDataFrame(docs, DOCS)
    goal = spark.createDataFrame(targets, "source string, target_share double, max_repeat int")
    chosen = X.mix(sizes, goal)
    got = {r["source"]: r for r in X.shares(chosen, goal).collect()}
    for source, share, most in targets[:4]:
        assert got[source]["share"] == pytest.approx(share / 0.9, rel=0.01) and got[source]["most_copies"] <= most
    assert got["none"]["tokens"] == 0 and got["tiny"]["most_copies"] == 4 and got["tiny"]["documents"] == 20
    assert chosen.where("copies < 1").count() == 0 and chosen.where("source = 'c'").count() == 0
    part = {r["source"]: r for r in X.shares(X.mix(sizes, goal, total=5000.0), goal).collect()}
    assert part["big"]["tokens"] == pytest.approx(5000 * 0.5 / 0.9, rel=0.01)


def test_mixing_against_the_order_gone_through(spark):
    """The rows taken are those of a walk in order that skips what does not fit, and of all walks after it."""
    rng = random.Random(4)
    docs = [(i, rng.choice("ab"), rng.randrange(1, 300), rng.choice([0.05, 0.5, 1.0]), 0, 0) for i in range(800)]
    docs += [(5, "a", 7, 1.0, 0, 0)] * 3
    sizes = spark.createDataFrame(docs, DOCS)
    goal = spark.createDataFrame([("a", 0.6, 3), ("b", 0.4, 3)], "source string, target_share double, max_repeat int")
    total = 1.7 * sum(d[2] for d in docs if d[1] == "a") / 0.6
    got = {(r["doc_id"], r["source"], r["tokens"]): r["copies"] for r in X.mix(sizes, goal, total=total).collect()}
    keys = sizes.select("doc_id", "source", "tokens", (-X.F.log((X.F.pmod(X.F.xxhash64("doc_id", X.F.lit(X.SEED)), X.F.lit(1 << 52)) + 0.5) / float(1 << 52)) / X.F.col("quality")).alias("key")).collect()
    for source, share in (("a", 0.6), ("b", 0.4)):
        own = sorted((r["key"], r["doc_id"], r["tokens"]) for r in keys if r["source"] == source)
        have = sum(x[2] for x in own)
        epochs = min(3, int(share * total / have + 1e-9))
        room = min(share * total, 3 * have) - epochs * have
        want = {}
        for _, i, _ in own:
            want[i] = want.get(i, 0) + epochs
        left = own if epochs < 3 else []
        while True:  # prefixes of what fits into the room, again and again
            fits, taken, used = [x for x in left if x[2] <= room], [], 0
            for x in fits:
                if used + x[2] > room:
                    break
                taken.append(x)
                used += x[2]
            if not taken:
                break
            room -= used
            for x in taken:
                want[x[1]] += 1
                left.remove(x)
        near = [(abs(x[2] - room), x) for x in left if abs(x[2] - room) < room]
        if near:
            want[min(near)[1][1]] += 1
        assert {i: n for (i, s, _), n in got.items() if s == source} == {i: n for i, n in want.items() if n}


def test_mixing_cases(spark):
    goal = spark.createDataFrame([("a", 0.5, 1), (None, 0.2, 1), ("b", None, 1), ("c", 0.5, -1)], "source string, target_share double, max_repeat int")
    sizes = spark.createDataFrame([(1, "a", 5, 1.0, 0, 0), (2, None, 5, 1.0, 0, 0), (3, "c", 5, 1.0, 0, 0), (1, "a", 5, 1.0, 0, 0)], DOCS)
    assert {(r["doc_id"], r["source"]) for r in X.mix(sizes, goal).collect()} == {(1, "a")}
    assert X.mix(sizes.limit(0), goal).count() == 0 and X.mix(sizes, goal.limit(0)).count() == 0
    docs = spark.createDataFrame([(1, "a", None), (2, "a", ""), (3, None, "x y"), (4, "a", "nan")], "doc_id long, source string, text string")
    assert [r["doc_id"] for r in X.measured(docs).collect()] == [3]


def check_pieces(text, limit, overlap):
    own = tokenizer()
    out = S.pieces(text, own, limit, overlap)
    if own.count(text) <= limit:
        assert out == []
        return out
    assert all(n == own.count(text[a:b]) <= limit for a, b, _, n in out)
    assert "".join(text[new:b] for _, b, new, _ in out) == text
    assert all(x[1] == y[2] and y[0] <= y[2] for x, y in zip(out, out[1:]))
    return out


SENTENCES = "The old boat left. It came back late! یِم کِتاب چھَ اَصٕل۔ किताब अच्छी है। "


@pytest.mark.parametrize("text", [SENTENCES * 40, "word " * 900, "x" * 3000, "کِ" * 900, "\n\n".join([SENTENCES] * 30), "😀" * 300, "| 12 | 34 |\n" * 200, "short", ""])
def test_pieces(text):
    out = check_pieces(text, 100, 12)
    if text.startswith("The old"):
        strength = S.boundary_strength(text)
        assert all(strength[b] >= S.SENTENCE for _, b, _, _ in out[:-1])


@given(st.text(alphabet="ab \n.۔کِ😀", max_size=400), st.integers(20, 60), st.integers(0, 10))
@settings(max_examples=80, deadline=None)
def test_pieces_round_trip(text, limit, overlap):
    check_pieces(text, limit, overlap)


def test_split_rows(spark):
    rows = [(1, SENTENCES * 60, "x"), (2, None, "x"), (3, "", "x"), (4, "nan", "x"), (5, "short", "x"), (1, SENTENCES * 60, "x")]
    got = S.split(spark.createDataFrame(rows, "doc_id long, text string, pieces string"), 100, 10).collect()
    assert {r["doc_id"] for r in got} == {1}
    assert len(got) == 2 * got[0]["pieces"]
    with pytest.raises(ValueError):
        S.split(spark.createDataFrame(rows, "doc_id long, text string, pieces string"), 10, 10)
