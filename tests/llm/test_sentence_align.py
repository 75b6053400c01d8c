import random

import numpy as np
import pyarrow as pa

from weftline.llm import sentence_align as A

SCHEMA = "file_id long, side string, line_no int, line string, n int, block string"


def corpus(files=60, seed=1):
    rng = random.Random(seed)
    vocab = {f"w{a}{b}": f"ک{chr(0x628 + i)}{chr(0x62a + j)}" for i, a in enumerate("abcdefghij") for j, b in enumerate("klmnopqr")}
    words = list(vocab)
    rows, want = [], set()
    for f in range(files):
        lines = [[rng.choice(words) for _ in range(rng.randrange(6, 12))] for _ in range(14)]
        src, tgt = [], []
        for k, ln in enumerate(lines):
            if k == 5:  # no counterpart
                src.append(" ".join(ln))
                continue
            text = " ".join(vocab[w] for w in ln)
            if k == 9:  # rendered together with the line before
                src.append(" ".join(ln))
                tgt[-1] += " " + text
            else:
                src.append(" ".join(ln))
                tgt.append(text)
            want.add((f, len(src), len(tgt)))
        if f % 4 == 0:  # a line moved
            tgt.append(tgt.pop(2))
            want = {(g, s, len(tgt) if t == 3 else t - 1 if t > 3 else t) if g == f else (g, s, t) for g, s, t in want}
        rows += [(f, A.SOURCE, i, x, 0, "") for i, x in enumerate(src, 1)] + [(f, A.TARGET, i, x, 0, "") for i, x in enumerate(tgt, 1)]
    return rows, want


def found(spark, rows, **kw):
    return {(r["file_id"], r["s_line"], r["t_line"]) for r in A.aligned(spark.createDataFrame(rows, SCHEMA), **kw).collect()}


def test_merges_omissions_and_moves(spark):
    rows, want = corpus()
    got = found(spark, rows)
    assert len(got & want) / len(want) > 0.95 and len(got & want) / len(got) > 0.95
    assert found(spark, rows, small_lexicon=0) == got  # the lexicon joined, not broadcast
    cut = found(spark, rows, block=7, margin=4)  # files longer than a block
    assert len(cut & want) / len(want) > 0.9


def test_void_and_one_sided(spark):
    rows, want = corpus(20)
    extra = [(500, A.SOURCE, 1, "wak wbl", 0, ""), (501, A.TARGET, 1, "کبت", 0, ""), (502, A.SOURCE, 1, None, 0, ""), (502, A.TARGET, 1, "", 0, ""), (503, A.SOURCE, 1, "...", 0, ""), (503, A.TARGET, 1, "nan", 0, ""), (504, "xx", 1, "a", 0, "")]
    extra += [(500, A.TARGET, None, "کبت", 0, ""), (0, A.SOURCE, None, "wak wbl", 0, ""), (None, A.SOURCE, 1, "wak wbl", 0, "")]
    got = found(spark, rows + extra + rows[:1])
    assert not {f for f, _, _ in got} & {500, 501, 502, 503, 504}
    assert found(spark, []) == set()


def test_size_does_not_change_results(spark):
    rows, _ = corpus()
    assert found(spark, rows, block=5, margin=0) == found(spark, rows)


def test_long_file_with_omitted_and_moved_passages(spark):
    """One file of which most lines stand far from their place in proportion."""
    rng = random.Random(3)
    vocab = {f"w{a}{b}": f"ک{chr(0x628 + i)}{chr(0x62a + j)}" for i, a in enumerate("abcdefghij") for j, b in enumerate("klmnopqr")}
    lines = [[rng.choice(list(vocab)) for _ in range(rng.randrange(6, 12))] for _ in range(300)]
    order = [*range(100), *range(180, 290), 20000, *range(290, 300)]
    order = [5 if k == 20000 else k for k in order if k != 5]  # a passage of 80 lines omitted, one line moved to near the end
    long = [(900, A.SOURCE, i, " ".join(x), 0, "") for i, x in enumerate(lines, 1)]
    long += [(900, A.TARGET, i, " ".join(vocab[w] for w in lines[k]), 0, "") for i, k in enumerate(order, 1)]
    want = {(900, k + 1, i) for i, k in enumerate(order, 1)}
    rows = corpus()[0] + long
    cut = found(spark, rows, block=40, margin=8)
    assert len(cut & want) > 0.97 * len(want) and (900, 6, order.index(5) + 1) in cut
    assert cut == found(spark, rows)


def made_side(lines):
    word, at = A.fold(pa.array(lines, pa.large_string()))
    return A.Side(np.arange(1, len(lines) + 1), np.array([len(x) for x in lines]), word, at)


def test_shared_counts_against_brute_force():
    rng = random.Random(4)
    s, t = ([" ".join(rng.choices("a b 1 22 c".split(), k=rng.randrange(1, 6))) for _ in range(40)] for _ in range(2))
    want = {(i, j): n for i, x in enumerate(s) for j, y in enumerate(t) if (n := len(set(x.split()) & set(y.split())))}
    for cells in (1, 50, 10**6):
        got = [(int(i), int(j), int(n)) for part in A.shared_counts(made_side(s), made_side(t), cells) for i, j, n in zip(*part)]
        assert {(i, j): n for i, j, n in got} == want and len(got) == len(want)


def test_a_large_file_is_cut_without_loss():
    rng = random.Random(5)
    vocab = {f"w{a}{b}": f"ک{chr(0x628 + i)}{chr(0x62a + j)}" for i, a in enumerate("abcdefghij") for j, b in enumerate("klmnopqr")}
    lines = [rng.choices(list(vocab), k=rng.randrange(5, 15)) + ([str(rng.randrange(10**6))] if rng.random() < 0.2 else []) for _ in range(900)]
    order = [*range(300), *range(380, 900)]  # a passage omitted, lines moved
    for _ in range(12):
        order.insert(rng.randrange(len(order)), order.pop(rng.randrange(len(order))))
    s, t = made_side([" ".join(x) for x in lines]), made_side([" ".join(vocab.get(w, w) for w in lines[k]) for k in order])
    words = [(A.fold(pa.array([a]))[0][0], A.fold(pa.array([b]))[0][0]) for a, b in vocab.items()]
    lexicon = A.Lexicon(*(np.array(x) for x in zip(*words)), np.full(len(words), 0.9))
    want = {(k, i) for i, k in enumerate(order)}
    whole, cut = (set(zip(*(x.tolist() for x in A.by_words(s, t, lexicon, most=most)[:2]))) for most in (10**9, 20_000))
    assert len(A.rectangles(s, t, 20_000)) > 5 and len(cut & want) >= len(whole & want) - 2 and len(cut - want) <= len(whole - want) + 2
    assert len(cut & want) > 0.98 * len(want)
    i, j = A.confident(s, t, most=20_000)
    assert len(set(zip(i.tolist(), j.tolist())) & want) > 0.9 * len(i)
    assert A.rectangles(made_side(["a b"] * 50), made_side(["a b"] * 50), 10) == [(0, 50, 0, 50)]


def test_a_file_of_more_than_a_million_cells_is_whole():
    """A passage with the only numbers of the file, moved over 300 lines: cut there, the lines between are on different sides."""
    rng = random.Random(6)
    vocab = {f"w{a}{b}": f"ک{chr(0x628 + i)}{chr(0x62a + j)}" for i, a in enumerate("abcdefghij") for j, b in enumerate("klmnopqr")}
    lines = [rng.choices(list(vocab), k=rng.randrange(5, 40)) + ([str(10_000 + k)] if 500 <= k < 506 else []) for k in range(1100)]
    order = [*range(500), *range(506, 800), *range(500, 506), *range(800, 1100)]
    s, t = made_side([" ".join(x) for x in lines]), made_side([" ".join(vocab.get(w, w) for w in lines[k]) for k in order])
    pairs = lambda found: list(zip(*(x.tolist() for x in found)))
    words = [(A.fold(pa.array([a]))[0][0], A.fold(pa.array([b]))[0][0]) for a, b in vocab.items()]
    lexicon = A.Lexicon(*(np.array(x) for x in zip(*words)), np.full(len(words), 0.9))
    want = {(k, i) for i, k in enumerate(order)}
    assert len(set(pairs(A.confident(s, t))) & want) > 0.95 * len(want)
    assert pairs(A.confident(s, t)) == pairs(A.confident(s, t, most=10**9))
    assert pairs(A.by_words(s, t, lexicon)) == pairs(A.by_words(s, t, lexicon, most=10**9))
    assert {x[:2] for x in pairs(A.by_words(s, t, lexicon))} >= want


def test_sizes_of_strips_do_not_change_ways_or_scores(monkeypatch):
    rng = np.random.default_rng(7)
    tables = []
    for n, m in ((1, 1), (1, 9), (9, 1), (40, 60), (60, 40), (75, 75)):
        for low, high in ((-1, 2), (-3, 2), (0, 1)):  # many equal ways
            x = rng.integers(low, high, (3, n, m)).astype(float)
            x[1, 0] = -1e9
            tables.append(x)
    x = np.full((3, 50, 90), -1.0)
    x[0, np.arange(50), np.arange(40, 90) * (np.arange(50) > 20)] = 1  # a passage left out that is longer than a strip
    tables.append(x)

    def ways():
        return [[z.tolist() for z in A.align(lambda i, k, low, high: x[:, i:k, low:high], *x.shape[1:])] for x in tables]

    def best(x):
        total = np.zeros((x.shape[1] + 1, x.shape[2] + 1))
        for i in range(1, total.shape[0]):
            for j in range(1, total.shape[1]):
                ways = [total[i - 1, j], total[i, j - 1], total[i - 1, j - 1] + x[0, i - 1, j - 1]]
                ways += [total[i - 2, j - 1] + x[1, i - 1, j - 1]] if i > 1 else []
                ways += [total[i - 1, j - 2] + x[2, i - 1, j - 1]] if j > 1 else []
                total[i, j] = max(ways)
        return total[-1, -1]

    def value(x, i, j):
        total, k = 0, 0
        while k < len(i):
            two_s, two_t = k + 1 < len(i) and j[k] == j[k + 1], k + 1 < len(i) and i[k] == i[k + 1]
            at = k + 1 if two_s or two_t else k
            total, k = total + x[1 if two_s else 2 if two_t else 0, i[at], j[at]], at + 1
        return total

    whole = ways()
    assert [value(x, *way) for x, way in zip(tables, whole)] == [best(x) for x in tables]
    rows, _ = corpus(3)
    every = [[r[3] for r in rows if r[1] == side] for side in (A.SOURCE, A.TARGET)]
    s, t = made_side(every[0] * 2), made_side(every[1] * 2)  # lines that occur again
    word = np.unique(s.word)
    lexicon = A.Lexicon(np.repeat(word, 3), rng.choice(np.unique(t.word), 3 * len(word)), rng.random(3 * len(word)))
    aligned = lambda: [[x.tolist() for x in z] for z in (A.confident(s, t), A.by_words(s, t, lexicon))]
    found = aligned()
    for block, cells, tile, parts in ((2000, 30, 7, 16), (5, 10**6, 1, 2), (2000, 500, 13, 3), (1, 1, 50, 16)):
        monkeypatch.setattr(A, "CELLS", cells)
        monkeypatch.setattr(A, "TILE", tile)
        monkeypatch.setattr(A, "PARTS", parts)
        monkeypatch.setattr(A.align, "__defaults__", (block,))
        assert ways() == whole
        assert aligned() == found
