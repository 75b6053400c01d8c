"""Problem 5: sentence alignment in bilingual documents.

Lines are aligned by length first (Gale and Church's model, beads of 1-1, 1-0, 0-1, 2-1, 1-2). One-to-one
beads whose lengths and anchors (equal numbers and codes) do not contradict each other train
word-translation probabilities by expectation-maximization (IBM model 1) over all files. Then each file
is aligned again by dynamic programming over lexical scores, and lines left over, such as moved ones,
are paired where they are each other's best match.

Defined cases: null, blank and `nan` lines keep their numbers and are in no pair; a file with one side
only gives none; lines without a number are ignored; a repeated line number is kept as a line of its own with that number; ties go to the
smaller line number; sides other than the two named and other columns are ignored; an empty table gives an empty
result. Every file is aligned by one task and as a whole, whatever its size: time grows with the product of its sides. The tables
lines x lines are made for at most BLOCK source lines and about CELLS cells at a time: the dynamic programming keeps the totals
between some strips and where the way to them comes from, and goes back over the part of each strip that the way passes, so results do
not depend on these sizes. Lines out of order are sought in the whole file. Memory grows with the lines of a file.
"""

from __future__ import annotations

import bisect
import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import flat
from weftline.llm import leaks
from weftline.llm.common import has_text, sorted_distinct, stored, table, written

SOURCE, TARGET = "eng_Latn", "kas_Arab"
#: Most source lines, and most cells, of the tables lines x lines held at once.
BLOCK, CELLS = 2000, 4_000_000
#: Lines a side of the tables words x lines behind them.
TILE = 1000
#: Strips of a table that is larger, between which totals are kept.
PARTS = 16
#: Lines between anchors that confirm each other, and how much their distance may differ on the two sides.
NEAR, DRIFT = 60, 12
#: Variance of the length difference a character, and prior costs of beads, of the length model.
VARIANCE = 6.8
ONE_ONE, SKIP_ONE, TWO_ONE = 0.1, 4.5, 2.4
ROUNDS = 5
#: Least probability of a pair of words that stays in the lexicon, and pairs of lines in which it must stand.
LEAST_P, LEAST_SEEN = 0.01, 2
#: Pairs of words up to which their table is broadcast (24 bytes each); a larger one is joined to the blocks.
SMALL_LEXICON = 4_000_000
#: Pairs of lines whose pairs of words are counted at once.
PAIRS = 8000
#: Lexical score that a line must reach to be paired in order, and out of order.
IN_ORDER, MOVED = 0.33, 0.37
#: Share of a line's words that a line must render to be a counterpart at all, and to be one of several.
LEAST_COVER, PART_COVER = 0.38, 0.55

_digits: np.ndarray | None = None


def fold(part: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the words of each line, marks and punctuation left out, digits of any script as one."""
    global _digits
    if _digits is None:
        t = leaks.word_table().copy()
        for cp in range(0x660, 0x20000):
            if unicodedata.category(chr(cp)) == "Nd":
                t[cp] = 48 + unicodedata.decimal(chr(cp))
        _digits = t
    return leaks.words(part, _digits)


@dataclass
class Side:
    """The lines of one side of a file, in order."""

    no: np.ndarray
    size: np.ndarray  # characters
    word: np.ndarray  # digests of the words of all lines
    at: np.ndarray  # starts of the lines among the words

    def part(self, i: int, k: int) -> Side:
        return Side(self.no[i:k], self.size[i:k], self.word[self.at[i] : self.at[k]], self.at[i : k + 1] - self.at[i])


def length_cost(a: np.ndarray, b: np.ndarray, ratio: float) -> np.ndarray:
    """Minus the log probability that texts of a and b characters are translations, by their length."""
    mean = (a + b / ratio) / 2
    d = np.abs(b - a * ratio) / np.sqrt(np.maximum(mean, 1) * VARIANCE)
    return np.minimum(d * d / 2, 30) + 0.0


def strips(n: int, m: int, block: int) -> list[tuple[int, int]]:
    """Ranges of n lines of which the tables with m others are held at once."""
    step = max(1, min(block, CELLS // max(m, 1)))
    return [(i, min(n, i + step)) for i in range(0, n, step)]


def options(one: np.ndarray, two_s: np.ndarray, two_t: np.ndarray, last: np.ndarray, above: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(columns to the left, whether two rows up, totals) of the moves 3, 4 and 5 to a row; above, last: the totals of the two rows before."""
    yield 1, 0, last[:-1] + one
    yield 1, 1, above[:-1] + two_s
    yield 2, 0, last[:-2] + two_t[1:]


def sweep(one: np.ndarray, two_s: np.ndarray, two_t: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Moves of some rows of the dynamic programming; above: the totals of the two rows before.

    1 and 2 leave out a first or second line, 3, 4 and 5 are beads of 1-1, 2-1 and 1-2. Of equal ones the least is taken, 2 only if it is better.
    """
    n, m = one.shape
    move, (before, last) = np.ones((n, m + 1), np.int8), above
    for i in range(n):
        value = last.copy()
        for k, (shift, _, total) in enumerate(options(one[i], two_s[i], two_t[i], last, before), 3):
            better = total > value[shift:]
            np.copyto(value[shift:], total, where=better)
            np.copyto(move[i, shift:], k, where=better)
        run = np.maximum.accumulate(value)
        np.copyto(move[i], 2, where=run > value)
        before, last = last, run
    return move


def forward(rewards, rows: tuple[int, int], low: int, high: int, above: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Totals of the last two of some rows, and the column in which the way that sweep takes to each comes from above."""
    before, last = above
    every = np.arange(high - low + 1, dtype=np.int32)
    come_before, come = every, every
    for a, b in strips(rows[1] - rows[0], high - low, block):
        for each in zip(*rewards(rows[0] + a, rows[0] + b, low, high)):
            value, start = last.copy(), come.copy()
            for shift, two_up, total in options(*each, last, before):
                better = total > value[shift:]
                np.copyto(value[shift:], total, where=better)
                np.copyto(start[shift:], (come_before if two_up else come)[:-shift], where=better)
            run = np.maximum.accumulate(value)
            come_before, come = come, start[np.maximum.accumulate(np.where(run > value, 0, every))]
            before, last = last, run
    return np.stack([before, last]), np.stack([come_before, come])


def align(rewards, n: int, m: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Dynamic programming over rewards: beads (first, second line or -1) of 1-1, 2-1, 1-2; skips give 0.

    rewards(i, k, low, high) gives for the lines i to k and low to high one[i, j], the reward of i with
    j, two_s[i, j], of i - 1 and i with j, and two_t[i, j], of i with j - 1 and j. Returns pairs (i, j),
    a bead of three lines as two of them.

    Of a table that is too large, totals are kept between PARTS strips only, with the column of the border above in which
    the way to each of them starts. So the way back is known at the borders, and each strip is done again
    between the two columns that it passes there: the totals on the way and the moves are the same as in the whole table.
    """
    pairs: list[tuple[int, int]] = []

    def back(start: int, i: int, low: int, j: int, above: np.ndarray) -> tuple[int, int]:
        """Follows the way from (i, j) up to the row start, at most one above it by a bead of two source lines."""
        if i - start > 1 and (i - start > block or (i - start) * (j - low) > CELLS):
            step, borders = -(-(i - start) // PARTS), []
            for a in range(start, i, step):
                below, come = forward(rewards, (a, min(i, a + step)), low, j, above, block)
                borders.append((a, min(i, a + step), above, come))
                above = below
            for a, b, top, come in reversed(borders):
                if i > a:
                    first = int(come[1 if i == b else 0][j - low])
                    i, j = back(a, i, low + first, j, top[:, first : j - low + 1])
            return i, j
        move = sweep(*rewards(start, i, low, j), above)
        while i > start:
            k = move[i - 1 - start, j - low]
            if k == 1:
                i -= 1
            elif k == 2:
                j -= 1
            elif k == 3:
                pairs.append((i - 1, j - 1))
                i, j = i - 1, j - 1
            elif k == 4:
                pairs.extend([(i - 1, j - 1), (i - 2, j - 1)])
                i, j = i - 2, j - 1
            else:
                pairs.extend([(i - 1, j - 1), (i - 1, j - 2)])
                i, j = i - 1, j - 2
        return i, j

    back(0, n, 0, m, np.stack([np.full(m + 1, -np.inf), np.zeros(m + 1)]))
    found = np.array(pairs[::-1], np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def shifted(x: np.ndarray, axis: int) -> np.ndarray:
    """The values of the line before, minus infinity-like for the first."""
    out = np.full_like(x, -1e9)
    if axis == 0:
        out[1:] = x[:-1]
    else:
        out[:, 1:] = x[:, :-1]
    return out


def by_length(s: Side, t: Side, block: int = BLOCK, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the alignment by length."""
    ratio = max(0.2, min(5.0, t.size.sum() / max(1, s.size.sum())))
    a, b = s.size.astype(float), t.size.astype(float)
    a2, b2 = a + np.concatenate([[0.0], a[:-1]]), b + np.concatenate([[0.0], b[:-1]])
    gain = SKIP_ONE * 2

    distinct = [np.unique(x, return_inverse=True) for x in (a, b, a2, b2)]
    tables: dict[tuple[int, int], np.ndarray] = {}  # of the costs of distinct lengths, which are fewer than the lines

    def cost(x: int, y: int, i: int, k: int, low: int, high: int) -> np.ndarray:
        (first, own), (second, other) = distinct[x], distinct[y]
        own, other = own[i:k], other[low:high]
        if (k - i) * (high - low) <= len(first) * len(second):
            return length_cost(first[own][:, None], second[other][None, :], ratio)
        if (x, y) not in tables:
            tables[x, y] = length_cost(first[:, None], second[None, :], ratio)
        out = np.empty((k - i, high - low))
        for r, line in enumerate(own):
            np.take(tables[x, y][line], other, out=out[r], mode="clip")
        return out

    def rewards(i: int, k: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        one = gain - ONE_ONE - cost(0, 1, i, k, low, high)
        two_s, two_t = gain * 1.5 - TWO_ONE - cost(2, 1, i, k, low, high), gain * 1.5 - TWO_ONE - cost(0, 3, i, k, low, high)
        if i == 0:
            two_s[:1] = -1e9
        return one, two_s, two_t

    return align_parts(rewards, rectangles(s, t, most), block)


def word_lines(z: Side) -> tuple[np.ndarray, np.ndarray]:
    """(word, line), each word once a line, sorted by word and line."""
    line = flat.row_ids(z.at)
    order = np.lexsort((line, z.word))
    word, line = z.word[order], line[order]
    new = np.ones(len(word), bool)
    new[1:] = (word[1:] != word[:-1]) | (line[1:] != line[:-1])
    return word[new], line[new]


def shared_counts(s: Side, t: Side, cells: int = CELLS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, n) of lines with n > 0 equal words, which are numbers, codes and the like; by blocks of source lines, in order."""
    (word, line), (other, at) = word_lines(s), word_lines(t)
    order = np.argsort(line, kind="stable")
    word, line = word[order], line[order]
    low = np.searchsorted(other, word)
    times = np.searchsorted(other, word, "right") - low
    word, line, low, times = (x[times > 0] for x in (word, line, low, times))
    ends = np.append(np.flatnonzero(line[1:] != line[:-1]) + 1, len(line)) if len(line) else np.zeros(0, np.int64)
    done, sums = 0, np.concatenate([[0], np.cumsum(times)])
    while done < len(line):
        fit = ends[(ends > done) & (sums[ends] <= sums[done] + cells)]
        to = int(fit[-1]) if len(fit) else int(ends[ends > done][0])
        pairs = np.repeat(line[done:to], times[done:to]) * len(t.no) + at[spans(low[done:to], times[done:to])]
        key, n = sorted_distinct(pairs)
        yield key // len(t.no), key % len(t.no), n
        done = to


def rising(j: np.ndarray) -> np.ndarray:
    """Places of a longest rising subsequence."""
    tails, at, before = [], [], np.full(len(j), -1)
    for k, x in enumerate(j.tolist()):
        p = bisect.bisect_left(tails, x)
        before[k] = at[p - 1] if p else -1
        if p == len(tails):
            tails.append(x)
            at.append(k)
        else:
            tails[p], at[p] = x, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return np.array(out[::-1], np.int64)


def rectangles(s: Side, t: Side, most: int | None) -> list[tuple[int, int, int, int]]:
    """(first, end, first, end) of the parts of both sides that are aligned by themselves: all, if their table has `most` cells at most.

    Without `most` every file is whole; no query gives it, since a cut can change the pairs. Larger ones are cut before
    pairs of lines that alone share a number or code, which keep the order of each other, and
    of which two neighbours stand at the same distance on both sides. A file without such pairs stays whole.
    """
    n, m = len(s.no), len(t.no)
    if most is None or n * m <= most:
        return [(0, n, 0, m)]
    lone = []
    for z in (s, t):
        word, line = word_lines(z)
        distinct, times = sorted_distinct(word)
        first = np.searchsorted(word, distinct[times == 1])
        lone.append((word[first], line[first]))
    (e, i), (f, j) = lone
    at = np.minimum(np.searchsorted(f, e), max(len(f) - 1, 0))
    hit = f[at] == e if len(f) else np.zeros(len(e), bool)
    key, _ = sorted_distinct(i[hit] * m + j[at[hit]])
    i, j = key // m, key % m
    keep = rising(j)
    i, j = i[keep], j[keep]
    keep = np.diff(i, prepend=-1) > 0
    i, j = i[keep], j[keep]
    votes = np.zeros(len(i), np.int64)
    for d in range(1, 4):
        near = (i[d:] - i[:-d] <= NEAR) & (np.abs((i[d:] - i[:-d]) - (j[d:] - j[:-d])) <= DRIFT)
        votes[d:] += near
        votes[:-d] += near
    sure = np.flatnonzero(votes >= 2)
    out, a, b = [], 0, 0
    for k, nxt in zip(sure, [*sure[1:], None]):
        x, y = (int(i[nxt]), int(j[nxt])) if nxt is not None else (n, m)
        if (x - a) * (y - b) > most // 4 and i[k] > a and j[k] > b:
            out.append((a, int(i[k]), b, int(j[k])))
            a, b = int(i[k]), int(j[k])
    return [*out, (a, n, b, m)]


def align_parts(rewards, parts: list[tuple[int, int, int, int]], block: int) -> tuple[np.ndarray, np.ndarray]:
    """align of each rectangle, the pairs of all in order."""
    found = [align(lambda i, k, low, high, a=a, c=c: rewards(i + a, k + a, low + c, high + c), b - a, d - c, block) for a, b, c, d in parts]
    return tuple(np.concatenate([x[side] + part[2 * side] for x, part in zip(found, parts)]) for side in range(2))


def confident(s: Side, t: Side, block: int = BLOCK, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """One-to-one pairs by length that no anchor contradicts."""
    n, m = len(s.no), len(t.no)
    i, j = by_length(s, t, block, most)
    once = (np.bincount(i, minlength=n)[i] == 1) & (np.bincount(j, minlength=m)[j] == 1)
    aligned, here = i * m + j, np.zeros(len(i), np.int64)  # in order
    row_top, row_ties, row_at = (np.zeros(n, np.int64) for _ in range(3))
    col_top, col_ties = np.zeros(m, np.int64), np.zeros(m, np.int64)
    for x, y, count in shared_counts(s, t):
        key = x * m + y
        at = np.minimum(np.searchsorted(key, aligned), len(key) - 1)
        here = np.where(key[at] == aligned, count[at], here)
        first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
        top = np.repeat(np.maximum.reduceat(count, first), np.diff(np.append(first, len(x))))
        row_top[x] = top
        is_top = np.flatnonzero(count == top)
        row_ties += np.bincount(x[is_top], minlength=n)
        row_at[x[is_top][::-1]] = y[is_top][::-1]  # the first of them
        most_here = np.zeros(m, np.int64)
        np.maximum.at(most_here, y, count)
        ties = np.bincount(y[count == most_here[y]], minlength=m)
        col_ties = np.where(most_here > col_top, ties, np.where((most_here == col_top) & (most_here > 0), col_ties + ties, col_ties))
        col_top = np.maximum(col_top, most_here)
    keep = once & ~((row_top[i] > here) | (col_top[j] > here))
    i, j = i[keep], j[keep]
    # pairs that only an anchor tells, wherever they stand
    best = (row_top > 0) & (row_ties == 1) & (row_top == col_top[row_at]) & (col_ties[row_at] == 1)
    key, _ = sorted_distinct(np.concatenate([i * m + j, np.flatnonzero(best) * m + row_at[best]]))
    return key // m, key % m


class Lexicon:
    """Probabilities p of pairs of words (e, f), sorted by e."""

    def __init__(self, e: np.ndarray, f: np.ndarray, p: np.ndarray) -> None:
        order = np.argsort(e, kind="stable")
        self.e, self.f, self.p = e[order], f[order], p[order]

    @functools.cached_property
    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Digests of the pairs, sorted, and their probabilities."""
        key = pair_key(self.e, self.f)
        order = np.argsort(key)
        return key[order], self.p[order]

    def of(self, e: np.ndarray, f: np.ndarray) -> np.ndarray:
        """The probability of each pair, 0 for unknown ones."""
        known, p = self.keys
        if not len(known):
            return np.zeros(len(e))
        key = pair_key(e, f)
        at = np.minimum(np.searchsorted(known, key), len(known) - 1)
        return np.where(known[at] == key, p[at], 0.0)

    def entries(self, e: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in two sorted lists of words of all pairs known, and their probabilities."""
        low, high = np.searchsorted(self.e, e), np.searchsorted(self.e, e, "right")
        row, entry = np.repeat(np.arange(len(e)), high - low), spans(low, high - low)
        col = np.minimum(np.searchsorted(f, self.f[entry]), max(len(f) - 1, 0))
        hit = f[col] == self.f[entry] if len(f) else np.zeros(0, bool)
        return row[hit], col[hit], self.p[entry[hit]]


def spans(low: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The n numbers from each low on, one after another."""
    return np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n)


def pair_key(e: np.ndarray, f: np.ndarray) -> np.ndarray:
    return flat.mix(e * np.uint64(0x9E3779B97F4A7C15) ^ (f + np.uint64(0x632BE59BD9B4E019)))


class WordPairs:
    """All pairs of words (e, f) of pairs of lines, given as lists of distinct words."""

    def __init__(self, e: np.ndarray, e_at: np.ndarray, f: np.ndarray, f_at: np.ndarray) -> None:
        nf = np.diff(f_at)
        line = np.repeat(np.arange(len(nf)), nf)
        self.times = np.diff(e_at)[line]  # words of the source beside each word of the target
        self.owner = np.repeat(np.arange(len(f)), self.times)
        es, fs = sorted_distinct(e)[0], sorted_distinct(f)[0]
        place = np.searchsorted(es, e)[spans(e_at[line], self.times)]
        key = (place.astype(np.uint64) << np.uint64(32)) | np.searchsorted(fs, f).astype(np.uint64)[self.owner]
        self.order = np.argsort(key)
        key = key[self.order]
        self.first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        key = key[self.first]
        self.place = (key >> np.uint64(32)).astype(np.int64)
        self.e, self.f = es[self.place], fs[(key & np.uint64(0xFFFFFFFF)).astype(np.int64)]

    def sums(self, x: np.ndarray) -> np.ndarray:
        """By distinct pair, of a value for each pair of words."""
        return np.add.reduceat(x[self.order], self.first) if len(self.first) else np.zeros(0)

    def spread(self, x: np.ndarray) -> np.ndarray:
        """The values of the distinct pairs for each pair of words."""
        out = np.zeros(len(self.order), x.dtype)
        out[self.order] = np.repeat(x, np.diff(np.append(self.first, len(self.order))))
        return out

    def even(self) -> np.ndarray:
        return self.sums((1 / self.times)[self.owner])


def expected(pairs: WordPairs, lexicon: Lexicon | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of model 1 (e, f, count, pairs of lines); even without a lexicon.

    Pairs that the lexicon does not have are left out, but for a little weight.
    """
    n = np.diff(np.append(pairs.first, len(pairs.order)))
    if lexicon is None:
        return pairs.e, pairs.f, pairs.even(), n
    p = pairs.spread(lexicon.of(pairs.e, pairs.f))
    total = np.bincount(pairs.owner, p, len(pairs.times)) + 1e-6 * pairs.times
    c = pairs.sums(p / total[pairs.owner])
    hit = c > 0
    return pairs.e[hit], pairs.f[hit], c[hit], n[hit]


class Coverage:
    """The share of a source line's words that a target line renders, and the reverse.

    Words weigh by how few lines of the file they are in.
    """

    def __init__(self, s: Side, t: Side, lexicon: Lexicon, block: int = BLOCK) -> None:
        self.sides, self.near = [], []
        for z in (s, t):
            word, index = np.unique(z.word, return_inverse=True)
            key, _ = sorted_distinct(flat.row_ids(z.at) * len(word) + index)  # each word once a line
            own, at = key % len(word), np.searchsorted(key // len(word), np.arange(len(z.no) + 1))
            self.sides.append((own, at, np.log(1 + len(z.no) / np.bincount(own, minlength=len(word))).astype(np.float32)))
        e, f = sorted_distinct(s.word)[0], sorted_distinct(t.word)[0]
        row, col, p = lexicon.entries(e, f)
        _, same_e, same_f = np.intersect1d(e, f, assume_unique=True, return_indices=True)
        row, col = np.concatenate([row, same_e]), np.concatenate([col, same_f])
        near = np.concatenate([np.minimum(1.0, np.sqrt(p) * 1.2), np.ones(len(same_e))]).astype(np.float32)
        for own, other, size in ((row, col, len(e)), (col, row, len(f))):
            order = np.argsort(own, kind="stable")
            self.near.append((np.searchsorted(own[order], np.arange(size + 1)), other[order], near[order]))
        self.whole, every = None, (np.arange(len(s.no)), np.arange(len(t.no)))
        if len(strips(*map(len, every), block)) <= 1:
            self.whole = self.of(*every)

    def _words(self, side: int, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own, at, _ = self.sides[side]
        n = at[lines + 1] - at[lines]
        return own[spans(at[lines], n)], np.concatenate([[0], np.cumsum(n)])

    def _share(self, side: int, lines: np.ndarray, others: np.ndarray) -> np.ndarray:
        """lines x others: the share of the words of the lines of the side that the others render."""
        x, start = self._words(side, lines)
        y, y_at = self._words(1 - side, others)
        used, local = np.unique(x, return_inverse=True)
        order = np.argsort(y, kind="stable")
        y, line = y[order], flat.row_ids(y_at)[order]
        at, other, near = self.near[side]
        n = at[used + 1] - at[used]
        entry = spans(at[used], n)
        low = np.searchsorted(y, other[entry])
        times = np.searchsorted(y, other[entry], "right") - low
        # best counterpart in the other line of each word
        best = np.zeros(len(used) * len(others), np.float32)
        cell = np.repeat(np.repeat(np.arange(len(used)), n) * len(others), times) + line[spans(low, times)]
        np.maximum.at(best, cell, np.repeat(near[entry], times))
        weight = self.sides[side][2]
        best = best.reshape(len(used), len(others)) * weight[used][:, None]
        long = np.diff(start)
        order = np.argsort(-long, kind="stable")
        first, longer = start[:-1][order], len(long) - np.searchsorted(np.sort(long), np.arange(1, long.max()), "right")
        total = best[local[first]]  # lines hold a word at least
        for k, n in enumerate(longer.tolist(), 1):  # in the order of the words, so that a sum is the same in any table
            total[:n] += best[local[first[:n] + k]]
        out = np.empty_like(total)
        out[order] = total
        return out / np.add.reduceat(weight[x], start[:-1])[:, None]

    def of(self, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lines x lines, both ways."""
        if self.whole is not None:
            return tuple(x[np.ix_(rows, cols)] for x in self.whole)
        a, b = (np.zeros((len(rows), len(cols)), np.float32) for _ in range(2))
        for i in range(0, len(rows), TILE):
            for j in range(0, len(cols), TILE):
                mine, others = rows[i : i + TILE], cols[j : j + TILE]
                a[i : i + TILE, j : j + TILE] = self._share(0, mine, others)
                b[i : i + TILE, j : j + TILE] = self._share(1, others, mine).T
        return a, b

    def at(self, i: np.ndarray, j: np.ndarray, step: int = 100) -> np.ndarray:
        """The greater share of each pair: a line that renders two others is covered in one direction only."""
        if self.whole is not None:
            return np.maximum(*self.whole)[i, j]
        out = np.zeros(len(i), np.float32)
        for k in range(0, len(i), step):
            out[k : k + step] = np.maximum(*self.of(i[k : k + step], j[k : k + step])).diagonal()
        return out


def by_words(s: Side, t: Side, lexicon: Lexicon, block: int = BLOCK, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j, score) of the final alignment of a file."""
    n, m = len(s.no), len(t.no)
    cover = Coverage(s, t, lexicon, block)
    wa, wb = np.sqrt(np.diff(s.at))[:, None], np.sqrt(np.diff(t.at))[None, :]

    def score(rows: np.ndarray, cols: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = wa[rows], wb[:, cols]
        return (a * x + b * y) / np.maximum(x + y, 1e-9)

    def rewards(i: int, k: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        before = min(i, 1)
        rows, cols = np.arange(i - before, k), np.arange(low, high)
        a, b = cover.of(rows, cols)
        one = score(rows, cols, a, b) - IN_ORDER
        two_s = np.minimum(a, shifted(a, 0)) + b_pair(b, 0) - 2 * IN_ORDER - 0.15
        two_t = np.minimum(b, shifted(b, 1)) + b_pair(a, 1) - 2 * IN_ORDER - 0.15
        return one[before:], two_s[before:], two_t[before:]

    i, j = align_parts(rewards, rectangles(s, t, most), block)
    keep = cover.at(i, j) >= LEAST_COVER
    i, j = i[keep], j[keep]
    used_s, used_t = np.zeros(n, bool), np.zeros(m, bool)
    used_s[i] = used_t[j] = True
    free_s, free_t = np.flatnonzero(~used_s), np.flatnonzero(~used_t)
    if len(free_s) and len(free_t):  # moved lines
        col_top, moved = np.full(len(free_t), -np.inf), []
        for x, y in strips(len(free_s), len(free_t), block):
            rest = score(free_s[x:y], free_t, *cover.of(free_s[x:y], free_t))
            col_top = np.maximum(col_top, rest.max(0))
            r, c = np.nonzero((rest == rest.max(1, keepdims=True)) & (rest == col_top) & (rest >= MOVED))
            moved.append((r + x, c, rest[r, c]))
        r, c, best = (np.concatenate(z) for z in zip(*moved))
        r, c = r[best == col_top[c]], c[best == col_top[c]]
        i, j = np.concatenate([i, free_s[r]]), np.concatenate([j, free_t[c]])
        used_s[free_s[r]] = used_t[free_t[c]] = True
    # lines rendered within a line that has another counterpart already
    for of_s, free, others in ((True, np.flatnonzero(~used_s), np.arange(m)), (False, np.flatnonzero(~used_t), np.arange(n))):
        for p, q in strips(len(free), len(others), block):
            own = free[p:q]
            part = cover.of(own, others)[0] if of_s else cover.of(others, own)[1].T
            best = part.argmax(1)
            fits = part[np.arange(len(own)), best] >= PART_COVER
            x, y = own[fits], best[fits]
            i, j = (np.concatenate([i, x]), np.concatenate([j, y])) if of_s else (np.concatenate([i, y]), np.concatenate([j, x]))
    return i, j, cover.at(i, j)


def b_pair(x: np.ndarray, axis: int) -> np.ndarray:
    """Sum of the shares of a line that it and the line before cover, at most 1."""
    y = shifted(x, axis)
    return np.where(y < -1e8, -1e9, np.minimum(1.0, x + y))


def feature_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: (file_id, side, line_no, line) -> the same with size and digests of words for the line."""
    for batch in batches:
        for first, part in flat.slices(batch.column(3)):
            rows = batch.slice(first, len(part))
            word, at = fold(part)
            cps, starts = flat.decode(part)
            out = pa.RecordBatch.from_arrays(
                [*rows.columns[:3], pa.array(np.diff(starts).astype(np.int32)), flat.list_array(flat.i64(word), at)],
                ["file_id", "side", "line_no", "size", "words"],
            )
            yield out.filter(pa.array(np.diff(at) > 0))


def files(lines: DataFrame) -> DataFrame:
    """(file_id, side, line_no, line) -> (file_id, s, t): the lines of both sides as sorted arrays of structs."""
    own = lines.where(F.col("side").isin(SOURCE, TARGET) & has_text("line") & F.col("line_no").isNotNull()).select("file_id", "side", "line_no", "line")
    featured = own.mapInArrow(feature_lines, "file_id long, side string, line_no int, size int, words array<long>")
    part = lambda side: F.sort_array(F.collect_list(F.when(F.col("side") == side, F.struct("line_no", "size", "words"))))
    return featured.groupBy("file_id").agg(part(SOURCE).alias("s"), part(TARGET).alias("t")).where((F.size("s") > 0) & (F.size("t") > 0))


def sides(col: pa.Array) -> Iterator[Side]:
    """The Side of each row of a column of arrays of (line_no, size, words)."""
    lists = col.offsets.to_numpy()
    lines = col.values
    no, size, words = (lines.field(k) for k in range(3))
    no, size = no.to_numpy(zero_copy_only=False), size.to_numpy(zero_copy_only=False)
    at, word = words.offsets.to_numpy(), words.values.to_numpy(zero_copy_only=False).view(np.uint64)
    for a, b in zip(lists[:-1], lists[1:]):
        yield Side(no[a:b], size[a:b], word[at[a] : at[b]], at[a : b + 1] - at[a])


def own_lexicons(col: pa.Array) -> Iterator[Lexicon]:
    """The lexicon of each row of a column of arrays of (e, f, p)."""
    at, (e, f, p) = col.offsets.to_numpy(), (col.values.field(k).to_numpy(zero_copy_only=False) for k in range(3))
    for a, b in zip(at[:-1], at[1:]):
        yield Lexicon(e[a:b].view(np.uint64), f[a:b].view(np.uint64), p[a:b])


def confident_pairs(block: int = BLOCK):
    """mapInArrow function: (s, t) -> (e, f), the words of confident pairs of lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e, f = [], []
            for s, t in zip(sides(batch.column(0)), sides(batch.column(1))):
                for i, j in zip(*confident(s, t, block)):
                    e.append(sorted_distinct(s.word[s.at[i] : s.at[i + 1]])[0].view(np.int64))
                    f.append(sorted_distinct(t.word[t.at[j] : t.at[j + 1]])[0].view(np.int64))
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(e, kind), pa.array(f, kind)], ["e", "f"])

    return run


def lists(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    at = col.offsets.to_numpy().astype(np.int64)
    return col.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]], at - at[0]


def blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, WordPairs]]:
    """(e, f, ...): the rows, about `size` at a time whatever the batches, and their pairs of words."""
    kept: list[pa.RecordBatch] = []

    def block() -> tuple[pa.RecordBatch, WordPairs]:
        rows = pa.concat_batches(kept)
        (e, e_at), (f, f_at) = lists(rows.column(0)), lists(rows.column(1))
        return rows, WordPairs(e.view(np.uint64), e_at, f.view(np.uint64), f_at)

    for batch in batches:
        for k in range(0, len(batch), size):
            kept.append(batch.slice(k, size))
            if sum(map(len, kept)) >= size:
                yield block()
                kept = []
    if kept:
        yield block()


def expectation(first: bool):
    """mapInArrow: (e, f[, lexicon]) -> (e, f, c, n), expected counts summed over some thousand pairs of lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, pairs in blocks(batches, PAIRS):
            lexicon = None
            if not first:
                x = list(own_lexicons(rows.column(2)))
                e, f, p = (np.concatenate([getattr(y, k) for y in x]) for k in ("e", "f", "p"))
                _, one = np.unique(pair_key(e, f), return_index=True)
                lexicon = Lexicon(e[one], f[one], p[one])
            ee, ff, c, n = expected(pairs, lexicon)
            yield pa.RecordBatch.from_arrays([flat.i64(ee), flat.i64(ff), pa.array(c, pa.float64()), pa.array(n)], ["e", "f", "c", "n"])

    return run


def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: (e, f) -> (e, f), the pairs of words that reach LEAST_P in their block.

    A pair that has the share over all lines has it in one block at least, so none is missed.
    """
    for _, pairs in blocks(batches, PAIRS):
        if not len(pairs.first):
            continue
        c = pairs.even()
        edge = np.flatnonzero(np.append(True, pairs.place[1:] != pairs.place[:-1]))
        keep = c >= LEAST_P * (1 - 1e-9) * np.repeat(np.add.reduceat(c, edge), np.diff(np.append(edge, len(c))))
        yield pa.RecordBatch.from_arrays([flat.i64(pairs.e[keep]), flat.i64(pairs.f[keep])], ["e", "f"])


def numbered(known: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Places of the words among those known, which are sorted; one past them for others."""
    at = np.searchsorted(known, words)
    return np.where(known[np.minimum(at, len(known) - 1)] == words, at, len(known)).astype(np.uint64)


def matched(shared):
    """mapInArrow: (e, f) -> (entries, each, words): the places in the table of pairs of the words of a pair of lines.

    They stand in the order of the words of the target, each with its number; words: those of the source.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_e, all_f, known = shared.value
        for rows, pairs in blocks(batches, PAIRS):
            key = (numbered(all_e, pairs.e) << np.uint64(32)) | numbered(all_f, pairs.f)  # in order but for unknown words
            at = np.minimum(np.searchsorted(known, key), len(known) - 1)
            found = pairs.spread(np.where(known[at] == key, at, -1)) if len(key) else np.zeros(0, np.int64)
            hit = found >= 0
            each = np.bincount(pairs.owner[hit], minlength=len(pairs.times))
            f_at = lists(rows.column(1))[1]
            entry_at = np.append(0, np.cumsum(each))[f_at]
            words = np.diff(lists(rows.column(0))[1])
            yield pa.RecordBatch.from_arrays(
                [flat.list_array(pa.array(found[hit].astype(np.int32)), entry_at), flat.list_array(pa.array(each.astype(np.int32)), f_at), pa.array(words.astype(np.int32))],
                ["entries", "each", "words"],
            )

    return run


def entry_counts(shared, size: int):
    """mapInArrow: (entries, each, words) -> (entry, c, n); shared: the probabilities of the entries, none for even ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, c, n = shared.value if shared else None, np.zeros(size), np.zeros(size, np.int64)
        for batch in batches:
            (entry, _), (each, each_at) = lists(batch.column(0)), lists(batch.column(1))
            words = np.repeat(batch.column(2).to_numpy(zero_copy_only=False), np.diff(each_at))
            owner = np.repeat(np.arange(len(each)), each)
            if p is None:
                c += np.bincount(entry, (1 / np.maximum(words, 1))[owner], size)
                n += np.bincount(entry, minlength=size)
            else:
                own = p[entry]
                total = np.bincount(owner, own, len(each)) + 1e-6 * words
                c += np.bincount(entry, own / total[owner], size)
        used = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(c[used]), pa.array(n[used])], ["entry", "c", "n"])

    return run


def final_pairs(shared, block: int = BLOCK):
    """mapInArrow function: (file_id, s, t[, lexicon]) -> (file_id, s_line, t_line, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, si, ti, score = [], [], [], []
            lexicons = own_lexicons(batch.column(3)) if batch.num_columns > 3 else (shared.value for _ in range(len(batch)))
            for file, s, t, lexicon in zip(batch.column(0).to_pylist(), sides(batch.column(1)), sides(batch.column(2)), lexicons):
                i, j, x = by_words(s, t, lexicon, block)
                ids += [file] * len(i)
                si.append(s.no[i])
                ti.append(t.no[j])
                score.append(x)
            join = lambda x: np.concatenate(x) if x else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(join(si).astype(np.int32)), pa.array(join(ti).astype(np.int32)), pa.array(join(score), pa.float64())],
                ["file_id", "s_line", "t_line", "score"],
            )

    return run


class Lookup:
    """A lexicon as a table (e, f, p), or by broadcast; given to tasks so or by a join to their rows."""

    def __init__(self, entries: DataFrame | None, shared=None) -> None:
        self.entries, self.shared = entries, shared

    def given(self, rows: DataFrame, words: F.Column) -> DataFrame:
        """rows as they are, or with the column lexicon of the entries for their words."""
        if self.shared is not None:
            return rows
        rows = stored(rows.withColumn("at", F.monotonically_increasing_id()))
        mine = rows.select("at", F.explode(F.array_distinct(words)).alias("e")).join(self.entries, "e")
        packed = mine.groupBy("at").agg(F.collect_list(F.struct("e", "f", "p")).alias("lexicon"))
        none = F.array().cast("array<struct<e:bigint,f:bigint,p:double>>")
        return rows.join(packed, "at", "left").withColumn("lexicon", F.coalesce("lexicon", none)).drop("at")


def lexicon_of(pairs: DataFrame, rounds: int = ROUNDS, small: int = SMALL_LEXICON) -> Lookup:
    """Expectation-maximization over all pairs (e, f) of word lists.

    The first round, in which all pairs of words count, is done on those that can reach LEAST_P. If these are `small`
    at most, the lines keep the places of their pairs in a table and a round sums numbers; else a round joins.
    """
    share = pairs.sparkSession.sparkContext.broadcast
    with written(pairs.mapInArrow(likely, "e long, f long").distinct()) as table:
        if table.limit(small + 1).count() > small:
            return joined_lexicon(pairs, rounds)
        rows = table.toArrow()
        words = pairs.select(F.explode("e").alias("e"), (F.size("f") / F.size("e")).alias("c")).groupBy("e").agg(F.sum("c").alias("c"))
        sums = words.join(table.select("e").distinct(), "e", "left_semi").toArrow()  # no more than the entries
    e, f = (rows.column(k).to_numpy().view(np.uint64) for k in range(2))
    order = np.lexsort((f, e))
    e, f = e[order], f[order]
    if not len(e):
        return Lookup(None, share(Lexicon(e, f, np.zeros(0))))
    all_e, n = sorted_distinct(e)
    all_f, _ = sorted_distinct(f)
    of, edge = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
    total = sums.column(1).to_numpy()[np.argsort(sums.column(0).to_numpy().view(np.uint64))]
    known = (of.astype(np.uint64) << np.uint64(32)) | numbered(all_f, f)
    p = None
    with written(pairs.mapInArrow(matched(share((all_e, all_f, known))), "entries array<int>, each array<int>, words int")) as sparse:
        for _ in range(rounds):
            counts = sparse.mapInArrow(entry_counts(None if p is None else share(p), len(e)), "entry long, c double, n long")
            got = counts.groupBy("entry").agg(F.sum("c").alias("c"), F.sum("n").alias("n")).toArrow()
            at, (c, n) = got.column(0).to_numpy(), np.zeros((2, len(e)))
            c[at], n[at] = got.column(1).to_numpy(), got.column(2).to_numpy()
            keep = n >= LEAST_SEEN if p is None else c > 0
            all_of = total if p is None else np.add.reduceat(c, edge)
            p = c / np.maximum(all_of[of], 1e-300)
            p[~keep | (p < LEAST_P)] = 0.0
    used = np.flatnonzero(p)
    return Lookup(None, share(Lexicon(e[used], f[used], p[used])))


def joined_lexicon(pairs: DataFrame, rounds: int) -> Lookup:
    """lexicon_of for tables of any size: the counts stay distributed."""
    lookup: Lookup | None = None
    for _ in range(rounds):
        rows = pairs if lookup is None else lookup.given(pairs, F.col("e"))
        counts = rows.mapInArrow(expectation(lookup is None), "e long, f long, c double, n long")
        counts = stored(counts.groupBy("e", "f").agg(F.sum("c").alias("c"), F.sum("n").alias("n")))
        total = counts.groupBy("e").agg(F.sum("c").alias("all"))
        kept = counts.where(F.col("n") >= LEAST_SEEN) if lookup is None else counts
        kept = kept.join(total, "e").withColumn("p", F.col("c") / F.col("all")).where(F.col("p") >= LEAST_P)
        lookup = Lookup(stored(kept.select("e", "f", "p")))
    return lookup


def aligned(lines: DataFrame, block: int = BLOCK, margin: int | None = None, small_lexicon: int = SMALL_LEXICON) -> DataFrame:
    """(file_id, side, line_no, line) -> (file_id, s_line, t_line, score).

    block bounds memory only; margin is taken for older callers and has no effect: files are not cut.
    """
    cut = stored(files(lines))
    with written(cut.select("s", "t").mapInArrow(confident_pairs(block), "e array<long>, f array<long>")) as pairs:
        lookup = lexicon_of(pairs, small=small_lexicon)
    words = F.flatten(F.transform("s", lambda x: x["words"]))
    rows = lookup.given(cut.select("file_id", "s", "t"), words)
    found = rows.mapInArrow(final_pairs(lookup.shared, block), "file_id long, s_line int, t_line int, score double")
    return found.groupBy("file_id", "s_line", "t_line").agg(F.max("score").alias("score"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "twin_lines")).select("file_id", "s_line", "t_line")


QUERIES = {"p5_found": p5_found}
