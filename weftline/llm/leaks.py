"""Problem 3: evaluation texts leaking into training text.

The held-out lines are a stated query set; they are indexed in blocks of bounded size and each block
is compared with all rows. Seeds are runs of words shared by a line and a text. A line of n words has
seeds of min(SEED, n / 2, (n - 2) / 3) words, so that any text that holds half of the line in one run,
or the whole line with two words replaced, shares a seed. The places of the seeds tell where a line may lie in a
text; what stands at its own place there is counted for many at a time. Each (text, line) that can be a case is
tiled greedily: the longest common run of words not yet marked is found by Karp-Rabin digests and
marked in both, until none of MIN_TILE words is left. The tiles' share of the line is its coverage,
which also finds passages in another order.

Defined cases: letter case, punctuation, marks and kinds of blanks do not matter; null, blank and `nan`
texts and lines hold nothing, nor do lines without an item_id; of a line of one or two words one word is enough; a text that
holds a line several times gives one row; repeated rows each give theirs; texts are taken whole, in
memory one at a time if they are long; other columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import flat
from weftline.llm.common import SQL_BLANK, has_text, sql_has_text, table
from weftline.llm.cross_split import fold_table

SEED, MIN_TILE = 8, 3
#: Lines in a block of the query set; its index takes about 10 KB a line of 30 words in 64-bit digests.
BLOCK_LINES = 20_000
REPLACED = 2
#: Places of seeds, and words beside them, that are compared at once.
HITS, CELLS = 1 << 20, 1 << 22

_words: np.ndarray | None = None


def word_table() -> np.ndarray:
    """As fold_table, with every blank as 32: it parts words."""
    global _words
    if _words is None:
        t = fold_table().copy()
        for cp in [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]:
            t[cp] = 32
        _words = t
    return _words


def words(part: pa.Array, fold: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the folded words of all rows, and the row starts among them; fold is as word_table."""
    cps, starts = flat.decode(part)
    cps = (word_table() if fold is None else fold)[cps]
    cps, starts = flat.compact(cps, starts, cps != 0)
    solid = np.zeros(len(cps) + 2, bool)
    solid[1:-1] = cps != 32
    begins = solid[1:-1] & ~solid[:-2]
    ends = solid[1:-1] & ~solid[2:]
    edges = starts[1:-1]
    edges = edges[(edges > 0) & (edges < len(cps))]
    begins[edges[solid[1:-1][edges]]] = True
    ends[edges[solid[edges]] - 1] = True
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return flat.span_hash(flat.prefix_hash(cps), begin, end), np.searchsorted(begin, starts)


def seed_length(n: int) -> int:
    """The longest run that any case of a line of n words must share with it, SEED at most."""
    return max(1, min(SEED, -(-n // 2), -(-(n - REPLACED) // (REPLACED + 1))))


class LineIndex:
    """Words and seeds of the lines of one block."""

    def __init__(self, ids: list[int], lines: list[str | None]) -> None:
        self.words, self.starts = words(pa.array(lines, pa.large_string()))
        self.ids = np.array(ids, np.int64)
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        prefix = flat.prefix_hash(self.words)
        sizes = np.diff(self.starts)
        self.needed = np.array([seed_length(int(n)) if n else 0 for n in sizes], np.int64)
        for k in sorted(set(self.needed.tolist()) - {0}):
            own = np.flatnonzero(self.needed == k)
            begin = np.concatenate([np.arange(self.starts[i], self.starts[i + 1] - k + 1) for i in own])
            line = np.repeat(own, sizes[own] - k + 1)
            h = flat.span_hash(prefix, begin, begin + k)
            order = np.argsort(h, kind="stable")
            self.seeds[k] = (h[order], line[order], (begin - self.starts[line])[order])

    def places(self, tokens: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, line, shift) of the places, about HITS at a time, where a seed puts a line: shift words after the row's first."""
        prefix = flat.prefix_hash(tokens)
        row = flat.row_ids(starts)
        for k, (h, line, offset) in self.seeds.items():
            if len(tokens) < k:
                continue
            begin = np.flatnonzero(np.arange(len(tokens)) + k <= starts[row + 1])
            mine = flat.span_hash(prefix, begin, begin + k)
            low = np.searchsorted(h, mine)
            found = np.flatnonzero(h[np.minimum(low, len(h) - 1)] == mine)
            low, begin = low[found], begin[found]
            n = np.searchsorted(h, mine[found], "right") - low
            cut = np.flatnonzero(np.diff(np.cumsum(n) // HITS, prepend=0))
            for a, b in zip(np.append(0, cut), np.append(cut, len(n))):
                times = n[a:b]
                at = np.repeat(low[a:b] - np.cumsum(times) + times, times) + np.arange(times.sum())
                where = np.repeat(begin[a:b], times)
                yield row[where], line[at], where - starts[row[where]] - offset[at]

    def lying(self, tokens: np.ndarray, starts: np.ndarray, row: np.ndarray, line: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each place: the words of the line that stand there, their longest run, and whether the whole line has room."""
        size, length = np.diff(self.starts)[line], np.diff(starts)[row]
        same, run = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        cut = np.flatnonzero(np.diff(np.cumsum(size) // CELLS, prepend=0))
        for a, b in zip(np.append(0, cut), np.append(cut, len(row))):
            n = size[a:b]
            first = np.cumsum(n) - n
            inner = np.arange(n.sum()) - np.repeat(first, n)
            at = inner + np.repeat(shift[a:b], n)
            ok = (at >= 0) & (at < np.repeat(length[a:b], n))
            place = np.where(ok, at + np.repeat(starts[row[a:b]], n), 0)
            ok &= self.words[inner + np.repeat(self.starts[line[a:b]], n)] == tokens[place]
            if len(n):
                same[a:b] = np.add.reduceat(ok.astype(np.int64), first)
                # words since the last that differs or the line's beginning
                since = np.arange(len(ok)) - np.maximum.accumulate(np.where(~ok, np.arange(len(ok)), np.repeat(first, n) - 1))
                run[a:b] = np.maximum.reduceat(np.where(ok, since, 0), first)
        return same, run, (shift >= 0) & (shift + size <= length)

    def candidates(self, tokens: np.ndarray, starts: np.ndarray, least_coverage: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, line, aligned) that can be cases: half of the line in a run, the line but for words replaced, or so much covered.

        aligned: the most words of the line that stand at their own places in one stretch of the text.
        """
        bits = np.uint64(32)
        pairs, wanted, most, sums = [np.zeros(0, np.uint64)], [np.zeros(0, bool)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for row, line, shift in self.places(tokens, starts):
            order = np.lexsort((shift, line, row))
            row, line, shift = row[order], line[order], shift[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (line[1:] != line[:-1]) | (shift[1:] != shift[:-1])
            row, line, shift = row[new], line[new], shift[new]
            if not len(row):
                continue
            same, run, room = self.lying(tokens, starts, row, line, shift)
            size = np.diff(self.starts)[line]
            aligned = np.where(room, same, 0)
            key = (row.astype(np.uint64) << bits) | line.astype(np.uint64)
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            pairs.append(key[first])
            wanted.append(np.logical_or.reduceat((2 * run >= size) | (aligned >= np.maximum(1, size - REPLACED)), first))
            most.append(np.maximum.reduceat(aligned, first))
            sums.append(np.add.reduceat(same, first))
        key, wanted, most, sums = (np.concatenate(x) for x in (pairs, wanted, most, sums))
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        if not len(first):
            none = np.zeros(0, np.int64)
            return none, none, none
        wanted, most, sums = np.logical_or.reduceat(wanted[order], first), np.maximum.reduceat(most[order], first), np.add.reduceat(sums[order], first)
        row, line = (key[first] >> bits).astype(np.int64), (key[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        if least_coverage is not None:  # a tile is found at its seeds only where these are no longer than a tile
            size = np.diff(self.starts)[line]
            wanted |= (self.needed[line] > MIN_TILE) | (sums >= least_coverage * size)
        return row[wanted], line[wanted], most[wanted]


def _free_spans(prefix: np.ndarray, marked: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(marked) - s + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    taken = np.concatenate([[0], np.cumsum(marked)])
    begin = np.flatnonzero(taken[s:] == taken[:-s])
    return begin, flat.span_hash(prefix, begin, begin + s)


def greedy_tiles(line: np.ndarray, text: np.ndarray, least: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in line, start in text, length), longest first, none overlapping.

    The longest common unmarked run is found by halving its length over Karp-Rabin digests; ties go
    to the first in the line, then the first in the text.
    """
    p, q = flat.prefix_hash(line), flat.prefix_hash(text)
    a, b = np.zeros(len(line), bool), np.zeros(len(text), bool)
    tiles: list[tuple[int, int, int]] = []
    top = min(len(line), len(text))
    while True:
        low, high, best = least, top, None
        while low <= high:  # a common run of s words contains common runs of any fewer
            s = (low + high + 1) // 2
            (i, x), (j, y) = _free_spans(p, a, s), _free_spans(q, b, s)
            y, first = np.unique(y, return_index=True)
            hit = np.flatnonzero(np.isin(x, y))
            if len(hit):
                best = (int(i[hit[0]]), int(j[first[np.searchsorted(y, x[hit[0]])]]), s)
                low = s + 1
            else:
                high = s - 1
        if best is None:
            return tiles
        i, j, top = best
        a[i : i + top] = b[j : j + top] = True
        tiles.append(best)


FOUND = "tbl string, rec_id long, item_id long, words int, longest int, aligned int, coverage double"


def compare(index, least_coverage: float | None) -> object:
    """mapInArrow function: (tbl, rec_id, text) -> FOUND, a row for each text and line that can be a case."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: LineIndex = index.value
        for batch in batches:
            out: list[tuple] = []
            for first, part in flat.slices(batch.column(2)):
                tokens, starts = words(part)
                for row, line, aligned in zip(*(x.tolist() for x in lines.candidates(tokens, starts, least_coverage))):
                    own, text = lines.words[lines.starts[line] : lines.starts[line + 1]], tokens[starts[row] : starts[row + 1]]
                    tiles = greedy_tiles(own, text, min(MIN_TILE, -(-len(own) // 2)))
                    covered, longest = sum(t[2] for t in tiles), max((t[2] for t in tiles), default=0)
                    at = first + row
                    out.append((batch.column(0)[at].as_py(), batch.column(1)[at].as_py(), int(lines.ids[line]), len(own), longest, aligned, covered / len(own)))
            cols = list(zip(*out)) if out else [()] * 7
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["tbl", "rec_id", "item_id", "words", "longest", "aligned", "coverage"])

    return run


def leaks(texts: DataFrame, lines: DataFrame, least_coverage: float | None = None, block_lines: int = BLOCK_LINES) -> DataFrame:
    """texts (tbl, rec_id, text) against lines (item_id, line) -> FOUND of the cases, the best of each record and item.

    The lines are read in blocks of about block_lines, each a pass over all texts, so that an index
    has a bounded size whatever their number.
    """
    spark = texts.sparkSession
    lines = lines.where(has_text("line") & F.col("item_id").isNotNull()).select("item_id", "line")
    blocks = max(1, -(-lines.count() // block_lines))
    found = None
    for b in range(blocks):
        rows = lines.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
        index = spark.sparkContext.broadcast(LineIndex([r["item_id"] for r in rows], [r["line"] for r in rows]))
        one = texts.select("tbl", "rec_id", "text").mapInArrow(compare(index, least_coverage), FOUND)
        found = one if found is None else found.unionByName(one)
    best = [F.max(c).alias(c) for c in ("words", "longest", "aligned", "coverage")]
    return found.where(is_case(least_coverage)).groupBy("tbl", "rec_id", "item_id").agg(*best)


def is_case(least_coverage: float | None = None) -> F.Column:
    """Half of the line's words in one run, or the whole line with two words replaced.

    With least_coverage also lines of which the tiles cover so much, in any order.
    """
    case = (F.col("longest") * 2 >= F.col("words")) | (F.col("aligned") >= F.greatest(F.lit(1), F.col("words") - REPLACED))
    return case if least_coverage is None else case | (F.col("coverage") >= least_coverage)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "pool_pairs").where("split_name = 'train'").select("row_id", F.explode(F.array("s", "t")).alias("text"))
    pairs = pairs.select(F.lit("pool_pairs").alias("tbl"), F.col("row_id").alias("rec_id"), "text")
    docs = table(spark, sf_dir, "documents").select(F.lit("documents").alias("tbl"), F.col("doc_id").alias("rec_id"), "text")
    return pairs.unionByName(docs).where(has_text("text"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(corpus(spark, sf_dir), table(spark, sf_dir, "dev_lines")).select("tbl", "rec_id", "item_id")


def p3_leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each held-out line that leaked: the records that hold it and its best coverage, reordered passages included."""
    found = leaks(corpus(spark, sf_dir), table(spark, sf_dir, "dev_lines"), 0.6)
    return found.groupBy("item_id").agg(F.count("*").alias("records"), F.max("longest").alias("longest"), F.round(F.max("coverage"), 6).alias("coverage"))


def _folded(c: str) -> str:
    """The words of a text in SQL, without what does not matter."""
    return rf"list_filter(string_split(regexp_replace(regexp_replace(lower(strip_accents({c})), '{SQL_BLANK}+', ' ', 'g'), '[\p{{M}}\p{{P}}\p{{C}}]+', '', 'g'), ' '), lambda w: w <> '')"


#: Every place where a line and a text have a run of words in common that each case has, compared word by word.
SQL = {
    "p3_found": f"""WITH t AS (SELECT row_number() OVER () AS i, tbl, rec_id, {_folded("v")} AS w FROM (SELECT 'pool_pairs' AS tbl, row_id AS rec_id, s AS v FROM pool_pairs WHERE split_name = 'train'
    UNION ALL SELECT 'pool_pairs', row_id, t FROM pool_pairs WHERE split_name = 'train' UNION ALL SELECT 'documents', doc_id, text FROM documents) WHERE {sql_has_text("v")}),
z AS (SELECT item_id, w, len(w) AS n, greatest(1, least({SEED}, (len(w) + 1) // 2, len(w) // 3)) AS k FROM (SELECT item_id, {_folded("line")} AS w FROM dev_lines WHERE {sql_has_text("line")}) WHERE len(w) > 0),
lr AS (SELECT item_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS r FROM (SELECT *, unnest(range(1, n - k + 2)) AS p FROM z)),
tr AS (SELECT i, k, q, array_to_string(w[q:q + k - 1], ' ') AS r FROM (SELECT i, k, w, unnest(range(1, len(w) - k + 2)) AS q FROM t, (SELECT DISTINCT k FROM z))),
s AS (SELECT DISTINCT i, item_id, q - p AS shift FROM lr JOIN tr USING (k, r)),
e AS (SELECT t.tbl, t.rec_id, s.item_id, z.n, shift >= 0 AND shift + z.n <= len(t.w) AS room,
    array_to_string(list_transform(range(1, z.n + 1), lambda x: CASE WHEN x + shift >= 1 AND z.w[x] = t.w[x + shift] THEN '1' ELSE '0' END), '') AS e FROM s JOIN t USING (i) JOIN z USING (item_id))
SELECT DISTINCT tbl, rec_id, item_id FROM e WHERE 2 * list_max(list_transform(string_split(e, '0'), lambda x: length(x))) >= n OR room AND length(replace(e, '0', '')) >= greatest(1, n - {REPLACED})"""
}
QUERIES = {"p3_found": p3_found, "p3_leaked_items": p3_leaked_items}
