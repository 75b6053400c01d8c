"""Held-out text in a corpus: exact, loose and near, and anti-joins with counts asserted."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import flat
from weftline.functions import text as T


def drop_heldout(rows: DataFrame, held: DataFrame, keys: list[str], expect_all: bool = False) -> DataFrame:
    """rows without those whose keys are held out. With expect_all it is an error unless as many rows go as there are distinct keys."""
    own = held.select(*keys).distinct()
    if expect_all:
        found = rows.select(*keys).join(own, keys, "left_semi").groupBy(*keys).agg(F.count("*").alias("n"))
        n, removed = own.count(), found.agg(F.count("*").alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
        if removed["rows"] != n:
            raise ValueError(f"{n} keys are held out, {removed['rows']} rows of {removed['keys']} of them are there")
    return rows.join(own, keys, "left_anti")


def drop_by_derived_key(rows: DataFrame, held: DataFrame, text: str, key=T.strip_key, also: tuple[str, ...] = ()) -> DataFrame:
    """rows without those whose key of the text, and whose columns `also`, are those of a held row."""
    own = held.select(key(text).alias("_k"), *also).distinct()
    return rows.withColumn("_k", key(text)).join(own, ["_k", *also], "left_anti").select(*rows.columns)


def assert_disjoint(a: DataFrame, b: DataFrame, keys: list[str]) -> None:
    n = a.select(*keys).join(b.select(*keys), keys, "left_semi").limit(1).count()
    if n:
        raise AssertionError("the two sets share " + ", ".join(keys))


def shared_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(n): distinct keys that both have; assert_disjoint is for where there must be none."""
    return a.select(*keys).join(b.select(*keys), keys, "left_semi").distinct().agg(F.count("*").alias("n"))


def overlap_count(rows: DataFrame, held: DataFrame, text: str, other: str) -> DataFrame:
    """(n): rows whose text, case and blanks disregarded, is among the others."""
    key = lambda c: F.lower(T.flatten(c)).alias("_k")
    return rows.select(key(text)).join(held.select(key(other)).distinct(), "_k", "left_semi").agg(F.count("*").alias("n"))


def by_key(rows: DataFrame, lines: DataFrame, key, kind: str) -> DataFrame:
    """(row_id, side, text) and (item_id, side, line): rows whose key equals that of a line of the same side."""
    own = lines.select("side", key("line").alias("_k"), "item_id").where("_k <> ''").groupBy("side", "_k").agg(F.min("item_id").alias("item_id"))
    keyed = rows.select("row_id", "side", key("text").alias("_k"))
    return keyed.join(own, ["side", "_k"]).select("row_id", "side", F.lit(kind).alias("kind"), F.lit(1.0).alias("score"), "item_id")


#: Grams of all lines together up to which their index is broadcast, 24 bytes each; more are joined.
SMALL_GRAMS = 2_000_000
#: Grams of rows compared with lines at once.
CELLS = 1 << 22
SETS = "id long, side string, n int, g array<long>"
NEAR = "row_id long, side string, score double, item_id long"


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(id, side, k) -> rows with text, and their distinct hashed grams: row, gram, and starts of the rows."""
    for batch in batches:
        for first, part in flat.slices(batch.column(2)):
            cps, starts = flat.decode(part)
            size = np.diff(starts)
            count = np.where(size >= n, size - n + 1, np.minimum(size, 1))
            row = np.repeat(np.arange(len(part)), count)
            begin = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + starts[row]
            gram = flat.span_hash(flat.prefix_hash(cps), begin, np.minimum(begin + n, starts[row + 1]))
            order = np.lexsort((gram, row))
            row, gram = row[order], gram[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])
            row, gram = row[new], gram[new]
            yield batch.slice(first, len(part)), row, gram, np.searchsorted(row, np.arange(len(part) + 1))


def gram_sets(df: DataFrame, id_: str, text: str, n: int) -> DataFrame:
    """SETS of the loose keys: distinct runs of n characters as 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, gram, at in _sets(batches, n):
            out = pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(np.diff(at).astype(np.int32)), flat.list_array(flat.i64(gram), at)], ["id", "side", "n", "g"])
            yield out.filter(pa.array(np.diff(at) > 0))

    return _keyed(df, id_, text).mapInArrow(run, SETS)


def _keyed(df: DataFrame, id_: str, text: str) -> DataFrame:
    return df.select(F.col(id_).alias("id"), "side", F.replace(T.loose_key(text), F.lit(" "), F.lit("")).alias("k"))


def _needed(size: np.ndarray, least: float) -> np.ndarray:
    """Rarest grams of a set of the size of which any set of the similarity has one."""
    return size - np.ceil(size * least - 1e-9).astype(np.int64) + 1


class GramIndex:
    """The gram sets of the lines of one side: by line, and for each gram the lines that have it."""

    def __init__(self, ids: np.ndarray, line: np.ndarray, gram: np.ndarray) -> None:
        self.ids, self.size = ids, np.bincount(line, minlength=len(ids))
        order = np.argsort(gram, kind="stable")
        self.gram, self.line = gram[order], line[order]
        self.member = np.sort(flat.mix(gram) + line.astype(np.uint64) * np.uint64(flat.BASE))

    def best(self, row: np.ndarray, gram: np.ndarray, at: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, score, item_id) of the most similar line of each row that has one of the similarity."""
        low = np.searchsorted(self.gram, gram)
        df = np.searchsorted(self.gram, gram, "right") - low
        order = np.lexsort((gram, df, row))
        size = np.diff(at)
        first = order[(np.arange(len(row)) - at[row] < _needed(size, least)[row]) & (df[order] > 0)]
        times = df[first]
        line = self.line[np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low[first], times)]
        pair = np.repeat(row[first], times) * len(self.ids) + line
        pair = np.sort(pair)
        pair = pair[np.append(True, pair[1:] != pair[:-1])] if len(pair) else pair
        r, k = pair // len(self.ids), pair % len(self.ids)
        fits = (self.size[k] >= np.ceil(size[r] * least - 1e-9)) & (size[r] >= np.ceil(self.size[k] * least - 1e-9))
        r, k = r[fits], k[fits]
        shared = np.zeros(len(r), np.int64)
        cut = np.append(np.flatnonzero(np.diff(np.cumsum(size[r]) // CELLS, prepend=0)), len(r))
        for a, b in zip(np.append(0, cut), cut):
            n = size[r[a:b]]
            own = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at[r[a:b]], n)
            key = flat.mix(gram[own]) + np.repeat(k[a:b], n).astype(np.uint64) * np.uint64(flat.BASE)
            hit = self.member[np.minimum(np.searchsorted(self.member, key), len(self.member) - 1)] == key
            shared[a:b] = np.bincount(np.repeat(np.arange(b - a), n), hit, b - a)
        score = shared / np.maximum(size[r] + self.size[k] - shared, 1)
        ok = score >= least - 1e-12
        r, k, score = r[ok], k[ok], score[ok]
        order = np.lexsort((self.ids[k], -score, r))
        top = order[np.append(True, np.diff(r[order]) > 0)] if len(order) else order
        return r[top], score[top], self.ids[k[top]]


def _near_small(rows: DataFrame, lines: DataFrame, least: float, n: int) -> DataFrame:
    """NEAR for lines whose index is broadcast: rows stay where they are."""
    sets = lines.toArrow()
    index = {}
    ids, side, sizes = sets.column("id").to_numpy(), np.array(sets.column("side").to_pylist(), object), sets.column("n").to_numpy()
    gram = sets.column("g").combine_chunks().flatten().to_numpy().view(np.uint64) if len(sets) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    for name in sorted({x for x in side if x is not None}):
        own = np.flatnonzero(side == name)
        hit = np.isin(owner, own)
        index[name] = GramIndex(ids[own], np.searchsorted(own, owner[hit]), gram[hit])
    shared = rows.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, row, gram, at in _sets(batches, n):
            of = np.array(part.column(1).to_pylist(), object)
            for name, lines in shared.value.items():
                mine = of == name
                keep = mine[row]
                own = np.concatenate([[0], np.cumsum(np.where(mine, np.diff(at), 0))])
                r, score, item = lines.best(row[keep], gram[keep], own, least)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(r)), part.column(1).take(pa.array(r)), pa.array(score, pa.float64()), pa.array(item, pa.int64())], [x.split()[0] for x in NEAR.split(", ")])

    return _keyed(rows, "row_id", "text").mapInArrow(run, NEAR)


def _prefixed(sets: DataFrame, rank: DataFrame, least: float) -> DataFrame:
    """(id, side, n, gram): the rarest grams, by the counts of the lines, as many as any match must share one of.

    Grams that no line has are rarest of all; they take their places in the count, but cannot match.
    """
    one = sets.select("id", "side", "n", F.explode("g").alias("gram")).join(rank, "gram")
    packed = one.groupBy("id", "side").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("c"))
    k = (F.size("c") + 1 - F.ceil(F.col("n") * F.lit(least) - 1e-9)).cast("int")
    rows = packed.withColumn("k", k).where("k > 0")
    return rows.select("id", "side", "n", F.explode(F.transform(F.slice("c", F.lit(1), F.col("k")), lambda x: x["gram"])).alias("gram"))


def _near_joined(rows: DataFrame, lines: DataFrame, least: float) -> DataFrame:
    """NEAR by joins: pairs by their rarest grams first, each once, then the sets of the pairs."""
    rank = lines.select(F.explode("g").alias("gram")).groupBy("gram").agg(F.count("*").alias("df"))
    a, b = (_prefixed(s, rank, least).select(F.col("id").alias(i), "side", F.col("n").alias(c), "gram") for s, i, c in ((rows, "row_id", "nq"), (lines, "item_id", "nd")))
    sized = (F.col("nd") >= F.ceil(F.col("nq") * least - 1e-9)) & (F.col("nq") >= F.ceil(F.col("nd") * least - 1e-9))
    pairs = a.join(b, ["side", "gram"]).where(sized).select("row_id", "item_id", "side").distinct()
    both = pairs.join(rows.select(F.col("id").alias("row_id"), "side", "g"), ["row_id", "side"]).join(lines.select(F.col("id").alias("item_id"), "side", F.col("g").alias("h")), ["item_id", "side"])
    shared = F.size(F.array_intersect("g", "h"))
    scored = both.select("row_id", "side", "item_id", (shared / (F.size("g") + F.size("h") - shared)).alias("score")).where(F.col("score") >= least - 1e-12)
    best = F.max_by(F.struct("item_id", "score"), F.struct("score", -F.col("item_id"))).alias("m")
    return scored.groupBy("row_id", "side").agg(best).select("row_id", "side", "m.score", "m.item_id")


def near(rows: DataFrame, lines: DataFrame, least: float = 0.8, n: int = 5, small: int = SMALL_GRAMS) -> DataFrame:
    """The most similar line of the same side by Jaccard similarity of runs of n, if at least `least`.

    Sets meet by their rarest grams only, which gives all pairs of the similarity and more, and the pairs
    are scored on the full sets. Ties go to the lower item_id. Up to `small` grams the lines are broadcast.
    """
    sets = gram_sets(lines, "item_id", "line", n)
    if (sets.agg(F.sum("n")).first()[0] or 0) <= small:
        found = _near_small(rows, sets, least, n)
    else:
        found = _near_joined(gram_sets(rows, "row_id", "text", n), sets, least)
    return found.select("row_id", "side", F.lit("near").alias("kind"), "score", "item_id")


def leak_reasons(rows: DataFrame, lines: DataFrame, least: float = 0.8) -> DataFrame:
    """(row_id, side, kind, score, item_id): exact, else loose, else near; one reason a row and side.

    The costly near join sees only rows that the cheap ones left.
    """
    rows = rows.where(F.length("text") > 0)
    exact = by_key(rows, lines, T.clean, "exact")
    left = rows.join(exact, ["row_id", "side"], "left_anti")
    loose = by_key(left, lines, T.loose_key, "loose")
    left = left.join(loose, ["row_id", "side"], "left_anti")
    return exact.unionByName(loose).unionByName(near(left, lines, least))


def leak_report(reasons: DataFrame) -> DataFrame:
    """(side, kind, rows, lines): rows leaked and distinct lines they hit."""
    return reasons.groupBy("side", "kind").agg(F.count("*").alias("rows"), F.countDistinct("item_id").alias("lines"))


def split_leaked(rows: DataFrame, reasons: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clean rows, leaked rows with leak_reasons as an array of structs)."""
    packed = reasons.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("side", "kind", "score", "item_id"))).alias("leak_reasons"))
    return rows.join(packed, "row_id", "left_anti"), rows.join(packed, "row_id")


def leak_gate(rows: DataFrame, lines: DataFrame, least: float = 0.8) -> DataFrame:
    """(n): rows of side_rows of which a side leaks in any way: equal, equal but for marks and signs, or near."""
    return leak_reasons(rows, lines, least).select("row_id").distinct().agg(F.count("*").alias("n"))


def side_rows(df: DataFrame, src: str, tgt: str) -> DataFrame:
    """(row_id, side, text): a row for each side of a pair."""
    sides: Column = F.explode(F.array(F.struct(F.lit("eng_Latn").alias("side"), F.col(src).alias("text")), F.struct(F.lit("kas_Arab").alias("side"), F.col(tgt).alias("text"))))
    long = df.select("row_id", sides.alias("x")).select("row_id", "x.side", "x.text").where(T.has_text("text"))
    return long.withColumn("text", T.flatten("text"))
