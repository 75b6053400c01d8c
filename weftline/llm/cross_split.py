"""Problem 4: same or near-same records across splits.

Texts are normalised (letter case, punctuation, blanks and combining marks do not matter) and cut
into content-defined chunks: a cut falls where the rolling hash of a short window is the least
within a radius, and MOST characters after the last cut, so an edit moves only the cuts around it.

A chunk between two such least places is found again in any text that holds its span, the characters on
which its two cuts depend. Two texts of the similarity differ in a bounded number of runs, and a place where
they differ costs BREAK_COST runs at least (fewer near the ends), so of chunks whose spans lie GAP apart only so many can
be touched. A held-out text therefore joins by the digests of one such span more, the rarest ones it has; of the
train texts only the chunks that pass a Bloom filter of these are shuffled. Finer chunks serve texts that have too few. Where a held-out text has too few spans
(short or repetitive ones), it joins by the first of its runs of five in one order of all runs, rarest
first: two texts of the similarity share one of the first n - ceil(similarity n) + 1. Exact copies are one class
for each field and side. A bound from sketches of the runs is applied inside the join; it can only drop
pairs below the similarity. The pairs left are checked exactly on their runs, and the lengths of
their shared chunks are summed into overlap fractions.

The chunk search misses a pair only if, at several places, a difference makes fewer new runs than BREAK_COST: a short
word said twice, or runs that the other text has elsewhere. So spans that hold a repeated run are not taken, nor
texts of few different characters, and short texts are taken to differ by FEW_COST runs a place.

Defined cases: null, blank and `nan` texts, and texts without a letter or digit, match nothing;
texts under five characters have themselves as their only run; records with an unknown or null split,
or without a row_id, are ignored; repeated rows each give their pairs; a row never pairs with itself; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import flat
from weftline.llm import bloom
from weftline.llm.common import has_text, join_small, salt, salts, sorted_distinct, sql_has_text, stored, table

GRAM = 5
SIMILARITY = 0.8
#: Radius within which a cut is the least, and the window hashed for it: of the chunks, and of finer ones for
#: texts that have too few of the first.
LEVELS = ((2, 4), (1, 4))
#: Longest chunk.
MOST = 64
#: Runs of five by which two texts differ at least where they differ in one place, GAP characters from the next;
#: less where a word of a few letters is said twice, which counts in texts that may differ in FEW runs at most.
BREAK_COST, GAP, FEW, FEW_COST = 7, 6, 12, 4

_fold: np.ndarray | None = None


def fold_table() -> np.ndarray:
    """Code point -> lower-case base character, 0 for what does not matter; from Unicode's own tables."""
    global _fold
    if _fold is None:
        t = np.arange(0x110000, dtype=np.uint32)
        for cp in range(0x110000):
            if 0xAC00 <= cp < 0xD7A4 or 0x3400 <= cp < 0xA000 or 0x20000 <= cp < 0xE0000 or 0xE000 <= cp < 0xF900 or cp >= 0xF0000:
                continue  # letters without case or marks
            ch = chr(cp)
            if unicodedata.category(ch)[0] in "ZPCM" or ch.isspace():
                t[cp] = 0
            else:
                base = unicodedata.normalize("NFD", ch)[0].lower()
                t[cp] = ord(base[0])
        _fold = t
    return _fold


def normalised(part: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    cps, starts = flat.decode(part)
    cps = fold_table()[cps]
    return flat.compact(cps, starts, cps != 0)


def gram_hashes(cps: np.ndarray, starts: np.ndarray, prefix: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n (of the whole text if it is shorter) and their row starts."""
    sizes = np.diff(starts)
    count = np.where(sizes >= n, sizes - n + 1, np.minimum(sizes, 1))
    at = np.zeros(len(starts), np.int64)
    np.cumsum(count, out=at[1:])
    row = np.repeat(np.arange(len(count)), count)
    begin = np.arange(at[-1]) - at[row] + starts[row]
    return flat.span_hash(prefix, begin, np.minimum(begin + n, starts[row + 1])), at


def least_places(starts: np.ndarray, prefix: np.ndarray, radius: int, window: int) -> np.ndarray:
    """Flags of the positions whose window hash is the least within the radius."""
    n = int(starts[-1])
    if not n:
        return np.zeros(0, bool)
    row = flat.row_ids(starts)
    pos = np.arange(n)
    inside = pos + window <= starts[row + 1]
    h = np.full(n + 2 * radius, np.iinfo(np.uint64).max, np.uint64)
    h[radius:-radius][inside] = flat.span_hash(prefix, pos[inside], pos[inside] + window)
    here = h[radius : radius + n]
    least = inside.copy()
    room_left, room_right = pos - starts[row], starts[row + 1] - pos
    for d in range(1, radius + 1):
        least &= (here < h[radius + d : radius + d + n]) | (room_right <= d)
        least &= (here <= h[radius - d : radius - d + n]) | (room_left < d)
    return least


def cuts(starts: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Flags of the positions where a chunk begins: row starts, least places, and MOST characters after the last one."""
    flags = np.append(least, False)
    flags[starts] = True
    edge = np.flatnonzero(flags)
    more = (np.diff(edge) - 1) // MOST  # a stretch without a minimum, such as one repeated character
    begin = np.repeat(edge[:-1], more)
    flags[begin + MOST * (np.arange(len(begin)) - np.repeat(np.cumsum(more) - more, more) + 1)] = True
    return flags


def spans(starts: np.ndarray, least: np.ndarray, radius: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, begin, end) of the characters that make sure of a chunk between two least places, where they are within the row."""
    at = np.flatnonzero(least)
    row = np.searchsorted(starts, at, "right") - 1
    begin, end, row = at[:-1] - radius, at[1:] + radius + window, row[:-1]
    ok = (at[1:] - at[:-1] <= MOST) & (begin >= starts[row]) & (end <= starts[row + 1])
    return row[ok], begin[ok], end[ok]


def room(n: np.ndarray, similarity: float) -> np.ndarray:
    """The most runs in which a text of n distinct runs can differ from one of the similarity, in either."""
    return np.floor((1 - similarity) / similarity * n + 1e-9).astype(np.int64)


#: Texts of fewer different characters join by runs, since a change in them often makes a run that they have already.
LETTERS = 8
#: Places of the counts of runs and of spans.
BUCKETS = 1 << 18
#: Bits of the digest of a run that are kept; the rest hold the row.
RUN_BITS = 44
FIELD, RUN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def run_of(grams: np.ndarray) -> np.ndarray:
    return grams >> np.uint64(64 - RUN_BITS)


def bucket(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(BUCKETS - 1)).astype(np.int64)


class Texts:
    """Normalised texts of a part of a column: their runs, least places, chunks and digests."""

    def __init__(self, text: pa.Array, field: np.ndarray) -> None:
        self.cps, self.starts = normalised(text)
        self.prefix = flat.prefix_hash(self.cps)
        self.field = np.where(field, FIELD, np.uint64(0))
        places = [least_places(self.starts, self.prefix, *level) for level in LEVELS]
        self.least = places[0]
        self.spans = []
        for k, (level, least) in enumerate(zip(LEVELS, places)):
            row, begin, end = spans(self.starts, least, *level)
            self.spans.append((row, begin, end, flat.span_hash(self.prefix, begin, end) ^ self.field[row] ^ np.uint64(k)))
        self.grams, self.at = gram_hashes(self.cps, self.starts, self.prefix, GRAM)

    @functools.cached_property
    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """(row, run) of the distinct runs, in order; a run by the first RUN_BITS bits of its digest."""
        key, _ = sorted_distinct(self.packed)
        return (key >> np.uint64(RUN_BITS)).astype(np.int64), key & np.uint64((1 << RUN_BITS) - 1)

    @functools.cached_property
    def packed(self) -> np.ndarray:
        """Row and run of all runs in one number each."""
        return (flat.row_ids(self.at).astype(np.uint64) << np.uint64(RUN_BITS)) | run_of(self.grams)

    def sizes(self) -> np.ndarray:
        return np.bincount(self.distinct[0], minlength=len(self.at) - 1)

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        return digests(self.cps, self.starts, self.field == FIELD)

    def sketches(self) -> np.ndarray:
        """Two words a row: whether the distinct runs that fall on each of 128 places are odd in number."""
        out = np.zeros((2, len(self.starts) - 1), np.uint64)
        row, runs = self.distinct
        if len(row):
            bit = np.uint64(1) << (runs & np.uint64(63))
            upper = (runs >> np.uint64(6)) & np.uint64(1) != 0
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            for k in range(2):
                out[k, row[first]] = np.bitwise_xor.reduceat(np.where(upper == bool(k), bit, np.uint64(0)), first)
        return out

    def first_runs(self, counts: np.ndarray, similarity: float, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, key) of the runs of the rows flagged of which any text of the similarity has one among its own."""
        row, runs = self.distinct
        keep = rows[row]
        row, runs = row[keep], runs[keep]
        count = np.minimum(counts[bucket(runs)], 4095).astype(np.uint64)
        order = np.argsort((row.astype(np.uint64) << np.uint64(RUN_BITS)) | (count << np.uint64(RUN_BITS - 12)) | (runs >> np.uint64(12)), kind="stable")
        row, runs = row[order], runs[order]
        n = np.bincount(row, minlength=len(self.at) - 1)
        rank = np.arange(len(row)) - (np.cumsum(n) - n)[row]
        first = rank <= (n - np.ceil(similarity * n - 1e-9).astype(np.int64))[row]
        return row[first], flat.mix(runs[first] ^ self.field[row[first]] ^ RUN)

    def chosen_spans(self, counts: np.ndarray, n: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, key) of the spans chosen for each row, rarest first, GAP apart, until any text of the similarity must
        have one of them; flags of the rows that have too few at any level.

        Near the ends of a text a difference costs less, down to one run a character cut off, and so where runs stand
        that the text has twice.
        """
        every, times = sorted_distinct(self.packed)
        alone = np.concatenate([[0], np.cumsum(times[np.searchsorted(every, self.packed)] == 1)])
        # by character: the runs over it that its text has only once
        place = np.arange(len(self.cps))
        row = flat.row_ids(self.starts)
        low, shift = self.at[row], self.at[row] - self.starts[row]
        lone = alone[np.minimum(place + shift + 1, self.at[row + 1])] - alone[np.maximum(place + shift - GRAM + 1, low)]
        letters, _ = sorted_distinct((flat.row_ids(self.starts).astype(np.uint64) << np.uint64(32)) | self.cps)
        open_rows = (n > 0) & (np.bincount((letters >> np.uint64(32)).astype(np.int64), minlength=len(n)) >= LETTERS)
        need, short = room(n, similarity), n > 0
        rows, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for row, begin, end, key in self.spans:
            if not len(row):
                continue
            # the fewest runs of one place of the span; a difference there changes them, and makes about as many others
            size = end - begin
            first = np.cumsum(size) - size
            fewest = np.minimum.reduceat(lone[np.arange(size.sum()) + np.repeat(begin - first, size)], first)
            most = np.minimum(np.where(need < FEW, FEW_COST, BREAK_COST)[row], fewest + BREAK_COST - GRAM)
            cost = np.minimum(np.minimum(begin - self.starts[row], self.starts[row + 1] - end) + 1, most)
            order = np.lexsort((begin, counts[bucket(key)], row))
            order, cost = order[cost[order] > BREAK_COST - GRAM], cost.tolist()
            own = np.searchsorted(row[order], np.arange(len(n) + 1))
            a, b = begin.tolist(), end.tolist()
            for r in np.flatnonzero(short & open_rows).tolist():
                mine = order[own[r] : own[r + 1]].tolist()
                taken = enough(mine, a, b, cost, int(need[r])) or enough(sorted(mine, key=b.__getitem__), a, b, cost, int(need[r]))
                if taken:
                    short[r] = False
                    rows.append(np.full(len(taken), r))
                    keys.append(key[taken])
        return np.concatenate(rows), np.concatenate(keys), short


def enough(order: list[int], begin: list[int], end: list[int], cost: list[int], need: int) -> list[int]:
    """Spans in the order given, GAP apart, that cost more than needed to touch all; none if there are too few."""
    taken: list[int] = []
    for k in order:
        if all(begin[k] >= end[j] + GAP or begin[j] >= end[k] + GAP for j in taken):
            taken.append(k)
            need -= cost[k]
            if need < 0:
                return taken
    return []


def digests(cps: np.ndarray, starts: np.ndarray, field: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two digests of the normalised texts, the first with their fields."""
    hi, lo = (flat.span_hash(flat.prefix_hash(cps ^ np.uint32(x)), starts[:-1], starts[1:]) for x in (0, 0x155555))
    return flat.mix(hi ^ np.where(field, FIELD, np.uint64(0))), lo


def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """(row_id, fld, text): the rows and their texts, a part at a time; rows without letters or digits have no runs."""
    for batch in batches:
        for first, part in flat.slices(batch.column(2)):
            rows = batch.slice(first, len(part))
            yield rows, Texts(part, rows.column(1).to_numpy(zero_copy_only=False) == "t")


#: Parts in which the counts are summed.
PARTS = 16


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How often the runs, and the chunk spans, of the texts (row_id, fld, text) fall in each bucket; of bounded size."""
    wide = 2 * BUCKETS // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * BUCKETS, np.int64)
        for _, own in parted(batches):
            for k, h in enumerate((run_of(own.grams), np.concatenate([x[3] for x in own.spans]))):
                total[k * BUCKETS : (k + 1) * BUCKETS] += np.bincount(bucket(h), minlength=BUCKETS)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS)), pa.array([zlib.compress(x.tobytes(), 1) for x in total.reshape(PARTS, wide)], pa.binary())], ["part", "n"])

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(zlib.decompress(x), np.int64) for x in rows["n"]], axis=0)
        return pd.DataFrame({"part": rows["part"].iloc[:1], "n": [zlib.compress(total.tobytes(), 1)]})

    out = np.zeros((PARTS, wide), np.int64)
    for r in texts.mapInArrow(run, "part long, n binary").groupBy("part").applyInPandas(added, "part long, n binary").collect():
        out[r["part"]] = np.frombuffer(zlib.decompress(bytes(r["n"])), np.int64)
    return out.reshape(2, BUCKETS)


#: Classes of sizes (distinct runs), each about a fifth above the one before.
SIZE_STEP = 0.2


def size_class(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(n, 1)) / SIZE_STEP + 1e-9).astype(np.int64)


KEYS = "hi long, n int, b0 long, b1 long, short boolean, key long"


def keyed(own: Texts, n: np.ndarray, short: np.ndarray, row: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
    """KEYS, a row for each key of a text; of equal texts of the part only the first has any."""
    hi, _ = own.digests()
    first = np.zeros(len(n), bool)
    first[np.unique(hi, return_index=True)[1]] = True
    keep = first[row]
    row, key = row[keep], key[keep]
    sketch = own.sketches()
    columns = [flat.i64(hi[row]), pa.array(n[row].astype(np.int32)), flat.i64(sketch[0, row]), flat.i64(sketch[1, row]), pa.array(short[row]), flat.i64(key)]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in KEYS.split(", ")])


def held_keys(counts, similarity: float):
    """mapInArrow: (row_id, fld, text) -> KEYS by which held-out texts join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, chunks = counts.value
        for _, own in parted(batches):
            n = own.sizes()
            row, key, short = own.chosen_spans(chunks, n, similarity)
            run_row, run_key = own.first_runs(runs, similarity, short)
            yield keyed(own, n, short, np.concatenate([row, run_row]), np.concatenate([key, run_key]))

    return run


def train_keys(counts, passing, sizes, similarity: float):
    """mapInArrow: (row_id, fld, text) -> KEYS that pass the filter of the held-out ones.

    First runs are sought in texts of the size classes in which a held-out text that joins by runs may have a partner.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, wanted = counts.value[0], passing.value
        for _, own in parted(batches):
            row, key = [], []
            for span_row, _, _, span_key in own.spans:
                ok = wanted.passes(span_key)
                row.append(span_row[ok])
                key.append(span_key[ok])
            n = own.sizes()
            may = np.isin(size_class(n), sizes) & (n > 0)
            if may.any():
                run_row, run_key = own.first_runs(runs, similarity, may)
                hit = wanted.passes(run_key)
                row.append(run_row[hit])
                key.append(run_key[hit])
            yield keyed(own, n, may, np.concatenate(row), np.concatenate(key))

    return run


MATCHED = "row_id long, fld string, hi long, lo long, text string"


def matched(wanted):
    """mapInArrow: (row_id, fld, text) -> MATCHED of the rows of which the digest hi passes the filter.

    Of equal texts of a part only the first comes with its text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in flat.slices(batch.column(2)):
                rows = batch.slice(at, len(part))
                hi, lo = digests(*normalised(part), rows.column(1).to_numpy(zero_copy_only=False) == "t")
                ok = np.flatnonzero(wanted.value.passes(hi))
                first = np.zeros(len(ok), bool)
                first[np.unique(hi[ok], return_index=True)[1]] = True
                text = pa.array([x if f else None for x, f in zip(part.take(pa.array(ok)).to_pylist(), first.tolist())], pa.string())
                yield pa.RecordBatch.from_arrays([*(rows.column(k).take(pa.array(ok)) for k in range(2)), flat.i64(hi[ok]), flat.i64(lo[ok]), text], [x.split()[0] for x in MATCHED.split(", ")])

    return run


def compared(a: pa.Array, b: pa.Array, at_least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairwise: is the exact similarity of runs of five at least the given one, and the share of a in shared chunks."""
    close, overlap = np.zeros(len(a), bool), np.zeros(len(a))
    x, y = (v.cast(pa.large_string()) for v in (a, b))
    for first, part in flat.slices(x, 1 << 18):
        m = len(part)
        one, two = (Texts(col, np.zeros(m, bool)) for col in (part, y.slice(first, m)))
        packed = lambda row, h: (row.astype(np.uint64) << np.uint64(RUN_BITS)) | h
        both = np.intersect1d(packed(*one.distinct), packed(*two.distinct), assume_unique=True)
        shared, na, nb = np.bincount((both >> np.uint64(RUN_BITS)).astype(np.int64), minlength=m), one.sizes(), two.sizes()
        close[first : first + m] = (shared >= at_least * (na + nb - shared) - 1e-9) & (shared > 0)
        chunks = []
        for own in (one, two):
            edge = np.flatnonzero(cuts(own.starts, own.least))
            row = np.searchsorted(own.starts, edge[:-1], "right") - 1
            chunks.append((row, packed(row, run_of(flat.span_hash(own.prefix, edge[:-1], edge[1:]))), np.diff(edge)))
        row, digest, size = chunks[0]
        overlap[first : first + m] = np.bincount(row, size * np.isin(digest, chunks[1][1]), m) / np.maximum(np.bincount(row, size, m), 1)
    return close, overlap


KEY = ["hi", "lo"]


def near_pairs(held: DataFrame, train: DataFrame, similarity: float) -> DataFrame:
    """Pairs (e_hi, t_hi) of digests of texts with a key in common and whose sketches allow the similarity."""
    side = lambda d, p: d.select(*(F.col(c).alias(f"{p}_{c}") for c in ("hi", "n", "b0", "b1")), "key")
    apart = F.bit_count(F.col("e_b0").bitwiseXOR(F.col("t_b0"))) + F.bit_count(F.col("e_b1").bitwiseXOR(F.col("t_b1")))
    near = apart <= (F.col("e_n") + F.col("t_n")) * ((1 - similarity) / (1 + similarity) + 1e-9)
    sized = (F.col("e_n") >= F.col("t_n") * (similarity - 1e-9)) & (F.col("t_n") >= F.col("e_n") * (similarity - 1e-9))
    return side(train, "t").join(side(held, "e"), "key").where(near & sized).select("e_hi", "t_hi").distinct()


def rows_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """MATCHED of the rows (row_id, fld, text) with a digest among those of the one column hi, stored."""
    passing = texts.sparkSession.sparkContext.broadcast(bloom.fit_one(wanted))
    return stored(texts.mapInArrow(matched(passing), MATCHED).join(wanted, "hi").select(*(x.split()[0] for x in MATCHED.split(", "))))


def cross_pairs(records: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(row_id, split_name, s, t) -> (row_id_a, row_id_b, e, t, by_t, overlap): pairs of a train and a held-out row.

    overlap is the share of the held-out record e made up of chunks shared with the train record t.
    """
    fields = F.explode(F.array(*(F.struct(F.lit(f).alias("fld"), F.col(f).alias("text")) for f in ("s", "t")))).alias("f")
    texts = records.select("row_id", "split_name", fields).select("row_id", "split_name", "f.*").where(has_text("text") & F.col("row_id").isNotNull())
    columns = ["row_id", "fld", "text"]
    ours, theirs = texts.where(F.col("split_name").isin("r0", "eval")).select(columns), texts.where("split_name = 'train'").select(columns)
    share = records.sparkSession.sparkContext.broadcast
    counts = share(bucket_counts(ours))
    held = stored(ours.mapInArrow(held_keys(counts, similarity), KEYS).dropDuplicates(["hi", "key"]))
    passing = share(bloom.fit_one(held.select("key")))
    kind = F.floor(F.log(F.col("n")) / SIZE_STEP + 1e-9).cast("int")  # as size_class
    alone = np.array([r[0] for r in held.where("short").select(kind).distinct().collect()], np.int64)  # some hundred at most
    reach = int(np.ceil(-np.log(similarity) / SIZE_STEP)) + 1
    sizes = np.unique((alone[:, None] + np.arange(-reach, reach + 1)).ravel())
    train = theirs.mapInArrow(train_keys(counts, passing, sizes, similarity), KEYS)
    rough = stored(near_pairs(held, train, similarity))
    found, classes = {}, {}
    for side, source in (("e", ours), ("t", theirs)):
        found[side] = rows_of(source, stored(rough.select(F.col(f"{side}_hi").alias("hi")).distinct()))
        grouped = found[side].groupBy(*KEY).agg(F.count("*").alias("size"), F.first("text", ignorenulls=True).alias("text"), F.first("fld").alias("fld"))
        classes[side] = stored(grouped.select(*(F.col(c).alias(f"{side}_{c}") for c in grouped.columns)))
    whole = rough.join(classes["e"], "e_hi").join(classes["t"], "t_hi")

    @F.arrow_udf("struct<close: boolean, overlap: double>")
    def check(a: pa.Array, b: pa.Array) -> pa.Array:
        close, overlap = compared(a, b, similarity)
        return pa.StructArray.from_arrays([pa.array(close), pa.array(overlap)], ["close", "overlap"])

    checked = whole.withColumn("c", check("e_text", "t_text")).select("e_hi", "e_lo", "e_fld", "t_hi", "t_lo", "c.close", "c.overlap")
    linked = stored(checked.where("close").drop("close"))
    for side in found:
        linked = with_members(linked, side, found[side], classes[side])
    return linked.select(F.least("e", "t").alias("row_id_a"), F.greatest("e", "t").alias("row_id_b"), "e", "t", (F.col("e_fld") == "t").alias("by_t"), "overlap")


def with_members(linked: DataFrame, side: str, rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Puts for each class of the side its rows; a class is joined in parts of some HOT rows."""
    own, size = [f"{side}_hi", f"{side}_lo"], f"{side}_size"
    used = stored(classes.select(*own, size).join(linked.select(*own).distinct(), own))
    members = rows.select(F.col("hi").alias(own[0]), F.col("lo").alias(own[1]), F.col("row_id").alias(side))
    members = join_small(members, used, own, size=size)
    members = members.select(*own, side, salt(salts(F.col(size)), side).alias("salt"))
    cut = used.select(*own, F.explode(F.sequence(F.lit(0), salts(F.col(size)) - 1)).alias("salt"))
    return linked.join(cut, own).join(members, [*own, "salt"]).drop("salt", *own)


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pool_pairs").select("row_id", "split_name", "s", "t", "config")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_pairs(pool(spark, sf_dir)).select("row_id_a", "row_id_b").distinct()


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping pairs and held-out rows by split and config, the mean overlap with them."""
    rows = pool(spark, sf_dir)
    found = cross_pairs(rows).groupBy("e", "t").agg(F.max("overlap").alias("overlap"))
    per = found.groupBy("e").agg(F.count("*").alias("pairs"), F.max("overlap").alias("overlap"))
    named = per.join(rows.select(F.col("row_id").alias("e"), "split_name", "config"), "e")
    return named.groupBy("split_name", "config").agg(F.count("*").alias("rows"), F.sum("pairs").alias("pairs"), F.round(F.avg("overlap"), 6).alias("mean_overlap"))


_BARE = r"regexp_replace(lower(strip_accents(v)), '[\p{M}\p{P}\p{C}\p{Z}\t-\r\x{1c}-\x{1f}\x{85}]+', '', 'g')"
#: All pairs of texts with a run in common, compared on all their runs.
SQL = {
    "p4_found": f"""WITH x AS (SELECT row_id, split_name = 'train' AS own, f, {_BARE} AS k FROM (SELECT row_id, split_name, 's' AS f, s AS v FROM pool_pairs UNION ALL SELECT row_id, split_name, 't', t FROM pool_pairs)
    WHERE split_name IN ('train', 'r0', 'eval') AND {sql_has_text("v")}),
c AS (SELECT *, row_number() OVER () AS id FROM (SELECT DISTINCT f, own, k FROM x WHERE k <> '')),
l AS (SELECT *, list_distinct(list_transform(range(1, greatest(length(k) - {GRAM - 1}, 1) + 1), lambda i: substr(k, i, {GRAM}))) AS g FROM c),
g AS (SELECT f, own, id, len(g) AS n, unnest(g) AS g FROM l),
j AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS m FROM g a JOIN g b ON a.f = b.f AND a.g = b.g AND a.own AND NOT b.own AND a.n >= {SIMILARITY} * b.n AND b.n >= {SIMILARITY} * a.n GROUP BY ALL),
p AS (SELECT a.f, a.k AS ka, b.k AS kb FROM j JOIN c a ON a.id = j.a JOIN c b ON b.id = j.b WHERE m >= {SIMILARITY} * (na + nb - m) - 1e-9)
SELECT DISTINCT least(s.row_id, t.row_id) AS row_id_a, greatest(s.row_id, t.row_id) AS row_id_b FROM p JOIN x s ON s.f = p.f AND s.own AND s.k = ka JOIN x t ON t.f = p.f AND NOT t.own AND t.k = kb"""
}
QUERIES = {"p4_found": p4_found, "p4_counts": p4_counts}
