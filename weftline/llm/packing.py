"""Problem 7: filling fixed-capacity containers with items.

Only the histogram of lengths, at most `capacity` numbers, reaches the driver. Patterns of few
documents whose lengths sum to the capacity are enumerated, their repeat counts are fitted to the
histogram by non-negative least squares and rounded down, and what is left is packed by patterns made
greedily, longest first, best fit next. Documents then find their containers by their rank among
those of the same length; ranks are counted in hash buckets of about RANKED items, as many as the most frequent
length needs, so a length that a third of all documents have is no hot group.

Defined cases: null, blank and `nan` texts have no tokens to pack and are left out; a text longer than
the capacity is cut into parts of exactly the capacity and a rest, the only texts that are split;
repeated rows are packed each; ties in rank go by doc_id; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import has_text, stored, table
from weftline.llm.tokens import token_count

CAPACITY = 2048
#: Lengths that patterns of three and more combine with any other, taken at quantiles of the histogram.
GRID = 12
STEPS = 300
#: Items of one length that are ranked by one task, about.
RANKED = 50_000


def patterns(h: np.ndarray, capacity: int) -> np.ndarray:
    """Patterns as rows of up to four lengths, 0 for none, that sum to the capacity and occur in h."""
    have = np.flatnonzero(h)
    if not len(have):
        return np.zeros((0, 4), np.int64)
    share = np.cumsum(h[have]) / h.sum()
    grid = np.unique(have[np.minimum(np.searchsorted(share, (np.arange(GRID) + 0.5) / GRID), len(have) - 1)])
    none = np.zeros(1, np.int64)
    out = []
    for fixed in (none, grid):
        for more in (none, grid):
            a, b, c = (x.ravel() for x in np.meshgrid(have, fixed, more, indexing="ij"))
            out.append(np.column_stack([a, capacity - a - b - c, b, c]))
    out.append(np.array([[capacity, 0, 0, 0]]))
    p = np.concatenate(out)
    p = p[(p[:, 1] >= 0) & ((p == 0) | (h[np.clip(p, 0, capacity)] > 0)).all(1)]
    return np.unique(-np.sort(-p, axis=1), axis=0)


def nonnegative_fit(p: np.ndarray, h: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Repeats x >= 0 of the patterns with least squared error of their lengths against h, by projected steps.

    Lengths are weighted by 1 / sqrt(h), so that rare ones count too.
    """
    flat, weight = p.ravel(), 1 / np.sqrt(np.maximum(h, 1))
    scale = weight * (np.arange(len(h)) > 0)
    used = lambda x: np.bincount(flat, np.repeat(x, p.shape[1]), len(h)) * scale
    back = lambda r: (r * scale)[p].sum(1)
    target = h * scale
    # diagonal scaling: a step for each pattern by how often its lengths are used by all
    density = np.bincount(flat, minlength=len(h)) * scale
    step = 1 / np.maximum(back(density), 1e-9)
    x = np.zeros(len(p))
    y, t = x, 1.0
    for _ in range(steps):
        new = np.maximum(0, y + step * back(target - used(y)))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x


def greedy_patterns(h: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Packs the histogram by repeated patterns: the longest item, then always the longest that fits.

    Every pattern is repeated until one of its lengths is used up, so there are at most as many
    patterns as lengths, whatever the number of items.
    """
    h, out = h.copy(), []
    while True:
        have = np.flatnonzero(h)
        if not len(have):
            return out
        used: dict[int, int] = {}
        room = capacity
        while True:
            k = int(np.searchsorted(have, room, "right")) - 1
            while k >= 0 and h[have[k]] <= used.get(int(have[k]), 0):
                k -= 1
            if k < 0:
                break
            size = int(have[k])
            n = min(room // size, int(h[size]) - used.get(size, 0))
            used[size] = used.get(size, 0) + n
            room -= n * size
            if not room:
                break
        times = min(int(h[s]) // n for s, n in used.items())
        for s, n in used.items():
            h[s] -= n * times
        out.append(([s for s, n in used.items() for _ in range(n)], times))


def solve(h: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """(lengths, repeats) of all containers for the histogram h, h[l] items of length l."""
    p = patterns(h, capacity)
    left, out = h.copy(), []
    if len(p):
        x = nonnegative_fit(p, h)
        for k in np.argsort(-x, kind="stable"):
            if x[k] < 1:
                break
            sizes, n = np.unique(p[k][p[k] > 0], return_counts=True)
            times = min(int(x[k]), int((left[sizes] // n).min()))
            if times:
                left[sizes] -= n * times
                out.append((np.repeat(sizes, n).tolist(), times))
    return out + greedy_patterns(left, capacity)


def slots(containers: list[tuple[list[int], int]], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the items of each length go, in order of rank: (length, first rank, first container, items each, filled)."""
    rows, given, base = [], np.zeros(capacity + 1, np.int64), 0
    for lengths, times in containers:
        sizes, n = np.unique(lengths, return_counts=True)
        for s, c in zip(sizes.tolist(), n.tolist()):
            rows.append((s, int(given[s]), base, c, sum(lengths)))
            given[s] += c * times
        base += times
    table = np.array(rows, np.int64).reshape(-1, 5)
    return table[np.lexsort((table[:, 1], table[:, 0]))], given


def ranked(items: DataFrame, buckets: int) -> DataFrame:
    """Adds rank from 0 among the items of the same length, each length cut into so many buckets."""
    bucketed = items.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "part"), F.lit(buckets)).cast("int"))
    counts = bucketed.groupBy("tokens", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("tokens", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("tokens", "bucket").orderBy("doc_id", "part")) - 1
    return bucketed.withColumn("own", own).join(base, ["tokens", "bucket"]).withColumn("rank", F.col("own") + F.col("base")).drop("own", "base", "bucket")


def parts(sizes: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, tokens) -> (doc_id, part, tokens): parts of the capacity and a rest for larger texts."""
    number = F.ceil(F.col("tokens") / capacity).cast("int")
    one = sizes.where("tokens > 0").select("doc_id", F.col("tokens").alias("all"), F.explode(F.sequence(F.lit(0), number - 1)).alias("part"))
    return one.select("doc_id", "part", F.least(F.lit(capacity), F.col("all") - F.col("part") * capacity).cast("long").alias("tokens"))


def pack(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, tokens) -> (container_id, doc_id, part, tokens, filled)."""
    items = stored(parts(sizes, capacity))
    h = np.zeros(capacity + 1, np.int64)
    for r in items.groupBy("tokens").agg(F.count("*").alias("n")).toLocalIterator():  # at most `capacity` rows
        h[r["tokens"]] = r["n"]
    where, _ = slots(solve(h, capacity), capacity)
    shared = items.sparkSession.sparkContext.broadcast(where)

    @F.arrow_udf("struct<container_id: bigint, filled: bigint>")
    def place(tokens: pa.Array, rank: pa.Array) -> pa.Array:
        rows, wide = shared.value, np.int64(1) << np.int64(40)
        t, r = tokens.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        at = np.searchsorted(rows[:, 0] * wide + rows[:, 1], t * wide + r, "right") - 1
        hit = rows[at]
        box = hit[:, 2] + (r - hit[:, 1]) // hit[:, 3]
        return pa.StructArray.from_arrays([pa.array(box), pa.array(hit[:, 4])], ["container_id", "filled"])

    placed = ranked(items, -(-max(1, int(h.max())) // RANKED)).withColumn("c", place("tokens", F.col("rank").cast("long")))
    return placed.select("c.container_id", "doc_id", "part", "tokens", "c.filled")


def token_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(has_text("text")).select("doc_id", token_count("text").alias("tokens"))


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_sizes(spark, sf_dir))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers by their number of documents, and the room they leave."""
    boxes = p7_packed(spark, sf_dir).groupBy("container_id").agg(F.count("*").alias("items"), F.sum("tokens").alias("tokens"))
    return boxes.groupBy("items").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.sum(F.lit(CAPACITY) - F.col("tokens")).alias("unused"))


QUERIES = {"p7_packed": p7_packed, "p7_fill": p7_fill}
