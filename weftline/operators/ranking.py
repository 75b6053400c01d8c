"""Exact global ranks and running sums without a single-task sort.

Rows are cut into ordered ranges of a value; each range is ranked by itself and moved by the size of the
ranges before it. The ranges are few and their table is joined by broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows that one task ranks, about.
RANGE_ROWS = 100_000


def ranked(df: DataFrame, order: list[Column | str], bucket: Column, by: list[str] | None = None, name: str = "rank") -> DataFrame:
    """Adds the rank from 0 over all rows, or those with the same `by`; bucket must rise with the order."""
    by = by or []
    df = df.withColumn("_b", bucket)
    sizes = df.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(*(F.col(c).alias(f"_by{i}") for i, c in enumerate(by)), F.col("_b").alias("_b2"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = F.row_number().over(Window.partitionBy(*by, "_b").orderBy(*order)) - 1
    same = F.col("_b").eqNullSafe(F.col("_b2"))
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    joined = df.withColumn("_own", own).join(base, same)
    return joined.withColumn(name, (F.col("_own") + F.col("_base")).cast("long")).drop("_b", "_b2", "_own", "_base", *(f"_by{i}" for i in range(len(by))))


def hash_order(seed: str, column: str) -> Column:
    """A reproducible random order: the MD5 of seed and value, as hex."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(column).cast("string")))


def ranked_by_hash(df: DataFrame, seed: str, column: str = "row_id", by: list[str] | None = None, name: str = "rank") -> DataFrame:
    """Rank in hash order; ranges are by the first hex digits, as many as the rows need for RANGE_ROWS a range."""
    digits = 1
    rows = df.count()
    while 16**digits * RANGE_ROWS < rows:
        digits += 1
    keyed = df.withColumn("_h", hash_order(seed, column))
    return ranked(keyed, ["_h", column], F.substring("_h", 1, digits), by, name).drop("_h")


def quantiles(df: DataFrame, column: str, qs: list[float], ranges: int = 64) -> DataFrame:
    """One row (n, q<percent>...): for each q the value at index floor(q * (n - 1)) of the sorted column."""
    have = df.where(F.col(column).isNotNull()).select(F.col(column).alias("v"))
    counts = have.groupBy("v").agg(F.count("*").alias("c"))
    edges = sorted(set(have.approxQuantile("v", [i / ranges for i in range(1, ranges)], 0.005))) or [0.0]
    bucket = F.lit(0)
    for e in edges:  # at most `ranges` comparisons
        bucket = bucket + (F.col("v") > F.lit(e)).cast("int")
    counts = counts.withColumn("b", bucket)
    sums = counts.groupBy("b").agg(F.sum("c").alias("s"))
    base = sums.select("b", F.coalesce(F.sum("s").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.sum("s").over(Window.partitionBy()).alias("n"))
    upto = F.sum("c").over(Window.partitionBy("b").orderBy("v"))
    placed = counts.withColumn("upto", upto).join(F.broadcast(base), "b").select("v", "n", (F.col("upto") + F.col("base")).alias("to"), "c")
    picks = []
    for q in qs:
        at = F.floor(F.lit(q) * (F.col("n") - 1))
        hit = (F.col("to") > at) & (F.col("to") - F.col("c") <= at)
        picks.append(F.max(F.when(hit, F.col("v"))).alias(f"q{round(q * 100):02d}"))
    return placed.groupBy().agg(F.max("n").alias("n"), *picks)
