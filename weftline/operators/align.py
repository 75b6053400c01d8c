"""Alignment checks of parallel files: length correlation of blocks, shifted neighbours, rolling majorities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.vectors import dot


def pearson(x: Column, y: Column) -> Column:
    """Correlation of a group from sums; 0 where one does not vary."""
    n, sx, sy = F.count("*"), F.sum(x), F.sum(y)
    vx, vy = n * F.sum(x * x) - sx * sx, n * F.sum(y * y) - sy * sy
    return F.when((vx > 0) & (vy > 0), (n * F.sum(x * y) - sx * sy) / F.sqrt(F.greatest(vx, F.lit(1)).cast("double") * F.greatest(vy, F.lit(1)).cast("double"))).otherwise(0.0)


def block_correlation(rows: DataFrame, x: Column, y: Column, position: Column, size: int = 600, least: float = 0.5, least_rows: int = 50, by: list[str] | None = None) -> DataFrame:
    """(by, block, n, r, keep): blocks of `size` positions; kept if they correlate or are short."""
    by = by or []
    blocks = rows.withColumn("block", F.floor(position / size).cast("long")).groupBy(*by, "block")
    out = blocks.agg(F.count("*").alias("n"), F.round(pearson(x.cast("long"), y.cast("long")), 6).alias("r"))
    return out.withColumn("keep", (F.col("n") < least_rows) | (F.col("r") >= least))


def shifted_cosines(a: DataFrame, b: DataFrame, id_: str = "vec_id", shifts: tuple[int, ...] = (-1, 0, 1)) -> DataFrame:
    """(id, cos_<i>...): cosine of a's vector with b's at each shift, -1 where there is none. One join on the id."""
    spread = b.select(F.explode(F.array(*(F.struct((F.col(id_) - s).alias(id_), F.lit(s).alias("s")) for s in shifts))).alias("k"), F.col("embedding").alias("_b")).select(f"k.{id_}", "k.s", "_b")
    joined = a.select(id_, F.col("embedding").alias("_a")).join(spread, id_, "left")
    cos = joined.groupBy(id_).agg(*(F.max(F.when(F.col("s") == s, F.round(dot("_a", "_b"), 6))).alias(f"cos_{i}") for i, s in enumerate(shifts)))
    return cos.na.fill(-1.0)


def rolling_majority(rows: DataFrame, value: str, values: list[int], id_: str = "vec_id", window: int = 21, block: int = 100_000) -> DataFrame:
    """Adds regime: the commonest value in a centred window of rows; ties to the first of `values`.

    Positions must be consecutive numbers. They are cut into blocks, each with half a window of its
    neighbours' rows, so that no window needs one task for the whole table.
    """
    half = window // 2
    ends = F.array_distinct(F.array(F.floor((F.col(id_) - half) / block), F.floor(F.col(id_) / block), F.floor((F.col(id_) + half) / block)))
    spread = rows.withColumn("_b", F.explode(ends))
    span = Window.partitionBy("_b").orderBy(id_).rowsBetween(-half, half)
    for i, v in enumerate(values):
        spread = spread.withColumn(f"_n{i}", F.count(F.when(F.col(value) == v, 1)).over(span))
    best, regime = F.col("_n0"), F.lit(values[0])
    for i, v in enumerate(values[1:], 1):
        regime = F.when(F.col(f"_n{i}") > best, v).otherwise(regime)
        best = F.greatest(best, F.col(f"_n{i}"))
    own = spread.withColumn("regime", regime.cast("long")).where(F.col("_b") == F.floor(F.col(id_) / block))
    return own.drop("_b", *(f"_n{i}" for i in range(len(values))))


def regime_filter(rows: DataFrame, shifts: tuple[int, ...] = (-1, 0, 1), least: float = 0.15, margin: float = 0.05, id_: str = "vec_id") -> DataFrame:
    """Adds offset (of the greatest cosine), regime, chosen, best and keep to shifted_cosines."""
    cols = [F.col(f"cos_{i}") for i in range(len(shifts))]
    best = F.greatest(*cols)
    offset = F.lit(None).cast("long")
    for i in reversed(range(len(shifts))):
        offset = F.when(cols[i] == best, shifts[i]).otherwise(offset)
    with_regime = rolling_majority(rows.withColumn("offset", offset.cast("long")), "offset", list(shifts), id_)
    chosen = F.lit(None).cast("double")
    for i, s in enumerate(shifts):
        chosen = F.when(F.col("regime") == s, cols[i]).otherwise(chosen)
    out = with_regime.withColumn("best", best).withColumn("chosen", chosen)
    return out.withColumn("keep", (F.col("chosen") >= least) & (F.round(F.col("best") - F.col("chosen"), 9) <= margin))


def reordered_outer(a: DataFrame, b: DataFrame, id_: str) -> DataFrame:
    """Full outer comparison by id and position: (id, pos_a, pos_b, verdict) of missing, extra and moved rows."""
    both = a.select(id_, F.col("pos").alias("pos_a")).join(b.select(id_, F.col("pos").alias("pos_b")), id_, "full_outer")
    verdict = F.when(F.col("pos_b").isNull(), "missing").when(F.col("pos_a").isNull(), "extra").when(F.col("pos_a") != F.col("pos_b"), "moved")
    return both.withColumn("verdict", verdict).where("verdict is not null")
