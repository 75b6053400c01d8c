"""Apportionment, stratified fill, dealing, splitting and upweighting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.ranking import hash_order, ranked_by_hash


def apportion(histogram: DataFrame, total: int, key: str = "n", weight: str = "weight") -> DataFrame:
    """(key, weight) -> (key, need): whole numbers in proportion that sum to total.

    Floors first, then one more to the largest remainders, ties to the smaller key. A histogram is small.
    """
    every = Window.partitionBy()
    exact = F.round(F.col(weight) * total / F.sum(weight).over(every), 9)
    base = histogram.select(key, exact.alias("exact")).withColumn("base", F.floor("exact"))
    order = F.row_number().over(Window.orderBy(F.round(F.col("exact") - F.col("base"), 9).desc(), key))
    spare = F.lit(total) - F.sum("base").over(every)
    return base.withColumn("o", order).withColumn("spare", spare).select(key, (F.col("base") + (F.col("o") <= F.col("spare")).cast("long")).cast("long").alias("need"))


def stratified_fill(
    rows: DataFrame, needs: DataFrame, preferred: str, others: list[str], share: float, total: int, seed: str = "0",
    key: str = "n", config: str = "config",
) -> DataFrame:
    """Fills each stratum: up to round-half-even(need * share) preferred rows, then the others in order, then preferred.

    Within a phase rows go by hash. total bounds every need, which lets the ranks be cut before the shuffle.
    Adds need, phase and place (from 1).
    """
    order = F.array(*(F.lit(x) for x in [preferred, *others]))
    known = rows.where(F.col(config).isin([preferred, *others])).withColumn("_h", hash_order(seed, "row_id")).withColumn("_c", F.array_position(order, F.col(config)))
    own = Window.partitionBy(key, config).orderBy("_h", "row_id")
    top = known.withColumn("_r", F.row_number().over(own)).where(F.col("_r") <= total)
    with_need = top.join(F.broadcast(needs), key)  # a row a stratum
    first = (F.col(config) == preferred) & (F.col("_r") <= F.bround(F.col("need") * F.lit(share)))
    phase = F.when(first, 0).when(F.col(config) != preferred, 1).otherwise(2)
    place = F.row_number().over(Window.partitionBy(key).orderBy("phase", "_c", "_h", "row_id"))
    filled = with_need.withColumn("phase", phase).withColumn("place", place)
    return filled.where(F.col("place") <= F.col("need")).drop("_h", "_c", "_r")


def shortfall(filled: DataFrame, needs: DataFrame, key: str = "n") -> DataFrame:
    """(key, need, got) of the strata that could not be filled."""
    got = filled.groupBy(key).agg(F.count("*").alias("got"))
    return needs.join(got, key, "left").select(key, "need", F.coalesce("got", F.lit(0)).alias("got")).where("got < need")


def deal(rows: DataFrame, seed: str = "0", key: str = "n") -> DataFrame:
    """Adds hand: A and B in turn within each stratum, in hash order."""
    order = Window.partitionBy(key).orderBy(hash_order(seed, "row_id"), "row_id")
    return rows.withColumn("hand", F.when((F.row_number().over(order) - 1) % 2 == 0, "A").otherwise("B"))


def split(rows: DataFrame, first: float | int, seed: str = "0", column: str = "row_id") -> DataFrame:
    """Adds part: 1 for the first share (or number) of the rows in hash order, else 2."""
    n = rows.agg(F.count("*").alias("_total"))
    ranked = ranked_by_hash(rows, seed, column, name="_rank").crossJoin(F.broadcast(n))  # one row
    size = F.floor(F.col("_total") * F.lit(first)) if isinstance(first, float) else F.lit(first)
    return ranked.withColumn("part", F.when(F.col("_rank") < size, 1).otherwise(2)).drop("_rank", "_total")


def sample(rows: DataFrame, k: int, seed: str = "0", column: str = "row_id") -> DataFrame:
    """k rows at random, by hash; a top-k, not a full sort."""
    return rows.orderBy(hash_order(seed, column), column).limit(k)


def repeat_factor(selected: int, rest: int, share: float, most: int) -> int:
    """Times to repeat the selected rows so that they make up the share, between 1 and most; halves to even."""
    if selected <= 0:
        return 1
    return max(1, min(most, round(share * rest / ((1 - share) * selected))))


def upweighted(rest: DataFrame, selected: DataFrame, times: int) -> DataFrame:
    """rest and the selected rows repeated."""
    again = selected.withColumn("_r", F.explode(F.sequence(F.lit(1), F.lit(times)))).drop("_r")
    return rest.unionByName(again)
