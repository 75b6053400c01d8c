"""What the operators share: tables, the void-text rule, shared storage, joins that survive hot keys."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.sources import readers, storage

#: Blanks of any kind, for Java's regular expressions.
BLANK = r"[\s\p{Z}\x{85}\x{1c}-\x{1f}]"


#: Blanks of any kind, for the regular expressions of the SQL.
SQL_BLANK = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sql_has_text(c: str) -> str:
    """has_text in SQL."""
    return f"{c} IS NOT NULL AND lower(regexp_replace({c}, '{SQL_BLANK}+', '', 'g')) NOT IN ('', 'nan')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return readers.table(spark, sf_dir, name)


def has_text(c: Column | str) -> Column:
    """Neither null nor blank nor the word nan in any letter case."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.coalesce(c.rlike(rf"(?i)^{BLANK}*(nan)?{BLANK}*$"), F.lit(True))


def sorted_distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and how often each occurs; by sorting, which for numbers is faster than a table."""
    x = np.sort(x)
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
    return x[first], np.diff(np.append(first, len(x)))


def stored(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cuts the lineage by a checkpoint in the shared folder, which survives the loss of executors."""
    storage.shared_dir(df.sparkSession)
    return df.checkpoint(eager)


@contextlib.contextmanager
def written(df: DataFrame) -> Iterator[DataFrame]:
    """The rows as a table in the shared folder, which is removed at the end of the block; words that occur often take little of it."""
    spark = df.sparkSession
    path = f"{storage.shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: A key with at least so many rows is hot; and the most keys taken as hot, so many rows of a few bytes are broadcast.
HOT, MOST_HOT = 20_000, 50_000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, hot: int = HOT) -> DataFrame:
    """rows inner-joined with groups (stored; one row a key, `size` = its number of rows), safe for hot keys.

    Hot keys are joined by broadcast, so that their rows stay where they are. A key is hot from `hot` rows on,
    or from a share of 1 / MOST_HOT of all rows on if that is more, so there are MOST_HOT of them at most.
    """
    total = groups.agg(F.sum(size), F.max(size)).first()
    hot = max(hot, -(-(total[0] or 0) // MOST_HOT))
    if (total[1] or 0) < hot:
        return rows.join(groups, keys)
    big, small = groups.where(F.col(size) >= hot), groups.where(F.col(size) < hot)
    return rows.join(F.broadcast(big), keys).unionByName(rows.join(small, keys))


def salts(size: Column, hot: int = HOT) -> Column:
    """The parts of at most about `hot` rows that a group is cut into."""
    return F.greatest(F.lit(1), F.ceil(size / hot)).cast("int")


def salt(parts: Column, *by: str) -> Column:
    return F.pmod(F.xxhash64(*by), parts).cast("int")


def unlike_pairs(rows: DataFrame, keys: list[str], kind: str, item: str, hot: int = HOT) -> DataFrame:
    """(keys, kind, item) -> (keys, a_item, b_item): all pairs of rows of one group and different kinds, each once.

    The kinds of a group are paired, not its rows; then the rows of both are put in, by salts of about `hot` rows,
    so that no task gets more than `hot` rows a side of one pair of kinds and rows of one kind never meet.
    """
    kinds = stored(rows.groupBy(*keys, kind).agg(F.count("*").alias("size")))
    side = lambda p: kinds.select(*keys, F.col(kind).alias(f"{p}_kind"), salts(F.col("size"), hot).alias(f"{p}_salts"))
    pairs = side("a").join(side("b"), keys).where("a_kind < b_kind")
    cells = pairs.withColumn("a_salt", F.explode(F.sequence(F.lit(0), F.col("a_salts") - 1))).withColumn("b_salt", F.explode(F.sequence(F.lit(0), F.col("b_salts") - 1)))
    cells = stored(cells.drop("a_salts", "b_salts"))
    salted = join_groups(rows, kinds, [*keys, kind], "size", hot).select(*keys, kind, item, salt(salts(F.col("size"), hot), item).alias("salt"))
    names = [*keys, "a_kind", "b_kind", "a_salt", "b_salt"]
    a, b = (cells.join(salted.select(*keys, F.col(kind).alias(f"{p}_kind"), F.col("salt").alias(f"{p}_salt"), F.col(item).alias(f"{p}_{item}")), [*keys, f"{p}_kind", f"{p}_salt"]) for p in "ab")
    return a.join(b, names).select(*keys, f"a_{item}", f"b_{item}")


#: Rows of a few numbers each up to which a side, once stored and counted, is broadcast: some MB.
SMALL_ROWS = 100_000


def join_small(rows: DataFrame, few: DataFrame, keys: list[str], size: str | None = None) -> DataFrame:
    """rows joined with few, a stored table of numbers, by broadcast if it has SMALL_ROWS at most, else by shuffle.

    size: the column of few that holds the rows of the key, for hot keys.
    """
    if few.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
        return rows.join(F.broadcast(few), keys)
    return join_groups(rows, few, keys, size) if size else rows.join(few, keys)
