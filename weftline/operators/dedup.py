"""Keep-first deduplication. Groups are reduced before the shuffle, so a hot key is no hot task.

Keys are shuffled as 128-bit digests. Where only columns that order the rows are wanted, the least of them is found
by a hash aggregate of numbers; only else do the columns wanted travel, once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as T


def digest(*keys: Column) -> Column:
    """128 bits of the texts, nulls apart from empty ones."""
    marked = [F.coalesce(F.concat(F.lit("="), k.cast("string")), F.lit("-")) for k in keys]
    sized = [F.concat(F.length(m).cast("string"), m) for m in marked[:-1]]
    return F.unhex(F.md5(F.concat(*sized, marked[-1])))


def keep_first(df: DataFrame, keys: list[Column], order: list[str], copies: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """The first row by `order` for each value of the keys; with `copies` also how many there were.

    columns: those of the row that are wanted, all by default.
    """
    wanted = df.columns if columns is None else columns
    extra = [F.count("*").alias(copies)] if copies else []
    rest = [c for c in wanted if c not in order]
    if len(order) == 1 and not rest:
        own = df.select(digest(*keys).alias("_k"), *order).groupBy("_k")
        return own.agg(F.min(order[0]).alias(order[0]), *extra).drop("_k")
    grouped = df.select(digest(*keys).alias("_k"), F.struct(*order, *rest).alias("_r")).groupBy("_k").agg(F.min("_r").alias("_row"), *extra)
    return grouped.select(*(F.col(f"_row.{c}").alias(c) for c in wanted), *([copies] if copies else []))


def exact_pairs(df: DataFrame, src: str = "src", tgt: str = "tgt", order: str = "row_id", copies: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """First of all rows with the same two texts, blanks at the ends disregarded."""
    edge = lambda c: F.regexp_replace(c, f"^{T.WS}+|{T.WS}+$", "")
    return keep_first(df, [edge(src), edge(tgt)], [order], copies, columns)


def stripped_targets(df: DataFrame, src: str = "s", tgt: str = "t", order: str = "row_id", copies: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """First of all rows with the same source and the same target but for restorable marks."""
    return keep_first(df, [F.col(src), T.strip_key(tgt)], [order], copies, columns)


def across_sources(parts: list[DataFrame], text: str = "text", order: str = "row_id", columns: list[str] | None = None) -> DataFrame:
    """Union of (row_id, text, source) frames, earlier ones first; the first row of each text without marks stays."""
    union = None
    for rank, part in enumerate(parts):
        one = part.select(F.lit(rank).alias("source_rank"), order, text, "source")
        union = one if union is None else union.unionByName(one)
    return keep_first(union.where(F.length(text) > 0), [T.strip_key(text)], ["source_rank", order], columns=columns)
