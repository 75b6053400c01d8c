"""Selection by embeddings: scores against a query set, per-query caps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries in a block; a block of 768 dimensions takes 60 MB.
QUERY_BLOCK = 20_000


def _matrix(col: pa.Array) -> np.ndarray:
    n = len(col)
    return col.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float64) if n else np.zeros((0, 1))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_: str = "vec_id", block: int = QUERY_BLOCK, other: bool = False) -> DataFrame:
    """(id, embedding) against all queries -> (id, score, query_id): mean of the top k cosines, and the nearest.

    other: a vector that is a query itself is compared with the other queries only.

    The queries are a stated set and are compared in blocks of bounded size; the top k of the blocks are
    merged. Cosines are rounded to 9 digits, ties go to the lower query id.
    """
    total = queries.count()
    found = None
    for b in range(max(1, -(-total // block))):
        part = queries.where(F.pmod(F.xxhash64(id_), F.lit(max(1, -(-total // block)))) == b).orderBy(id_)
        rows = part.select(id_, "embedding").toArrow()
        ids, q = rows.column(0).to_numpy(), _matrix(rows.column(1).combine_chunks())
        shared = vectors.sparkSession.sparkContext.broadcast((ids, q))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, m = shared.value
            for batch in batches:
                s = np.round(_matrix(batch.column(1)) @ m.T, 9) if len(names) else np.zeros((len(batch), 0))
                if other:
                    s[batch.column(0).to_numpy(zero_copy_only=False)[:, None] == names[None, :]] = -np.inf
                top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                n = np.full(len(batch), top.shape[1])
                at = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                pairs = pa.StructArray.from_arrays([pa.array(np.take_along_axis(s, top, 1).ravel()), pa.array(names[top].ravel())], ["cos", "query_id"])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(at), pairs)], ["id", "top"])

        one = vectors.select(id_, "embedding").mapInArrow(run, "id long, top array<struct<cos: double, query_id: long>>")
        found = one if found is None else found.unionByName(one)
    if total > block:
        found = found.groupBy("id").agg(F.flatten(F.collect_list("top")).alias("top"))
    ordered = F.slice(F.array_sort("top", lambda a, b: F.when(a["cos"] > b["cos"], -1).when(a["cos"] < b["cos"], 1).when(a["query_id"] < b["query_id"], -1).otherwise(1)), 1, k)
    top = found.withColumn("top", F.filter(ordered, lambda x: x["cos"] > float("-inf")))
    mean = F.aggregate("top", F.lit(0.0), lambda s, x: s + x["cos"]) / F.size("top")
    return top.select(F.col("id").alias(id_), F.round(mean, 6).alias("score"), F.element_at("top", 1)["query_id"].alias("query_id"))


def capped(scored: DataFrame, cap: int, n: int, id_: str = "vec_id") -> DataFrame:
    """The best n by score of which at most cap share their nearest query; ties to the lower id."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), id_)
    return scored.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= cap).drop("_r").orderBy(F.col("score").desc(), id_).limit(n)
