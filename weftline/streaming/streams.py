"""Row-wise curation and keep-first deduplication of a stream of pairs.

The batch operators of single rows work unchanged on streams. Duplicates are dropped within a
watermark, so the state is bounded by the lateness allowed, not by the stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import filters


def pairs(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def curated(stream: DataFrame, time: str = "landed_at", late: str = "1 day", ratio: tuple[float, float] = (0.5, 2.0), arabic: float = 0.8) -> DataFrame:
    """The waterfall on a stream: row filters, then the first of equal pairs (marks disregarded) within the watermark."""
    rows = filters.nonempty(stream, "src", "tgt").where(filters.length_ok("src", "tgt", (1, 200), ratio))
    rows = rows.where((T.arabic_share("tgt") >= arabic) & ~T.has_devanagari("tgt"))
    keyed = rows.withColumn("_k", F.sha2(F.concat_ws("\u0001", "src", T.strip_key("tgt")), 256)).withWatermark(time, late)
    return keyed.dropDuplicatesWithinWatermark(["_k"]).drop("_k")


def arrivals(stream: DataFrame, time: str = "landed_at", window: str = "1 day", late: str = "7 days") -> DataFrame:
    """(start, config, n): rows by arrival window."""
    w = stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), F.coalesce("config", F.lit("(none)")).alias("config"))
    return w.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "config", "n")


def write_append(df: DataFrame, path: str, checkpoint: str):
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
