"""Queries that write files and read them again: every format goes there and back over a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import filters, lexicon
from weftline.sources import readers, storage, writers


def _pool(spark: SparkSession, d: str) -> DataFrame:
    return filters.nonempty(readers.table(spark, d, "pool_pairs").select("row_id", "s", "t"), "s", "t")


def q61(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines there and back, nulls and line ends included."""
    path = storage.work_dir(spark) + "/pairs.jsonl"
    writers.jsonl(readers.table(spark, d, "raw_pairs").select("src", "tgt", "config", "provenance", "source_file"), path)
    size = lambda c: F.coalesce(F.sum(F.length(c)), F.lit(0)).alias(f"chars_{c}")
    rows = readers.jsonl(spark, path)
    return rows.groupBy(F.coalesce("config", F.lit("(none)")).alias("config")).agg(F.count("*").alias("n"), F.count("src").alias("n_src"), F.count("tgt").alias("n_tgt"), size("src"), size("tgt"))


def q62(spark: SparkSession, d: str) -> DataFrame:
    """Tab-separated lines with a header in another order than asked for, read in the dialect that fits."""
    path = storage.work_dir(spark) + "/pairs.tsv"
    rows = filters.nonempty(readers.table(spark, d, "raw_pairs"), "src", "tgt").where("src_lang is not null and tgt_lang is not null")
    writers.tsv(rows.select("tgt", "src_lang", "src", "tgt_lang"), path)
    size = lambda c: F.sum(F.length(c)).alias(f"chars_{c}")
    return readers.tsv(spark, path).groupBy("src_lang", "tgt_lang").agg(F.count("*").alias("n"), size("src"), size("tgt"))


def q63(spark: SparkSession, d: str) -> DataFrame:
    """Twin files in the order of the rows, zipped by position again."""
    folder = storage.work_dir(spark)
    left, right = (f"{folder}/{x}" for x in writers.twins(_pool(spark, d), folder, "train")["files"])
    return readers.twins(spark, left, right).select("row_id", F.md5("s").alias("s_md5"), F.md5("t").alias("t_md5"))


def q64(spark: SparkSession, d: str) -> DataFrame:
    """A submission as CSV in the order of its source, every cell read as it stands."""
    path = storage.work_dir(spark) + "/submission.csv"
    rows = readers.table(spark, d, "pool_pairs").select(F.col("row_id").alias("pos"), F.col("row_id").cast("string").alias("ID"), T.flatten("t").alias("kashmiri_text"))
    writers.submission(rows, path)
    return readers.csv_strings(spark, path).select("ID", F.md5("kashmiri_text").alias("text_md5"))


def q65(spark: SparkSession, d: str) -> DataFrame:
    """A lexicon with three tables of contexts as one JSON file."""
    from weftline.plans.catalogue import _lexicon

    path = storage.work_dir(spark) + "/lexicon.json"
    writers.lexicon(_lexicon(spark, d), path)
    lex: lexicon.Lexicon = readers.lexicon_json(spark, path)
    any_ = F.lit("*")
    parts = [
        lex.unigram.select(any_.alias("prev"), "key", any_.alias("next"), "form"), lex.both.select("prev", "key", "next", "form"),
        lex.left.select("prev", "key", any_.alias("next"), "form"), lex.right.select(any_.alias("prev"), "key", "next", "form"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def q66(spark: SparkSession, d: str) -> DataFrame:
    """Two files of candidate pools put together pool by pool."""
    from weftline.plans.catalogue import _candidates

    folder = storage.work_dir(spark)
    wide = _candidates(spark, d).groupBy("pool").agg(F.min_by("src", "j").alias("src"), F.array_sort(F.collect_list(F.struct("j", "text"))).alias("c"))
    wide = wide.select("pool", "src", F.transform("c", lambda x: x["text"]).alias("candidates"))
    for name in ("a", "b"):
        writers.pools(wide, f"{folder}/{name}", name)
    both = readers.pools(spark, f"{folder}/a", f"{folder}/b")
    return both.select("pool", F.size("candidates").cast("long").alias("n"), F.md5("src").alias("src_md5"), F.md5(F.array_join("candidates", "|")).alias("candidates_md5"))


def q67(spark: SparkSession, d: str) -> DataFrame:
    """Scores kept by the text of a pair: each text is scored once, a second call scores none."""
    path = storage.work_dir(spark) + "/scores"
    pairs = readers.table(spark, d, "pool_pairs").select("row_id", F.col("s").alias("src"), F.col("t").alias("tgt")).where("src is not null and tgt is not null")
    score = lambda new: new.select("key", F.round(F.length("tgt") / F.greatest(F.length("src"), F.lit(1)), 6).alias("score"))
    writers.cached_scores(spark, pairs, score, path)
    return writers.cached_scores(spark, pairs, score, path).select("row_id", "score")


def q68(spark: SparkSession, d: str) -> DataFrame:
    """Files by their content: of the twin files of each side, written one a file, how many are there once and more than once."""
    folder = storage.work_dir(spark) + "/side=kas"
    lines = readers.table(spark, d, "twin_lines").where("side = 'kas_Arab'").groupBy("line_no").agg(F.count("line").alias("n"))
    lines.select("line_no", F.concat_ws(" ", F.lit("lines"), F.col("n").cast("string")).alias("value")).write.partitionBy("line_no").mode("overwrite").text(folder)
    files = readers.distinct_files(spark, folder + "/*/*.txt")
    return files.groupBy("sha256").agg(F.count("*").alias("files"), F.countDistinct("first").alias("firsts"))


def q82(spark: SparkSession, d: str) -> DataFrame:
    """Texts with their source and tag from JSON lines and from plain lines."""
    folder = storage.work_dir(spark)
    rows = filters.nonempty(readers.table(spark, d, "raw_pairs"), "src", "tgt")
    writers.jsonl(rows.select("src", "tgt", "config", "provenance", "source_file"), folder + "/a.jsonl")
    _pool(spark, d).select(F.col("t").alias("value")).write.text(folder + "/b.txt")
    both = readers.any_text(spark, folder + "/a.jsonl", "pairs").unionByName(readers.any_text(spark, folder + "/b.txt", "lines"))
    return both.groupBy("source", F.coalesce("tag", F.lit("(none)")).alias("tag")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def q83(spark: SparkSession, d: str) -> DataFrame:
    """Tuned weights as a settings file, read again."""
    from weftline.plans.catalogue import WEIGHTS

    path = storage.work_dir(spark) + "/weights.yaml"
    writers.tuned(WEIGHTS, path, "given by hand")
    return spark.createDataFrame([(k, float(v)) for k, v in readers.settings(path).items()], "name string, value double")


def q84(spark: SparkSession, d: str) -> DataFrame:
    """Vectors kept by the text: equal texts are embedded once."""
    path = storage.work_dir(spark) + "/vectors"
    rows = readers.table(spark, d, "pool_pairs").where("s is not null").select("row_id", F.col("s").alias("text"))
    sizes = F.array(F.length("text"), F.length(F.replace("text", F.lit(" "), F.lit(""))))
    embed = lambda new: new.select("key", sizes.cast("array<float>").alias("embedding"))
    found = writers.cached_vectors(spark, rows, embed, path)
    return found.select("row_id", *(F.element_at("embedding", k).cast("long").alias(f"v{k}") for k in (1, 2)))


FILE_QUERIES = {
    "q61_jsonl": q61, "q62_tsv": q62, "q63_twin_zip": q63, "q64_submission_csv": q64, "q65_lexicon_json": q65, "q66_pool_files": q66, "q67_score_cache": q67, "q68_same_files": q68,
    "q82_any_text": q82, "q83_settings": q83, "q84_vector_cache": q84,
}
