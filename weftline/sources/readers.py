"""Readers with explicit schemas. Everything is read as string where the format has no types."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as t

from weftline.functions import text as T

PAIR = t.StructType([t.StructField(c, t.StringType()) for c in ("src", "tgt", "config", "provenance", "source_file")])
TEXT_COLUMNS = ("sentence", "english", "text", "src")


def strings(*columns: str) -> t.StructType:
    return t.StructType([t.StructField(c, t.StringType()) for c in columns])


def numbered(df: DataFrame, name: str = "row_id", start: int = 1) -> DataFrame:
    """Adds consecutive numbers in the order of the rows: each split is counted, then moved by the splits before it."""
    columns, split = df.columns, F.shiftright("_m", 33)
    marked = df.withColumn("_m", F.monotonically_increasing_id())
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    base = marked.groupBy(split.alias("_p")).agg(F.count("*").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = F.col("_base") + F.col("_m").bitwiseAND((1 << 33) - 1) + start
    return marked.withColumn("_p", split).join(F.broadcast(base), "_p").select(own.alias(name), *columns)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table of the folder, spread over the cores if it has fewer splits than there are.

    A large table has more splits and is read as it is; a small one in a single row group would
    otherwise keep one core busy. Filters and column pruning still reach the scan.
    """
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def jsonl(spark: SparkSession, path: str, schema: t.StructType = PAIR) -> DataFrame:
    """One JSON object a line; blank lines are skipped, missing keys are null."""
    return spark.read.schema(schema).json(path)


def scored_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return jsonl(spark, path, t.StructType([*PAIR.fields, t.StructField("labse", t.DoubleType())]))


def lines(spark: SparkSession, path: str, keep_blank: bool = False) -> DataFrame:
    """(line); blank lines are rows where position counts."""
    df = spark.read.text(path).withColumnRenamed("value", "line")
    return df if keep_blank else df.where(T.flatten("line") != "")


def tsv(spark: SparkSession, path: str, columns: tuple[str, ...] = ("src_lang", "tgt_lang", "src", "tgt")) -> DataFrame:
    """Tab-separated with a header in any order, in the dialect that fits it: quoted, unless unquoted gives more rows.

    Rows of another width are dropped. The columns named must be there.
    """
    header = spark.read.text(path).limit(1).collect()
    names = header[0]["value"].lstrip("﻿").split("\t") if header else []
    missing = [c for c in columns if c not in names]
    if missing:
        raise ValueError(f"{path} has no column {missing[0]}")
    options = {"sep": "\t", "header": "true", "enforceSchema": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "nullValue": "\u0001", "emptyValue": ""}

    def read(quoted: bool) -> DataFrame:
        extra = {"quote": '"', "escape": '"', "multiLine": "true"} if quoted else {"quote": ""}
        df = spark.read.schema(strings(*names, "_bad")).options(**options, **extra).csv(path)
        return df.where(F.col("_bad").isNull() & F.col(names[-1]).isNotNull())

    return max((read(q) for q in (True, False)), key=lambda df: df.count()).select(*columns)


def csv_text(spark: SparkSession, path: str, text: tuple[str, ...] = TEXT_COLUMNS) -> DataFrame:
    """CSV as strings, its text column (the first known name) renamed text; a byte-order mark is dropped."""
    df = csv_strings(spark, path)
    found = next((c for c in text if c in df.columns), None)
    if found is None:
        raise ValueError(f"{path} has none of the columns {', '.join(text)}")
    return df.withColumnRenamed(found, "text")


def csv_strings(spark: SparkSession, path: str) -> DataFrame:
    """Every cell as it stands: empty cells and the word nan stay."""
    df = spark.read.options(header="true", inferSchema="false", multiLine="true", escape='"', nullValue="\u0001", emptyValue="").csv(path)
    return df.toDF(*(c.lstrip("﻿") for c in df.columns)).na.fill("")


def any_text(spark: SparkSession, path: str, source: str) -> DataFrame:
    """(text, source, tag) from JSON lines (targets, tagged by config) or plain lines."""
    if path.endswith(".jsonl"):
        df = jsonl(spark, path)
        return df.select(F.col("tgt").alias("text"), F.lit(source).alias("source"), F.concat(F.lit(source + ":"), "config").alias("tag"))
    return lines(spark, path).select(F.col("line").alias("text"), F.lit(source).alias("source"), F.lit(source).alias("tag"))


def distinct_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, first): byte-identical files after the first, by path, name the one they repeat."""
    files = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
    first = files.groupBy("sha256").agg(F.min("path").alias("first"))
    return files.join(first, "sha256").select("path", "sha256", "first")


def twins(spark: SparkSession, left: str, right: str) -> DataFrame:
    """(row_id, s, t): two files line by line. If their lengths differ, blank lines are dropped, should that help."""
    for keep in (True, False):
        a, b = (numbered(lines(spark, p, keep_blank=keep)) for p in (left, right))
        if a.count() == b.count():
            return a.withColumnRenamed("line", "s").join(b.withColumnRenamed("line", "t"), "row_id")
    raise ValueError(f"{left} and {right} have different numbers of lines")


def pools(spark: SparkSession, *paths: str) -> DataFrame:
    """(pool, src, candidates) of JSON lines; of several files, candidates of the same pool are put together."""
    from weftline.operators.scoring import merge_pools

    schema = "i long, src string, system string, candidates array<string>"
    out = None
    for p in paths:
        one = spark.read.schema(schema).json(p).select(F.col("i").alias("pool"), "src", "candidates")
        out = one if out is None else merge_pools(out, one)
    return out


def prefix_candidates(pooled: DataFrame, n: int, files: int = 1) -> DataFrame:
    """The first n candidates of each pool; of pools put together from several files there is no first, which is an error."""
    if files > 1:
        raise ValueError("a prefix of candidates needs a single file of pools")
    return pooled.withColumn("candidates", F.slice("candidates", 1, n))


def lexicon_json(spark: SparkSession, path: str):
    """The lexicon of a JSON file; context keys are joined by tabs, a flat context table is the left one."""
    from weftline.operators.lexicon import Lexicon

    m = "map<string, string>"
    row = spark.read.option("multiLine", "true").text(path, wholetext=True).select(F.col("value").alias("j"))
    nested = row.select(F.from_json("j", f"lexicon {m}, context struct<both: {m}, left: {m}, right: {m}>").alias("x"))
    flat = row.select(F.from_json(F.get_json_object("j", "$.context"), m).alias("left"))

    def table(expr: str, names: list[str], df: DataFrame = nested) -> DataFrame:
        parts = F.split("k", "\t")
        rows = df.select(F.explode(expr).alias("k", "form"))
        return rows.where((F.size(parts) == len(names)) & F.col("form").isNotNull()).select(*(parts[i].alias(n) for i, n in enumerate(names)), "form")

    left = table("x.context.left", ["prev", "key"]).unionByName(table("left", ["prev", "key"], flat))
    return Lexicon(table("x.lexicon", ["key"]), table("x.context.both", ["prev", "key", "next"]), left, table("x.context.right", ["key", "next"]))


def given(spark: SparkSession, texts: list[str]) -> DataFrame:
    """(row_id, text) of texts at hand."""
    return spark.createDataFrame(list(enumerate(texts, 1)), "row_id long, text string")


def scalar(text: str):
    """A YAML scalar, or a list of them in brackets, as a number, boolean, None, string or list."""
    text = text.strip()
    if text[:1] == "[" and text[-1:] == "]":
        return [scalar(x) for x in text[1:-1].split(",") if x.strip()]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return {"true": True, "false": False, "null": None, "~": None, "": None}.get(text.lower(), text.strip("'\""))


def settings(path: str) -> dict:
    """A YAML file of `name: value` lines as a dict; indented names make dicts, lines of `- value` lists.

    A name given twice, a line of another form or an indentation that fits no name is an error.
    """
    with open(path, encoding="utf-8") as f:
        lines = [x for x in (re.sub(r"(^|\s)#.*$", "", line.rstrip("\n")).rstrip() for line in f) if x]
    depth = lambda x: len(x) - len(x.lstrip(" "))

    def block(at: int, indent: int):
        if lines[at].lstrip().startswith("- "):
            out: list = []
            while at < len(lines) and depth(lines[at]) == indent and lines[at].lstrip().startswith("- "):
                out.append(scalar(lines[at].lstrip()[2:]))
                at += 1
            return out, at
        found: dict = {}
        while at < len(lines) and depth(lines[at]) == indent:
            name, colon, value = lines[at].strip().partition(":")
            if not colon or name in found or value[:1] not in ("", " "):
                raise ValueError(f"not a setting: {lines[at].strip()}")
            at += 1
            if value.strip() or at == len(lines) or depth(lines[at]) <= indent:
                found[name] = scalar(value)
            else:
                found[name], at = block(at, depth(lines[at]))
        return found, at

    out, at = block(0, 0) if lines else ({}, 0)
    if at < len(lines):
        raise ValueError(f"not a setting: {lines[at].strip()}")
    return out
