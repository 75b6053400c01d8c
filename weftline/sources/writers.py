"""Writers: partitioned Parquet and JSON in general; single ordered files only where the format is one."""

from __future__ import annotations

import contextlib
import hashlib
import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from weftline.operators.lexicon import Lexicon


def jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def tsv(df: DataFrame, path: str) -> None:
    """Tab-separated parts, each with a header; texts with quotes, tabs or line ends are quoted, quotes in them doubled."""
    df.write.mode("overwrite").options(sep="\t", header="true", quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(path)


def _stream(df: DataFrame, *files: tuple[Path, Callable[[Row], str]]) -> tuple[int, list[str]]:
    """Writes the rows to files in their order, in one pass, a partition at a time; returns the rows and the SHA-256 of each file."""
    digests, n = [hashlib.sha256() for _ in files], 0
    with contextlib.ExitStack() as stack:
        for path, _ in files:
            path.parent.mkdir(parents=True, exist_ok=True)
        out = [stack.enter_context(path.open("wb")) for path, _ in files]
        for row in df.toLocalIterator(prefetchPartitions=True):
            n += 1
            for file, digest, (_, line) in zip(out, digests, files):
                data = line(row).encode()
                file.write(data)
                digest.update(data)
    return n, [d.hexdigest() for d in digests]


def twins(df: DataFrame, folder: str, split: str, left: str = "eng_Latn", right: str = "kas_Arab", order: str = "row_id") -> dict:
    """Writes <split>.<left> and <split>.<right> line by line in order; returns pairs, files and hashes."""
    names = [f"{split}.{side}" for side in (left, right)]
    n, digests = _stream(df.orderBy(order).select("s", "t"), *((Path(folder, name), lambda r, k=k: r[k] + "\n") for k, name in enumerate(names)))
    return {"pairs": n, "files": names, "sha256": dict(zip(names, digests))}


def submission(df: DataFrame, path: str, order: str = "pos", columns: tuple[str, str] = ("ID", "kashmiri_text")) -> str:
    """Two columns as CSV, quoted only where needed, in source order."""

    def cell(x: str) -> str:
        x = "" if x is None else str(x)
        return '"' + x.replace('"', '""') + '"' if any(c in x for c in ',"\n\r') else x

    head = [",".join(columns) + "\n"]

    def line(r) -> str:
        start = head.pop() if head else ""
        return start + f"{cell(r[0])},{cell(r[1])}\n"

    return _stream(df.orderBy(order).select(*columns), (Path(path), line))[1][0]


def manifest(facts: dict, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(facts, ensure_ascii=False, indent=2, sort_keys=True))


def file_hash(path: str) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
    return digest.hexdigest()


def cached_scores(spark: SparkSession, rows: DataFrame, score, path: str, text: tuple[str, ...] = ("src", "tgt")) -> DataFrame:
    """rows with score; scores are kept in Parquet by content hash, and only new texts are scored.

    score: (key, *text) -> (key, score). Rejected rows are kept too, so thresholds can move for free.
    """
    keyed = rows.withColumn("key", F.sha2(F.concat_ws("\u0001", *text), 256))
    try:
        known = spark.read.parquet(path)
    except Exception:  # nothing there yet
        known = spark.createDataFrame([], "key string, score double")
    new = keyed.select("key", *text).dropDuplicates(["key"]).join(known, "key", "left_anti")
    score(new).select("key", F.col("score").cast("double").alias("score")).write.mode("append").parquet(path)
    return keyed.join(spark.read.parquet(path), "key", "left").drop("key")


def cached_vectors(spark: SparkSession, rows: DataFrame, embed, path: str, text: str = "text", model: str = "") -> DataFrame:
    """rows with embedding; vectors are kept in Parquet by the hash of text and model, only new texts are embedded.

    embed: (key, text) -> (key, embedding).
    """
    keyed = rows.withColumn("key", F.sha2(F.concat_ws("\u0001", F.lit(model), text), 256))
    try:
        known = spark.read.parquet(path).select("key")
    except Exception:  # nothing there yet
        known = spark.createDataFrame([], "key string")
    new = keyed.select("key", text).dropDuplicates(["key"]).join(known, "key", "left_anti")
    embed(new).select("key", F.col("embedding").cast("array<float>").alias("embedding")).write.mode("append").parquet(path)
    return keyed.join(spark.read.parquet(path), "key", "left").drop("key")


def pools(wide: DataFrame, path: str, system: str, meta: dict | None = None) -> None:
    wide.select(F.col("pool").alias("i"), "src", F.lit(system).alias("system"), "candidates").write.mode("overwrite").json(path)
    if meta is not None:
        manifest(meta, path.rstrip("/") + ".meta.json")


def lexicon(lex: Lexicon, path: str, stats: dict | None = None) -> None:
    """The lexicon as one JSON file, streamed; context keys are joined by tabs."""
    out = Path(path)
    out.parent.mkdir(parents=True, exist_ok=True)
    with out.open("w", encoding="utf-8") as f:

        def table(df: DataFrame | None, keys: list[str]) -> None:
            f.write("{")
            rows = [] if df is None else df.select(F.concat_ws("\t", *keys), "form").toLocalIterator()
            for i, r in enumerate(rows):
                f.write((", " if i else "") + json.dumps(r[0], ensure_ascii=False) + ": " + json.dumps(r[1], ensure_ascii=False))
            f.write("}")

        f.write(json.dumps({"stats": stats or {}}, ensure_ascii=False)[:-1] + ', "lexicon": ')
        table(lex.unigram, ["key"])
        f.write(', "context": {"both": ')
        table(lex.both, ["prev", "key", "next"])
        f.write(', "left": ')
        table(lex.left, ["prev", "key"])
        f.write(', "right": ')
        table(lex.right, ["key", "next"])
        f.write("}}")


def tuned(weights: dict[str, float], path: str, note: str) -> None:
    """Weights as YAML under a line that says where they come from."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(f"# {note}\n" + "".join(f"w_{k}: {v:.6g}\n" for k, v in weights.items()))
