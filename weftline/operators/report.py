"""Counts, profiles and validation of corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text as T


def group_counts(df: DataFrame, *by: str) -> DataFrame:
    """Rows by the columns, null shown as (none)."""
    return df.groupBy(*(F.coalesce(F.col(c), F.lit("(none)")).alias(c) for c in by)).agg(F.count("*").alias("n"))


def profile(df: DataFrame, src: str, tgt: str, by: str) -> DataFrame:
    """(by, pairs, mean_words, mean_chars, density) for each value and, as (all), over all; one pass."""
    per = df.select(F.coalesce(F.col(by), F.lit("(none)")).alias(by), T.n_words(src).alias("w"), F.length(tgt).cast("long").alias("c"), T.mark_count(tgt, True).alias("m"))
    sums = per.groupBy(by).agg(F.count("*").alias("pairs"), *(F.sum(x).alias(x) for x in "wcm"))
    both = sums.unionByName(sums.agg(*(F.sum(x).alias(x) for x in ("pairs", "w", "c", "m"))).withColumn(by, F.lit("(all)")))
    ratio = lambda a, b, k=1.0: F.round(F.when(F.col(b) > 0, F.col(a) * k / F.col(b)).otherwise(0.0), 6)
    return both.select(by, "pairs", ratio("w", "pairs").alias("mean_words"), ratio("c", "pairs").alias("mean_chars"), ratio("m", "c", 100.0).alias("density"))


def describe(df: DataFrame, src: str, tgt: str, by: str, short: int = 8) -> DataFrame:
    w = T.n_words(src)
    return df.groupBy(by).agg(
        F.count("*").alias("n"), F.round(F.avg(w), 6).alias("mean_words"), F.round(F.avg((w <= short).cast("int")) * 100, 6).alias("pct_short"),
        F.max(w).alias("max_words"), F.round(F.avg(F.length(tgt)), 6).alias("mean_chars"),
    )


def length_histogram(df: DataFrame, text: str, most: int) -> DataFrame:
    """(n, weight): share of texts of n words, 1 to most."""
    counts = df.select(T.n_words(text).alias("n")).where(F.col("n").between(1, most)).groupBy("n").agg(F.count("*").alias("c"))
    return counts.select("n", F.round(F.col("c") / F.sum("c").over(Window.partitionBy()), 9).alias("weight"))


def orthography(df: DataFrame, text: str, by: str) -> DataFrame:
    """Marks, punctuation, scripts and joiners by group: the metrics of a spelling profile."""
    c = F.col(text)
    n = lambda x: F.sum(x).cast("long")
    rows = df.where(F.length(T.clean(text)) > 0)
    latin, target = T.count_of(c, ".,?!;:"), T.count_of(c, T.TARGET_PUNCT)
    sums = rows.groupBy(F.coalesce(F.col(by), F.lit("(none)")).alias(by)).agg(
        F.count("*").alias("lines"), n(F.length(c)).alias("chars"), n(T.mark_count(c, True)).alias("marks"),
        n((T.mark_count(c, True) > 0).cast("int")).alias("marked_lines"), n(latin).alias("latin_punct"), n(target).alias("target_punct"),
        n(F.regexp_count(c, F.lit(r"\x{200d}"))).alias("joiners"), n(F.regexp_count(c, F.lit(r"\x{200c}"))).alias("non_joiners"),
        n(F.coalesce(c.contains("  "), F.lit(False)).cast("int")).alias("double_spaces"), n(T.count_of(c, T.ARABIC_BASIC)).alias("arabic"),
        n(T.count_of(c, "A-Za-z")).alias("latin"), n(T.count_of(c, T.DEVANAGARI)).alias("devanagari"),
    )
    return sums.withColumns({
        "marks_per_100": F.round(F.col("marks") * 100.0 / F.col("chars"), 6),
        "pct_marked": F.round(F.col("marked_lines") * 100.0 / F.col("lines"), 6),
        "pct_target_punct": F.round(F.col("target_punct") * 100.0 / F.greatest(F.lit(1), F.col("latin_punct") + F.col("target_punct")), 6),
        "pct_arabic": F.round(F.col("arabic") * 100.0 / F.col("chars"), 6),
        "mean_chars": F.round(F.col("chars") / F.col("lines"), 6),
    })


def top_marks(df: DataFrame, text: str, by: str, k: int = 6) -> DataFrame:
    """(by, mark, n, place): the k commonest marks of each group; ties to the lower code point."""
    marks = df.select(F.coalesce(F.col(by), F.lit("(none)")).alias(by), F.explode(F.regexp_extract_all(text, F.lit(r"(\p{Mn})"), F.lit(1))).alias("mark"))
    counts = marks.groupBy(by, F.hex(F.encode("mark", "UTF-8")).alias("mark")).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.col("n").desc(), "mark"))
    return counts.withColumn("place", place.cast("long")).where(F.col("place") <= k)


def verdict(ref_density: Column, hyp_density: Column, ref_punct: Column, hyp_punct: Column) -> Column:
    """Of a hypothesis' spelling against a reference's."""
    ratio = F.when(ref_density > 0, hyp_density / ref_density).otherwise(F.lit(float("inf")))
    marks = F.when(ratio < 0.5, "critical").when((ratio < 0.85) | (ratio > 1.2), "mismatch").otherwise("aligned")
    return F.struct(F.round(ratio, 6).alias("ratio"), marks.alias("marks"), (F.abs(ref_punct - hyp_punct) > 15).alias("map_punctuation"))


def validate(source: DataFrame, given: DataFrame, least_density: float = 1.0, text: str = "text", id_: str = "row_id", columns: list[str] | None = None) -> DataFrame:
    """(check, severity, n, pass) of a submission (id, pos, text) against its source (id, pos).

    columns: those that the submission should have, in order; the check columns counts places that differ.
    """
    wanted = given.columns if columns is None else columns
    wrong = sum(a != b for a, b in zip(given.columns, wanted)) + abs(len(given.columns) - len(wanted))
    if text not in given.columns or id_ not in given.columns:  # all other checks need them
        return given.sparkSession.createDataFrame([("columns", "error", wrong, False)], "check string, severity string, n long, pass boolean")
    from weftline.operators.align import reordered_outer

    c = F.coalesce(F.col(text), F.lit(""))
    ids = reordered_outer(source, given, id_).groupBy("verdict").agg(F.count("*").alias("n"))
    sums = given.agg(
        F.count("*").alias("rows"), F.sum((T.clean(c) == "").cast("long")).alias("empty"), F.sum(T.is_nan_like(c).cast("long")).alias("nan_like"),
        F.sum(F.length(c)).alias("chars"), F.sum(T.count_of(c, T.DEVANAGARI)).alias("devanagari"), F.sum(T.count_of(c, T.ARABIC_BASIC)).alias("arabic"),
        F.sum(T.count_of(c, "A-Za-z")).alias("latin"), F.sum(T.mark_count(c, True)).alias("marks"), F.sum((~T.is_nfc(c)).cast("long")).alias("not_nfc"),
    )
    distinct = given.select(c.alias("t")).groupBy("t").agg(F.lit(1).alias("one")).agg(F.count("*").alias("texts"))
    n_source = source.agg(F.count("*").alias("n_source"))
    moved = ids.groupBy().agg(*(F.coalesce(F.sum(F.when(F.col("verdict") == v, F.col("n"))), F.lit(0)).alias(v) for v in ("missing", "extra", "moved")))
    one = sums.crossJoin(distinct).crossJoin(n_source).crossJoin(moved)  # one row each
    share = lambda x: F.col(x) / F.greatest(F.col("chars"), F.lit(1))
    checks = [
        ("columns", "error", F.lit(wrong), F.lit(wrong == 0)), ("not_nfc", "warning", F.col("not_nfc"), F.col("not_nfc") == 0),
        ("row_count", "error", F.abs(F.col("rows") - F.col("n_source")), F.col("rows") == F.col("n_source")),
        ("missing_ids", "error", F.col("missing"), F.col("missing") == 0), ("extra_ids", "error", F.col("extra"), F.col("extra") == 0),
        ("order", "error", F.col("moved"), F.col("moved") == 0), ("empty", "error", F.col("empty"), F.col("empty") == 0),
        ("nan_like", "error", F.col("nan_like"), F.col("nan_like") == 0), ("devanagari", "error", F.col("devanagari"), F.col("devanagari") == 0),
        ("arabic_share", "error", F.col("arabic"), share("arabic") >= 0.5), ("latin_share", "warning", F.col("latin"), share("latin") <= 0.02),
        ("density", "warning", F.col("marks"), share("marks") * 100 >= least_density),
        ("duplicates", "warning", F.col("rows") - F.col("texts"), F.col("rows") - F.col("texts") <= F.col("rows") * 0.05),
    ]
    rows = F.explode(F.array(*(F.struct(F.lit(a).alias("check"), F.lit(b).alias("severity"), n.cast("long").alias("n"), p.alias("pass")) for a, b, n, p in checks)))
    return one.select(rows.alias("x")).select("x.*")


def gates(before: DataFrame, after: DataFrame, text: str = "text", most_drift: float = 2.0) -> DataFrame:
    """(gate, before, after, pass) of a restoration: the density of marks must rise, the length may drift so many percent."""
    sums = lambda df, p: df.agg(F.sum(T.mark_count(text)).alias(f"m{p}"), F.sum(F.length(T.strip_key(text))).alias(f"b{p}"), F.sum(F.length(text)).alias(f"c{p}"))
    one = sums(before, 0).crossJoin(sums(after, 1))  # one row each
    density = lambda p: F.round(F.col(f"m{p}") * 100.0 / F.greatest(F.col(f"c{p}"), F.lit(1)), 6)
    drift = F.abs(F.col("b1") - F.col("b0")) * 100.0 / F.greatest(F.col("b0"), F.lit(1))
    rows = [("density", density(0), density(1), density(1) > density(0)), ("base_length", F.col("b0").cast("double"), F.col("b1").cast("double"), drift <= most_drift)]
    return one.select(F.explode(F.array(*(F.struct(F.lit(g).alias("gate"), a.alias("before"), b.alias("after"), p.alias("pass")) for g, a, b, p in rows))).alias("x")).select("x.*")


def gate(value: float, limit: float, what: str) -> None:
    if value > limit:
        raise AssertionError(f"{what}: {value} is above {limit}")


def no_op_guard(before: float, after: float) -> None:
    """A restoration must raise the density of marks."""
    if after <= before:
        raise AssertionError(f"restoration did nothing: density {before} before, {after} after")


def share_alike(df: DataFrame, sources: str, restricted: list[str]) -> DataFrame:
    """Adds share_alike: does any recorded source, up to its colon, oblige to it?"""
    return df.withColumn("share_alike", F.exists(sources, lambda s: F.substring_index(s, ":", 1).isin(restricted)))


def vocabulary(df: DataFrame, text: str, least: int = 5) -> DataFrame:
    """(char, n): characters of the stripped texts that occur `least` times or more."""
    chars = df.select(F.explode(F.filter(F.split(T.strip_key(F.coalesce(F.col(text), F.lit(""))), ""), lambda x: x != "")).alias("char"))
    return chars.groupBy("char").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def examples(df: DataFrame, n: int, order: str, descending: bool = True, then: str | None = None) -> DataFrame:
    """The n rows first by the column, ties by the column `then`."""
    return df.orderBy(F.col(order).desc() if descending else F.col(order), *([then] if then else [])).limit(n)


def compositions(df: DataFrame, text: str, by: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """(by, letter, composed, sequence): how often letters stand as one character and as a sequence, by group."""
    counted = df.where(F.length(T.clean(text)) > 0).select(F.coalesce(F.col(by), F.lit("(none)")).alias(by), T.composition_counts(text, pairs).alias("c"))
    letters = [F.struct(F.lit(f"{ord(a):04x}").alias("letter"), F.col(f"c.pre_{ord(a):04x}").alias("a"), F.col(f"c.seq_{ord(a):04x}").alias("b")) for a, _ in pairs]
    rows = counted.select(by, F.explode(F.array(*letters)).alias("x")).groupBy(by, F.col("x.letter").alias("letter"))
    return rows.agg(F.sum("x.a").alias("composed"), F.sum("x.b").alias("sequence"))
