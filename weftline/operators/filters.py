"""Row filters of the curation waterfall, and their accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators.dedup import digest


def nonempty(df: DataFrame, *columns: str) -> DataFrame:
    """Blanks flattened in the columns; rows with an empty one dropped."""
    for c in columns:  # on the raw text: a filter on the cleaned one would clean it twice
        df = df.where(T.has_text(c))
    return df.withColumns({c: T.clean(c) for c in columns})


def language_is(df: DataFrame, **wanted: str) -> DataFrame:
    for c, lang in wanted.items():
        df = df.where(F.col(c) == lang)
    return df


def ratio_ok(src: str, tgt: str, ratio: tuple[float, float] = (0.5, 2.0)) -> Column:
    """Target by source characters within the bounds, both included."""
    return (F.length(tgt) / F.greatest(F.length(src), F.lit(1))).between(*ratio)


def length_ok(src: str, tgt: str, words: tuple[int, int] = (1, 200), ratio: tuple[float, float] = (0.5, 2.0)) -> Column:
    """Source words and the ratio of characters within the bounds, all included."""
    return ratio_ok(src, tgt, ratio) & T.n_words(src).between(*words)


def script_reason(c: str, devanagari: float = 0.10, arabic: float = 0.80) -> Column:
    """The first reason to reject a target by its script, null for none."""
    p = T.script_counts(c)
    n = p["letters"]
    return (
        F.when(n == 0, "no_letters")
        .when(p["devanagari"] / n > devanagari, "devanagari")
        .when(p["arabic"] / n < arabic, "arabic")
    )


def score_ok(score: str, least: float, scope: str = "all") -> Column:
    """Unscored rows pass. scope mined: rows of any other provenance pass whatever their score."""
    ok = F.col(score).isNull() | (F.col(score) >= least)
    if scope == "all":
        return ok
    if scope != "mined":
        raise ValueError(f"unknown scope {scope}")
    return ok | ~F.coalesce(F.col("provenance") == "mined", F.lit(False))


def provenance(df: DataFrame, *kinds: str) -> DataFrame:
    return df.where(F.col("provenance").isin(*kinds))


def tagged(df: DataFrame, *wanted: str, expect: bool = False) -> DataFrame:
    """Rows of which the tag or the coarse source is wanted. With expect it is an error if there are none."""
    rows = df.where(F.col("tag").isin(*wanted) | F.col("source").isin(*wanted))
    if expect and not rows.limit(1).count():
        raise ValueError(f"no rows of {', '.join(wanted)}")
    return rows


def text_reason(c: str, least_chars: int = 8, arabic: float = 0.8, least_marks: int = 0) -> Column:
    return (
        F.when(F.length(c) < least_chars, "short")
        .when(T.arabic_share(c, "wide") < arabic, "script")
        .when(T.mark_count(c) < least_marks, "marks")
    )


#: The stages of the waterfall in order.
STAGES = ["empty", "ratio", "script", "devanagari", "duplicate"]


def waterfall(df: DataFrame, src: str = "src", tgt: str = "tgt", order: str = "row_id", ratio: tuple[float, float] = (0.5, 2.0), arabic: float = 0.8) -> DataFrame:
    """Adds reason: the first stage of STAGES that rejects the row, null for survivors.

    Duplicates, by source and target without marks, are sought among the rows that got so far, and the
    first by `order` stays. They are found by an aggregate, which combines before the shuffle.
    """
    first = df.withColumns({src: T.clean(src), tgt: T.clean(tgt)}).withColumn("reason", row_reason(src, tgt, ratio, arabic))
    key = [F.col(src).alias("_s"), T.strip_key(tgt).alias("_t")]
    # a filter on reason would be pushed into the scan and the reason computed twice there
    kept = first.groupBy(*key).agg(F.min(F.when(F.col("reason").isNull(), F.col(order))).alias(order)).where(F.col(order).isNotNull()).select(order, F.lit(True).alias("_kept"))
    joined = first.join(kept, order, "left")
    dup = F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("_kept").isNull(), "duplicate")
    return joined.withColumn("reason", dup).drop("_kept")


def row_reason(src: str, tgt: str, ratio: tuple[float, float], arabic: float) -> Column:
    """The first stage before the last that rejects a row of clean texts."""
    return (
        F.when((F.length(src) == 0) | (F.length(tgt) == 0), "empty")
        .when(~ratio_ok(src, tgt, ratio), "ratio")
        .when(T.arabic_share(tgt) < arabic, "script")
        .when(T.has_devanagari(tgt), "devanagari")
    )


def reason_counts(df: DataFrame, src: str = "src", tgt: str = "tgt", ratio: tuple[float, float] = (0.5, 2.0), arabic: float = 0.8) -> DataFrame:
    """(reason, n) of waterfall, without its rows: one aggregate by reason and digest of the pair."""
    clean = df.select(T.clean(src).alias(src), T.clean(tgt).alias(tgt)).withColumn("reason", row_reason(src, tgt, ratio, arabic))
    pair = F.when(F.col("reason").isNull(), digest(F.col(src), T.strip_key(tgt))).alias("pair")
    groups = clean.select("reason", pair).groupBy("reason", "pair").agg(F.count("*").alias("n"))
    sums = groups.groupBy("reason").agg(F.sum("n").alias("n"), F.count("pair").alias("kept"))
    parts = F.array(F.struct("reason", F.when(F.col("reason").isNull(), F.col("kept")).otherwise(F.col("n")).alias("n")), F.struct(F.lit("duplicate").alias("reason"), F.when(F.col("reason").isNull(), F.col("n") - F.col("kept")).alias("n")))
    return sums.select(F.explode(parts).alias("x")).select("x.*").where("n > 0")


def stage_report(df: DataFrame, stages: list[str] = STAGES) -> DataFrame:
    """Rows with a reason -> (stage_no, stage, kept, dropped, pct_of_previous)."""
    return count_report(df.groupBy("reason").agg(F.count("*").alias("n")), stages)


def count_report(counts: DataFrame, stages: list[str] = STAGES) -> DataFrame:
    """stage_report of counts (reason, n)."""
    df = counts
    order = F.array(*(F.lit(s) for s in stages))
    every = df.sparkSession.createDataFrame([(i, s) for i, s in enumerate(["input", *stages])], "stage_no long, stage string")
    at = F.when(F.col("reason").isNull(), len(stages) + 1).otherwise(F.array_position(order, F.col("reason")))
    lost = counts.select(at.alias("lost_at"), "n")
    kept = every.join(F.broadcast(lost), F.col("lost_at") > F.col("stage_no"), "left").groupBy("stage_no", "stage").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("kept"))
    before = F.lag("kept").over(Window.orderBy("stage_no"))  # a row a stage
    out = kept.withColumn("before", before)
    pct = F.round(100.0 * F.col("kept") / F.col("before"), 4)
    return out.select("stage_no", "stage", "kept", F.coalesce(F.col("before") - F.col("kept"), F.lit(0)).alias("dropped"), F.when(F.col("before") > 0, pct).alias("pct"))
