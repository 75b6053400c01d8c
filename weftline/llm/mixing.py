"""Problem 8: mixing sources to target weights.

Every source gets target_share of a total. The total, unless given, is the largest at which each
source can fill its share without using a document more than max_repeat times. A source's budget is
spent on whole epochs over all its documents first; the rest is an Efraimidis-Spirakis sample:
documents in order of exponential keys divided by their quality, taken while the running sum of tokens
is within the budget. Where the next document would overrun it, the order is gone on with over those that fit into the
room left, until none fits; that room is less than one document's length. The running sum is taken over BINS bins of keys, and
only the bin in which the budget ends is put in order, so a source that holds a third of all rows is no hot group. What is
taken is told by a few numbers a source. Keys come from a hash of doc_id and `seed`.

Defined cases: null, blank and `nan` texts have no tokens and are never used; sources without a target
are left out; targets without documents are reported with no tokens, the other shares being scaled
up; a null or non-positive share counts as none, a null or negative max_repeat as 0; ties of keys go by
doc_id; repeated rows are documents of their own; with a total given, a source that can't reach its
share gives all it may, and the shares reached are reported; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import flat
from weftline.llm.common import has_text, stored, table
from weftline.llm.languages import BREAK, LETTER, SKIP, tables
from weftline.llm.tokens import tokenizer

SEED = 0
#: Bins of keys for the running sums of a source.
BINS = 1 << 14
LEAST_QUALITY = 0.05


def sized(path: str | None):
    """mapInArrow: (doc_id, source, text) -> (doc_id, source, tokens, quality); quality: share of letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, kind_of = tokenizer(path), tables()[0]
        for batch in batches:
            for first, part in flat.slices(batch.column(2)):
                rows = batch.slice(first, len(part))
                cps, starts = flat.decode(part)
                kind = kind_of[cps]
                sums = [np.concatenate([[0], np.cumsum(x)]) for x in (kind == LETTER, (kind > BREAK) & (kind != SKIP))]
                letters, solid = (s[starts[1:]] - s[starts[:-1]] for s in sums)
                quality = np.maximum(LEAST_QUALITY, letters / np.maximum(solid, 1))
                tokens = pa.array([own.count(t) for t in part.to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), tokens, pa.array(quality)], ["doc_id", "source", "tokens", "quality"])

    return run


def measured(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """(doc_id, source, text) -> (doc_id, source, tokens, quality)."""
    rows = docs.where(has_text("text")).select("doc_id", "source", "text")
    return rows.mapInArrow(sized(tokenizer_path), "doc_id long, source string, tokens long, quality double").where("tokens > 0")


def budgets(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """(source, target_share, max_repeat, have, budget, epochs, rest); a row for each source with a target."""
    goal = targets.where("source is not null and target_share > 0").groupBy("source").agg(
        F.sum("target_share").alias("target_share"), F.greatest(F.lit(0), F.coalesce(F.max("max_repeat"), F.lit(0))).alias("max_repeat")
    )
    have = sizes.groupBy("source").agg(F.sum("tokens").alias("have"), F.count("*").alias("documents"))
    joined = goal.join(have, "source", "left").na.fill(0, ["have", "documents"])
    can = F.col("have") * F.col("max_repeat") > 0
    whole = Window.partitionBy()  # one row a source with a target
    share = F.when(can, F.col("target_share") / F.sum(F.when(can, F.col("target_share"))).over(whole)).otherwise(0.0)
    joined = joined.withColumn("share", share)
    most = F.min(F.when(can, F.col("have") * F.col("max_repeat") / F.col("share"))).over(whole)
    joined = joined.withColumn("total", most if total is None else F.lit(float(total)))
    limit = (F.col("have") * F.col("max_repeat")).cast("double")
    budget = F.coalesce(F.least(F.col("share") * F.col("total"), limit), F.lit(0.0))
    joined = joined.withColumn("budget", budget)
    epochs = F.when(F.col("have") > 0, F.least(F.floor(F.col("budget") / F.col("have") + F.lit(1e-9)), F.col("max_repeat").cast("long"))).otherwise(0)
    return joined.withColumn("epochs", epochs).withColumn("rest", F.greatest(F.lit(0.0), F.col("budget") - F.col("epochs") * F.col("have")))


CUTS = "source string, room double, cuts array<struct<room: double, key: double, doc_id: bigint, at: bigint>>"


def place(prefix: str = "") -> F.Column:
    """The place of a document in the order; equal rows differ in `at`."""
    return F.struct(*(F.col(f"{prefix}{c}") for c in ("key", "doc_id", "at")))


def is_taken() -> F.Column:
    """Is the document among those of a cut: short enough for its room, and not after its last one?"""
    cut = lambda c: (F.col("tokens") <= c["room"]) & (place() <= F.struct(c["key"].alias("key"), c["doc_id"].alias("doc_id"), c["at"].alias("at")))
    return F.exists("cuts", cut)


def next_cuts(rows: DataFrame, state: DataFrame) -> list:
    """For each source with documents that fit into its room: the last one of them, in order, within it, and their tokens."""
    fits = rows.join(F.broadcast(state), "source").where(F.col("tokens") <= F.col("room")).where(~is_taken())
    fits = fits.withColumn("bin", F.floor(F.col("key") / (1 + F.col("key")) * BINS).cast("int"))
    order = Window.partitionBy("source").orderBy("bin")
    sums = fits.groupBy("source", "bin").agg(F.sum("tokens").alias("s"), F.max(place()).alias("last"), F.first("room").alias("room"))
    sums = sums.withColumn("before", F.sum("s").over(order) - F.col("s"))  # at most BINS rows a source
    ending = sums.where(F.col("before") + F.col("s") > F.col("room"))
    whole = sums.where(F.col("before") + F.col("s") <= F.col("room")).groupBy("source").agg(F.max("last").alias("last"), F.sum("s").alias("got"))
    one = stored(ending.groupBy("source").agg(F.min("bin").alias("bin"), F.min_by("before", "bin").alias("before")))
    inside = fits.join(F.broadcast(one), ["source", "bin"])
    upto = F.sum("tokens").over(Window.partitionBy("source").orderBy("key", "doc_id", "at").rowsBetween(Window.unboundedPreceding, 0)) + F.col("before")
    some = inside.withColumn("upto", upto).where(F.col("upto") <= F.col("room")).groupBy("source").agg(F.max(place()).alias("last"), F.sum("tokens").alias("got"))
    return whole.unionByName(some).groupBy("source").agg(F.max("last").alias("last"), F.sum("got").alias("got")).collect()  # a row a target


def mix(sizes: DataFrame, targets: DataFrame, total: float | None = None, seed: int = SEED) -> DataFrame:
    """(doc_id, source, tokens, quality) and (source, target_share, max_repeat) -> (doc_id, source, tokens, copies).

    When no further document fits into a source's room, the one that comes nearest may overrun it.
    """
    spark = sizes.sparkSession
    sizes = sizes.select("doc_id", "source", "tokens", "quality")
    plan = stored(budgets(sizes, targets, total)).select("source", "max_repeat", "epochs", "rest")  # a row a target
    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    rows = sizes.join(F.broadcast(plan), "source")
    full = rows.where("epochs > 0").select("doc_id", "source", "tokens", F.col("epochs").alias("copies"))
    open_rows = rows.where("epochs < max_repeat and rest > 0").withColumn("key", -F.log(u) / F.col("quality"))
    left = stored(open_rows.select("doc_id", "source", "tokens", "key", F.monotonically_increasing_id().alias("at")))
    state = {r["source"]: [float(r["rest"]), []] for r in plan.where("rest > 0").collect()}
    table = lambda: spark.createDataFrame([(s, room, cuts) for s, (room, cuts) in state.items()], CUTS)
    while found := next_cuts(left, table()):
        for r in found:
            own = state[r["source"]]
            own[1].append((own[0], *r["last"]))
            own[0] -= r["got"]
    marked = left.join(F.broadcast(table()), "source").withColumn("taken", is_taken())
    near = marked.where("not taken").withColumn("off", F.abs(F.col("tokens") - F.col("room"))).where("off < room")
    last = near.groupBy("source").agg(F.min_by(F.struct("doc_id", "tokens"), F.struct("off", "key", "at")).alias("d"))
    for one in (marked.where("taken"), last.select("d.doc_id", "source", "d.tokens")):
        full = full.unionByName(one.select("doc_id", "source", "tokens", F.lit(1).cast("long").alias("copies")))
    return full.groupBy("doc_id", "source", "tokens").agg(F.sum("copies").alias("copies"))


def shares(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, documents, tokens, share, most_copies): what was reached."""
    got = chosen.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    rows = targets.select("source", "target_share").join(got, "source", "left").na.fill(0, ["documents", "tokens", "most_copies"])
    share = F.col("tokens") / F.sum("tokens").over(Window.partitionBy())
    return rows.withColumn("share", F.round(F.coalesce(share, F.lit(0.0)), 9))


def inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return stored(measured(table(spark, sf_dir, "documents"))), table(spark, sf_dir, "mix_targets")


def p8_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(*inputs(spark, sf_dir))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes, targets = inputs(spark, sf_dir)
    return shares(mix(sizes, targets), targets)


def p8_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selection for as many tokens as all documents have: whole epochs of sources that are small for their shares."""
    sizes, targets = inputs(spark, sf_dir)
    return mix(sizes, targets, total=float(sizes.agg(F.sum("tokens")).first()[0] or 0))


def p8_whole_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the shares p8_whole reaches: a source gives at most max_repeat times what it has."""
    return shares(p8_whole(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


QUERIES = {"p8_selection": p8_selection, "p8_shares": p8_shares, "p8_whole": p8_whole, "p8_whole_shares": p8_whole_shares}
