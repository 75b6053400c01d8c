"""The curation pipelines as compositions of operators: clean, hold out, check leakage, split, select."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import dedup, filters, leakage, report, sampling, selection


@dataclass(frozen=True)
class CleanConfig:
    words: tuple[int, int] = (1, 200)
    ratio: tuple[float, float] = (0.5, 2.0)
    arabic: float = 0.80
    devanagari: float = 0.10
    score: float = 0.80
    provenance: tuple[str, ...] = ()


def load_and_clean(pairs: DataFrame, cfg: CleanConfig = CleanConfig()) -> DataFrame:
    """Cheap filters first: provenance, empties, exact duplicates, lengths, script, score."""
    df = filters.provenance(pairs, *cfg.provenance) if cfg.provenance else pairs
    df = dedup.exact_pairs(filters.nonempty(df, "src", "tgt"))
    df = df.where(filters.length_ok("src", "tgt", cfg.words, cfg.ratio))
    df = df.where(filters.script_reason("tgt", cfg.devanagari, cfg.arabic).isNull())
    return df.where(filters.score_ok("labse", cfg.score)) if "labse" in df.columns else df


def without_leaks(pairs: DataFrame, lines: DataFrame, least: float = 0.8) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clean, leaked, report) of pairs (row_id, src, tgt) against held-out lines (item_id, side, line)."""
    reasons = leakage.leak_reasons(leakage.side_rows(pairs, "src", "tgt"), lines, least)
    clean, leaked = leakage.split_leaked(pairs, reasons)
    return clean, leaked, leakage.leak_report(reasons)


@dataclass(frozen=True)
class HoldOutConfig:
    total: int = 2000
    longest: int = 60
    # fixed values: the configurations in their order of preference
    preferred: str = "bpcc-seed-latest"
    others: tuple[str, ...] = ("bpcc-seed-v1", "bpcc-seed-v2", "nllb-seed", "daily")
    share: float = 0.4
    seed: str = "0"


def hold_out(pairs: DataFrame, like: DataFrame, line: str, cfg: HoldOutConfig = HoldOutConfig()) -> DataFrame:
    """Pairs chosen to have the lengths of the lines they should be like; hand tells the two halves. Too few is an error."""
    needs = sampling.apportion(report.length_histogram(like, line, cfg.longest), cfg.total)
    rows = pairs.withColumn("n", T.n_words("src"))
    filled = sampling.stratified_fill(rows, needs, cfg.preferred, list(cfg.others), cfg.share, cfg.total, cfg.seed)
    dealt = sampling.deal(filled, cfg.seed)
    if not dealt.limit(1).count():
        raise ValueError("no rows to hold out")
    return dealt


def build_corpus(pairs: DataFrame, held: DataFrame, lines: DataFrame, dev_share: float = 0.02, seed: str = "0") -> dict[str, DataFrame]:
    """Clean pairs less the held-out ones and what leaked, split by hash into dev and train."""
    rest = leakage.drop_heldout(pairs, held, ["src", "tgt"], expect_all=True)
    clean, leaked, _ = without_leaks(rest, lines)
    parts = sampling.split(clean, dev_share, seed)
    return {"dev": parts.where("part = 1").drop("part"), "train": parts.where("part = 2").drop("part"), "leaked": leaked}


def select_like(vectors: DataFrame, queries: DataFrame, cap: int, n: int, share: float, most: int, control: bool = False) -> tuple[DataFrame, int]:
    """The n vectors nearest the queries (or, as a control, any n), and how often to repeat them to make up the share."""
    pool = vectors.join(queries.select("vec_id"), "vec_id", "left_anti")
    chosen = sampling.sample(pool, n, "control", "vec_id") if control else selection.capped(selection.nearest(pool, queries), cap, n)
    ids = chosen.select("vec_id")
    rest = pool.join(ids, "vec_id", "left_anti").count()
    return ids, sampling.repeat_factor(ids.count(), rest, share, most)


@dataclass
class Checks:
    """Named conditions asserted at the end of a pipeline."""

    failed: list[str] = field(default_factory=list)

    def equal(self, name: str, a: int, b: int) -> None:
        if a != b:
            self.failed.append(f"{name}: {a} and {b}")

    def done(self) -> None:
        if self.failed:
            raise AssertionError("; ".join(self.failed))


def stage_counts(df: DataFrame) -> DataFrame:
    return filters.stage_report(filters.waterfall(df)).orderBy("stage_no")


def score_report(pairs: DataFrame, hyp: str = "hyp", ref: str = "ref") -> DataFrame:
    from weftline.operators.scoring import corpus_scores

    n = pairs.where(F.col(hyp).isNull() | F.col(ref).isNull()).limit(1).count()
    if n:
        raise ValueError("hypotheses and references differ in number")
    return corpus_scores(pairs, hyp, ref)


def evaluate_restoration(gold: DataFrame, load, biases: list[float], text: str = "text") -> DataFrame:
    """(bias, side, mark, gold, pred, hit, p, r, f1, density_gold, density_pred) of a tagger for each bias.

    Marks are stripped, restored and compared; each density is over its own text's length.
    """
    from weftline.operators import models, scoring

    out = None
    for bias in biases:
        pairs = models.tag(gold.select(F.col(text).alias("gold")), load, "gold", none_bias=bias).withColumnRenamed("restored", "pred")
        density = lambda c: F.sum(T.mark_count(c)) * 100.0 / F.greatest(F.sum(F.length(c)), F.lit(1))
        both = pairs.agg(F.round(density("gold"), 6).alias("density_gold"), F.round(density("pred"), 6).alias("density_pred"))
        one = scoring.mark_scores(pairs).crossJoin(F.broadcast(both)).withColumn("bias", F.lit(float(bias)))  # one row
        out = one if out is None else out.unionByName(one)
    return out


def guarded_restoration(texts: DataFrame, restore, text: str = "text") -> DataFrame:
    """restore(texts), once it is seen to raise the density of marks."""
    out = restore(texts)
    sums = lambda df: df.agg((F.sum(T.mark_count(text)) * 100.0 / F.greatest(F.sum(F.length(text)), F.lit(1))).alias("d")).first()["d"] or 0.0
    report.no_op_guard(sums(texts), sums(out))
    return out
