"""Metrics and candidate selection: chrF++, BLEU, consensus, features, rank correlation, precision and recall."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import ngrams as N
from weftline.functions import text as T
from weftline.functions.labels import labels
from weftline.functions.vectors import geometric_mean, linear_score, minus_relative_distance

FEATURES = ["consensus", "density", "lexcov", "length", "marker"]


# candidates ------------------------------------------------------------------------------------


def pools(candidates: DataFrame, key=None) -> DataFrame:
    """(pool, j, text[, src]) long -> (pool, candidates array<struct<j, text, key>>), empty ones dropped.

    key: a column function that makes what is compared of the text; where that is blank the text itself is compared.
    """
    kept = candidates.where(T.not_blank("text"))
    own = F.col("text") if key is None else F.when(T.not_blank(key("text")), key("text")).otherwise(F.col("text"))
    return kept.groupBy("pool").agg(F.array_sort(F.collect_list(F.struct(F.col("j").cast("long").alias("j"), "text", own.alias("key")))).alias("candidates"))


def long_pools(wide: DataFrame) -> DataFrame:
    """(pool, src, candidates array<string>) -> (pool, j, text, src)."""
    return wide.select("pool", "src", F.posexplode("candidates").alias("j", "text"))


def merge_pools(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two wide frames of the same pools, candidates put together; an error if pools or sources differ."""
    both = a.join(b.select("pool", F.col("src").alias("_s"), F.col("candidates").alias("_c")), "pool", "full_outer")
    bad = both.where(~F.col("src").eqNullSafe(F.col("_s"))).limit(1).count()
    if bad:
        raise ValueError("the pools differ in number or source")
    return both.select("pool", "src", F.concat("candidates", "_c").alias("candidates"))


def pair_scores(pooled: DataFrame) -> DataFrame:
    """pools() -> (pool, h, r, chrf): every ordered pair of a pool."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pool, h, r, s = [], [], [], []
            lists = batch.column(1).to_pylist()
            for p, c, m in zip(batch.column(0).to_pylist(), lists, N.pools_chrf([[x["key"] for x in c] for c in lists])):
                js = [x["j"] for x in c]
                for a in range(len(c)):
                    for b in range(len(c)):
                        if a != b:
                            pool.append(p)
                            h.append(js[a])
                            r.append(js[b])
                            s.append(float(m[a, b]))
            yield pa.RecordBatch.from_arrays([pa.array(pool, pa.int64()), pa.array(h, pa.int64()), pa.array(r, pa.int64()), pa.array(s, pa.float64())], ["pool", "h", "r", "chrf"])

    return pooled.select("pool", "candidates").mapInArrow(run, "pool long, h long, r long, chrf double")


def consensus(pooled: DataFrame) -> DataFrame:
    """pools() -> (pool, j, utility, multiplicity): expected chrF++ of the keys against the other candidates'.

    Equal candidates are scored once and weigh by their number; an equal other counts 100.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pool, j, u, n = [], [], [], []
            lists = batch.column(1).to_pylist()
            every = [list(dict.fromkeys(x["key"] for x in c)) for c in lists]
            for p, c, distinct, m in zip(batch.column(0).to_pylist(), lists, every, N.pools_chrf(every)):
                texts = [x["key"] for x in c]
                where = {t: i for i, t in enumerate(distinct)}
                at = [where[t] for t in texts]
                count = np.bincount(at, minlength=len(distinct)).astype(float)
                np.fill_diagonal(m, 100.0)
                total = m @ count - 100.0
                utility = total / max(1, len(texts) - 1)
                for x, k in zip(c, at):
                    pool.append(p)
                    j.append(x["j"])
                    u.append(round(float(utility[k]), 9))
                    n.append(int(count[k]))
            yield pa.RecordBatch.from_arrays([pa.array(pool, pa.int64()), pa.array(j, pa.int64()), pa.array(u, pa.float64()), pa.array(n, pa.int64())], ["pool", "j", "utility", "multiplicity"])

    return pooled.select("pool", "candidates").mapInArrow(run, "pool long, j long, utility double, multiplicity long")


def best_by(rows: DataFrame, group: str, order: list[Column], keep: list[str]) -> DataFrame:
    """The row of each group with the greatest order."""
    best = rows.groupBy(group).agg(F.max_by(F.struct(*keep), F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)))).alias("b"))
    return best.select(group, *(F.col(f"b.{c}").alias(c) for c in keep))


def mbr_select(pooled: DataFrame) -> DataFrame:
    """(pool, j, utility): the candidate of the greatest utility; ties by multiplicity, then the earliest."""
    return best_by(consensus(pooled), "pool", [F.col("utility"), F.col("multiplicity"), -F.col("j")], ["j", "utility"])


def features(candidates: DataFrame, known_words: DataFrame, target_density: float, target_ratio: float) -> DataFrame:
    """(pool, j, text, src) -> (pool, j, FEATURES), all better when higher.

    known_words (key): the words that the lexicon can act on.
    """
    kept = candidates.where(T.not_blank("text"))
    shared = consensus(pools(kept)).select("pool", "j", (F.col("utility") / 100).alias("consensus"))
    own = kept.select(
        "pool", F.col("j").cast("long").alias("j"),
        minus_relative_distance(T.density("text"), target_density).alias("density"),
        minus_relative_distance(F.length("text") / F.greatest(F.length("src"), F.lit(1)), target_ratio).alias("length"),
        (-T.marker_fraction("text")).alias("marker"), F.transform(T.words("text"), T.strip_key).alias("keys"),
    )
    # the features of a text travel with its words, so that only the consensus is joined
    words = own.select("pool", "j", "density", "length", "marker", F.explode("keys").alias("key"))
    hit = known_words.select("key", F.lit(1).alias("hit"))
    cover = words.join(hit, "key", "left").groupBy("pool", "j").agg((F.count("hit") / F.count("*")).alias("lexcov"), *(F.first(c).alias(c) for c in ("density", "length", "marker")))
    rows = cover.join(shared, ["pool", "j"])
    return rows.select("pool", "j", *(F.round(F.col(c), 6).alias(c) for c in FEATURES))


def rerank(featured: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(pool, j, score): the greatest weighted sum of features; ties to the lowest j."""
    missing = [f for f, w in weights.items() if w and f not in featured.columns]
    if missing:
        raise ValueError(f"no feature {missing[0]}")
    scored = featured.withColumn("score", F.round(linear_score(weights), 9))
    return best_by(scored, "pool", [F.col("score"), -F.col("j")], ["j", "score"])


#: Sums of a corpus: match, hypothesis and reference for each order of chrF++; lengths, match and total of BLEU.
CHRF_SUMS, BLEU_SUMS = 3 * (N.CHAR_ORDER + N.WORD_ORDER), 10


def candidate_statistics(candidates: DataFrame, refs: DataFrame) -> DataFrame:
    """(pool, j, text) and (pool, ref) -> (pool, j, chrf, sums): each candidate against its pool's reference.

    chrf is that of the candidate alone, sums what it adds to the statistics of a corpus.
    """

    @F.arrow_udf("struct<chrf: double, sums: array<long>>")
    def run(hyp: pa.Array, ref: pa.Array) -> pa.Array:
        h, r = ([x or "" for x in c.to_pylist()] for c in (hyp, ref))
        c, b = N.chrf_pairs(h, r), N.bleu_pairs(h, r)
        sums = np.concatenate([c, b], axis=1)
        one = N.f_score(c[:, 0::3], c[:, 1::3], c[:, 2::3])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(h) + 1) * sums.shape[1], pa.int32()), pa.array(sums.ravel()))
        return pa.StructArray.from_arrays([pa.array(one), lists], ["chrf", "sums"])

    joined = candidates.where(T.not_blank("text")).join(refs.select("pool", "ref"), "pool").withColumn("x", run("text", "ref"))
    return joined.select("pool", F.col("j").cast("long").alias("j"), F.round("x.chrf", 9).alias("chrf"), "x.sums")


def corpus_geo(sums: np.ndarray) -> np.ndarray:
    """Geometric mean of BLEU and chrF++ of corpora, from the sums of their lines in the last axis."""
    c, b = sums[..., :CHRF_SUMS].astype(float), sums[..., CHRF_SUMS:].astype(float)
    chrf = N.f_score(c[..., 0::3], c[..., 1::3], c[..., 2::3])
    return np.sqrt(np.maximum(chrf * N.bleu_score(b), 0))


class Weighted:
    """Pools with features and statistics, kept; scores of many weightings in one pass over them."""

    def __init__(self, featured: DataFrame, statistics: DataFrame, names: list[str] = FEATURES) -> None:
        self.names = names
        columns = F.struct("j", F.array(*(F.col(c).cast("double") for c in names)).alias("x"), "sums")
        self.pools = featured.join(statistics, ["pool", "j"]).groupBy("pool").agg(F.array_sort(F.collect_list(columns)).alias("c")).persist()

    def geo(self, weights: list[dict[str, float]], where: Column | None = None) -> np.ndarray:
        """The corpus score of the winners of each weighting; ties go to the lowest j. where: of some pools only."""
        w = np.array([[one.get(f, 0.0) for f in self.names] for one in weights])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(w), CHRF_SUMS + BLEU_SUMS), np.int64)
            for batch in batches:
                for c in batch.column(0).to_pylist():
                    won = np.round(np.array([x["x"] for x in c]) @ w.T, 9).argmax(0)
                    total += np.array([x["sums"] for x in c], np.int64)[won]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(w))), pa.array(total.tolist(), pa.list_(pa.int64()))], ["k", "sums"])

        rows = self.pools if where is None else self.pools.where(where)
        out = np.zeros((len(w), CHRF_SUMS + BLEU_SUMS), np.int64)
        for r in rows.select("c").mapInArrow(run, "k long, sums array<long>").collect():  # a row a task and weighting
            out[r["k"]] += np.array(r["sums"], np.int64)
        return corpus_geo(out)

    def release(self) -> None:
        self.pools.unpersist()


def tune(pools: Weighted, free: list[str] = FEATURES, where: Column | None = None, draws: int = 300, starts: int = 5, passes: int = 4, span: float = 4.0, grid: int = 17, seed: int = 0) -> tuple[dict[str, float], float, int]:
    """(weights, corpus score, weightings tried): a search from several starts, one coordinate at a time.

    Starts are none, each feature alone, and draws between -span and span. From the best `starts` each weight in turn goes
    over a grid, then over halves and quarters of its step, until a pass helps none. All weightings of a step
    are scored in one pass over the data.
    """
    rng = np.random.default_rng(seed)
    tried = 0

    def scored(ways: list[dict[str, float]]) -> np.ndarray:
        nonlocal tried
        tried += len(ways)
        return pools.geo(ways, where)

    none = dict.fromkeys(FEATURES, 0.0)
    first = [none, *(none | {f: 1.0} for f in free)]
    first += [none | {f: round(float(x), 3) for f, x in zip(free, row)} for row in rng.uniform(-span, span, (draws, len(free)))]
    value = scored(first)
    order = np.argsort(-value, kind="stable")[:starts]
    now, best, open_ = [first[k] for k in order], value[order].copy(), np.ones(len(order), bool)
    step = 2 * span / (grid - 1)
    for _ in range(passes):
        helped = np.zeros(len(now), bool)
        for moves in ([round(-span + k * step, 4) for k in range(grid)], None):
            for f in free:
                ways, owner = [], []
                for k in np.flatnonzero(open_):
                    to = moves if moves is not None else [round(now[k][f] + d * step, 4) for d in (-0.5, 0.5, -0.25, 0.25)]
                    ways += [now[k] | {f: x} for x in to if x != now[k][f]]
                    owner += [k] * (len(ways) - len(owner))
                if not ways:
                    continue
                got = scored(ways)
                for k in set(owner):
                    mine = [i for i, o in enumerate(owner) if o == k]
                    top = max(mine, key=lambda i: got[i])
                    if got[top] > best[k] + 1e-9:
                        best[k], now[k], helped[k] = got[top], ways[top], True
        open_ &= helped
        if not open_.any():
            break
    top = int(np.argmax(best))
    return now[top], float(best[top]), tried


def tuning_report(candidates: DataFrame, refs: DataFrame, featured: DataFrame, tuned: Column, **options) -> list[dict]:
    """Corpus scores of the first candidates, of consensus, each feature alone, the best possible, a fit, and fits without each feature.

    tuned: a condition on pool; the fit sees only these pools, held is the score of the others. The fast sums must agree
    with corpus_scores within 0.01 on the first candidates.
    """
    stats = candidate_statistics(candidates, refs)
    pools = Weighted(featured.join(stats.select("pool", "j", F.col("chrf").alias("truth")), ["pool", "j"]), stats.select("pool", "j", "sums"), [*FEATURES, "truth"])
    try:
        none = dict.fromkeys(FEATURES, 0.0)
        first = best_by(candidates.where(T.not_blank("text")).withColumn("j", F.col("j").cast("long")), "pool", [-F.col("j")], ["text"]).join(refs, "pool")
        slow = corpus_scores(first, "text", "ref").first()["geo"] or 0.0
        fast = float(pools.geo([none])[0])
        if abs(fast - slow) > 0.01:
            raise AssertionError(f"scores of the first candidates differ: {fast} and {slow}")
        fit, _, tried = tune(pools, where=tuned, **options)
        rows = [("first", none, 1), ("consensus", none | {"consensus": 1.0}, 1), ("best", none | {"truth": 1.0}, 1), *((f"only_{f}", none | {f: 1.0}, 1) for f in FEATURES), ("fit", fit, tried)]
        for f in FEATURES:
            w, _, n = tune(pools, [x for x in FEATURES if x != f], tuned, **options)
            rows.append((f"without_{f}", w, n))
        ways = [w for _, w, _ in rows]
        parts = {"tuned": pools.geo(ways, tuned), "held": pools.geo(ways, ~tuned), "all": pools.geo(ways)}
        return [{"name": name, "weights": w, "tried": n} | {k: round(float(v[i]), 6) for k, v in parts.items()} for i, (name, w, n) in enumerate(rows)]
    finally:
        pools.release()


def mean_spearman(rows: DataFrame, group: str, xs: list[str], y: str) -> DataFrame:
    """(feature, rho): mean over groups of the rank correlation with y; ties share ranks, no variance counts 0."""
    long = rows.select(group, F.col(y).alias("y"), F.explode(F.array(*(F.struct(F.lit(x).alias("feature"), F.col(x).cast("double").alias("x")) for x in xs))).alias("f")).select(group, "y", "f.*")
    g = ["feature", group]
    for c in ("x", "y"):
        rank = F.rank().over(Window.partitionBy(*g).orderBy(c)) + (F.count("*").over(Window.partitionBy(*g, c)) - 1) / 2.0
        long = long.withColumn(f"r{c}", rank)
    n, sx, sy = F.count("*"), F.sum("rx"), F.sum("ry")
    cov = n * F.sum(F.col("rx") * F.col("ry")) - sx * sy
    vx, vy = n * F.sum(F.col("rx") * F.col("rx")) - sx * sx, n * F.sum(F.col("ry") * F.col("ry")) - sy * sy
    rho = F.when((vx > 0) & (vy > 0), cov / F.sqrt(F.greatest(vx * vy, F.lit(1e-12)))).otherwise(0.0)
    per = long.groupBy(*g).agg(F.round(rho, 9).alias("rho"))
    return per.groupBy("feature").agg(F.round(F.avg("rho"), 6).alias("rho"))


# corpus metrics ---------------------------------------------------------------------------------


def _statistics(kind: str):
    @F.arrow_udf("array<long>")
    def run(hyp: pa.Array, ref: pa.Array) -> pa.Array:
        h, r = ([x or "" for x in c.to_pylist()] for c in (hyp, ref))
        sums = N.chrf_pairs(h, r) if kind == "chrf" else N.bleu_pairs(h, r)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(h) + 1) * sums.shape[1], pa.int32()), pa.array(sums.ravel()))

    return run, CHRF_SUMS if kind == "chrf" else BLEU_SUMS


def corpus_scores(pairs: DataFrame, hyp: str = "hyp", ref: str = "ref") -> DataFrame:
    """(lines, bleu, chrf, geo, mean_chars, ratio) of a corpus: statistics are summed, then scored."""
    chrf, n = _statistics("chrf")
    bleu, m = _statistics("bleu")
    rows = pairs.select(hyp, ref, chrf(hyp, ref).alias("c"), bleu(hyp, ref).alias("b"))
    sums = rows.agg(
        F.count("*").alias("lines"), F.avg(F.length(hyp)).alias("mean_chars"), F.sum(F.length(hyp)).alias("h"), F.sum(F.length(ref)).alias("r"),
        *(F.sum(F.col("c")[i]).alias(f"c{i}") for i in range(n)), *(F.sum(F.col("b")[i]).alias(f"b{i}") for i in range(m)),
    )
    p, r, k = F.lit(0.0), F.lit(0.0), F.lit(0)
    for i in range(0, n, 3):
        have = (F.col(f"c{i + 1}") > 0) & (F.col(f"c{i + 2}") > 0)
        p = p + F.when(have, F.col(f"c{i}") / F.greatest(F.col(f"c{i + 1}"), F.lit(1))).otherwise(0.0)
        r = r + F.when(have, F.col(f"c{i}") / F.greatest(F.col(f"c{i + 2}"), F.lit(1))).otherwise(0.0)
        k = k + have.cast("int")
    p, r = p / F.greatest(k, F.lit(1)), r / F.greatest(k, F.lit(1))
    b = N.BETA**2
    chrf_score = F.when(b * p + r > 0, 100 * (1 + b) * p * r / F.greatest(b * p + r, F.lit(1e-300))).otherwise(0.0)
    log_sum, none, smooth = F.lit(0.0), F.lit(False), F.lit(1.0)
    for i in range(2, m, 2):  # an order without a match counts 1 / (2^k total), k of them so far
        match, total = F.col(f"b{i}"), F.col(f"b{i + 1}")
        none = none | (total == 0)
        smooth = F.when(match == 0, smooth * 2).otherwise(smooth)
        log_sum = log_sum + F.log(F.when(match == 0, 1.0 / (smooth * F.greatest(total, F.lit(1)))).otherwise(match / F.greatest(total, F.lit(1))))
    short = F.when(F.col("b0") < F.col("b1"), F.exp(1 - F.col("b1") / F.greatest(F.col("b0"), F.lit(1)))).otherwise(1.0)
    bleu_score = F.when(none | (F.col("b0") == 0) | (F.col("b2") == 0), 0.0).otherwise(100 * short * F.exp(log_sum / 4))
    out = sums.withColumn("bleu", bleu_score).withColumn("chrf", chrf_score)
    ratio = F.col("h") / F.greatest(F.col("r"), F.lit(1))
    return out.select(
        "lines", F.round("bleu", 6).alias("bleu"), F.round("chrf", 6).alias("chrf"), F.round(geometric_mean("bleu", "chrf"), 6).alias("geo"),
        F.round("mean_chars", 6).alias("mean_chars"), F.round(ratio, 6).alias("ratio"),
    )


def _prf(rows: DataFrame, by: list[str]) -> DataFrame:
    p = F.when(F.col("pred") > 0, F.col("hit") * 100.0 / F.col("pred")).otherwise(0.0)
    r = F.when(F.col("gold") > 0, F.col("hit") * 100.0 / F.col("gold")).otherwise(0.0)
    out = rows.withColumn("p", p).withColumn("r", r).withColumn("f1", F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0))
    return out.select(*by, "gold", "pred", "hit", *(F.bround(F.round(c, 9), 2).alias(c) for c in ("p", "r", "f1")))


def mark_scores(pairs: DataFrame, gold: str = "gold", pred: str = "pred", side: Column | None = None) -> DataFrame:
    """(side, mark, gold, pred, hit, p, r, f1) for each mark and MICRO; pairs whose bases differ are left out.

    side: a column over the rows, such as whether a word is known to a lexicon.
    """
    same = pairs.where(alignable(gold, pred)).select((side if side is not None else F.lit("all")).alias("side"), F.arrays_zip(labels(gold).alias("g"), labels(pred).alias("p")).alias("z"))
    marks = same.select("side", F.explode("z").alias("z")).select("side", "z.g", "z.p").where("g > 0 or p > 0")
    names = ["none", *T.MARK_NAMES]
    long = marks.select("side", F.explode(F.array_distinct(F.array("g", "p"))).alias("m"), "g", "p").where("m > 0")
    n = lambda c: F.sum(c.cast("long"))
    counted = long.groupBy("side", "m").agg(n(F.col("g") == F.col("m")).alias("gold"), n(F.col("p") == F.col("m")).alias("pred"), n((F.col("g") == F.col("m")) & (F.col("p") == F.col("m"))).alias("hit"))
    named = counted.withColumn("mark", F.element_at(F.array(*(F.lit(x) for x in names)), F.col("m") + 1))
    micro = named.groupBy("side").agg(*(F.sum(c).alias(c) for c in ("gold", "pred", "hit"))).withColumn("mark", F.lit("MICRO"))
    return _prf(named.select("side", "mark", "gold", "pred", "hit").unionByName(micro), ["side", "mark"])


def alignable(gold: str = "gold", pred: str = "pred") -> Column:
    """Do the texts differ in restorable marks only?"""
    return F.coalesce(T.strip_key(gold) == T.strip_key(pred), F.lit(False))


def unalignable(pairs: DataFrame, gold: str = "gold", pred: str = "pred", side: Column | None = None) -> DataFrame:
    """(side, pairs, left_out): the pairs of mark_scores, and those that it leaves out as their bases differ."""
    rows = pairs.select((side if side is not None else F.lit("all")).alias("side"), alignable(gold, pred).alias("same"))
    return rows.groupBy("side").agg(F.count("*").alias("pairs"), F.sum((~F.col("same")).cast("long")).alias("left_out"))


def line_accuracy(pairs: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    return pairs.agg(F.round(F.avg((F.col(gold) == F.col(pred)).cast("double")), 6).alias("accuracy"))


def winner_report(winners: DataFrame) -> DataFrame:
    """(pools, agreement, mean_place): winners (pool, j), the share that chose candidate 0, the mean place of the winner."""
    return winners.agg(F.count("*").alias("pools"), F.round(F.avg((F.col("j") == 0).cast("double")), 6).alias("agreement"), F.round(F.avg("j"), 6).alias("mean_place"))


def winner_counts(winners: DataFrame) -> DataFrame:
    """(j, n): how often each place won."""
    return winners.groupBy("j").agg(F.count("*").alias("n"))


def against_reference(candidates: DataFrame, refs: DataFrame) -> DataFrame:
    """(pool, j, text) and (pool, ref) -> (pool, j, chrf) of every candidate against its pool's reference."""

    @F.pandas_udf("double")
    def score(hyp: pd.Series, ref: pd.Series) -> pd.Series:
        return pd.Series([float(m[0, 1]) for m in N.pools_chrf([[h or "", r or ""] for h, r in zip(hyp, ref)])], dtype="float64")

    joined = candidates.where(T.not_blank("text")).join(refs.select("pool", "ref"), "pool")
    return joined.select("pool", F.col("j").cast("long").alias("j"), F.round(score("text", "ref"), 9).alias("chrf"))


def oracle_select(candidates: DataFrame, refs: DataFrame) -> DataFrame:
    """The candidate nearest the reference; ties to the lowest j. What a perfect selector would reach."""
    return best_by(against_reference(candidates, refs), "pool", [F.col("chrf"), -F.col("j")], ["j", "chrf"])


def mean_ratio(pairs: DataFrame, src: str, tgt: str) -> DataFrame:
    """(mean_ratio): the mean over rows of target by source length, not the ratio of sums."""
    return pairs.agg(F.round(F.avg(F.length(tgt) / F.greatest(F.length(src), F.lit(1))), 6).alias("mean_ratio"))
