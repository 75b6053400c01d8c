"""The catalogue of registered queries: each takes (spark, sf_dir) and runs over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import labels as L
from weftline.functions import text as T
from weftline.operators import align, dedup, filters, leakage, lexicon, models, ranking, report, sampling, scoring, selection
from weftline.plans import pipelines
from weftline.plans.file_queries import FILE_QUERIES
from weftline.sources import readers


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return readers.table(spark, sf_dir, name)


def raw(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "raw_pairs")


def pool(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "pool_pairs")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survivors of the curation waterfall that no held-out line leaked into, by config."""
    kept = filters.waterfall(raw(spark, sf_dir)).where("reason is null")
    reasons = leakage.leak_reasons(leakage.side_rows(kept, "src", "tgt"), t(spark, sf_dir, "dev_lines"))
    return report.group_counts(kept.join(reasons.select("row_id").distinct(), "row_id", "left_anti"), "config")


# filters and profiles ---------------------------------------------------------------------------


def q01(spark, d):
    df = filters.nonempty(raw(spark, d), "src", "tgt")
    return df.select("row_id", F.length("src").cast("long").alias("n_src"), F.length("tgt").cast("long").alias("n_tgt"), F.md5("tgt").alias("tgt_md5"))


def q02(spark, d):
    df = filters.nonempty(raw(spark, d).select("row_id", "src", "tgt"), "src", "tgt")
    return dedup.exact_pairs(df, copies="copies", columns=["row_id"])


def q03(spark, d):
    df = filters.nonempty(raw(spark, d), "src", "tgt")
    ratio = F.length("tgt") / F.greatest(F.length("src"), F.lit(1))
    return df.select("row_id", T.n_words("src").alias("words"), F.round(ratio, 6).alias("ratio"), filters.length_ok("src", "tgt", (8, 30), (0.5, 1.1)).alias("keep"))


def q04(spark, d):
    return raw(spark, d).select("row_id", T.script_counts("tgt").alias("p")).select("row_id", "p.*")


def q05(spark, d):
    df = filters.nonempty(raw(spark, d), "tgt")
    return df.groupBy(F.coalesce(filters.script_reason("tgt"), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def q06(spark, d):
    return filters.count_report(filters.reason_counts(raw(spark, d).select("src", "tgt")))


def q07(spark, d):
    return report.group_counts(raw(spark, d), "config", "provenance")


def q08(spark, d):
    return report.profile(filters.nonempty(raw(spark, d), "src", "tgt"), "src", "tgt", "config")


def q09(spark, d):
    return report.describe(filters.nonempty(pool(spark, d), "s", "t"), "s", "t", "split_name", 12)


def q10(spark, d):
    df = raw(spark, d)
    q = ranking.quantiles(df, "labse", [0.05, 0.25, 0.5, 0.75, 0.95])
    mean = df.agg(F.round(F.avg("labse"), 6).alias("mean"), F.round(F.percentile("labse", F.lit(0.5)), 6).alias("median"))
    return q.crossJoin(F.broadcast(mean))  # one row each


def q11(spark, d):
    return report.length_histogram(t(spark, d, "dev_lines").where("side = 'eng_Latn'"), "line", 60)


def q12(spark, d):
    df = filters.nonempty(pool(spark, d).select("row_id", "s", "t"), "s", "t")
    return dedup.stripped_targets(df, copies="copies", columns=["row_id"])


def q13(spark, d):
    lines = t(spark, d, "dev_lines").select(F.col("item_id").alias("row_id"), T.clean("line").alias("text"), F.lit("held").alias("source"))
    first = raw(spark, d).select("row_id", T.clean("tgt").alias("text"), F.lit("raw").alias("source"))
    second = pool(spark, d).select("row_id", T.clean("t").alias("text"), F.lit("pool").alias("source"))
    return dedup.across_sources([lines, first, second], columns=["source", "row_id"])


def q14(spark, d):
    return report.orthography(pool(spark, d), "t", "t_lang")


def q14_top(spark, d):
    return report.top_marks(pool(spark, d), "t", "t_lang")


def q14_verdict(spark, d):
    rows = report.orthography(raw(spark, d), "tgt", "config").select(F.col("config").alias("k"), F.col("marks_per_100").alias("hm"), F.col("pct_target_punct").alias("hp"))
    ref = rows.where("k = 'bpcc-seed-v1'").select(F.col("hm").alias("rm"), F.col("hp").alias("rp"))
    one = rows.crossJoin(F.broadcast(ref))  # one reference row
    return one.select(F.col("k").alias("config"), report.verdict(F.col("rm"), F.col("hm"), F.col("rp"), F.col("hp")).alias("v")).select("config", "v.*")


def q50(spark, d):
    shares = [F.round(T.arabic_share("tgt", v), 6).alias(v) for v in ("basic", "wide", "all")]
    return raw(spark, d).select("row_id", *shares, T.has_devanagari("tgt").alias("devanagari"))


def q51(spark, d):
    df = filters.language_is(filters.provenance(raw(spark, d), "human", "mined"), src_lang="eng_Latn", tgt_lang="kas_Arab")
    return df.where(filters.score_ok("labse", 0.8)).groupBy("provenance").agg(F.count("*").alias("n"), F.count("labse").alias("scored"))


def q52(spark, d):
    df = t(spark, d, "documents").where("text is not null")
    return df.groupBy(F.coalesce(filters.text_reason("text", 80, 0.8, 5), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


# leakage ----------------------------------------------------------------------------------------


def _leaks(spark, d):
    rows = leakage.side_rows(pool(spark, d).where("split_name = 'train'"), "s", "t")
    return rows, t(spark, d, "dev_lines")


def q15(spark, d):
    return leakage.by_key(*_leaks(spark, d), T.clean, "exact").select("row_id", "side", "item_id")


def q16(spark, d):
    rows, lines = _leaks(spark, d)
    exact = leakage.by_key(rows, lines, T.clean, "exact")
    loose = leakage.by_key(rows.join(exact, ["row_id", "side"], "left_anti"), lines, T.loose_key, "loose")
    return exact.unionByName(loose).select("row_id", "side", "kind", "item_id")


def q17(spark, d):
    found = leakage.near(*_leaks(spark, d), least=0.6)
    return found.select("row_id", "side", F.round("score", 6).alias("score"), "item_id")


def q18(spark, d):
    return leakage.leak_report(leakage.leak_reasons(*_leaks(spark, d), least=0.6))


def q53(spark, d):
    return leakage.overlap_count(raw(spark, d), pool(spark, d), "src", "s")


# sampling ---------------------------------------------------------------------------------------

# fixed values: the configurations in their order of preference
CONFIGS = ["bpcc-seed-v1", "bpcc-seed-v2", "nllb-seed", "daily"]
PREFERRED, TOTAL = "bpcc-seed-latest", 300


def _strata(spark, d):
    df = filters.nonempty(pool(spark, d).where("split_name = 'train'").select("row_id", "s", "t", "config"), "s", "t")
    return df.withColumn("n", T.n_words("s"))


def _needs(spark, d):
    return sampling.apportion(report.length_histogram(_strata(spark, d), "s", 40), TOTAL)


def q19(spark, d):
    return _needs(spark, d)


def q20(spark, d):
    return sampling.stratified_fill(_strata(spark, d), _needs(spark, d), PREFERRED, CONFIGS, 0.4, TOTAL).select("row_id", "n", "config", F.col("phase").cast("long").alias("phase"))


def q21(spark, d):
    return sampling.deal(sampling.stratified_fill(_strata(spark, d), _needs(spark, d), PREFERRED, CONFIGS, 0.4, TOTAL)).select("row_id", "n", "hand")


def q22(spark, d):
    return sampling.split(pool(spark, d).select("row_id"), 0.8, "7").select("row_id", F.col("part").cast("long").alias("part"))


def q23(spark, d):
    rows = filters.nonempty(pool(spark, d).select("row_id", "split_name", "s", "t"), "s", "t")
    held = rows.where("split_name <> 'train'")
    first = dedup.exact_pairs(rows, "s", "t")  # else a pair that stands several times would go several times
    return leakage.drop_heldout(first, held, ["s", "t"], expect_all=True).groupBy("split_name").agg(F.count("*").alias("n"))


def q54(spark, d):
    df = pool(spark, d).select("row_id", F.when(F.col("split_name") == "train", "rest").otherwise("selected").alias("k"))
    counts = {r["k"]: r["n"] for r in df.groupBy("k").agg(F.count("*").alias("n")).collect()}  # two rows
    times = sampling.repeat_factor(counts.get("selected", 0), counts.get("rest", 0), 0.3, 7)
    return sampling.upweighted(df.where("k = 'rest'"), df.where("k = 'selected'"), times).groupBy("k").agg(F.count("*").alias("n"))


# selection by embeddings -------------------------------------------------------------------------


def _knn(spark, d):
    """All vectors against the query set, the vectors with an id divisible by 100."""
    e = t(spark, d, "embeddings")
    return selection.nearest(e, e.where("vec_id % 100 = 0"), other=True)


def q24(spark, d):
    return _knn(spark, d)


def q25(spark, d):
    return selection.capped(_knn(spark, d), 3, 100)


def q26(spark, d):
    e = t(spark, d, "embeddings").select("vec_id")
    chosen = selection.capped(_knn(spark, d), 3, 100).select("vec_id")
    rest = e.join(chosen, "vec_id", "left_anti")
    times = sampling.repeat_factor(chosen.count(), rest.count(), 0.6, 7)
    return sampling.upweighted(rest, chosen, times).groupBy("vec_id").agg(F.count("*").alias("copies"))


def q27(spark, d):
    return sampling.sample(t(spark, d, "embeddings").select("vec_id"), 100, "control", "vec_id")


# lexicons ---------------------------------------------------------------------------------------


def _targets(spark, d):
    return raw(spark, d).where((F.col("tgt_lang") == "kas_Arab") & T.has_text("tgt")).select("row_id", T.flatten("tgt").alias("text"))


def _unseen(spark, d):
    return pool(spark, d).where("split_name <> 'train'").select("row_id", T.clean("t").alias("text"))


def q28(spark, d):
    return lexicon.build(_targets(spark, d)).unigram


def q29(spark, d):
    return lexicon.build(_targets(spark, d), context=("left",)).left.select("prev", "key", "form", "n", "total")


def q30(spark, d):
    b = lexicon.build(_targets(spark, d), context=("both", "left", "right"))
    one = lambda df, p, n: df.select((F.col("prev") if p else F.lit("*")).alias("prev"), "key", (F.col("next") if n else F.lit("*")).alias("next"), "form", "n", "total")
    return one(b.both, 1, 1).unionByName(one(b.left, 1, 0)).unionByName(one(b.right, 0, 1))


def _lexicon(spark, d):
    return lexicon.build(_targets(spark, d), context=("both", "left", "right"))


def q31(spark, d):
    out = lexicon.restored(_unseen(spark, d), _lexicon(spark, d))
    return out.select("row_id", F.md5("text").alias("text_md5"))


def q32(spark, d):
    return lexicon.coverage(lexicon.looked_up(lexicon.word_rows(_unseen(spark, d)), _lexicon(spark, d)))


def q33(spark, d):
    """A unigram lexicon merged with a lexicon with contexts in the model's place."""
    words = lexicon.word_rows(_unseen(spark, d))
    rich = _lexicon(spark, d)
    model = lexicon.looked_up(words, rich).select("row_id", "pos", F.coalesce("found", "key").alias("model"))
    plain = lexicon.looked_up(words, lexicon.Lexicon(rich.unigram)).join(model, ["row_id", "pos"])
    out = None
    for mode in ("known", "changed"):
        one = lexicon.joined(plain, lexicon.merged(plain, "model", mode)).select("row_id", F.lit(mode).alias("mode"), F.md5("text").alias("text_md5"))
        out = one if out is None else out.unionByName(one)
    return out


def q45(spark, d):
    rows = lexicon.word_rows(_targets(spark, d))
    per = rows.groupBy("key", "prev", "next").agg(F.count("*").alias("c"))
    edge = lambda c, mark: F.sum(F.when(F.col(c) == mark, F.col("c")).otherwise(0))
    return per.groupBy("key").agg(F.count("*").alias("contexts"), F.sum("c").alias("n"), edge("prev", "<s>").alias("first"), edge("next", "</s>").alias("last"))


# scoring ----------------------------------------------------------------------------------------

POOL = 8


def _candidates(spark, d):
    """Pools of the targets of eight neighbouring rows, a stand-in for sampled candidates."""
    df = raw(spark, d).where(T.has_text("tgt")).select(F.floor((F.col("row_id") - 1) / POOL).alias("pool"), (F.col("row_id") - 1).alias("i"), T.clean("tgt").alias("text"), T.clean("src").alias("src"))
    return df.select("pool", (F.col("i") - F.col("pool") * POOL).alias("j"), "text", "src")


def _run_of(n):
    return lambda i: F.substr("s", i, F.lit(n))


def q34(spark, d):
    w = T.words("text")
    df = _candidates(spark, d).select("pool", "j", F.replace("text", F.lit(" "), F.lit("")).alias("s"), w.alias("w"))
    out = []
    for n in range(1, 7):
        g = F.transform(F.sequence(F.lit(1), F.greatest(F.length("s") - (n - 1), F.lit(1))), _run_of(n))
        out.append(F.struct(F.lit(n).cast("long").alias("ord"), F.when(F.length("s") >= n, F.size(g)).otherwise(0).cast("long").alias("total"), F.when(F.length("s") >= n, F.size(F.array_distinct(g))).otherwise(0).cast("long").alias("distinct_grams")))
    return df.select("pool", "j", F.explode(F.array(*out)).alias("x")).select("pool", "j", "x.*")


def q35(spark, d):
    return scoring.pair_scores(scoring.pools(_candidates(spark, d))).select("pool", "h", "r", F.round("chrf", 6).alias("chrf"))


def q36(spark, d):
    return scoring.mbr_select(scoring.pools(_candidates(spark, d))).select("pool", "j", F.round("utility", 6).alias("utility"))


WEIGHTS = {"consensus": 1.0, "density": 0.2, "lexcov": 0.3, "length": 0.5, "marker": 0.4}


def _features(spark, d):
    return scoring.features(_candidates(spark, d), q28(spark, d), 18.0, 1.0)


def q37(spark, d):
    return scoring.rerank(_features(spark, d), WEIGHTS).select("pool", "j", F.round("score", 4).alias("score"))


def q38(spark, d):
    f = _features(spark, d)
    return scoring.mean_spearman(f, "pool", ["density", "lexcov", "length", "marker"], "consensus").select("feature", F.round("rho", 4).alias("rho"))


def _restored_pairs(spark, d):
    gold = _unseen(spark, d).withColumnRenamed("text", "gold")
    return gold.join(lexicon.restored(_unseen(spark, d), _lexicon(spark, d)).withColumnRenamed("text", "pred"), "row_id")


def q39(spark, d):
    return scoring.mark_scores(_restored_pairs(spark, d)).select("mark", "gold", "pred", "hit", "p", "r", "f1")


def q39_known(spark, d):
    """Marks of single words, those known to the lexicon apart from the others."""
    words = lexicon.looked_up(lexicon.word_rows(_unseen(spark, d)), _lexicon(spark, d))
    pairs = words.select(F.col("form").alias("gold"), F.coalesce("found", "key").alias("pred"), "found")
    return scoring.mark_scores(pairs, side=F.when(F.col("found").isNotNull(), "known").otherwise("tail"))


def q40(spark, d):
    """A restored text scored against the original, as a corpus."""
    return scoring.corpus_scores(_restored_pairs(spark, d), "pred", "gold")


def q55(spark, d):
    """One input, several restorations: density and exact lines of each, and the ceiling without marks."""
    rich = _lexicon(spark, d)
    base = _unseen(spark, d).where("text <> ''")
    strategies = {"none": base.select("row_id", T.strip_key("text").alias("pred")), "unigram": lexicon.restored(base, lexicon.Lexicon(rich.unigram)).withColumnRenamed("text", "pred"), "context": lexicon.restored(base, rich).withColumnRenamed("text", "pred"), "ceiling": base.select("row_id", F.col("text").alias("pred"))}
    out = None
    for name, pred in strategies.items():
        one = base.join(pred, "row_id").agg(F.count("*").alias("lines"), F.sum(T.mark_count("pred")).alias("marks"), F.sum(F.length("pred")).alias("chars"), F.sum((F.col("pred") == F.col("text")).cast("long")).alias("exact"))
        one = one.withColumn("strategy", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.select("strategy", "lines", F.round(F.col("marks") * 100.0 / F.col("chars"), 6).alias("density"), "exact")


def q57(spark, d):
    return report.vocabulary(raw(spark, d), "tgt", 50)


def q58(spark, d):
    return scoring.winner_report(scoring.mbr_select(scoring.pools(_candidates(spark, d))))


def q59(spark, d):
    """The candidate of each pool nearest its longest member."""
    c = _candidates(spark, d)
    refs = c.groupBy("pool").agg(F.max_by("text", F.struct(F.length("text"), -F.col("j"))).alias("ref"))
    return scoring.oracle_select(c, refs).select("pool", "j", F.round("chrf", 6).alias("chrf"))


def q60(spark, d):
    return scoring.mean_ratio(filters.nonempty(raw(spark, d), "src", "tgt"), "src", "tgt")


# alignment --------------------------------------------------------------------------------------


def q41(spark, d):
    df = filters.nonempty(raw(spark, d), "src", "tgt")
    return align.block_correlation(df, F.length("src"), F.length("tgt"), F.col("row_id") - 1, 50)


def _cosines(spark, d):
    e = t(spark, d, "embeddings").select("vec_id", "embedding")
    moved = F.col("vec_id") + F.floor(F.col("vec_id") / 50) % 3 - 1
    return align.shifted_cosines(e, e.select(moved.alias("vec_id"), "embedding"))


def q42(spark, d):
    return _cosines(spark, d)


def q43(spark, d):
    return align.regime_filter(_cosines(spark, d)).select("vec_id", F.col("offset"), "regime", "chosen", "keep")


def q44(spark, d):
    """The whole pool as a submission, with ids that are moved, missing and unknown."""
    p = pool(spark, d)
    source = p.select("row_id", F.col("row_id").alias("pos"))
    i = F.col("row_id")
    given = p.select(F.when(i % 997 == 0, -i).otherwise(i).alias("row_id"), F.when(i % 10 == 3, i + 1).otherwise(i).alias("pos"), F.col("t").alias("text"))
    return report.validate(source, given, columns=["row_id", "pos", "text"])


def q56(spark, d):
    """Positional pairing of twin files: lines of both sides under the same number, files of unequal length apart."""
    lines = t(spark, d, "twin_lines")
    on = lambda side: F.count(F.when(F.col("side") == side, 1))
    sizes = lines.groupBy("file_id").agg(on("eng_Latn").alias("s_lines"), on("kas_Arab").alias("t_lines"))
    e = lines.where("side = 'eng_Latn'").select("file_id", "line_no", F.col("line").alias("s"))
    k = lines.where("side = 'kas_Arab'").select("file_id", "line_no", F.col("line").alias("t"))
    both = e.join(k, ["file_id", "line_no"])
    n = both.groupBy("file_id").agg(F.count("*").alias("paired"))
    out = sizes.join(n, "file_id", "left").select("file_id", "s_lines", "t_lines", F.coalesce("paired", F.lit(0)).alias("paired"))
    return out.withColumn("equal", F.col("s_lines") == F.col("t_lines"))


# reports and rules beside the above -----------------------------------------------------------


def q69(spark, d):
    """Pairs of the train split that no held-out row has, the target compared without restorable marks."""
    p = pool(spark, d)
    kept = leakage.drop_by_derived_key(p.where("split_name = 'train'"), p.where("split_name <> 'train'"), "t", also=("s",))
    return report.group_counts(kept, "config")


def q70(spark, d):
    return leakage.leak_gate(*_leaks(spark, d), least=0.6)


def q71(spark, d):
    """Rows that the score lets pass, where all rows are scored and where only mined ones are."""
    rows = raw(spark, d).groupBy(F.coalesce("provenance", F.lit("(none)")).alias("provenance"))
    passed = lambda scope: F.sum(filters.score_ok("labse", 0.8, scope).cast("long")).alias(f"passed_{scope}")
    return rows.agg(F.count("*").alias("n"), passed("all"), passed("mined"))


def q72(spark, d):
    text = T.normalize("tgt", unicode_form="NFC", strip_joiner=True, punctuation=True)
    return raw(spark, d).select("row_id", F.md5(text).alias("text_md5"))


#: Letters with a sign above that stand as one character or as two: code points and their decompositions in Unicode.
COMPOSED = [("\u0622", "\u0627\u0653"), ("\u0624", "\u0648\u0654"), ("\u0626", "\u064a\u0654")]


def q73(spark, d):
    return report.compositions(pool(spark, d), "t", "t_lang", COMPOSED)


def q74(spark, d):
    """Consensus on texts without restorable marks; what comes out are the texts as they were."""
    return scoring.mbr_select(scoring.pools(_candidates(spark, d), T.strip_key)).select("pool", "j", F.round("utility", 6).alias("utility"))


def q75(spark, d):
    return ranking.ranked_by_hash(pool(spark, d).select("row_id"), "shuffle", name="place")


def q76(spark, d):
    return scoring.line_accuracy(_restored_pairs(spark, d))


def q77(spark, d):
    sources = F.array(F.concat(F.coalesce("config", F.lit("none")), F.lit(":"), F.coalesce("provenance", F.lit("unknown"))), F.coalesce("source_file", F.lit("none")))
    rows = report.share_alike(raw(spark, d).withColumn("sources", sources), "sources", ["daily", "nllb-seed"])
    return rows.groupBy("share_alike").agg(F.count("*").alias("n"))


def q78(spark, d):
    """Words whose restored form differs from the given one in more than restorable marks, known to the lexicon or not."""
    words = lexicon.looked_up(lexicon.word_rows(_unseen(spark, d)), _lexicon(spark, d))
    pairs = words.select(F.col("form").alias("gold"), F.coalesce("found", "key").alias("pred"), "found")
    return scoring.unalignable(pairs, side=F.when(F.col("found").isNotNull(), "known").otherwise("tail"))


def q79(spark, d):
    return report.examples(raw(spark, d).where("labse is not null"), 50, "labse", then="row_id").select("row_id", "labse")


def q80(spark, d):
    return scoring.winner_counts(scoring.mbr_select(scoring.pools(_candidates(spark, d))))


def q81(spark, d):
    """Weights fitted to corpus scores against each pool's longest member, with baselines and a fit without each feature."""
    c = _candidates(spark, d)
    refs = c.groupBy("pool").agg(F.max_by("text", F.struct(F.length("text"), -F.col("j"))).alias("ref"))
    found = scoring.tuning_report(c, refs, _features(spark, d), F.pmod(F.xxhash64("pool"), F.lit(10)) < 7, draws=40, starts=2, passes=1, grid=9)
    return spark.createDataFrame([(r["name"], r["tuned"], r["held"], r["all"], r["tried"]) for r in found], "name string, tuned double, held double, whole double, tried long")


def q85(spark, d):
    """Pairs of the train split that a held-out row has as well."""
    p = filters.nonempty(pool(spark, d).select("split_name", "s", "t"), "s", "t")
    return leakage.shared_keys(p.where("split_name = 'train'"), p.where("split_name <> 'train'"), ["s", "t"])


def q86(spark, d):
    """Gates of a restoration, from the texts without marks to the restored ones."""
    unseen = _unseen(spark, d).where("text <> ''")
    return report.gates(unseen.select(T.strip_key("text").alias("text")), lexicon.restored(unseen, _lexicon(spark, d)).select("text"))


def _by_code(texts):
    """A stand-in for a tagger: the label of a character is its code point modulo 4."""
    return [[[float(ord(c) % 4 == k) for k in range(4)] for c in t] for t in texts]


def q87(spark, d):
    """Marks put in by a tagger against the given ones, with and without a bias against marks."""
    found = pipelines.evaluate_restoration(_unseen(spark, d).where("text <> ''"), lambda: _by_code, [0.0, 2.0])
    return found.select("bias", "mark", "gold", "pred", "hit", "p", "r", "f1")


def q88(spark, d):
    """Encoder, translator and sampler in their places, with stand-ins for the models."""
    rows = pool(spark, d).where("s is not null").select("row_id", F.col("s").alias("text"))
    sizes = lambda: lambda xs: [[float(len(x)), float(x.count(" "))] for x in xs]
    out = models.embed(rows, sizes)
    out = models.translate(out, lambda: lambda xs: [x.replace(" ", "_") for x in xs])
    out = models.sample_candidates(out, lambda: lambda xs: [[x, x + x] for x in xs])
    size = [F.element_at("embedding", k).cast("long").alias(f"v{k}") for k in (1, 2)]
    return out.select("row_id", *size, F.md5("translation").alias("translation_md5"), F.aggregate("candidates", F.lit(0), lambda n, x: n + F.length(x)).cast("long").alias("chars"))


# functions --------------------------------------------------------------------------------------


def q46(spark, d):
    return raw(spark, d).select("row_id", F.md5(T.loose_key_exact("tgt")).alias("key_md5"))


def q46_sql(spark, d):
    return raw(spark, d).select("row_id", F.md5(T.loose_key("tgt")).alias("key_md5"))


def q47(spark, d):
    df = raw(spark, d).where("tgt is not null").select("row_id", "tgt", L.base_text("tgt").alias("base"), L.labels("tgt").alias("y"))
    back = L.apply_labels("base", "y")
    return df.select("row_id", F.size("y").cast("long").alias("n"), F.size(F.filter("y", lambda x: x > 0)).cast("long").alias("marked"), L.insertion_only(F.col("tgt"), back).alias("insertion_only"))


def q48(spark, d):
    df = t(spark, d, "documents").where("text is not null").select("doc_id", "text", L.chunk("text", 120).alias("c"))
    again = F.array_join(F.transform("c", lambda x: F.concat(x["before"], x["piece"])), "")
    return df.select("doc_id", (F.array_max(F.transform("c", lambda x: F.length(x["piece"]))) <= 120).alias("within"), (again == F.col("text")).alias("same"))


def q49(spark, d):
    logits = F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double") * 8)
    p = t(spark, d, "embeddings").select("vec_id", L.softmax(logits).alias("p"), L.softmax(logits, -1.5).alias("b"))
    rules = {"likeliest": L.decide("p"), "biased": L.decide("b"), "threshold": L.decide("p", threshold=0.9), "per_mark": L.decide("p", per_mark=[0.3, 0.5, 0.7])}
    return p.select("vec_id", *(r.cast("long").alias(k) for k, r in rules.items()), F.round(F.element_at("p", 1), 6).alias("none"))


NAMES = {
    "q01_flatten_nonempty": q01, "q02_dedup_exact": q02, "q03_length_ratio": q03, "q04_script_profile": q04, "q05_script_reject": q05,
    "q06_waterfall": q06, "q07_counts_by_config": q07, "q08_profile_rollup": q08, "q09_describe": q09, "q10_quantiles_floor": q10,
    "q11_length_hist": q11, "q12_dedup_stripped": q12, "q13_cross_source_dedup": q13, "q14_ortho_profile": q14, "q14_top_marks": q14_top,
    "q14_verdict": q14_verdict, "q15_leak_exact": q15, "q16_leak_loose": q16, "q17_leak_jaccard": q17, "q18_leak_report": q18,
    "q19_apportion": q19, "q20_stratified_fill": q20, "q21_deal": q21, "q22_split_hash": q22, "q23_heldout_antijoin": q23,
    "q24_knn_score": q24, "q25_knn_capped": q25, "q26_upweight": q26, "q27_random_control": q27, "q28_lexicon_unigram": q28,
    "q29_lexicon_left": q29, "q30_lexicon_both": q30, "q31_lexicon_apply": q31, "q32_coverage": q32, "q33_merge": q33,
    "q34_char_ngrams": q34, "q35_chrf_pairs": q35, "q36_mbr_select": q36, "q37_rerank_weighted": q37, "q38_spearman": q38,
    "q39_mark_prf": q39, "q39_mark_prf_known": q39_known, "q40_corpus_scores": q40, "q41_align_corr": q41, "q42_shift_cos": q42,
    "q43_rolling_majority": q43, "q44_validator": q44, "q45_neighbour_context": q45, "q46_loose_key_exact": q46, "q46_loose_key": q46_sql,
    "q47_encode_decode": q47, "q48_chunk": q48, "q49_decide_rules": q49, "q50_arabic_shares": q50, "q51_score_filter": q51,
    "q52_text_reasons": q52, "q53_overlap_count": q53, "q54_upweight_pairs": q54, "q55_restoration_strategies": q55, "q56_twin_files": q56,
    "q57_vocabulary": q57, "q58_winner_report": q58, "q59_oracle_select": q59, "q60_mean_ratio": q60, **FILE_QUERIES,
    "q69_cross_corpus": q69, "q70_leak_gate": q70, "q71_score_scope": q71, "q72_normalize": q72, "q73_compositions": q73, "q74_mbr_by_key": q74,
    "q75_shuffle": q75, "q76_line_accuracy": q76, "q77_share_alike": q77, "q78_left_out": q78, "q79_top_scores": q79, "q80_winner_places": q80, "q81_tuning": q81,
    "q85_shared_keys": q85, "q86_gates": q86, "q87_tagger": q87, "q88_models": q88,
}


def queries() -> dict:
    return dict(NAMES)


def oracle_sql() -> dict[str, str]:
    from weftline.plans import oracles

    return dict(oracles.SQL)
