import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import ngrams as N
from weftline.functions import text as T
from weftline.operators import align, dedup, filters, leakage, lexicon, ranking, report, sampling, scoring, selection


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_filters(spark):
    df = spark.createDataFrame([(1, "one two", "abc", 0.9), (2, "", "abc", None), (3, "ab", "a", 0.5), (4, "ab", "abcd", 0.8), (5, "ab", "abcde", None)], "row_id long, src string, tgt string, labse double")
    assert rows(df.where(filters.length_ok("src", "tgt")), "row_id") == [(3,), (4,)]
    assert rows(df.where(filters.score_ok("labse", 0.8)), "row_id") == [(1,), (2,), (4,), (5,)]
    assert rows(filters.nonempty(df, "src", "tgt"), "row_id") == [(1,), (3,), (4,), (5,)]
    t = spark.createDataFrame([(1, "۱۲ !"), (2, "اب" * 9 + "कख"), (3, "اب" * 9 + "कखग"), (4, "اب" * 8 + "abcd"), (5, "اب" * 8 + "abcde")], "i int, t string")
    assert rows(t.select("i", filters.script_reason("t"))) == [(1, "no_letters"), (2, None), (3, "devanagari"), (4, None), (5, "arabic")]


def test_waterfall_seeks_duplicates_among_survivors(spark):
    data = [(1, "ab", ""), (2, "abcd", "اب"), (3, "abcd", "اَب"), (4, "abcdefgh", "اب"), (5, "abcd", "ab"), (6, "abcd", "ابक"), (7, "abcd", "اب")]
    df = filters.waterfall(spark.createDataFrame(data, "row_id long, src string, tgt string"))
    assert rows(df, "row_id", "reason") == [(1, "empty"), (2, None), (3, "duplicate"), (4, "ratio"), (5, "script"), (6, "script"), (7, "duplicate")]
    report_ = {r["stage"]: (r["kept"], r["dropped"]) for r in filters.stage_report(df).collect()}
    assert report_ == {"input": (7, 0), "empty": (6, 1), "ratio": (5, 1), "script": (3, 2), "devanagari": (3, 0), "duplicate": (1, 2)}


def test_dedup_keeps_the_first_by_order(spark):
    df = spark.createDataFrame([(3, "a", "b"), (1, " a", "b "), (2, "a", "bَ"), (5, None, "b")], "row_id long, src string, tgt string")
    assert rows(dedup.exact_pairs(df, copies="n"), "row_id", "n") == [(1, 2), (2, 1), (5, 1)]
    assert rows(dedup.stripped_targets(df, "src", "tgt"), "row_id") == [(1,), (2,), (5,)]
    a = spark.createDataFrame([(9, "x", "A")], "row_id long, text string, source string")
    b = spark.createDataFrame([(1, "xَ", "B"), (2, "y", "B"), (3, "", "B")], "row_id long, text string, source string")
    assert rows(dedup.across_sources([a, b]), "source", "row_id") == [("A", 9), ("B", 2)]


def test_leakage(spark):
    q = spark.createDataFrame([(1, "s", "Abc def"), (2, "s", "abc, DEF"), (3, "s", "abcdefghijklmnopqrstuvwxyz"), (4, "s", "no match at all"), (5, "t", "Abc def"), (6, "s", "abc")], "row_id long, side string, text string")
    d = spark.createDataFrame([(7, "s", "Abc def"), (6, "s", "Abc  def"), (8, "s", "abcdefghijklmnopqrstuvwxy!"), (9, "s", None)], "item_id long, side string, line string")
    got = rows(leakage.leak_reasons(q, d), "row_id", "kind", "item_id")
    assert got == [(1, "exact", 6), (2, "loose", 6), (3, "near", 8)]
    clean, leaked = leakage.split_leaked(q, leakage.leak_reasons(q, d))
    assert rows(clean, "row_id") == [(4,), (5,), (6,)] and leaked.count() == 3
    held = spark.createDataFrame([("zz",)], "text string")
    with pytest.raises(ValueError):
        leakage.drop_heldout(q, held, ["text"], expect_all=True)
    with pytest.raises(AssertionError):
        leakage.assert_disjoint(q, q, ["text"])


def test_near_against_brute_force(spark):
    rng = random.Random(1)
    base = ["".join(rng.choices("abcd ", k=40)) for _ in range(30)]
    edit = lambda s: "".join(c if rng.random() > 0.03 else "x" for c in s)
    q = [(i, "s", edit(rng.choice(base))) for i in range(120)]
    d = [(i, "s", b) for i, b in enumerate(base)]

    def grams(s):
        k = "".join(s.lower().split())
        return {k[i : i + 5] for i in range(max(1, len(k) - 4))} if k else set()

    want = []
    for i, _, t in q:
        scored = [(len(grams(t) & grams(b)) / len(grams(t) | grams(b)), -j) for j, _, b in d]
        s, j = max(scored)
        if s >= 0.6:
            want.append((i, -j, round(s, 9)))
    for small in (leakage.SMALL_GRAMS, 0):  # the lines broadcast, and joined
        got = leakage.near(spark.createDataFrame(q, "row_id long, side string, text string"), spark.createDataFrame(d, "item_id long, side string, line string"), 0.6, small=small)
        assert rows(got.select("row_id", "item_id", F.round("score", 9))) == sorted(want)
    other = leakage.near(spark.createDataFrame(q, "row_id long, side string, text string"), spark.createDataFrame([(1, "t", base[0]), (2, None, base[0])], "item_id long, side string, line string"), 0.6)
    assert other.count() == 0


def test_held_out_joins(spark):
    held = spark.createDataFrame([("a", "b"), ("c", "d"), ("a", "b")], "s string, t string")
    df = spark.createDataFrame([(1, "a", "b"), (2, "c", "d"), (3, "e", "f")], "row_id long, s string, t string")
    assert rows(leakage.drop_heldout(df, held, ["s", "t"], expect_all=True), "row_id") == [(3,)]
    again = df.union(spark.createDataFrame([(4, "a", "b")], df.schema))  # one key, two rows
    with pytest.raises(ValueError):
        leakage.drop_heldout(again, held, ["s", "t"], expect_all=True)
    with pytest.raises(ValueError):
        leakage.drop_heldout(df.where("row_id > 1"), held, ["s", "t"], expect_all=True)
    marked = spark.createDataFrame([("e", "\u0641\u0650"), ("x", "\u0641")], "s string, t string")
    own = spark.createDataFrame([(1, "e", "\u0641"), (2, "y", "\u0641")], "row_id long, s string, t string")
    assert rows(leakage.drop_by_derived_key(own, marked, "t", also=("s",)), "row_id") == [(2,)]
    lines = spark.createDataFrame([(1, "eng_Latn", "one two three four"), (2, "kas_Arab", "\u06a9\u062a\u0627\u0628 \u0686\u06be")], "item_id long, side string, line string")
    pairs = spark.createDataFrame([(1, "One, two three FOUR", "x"), (2, "y", "\u06a9\u062a\u0627\u0628 \u0686\u06be"), (3, "other", "z"), (4, "one two three fours", "x")], "row_id long, s string, t string")
    assert leakage.leak_gate(leakage.side_rows(pairs, "s", "t"), lines, 0.8).first()["n"] == 3


def test_scope_and_tags(spark):
    df = spark.createDataFrame([("mined", 0.5), ("mined", None), ("human", 0.5), (None, 0.5), ("mined", 0.9)], "provenance string, labse double")
    assert df.where(filters.score_ok("labse", 0.8)).count() == 2 and df.where(filters.score_ok("labse", 0.8, "mined")).count() == 4
    with pytest.raises(ValueError):
        filters.score_ok("labse", 0.8, "some")
    tags = spark.createDataFrame([("a:x", "a")], "tag string, source string")
    assert filters.tagged(tags, "a", expect=True).count() == 1
    with pytest.raises(ValueError):
        filters.tagged(tags, "b", expect=True)


def test_waterfall_counts_agree_with_its_rows(spark):
    rng = random.Random(3)
    texts = ["\u06a9\u062a\u0627\u0628 \u0686\u06be", "\u06a9\u0650\u062a\u0627\u0628 \u0686\u06be", "latin words", "", None, "nan", "\u0915\u0915", "\u06a9" * 90]
    df = spark.createDataFrame([(i, rng.choice(["some words", "other words", "", None]), rng.choice(texts)) for i in range(300)], "row_id long, src string, tgt string")
    want = {r["reason"]: r["n"] for r in filters.waterfall(df).groupBy("reason").agg(F.count("*").alias("n")).collect()}
    assert {r["reason"]: r["n"] for r in filters.reason_counts(df).collect()} == want and len(want) >= 4
    assert rows(filters.count_report(filters.reason_counts(df))) == rows(filters.stage_report(filters.waterfall(df)))


def test_apportionment_and_fill(spark):
    h = lambda w: spark.createDataFrame(list(enumerate(w)), "n int, weight double")
    assert rows(sampling.apportion(h([1.0, 1.0, 1.0]), 4)) == [(0, 2), (1, 1), (2, 1)]
    assert rows(sampling.apportion(h([3.0]), 0)) == [(0, 0)]
    rng = random.Random(2)
    for _ in range(6):
        w = [rng.random() for _ in range(7)]
        got = rows(sampling.apportion(h(w), 50))
        exact = [x * 50 / sum(w) for x in w]
        assert sum(g[1] for g in got) == 50 and all(abs(g[1] - e) < 1 for g, e in zip(got, exact))
    cand = [(i, 5, c) for i, c in enumerate("ppppppppqqrxx")] + [(100, 6, "p"), (101, 7, "q")]
    df = spark.createDataFrame(cand, "row_id long, n int, config string")
    needs = spark.createDataFrame([(5, 5), (6, 3), (7, 1)], "n int, need long")
    got = sampling.stratified_fill(df, needs, "p", ["q", "r"], 0.5, 9)
    by = {}
    for r in got.collect():
        by.setdefault(r["n"], []).append((r["phase"], r["config"]))
    assert sorted(by[5]) == [(0, "p"), (0, "p"), (1, "q"), (1, "q"), (1, "r")]  # half of 5 is 2.5, to even 2
    assert sorted(by[6]) == [(0, "p")] and by[7] == [(1, "q")]
    assert rows(sampling.shortfall(got, needs)) == [(6, 3, 1)]
    hands = sampling.deal(got).groupBy("n").agg(F.sum(F.when(F.col("hand") == "A", 1).otherwise(0)).alias("a"), F.count("*").alias("c")).collect()
    assert all(r["a"] == math.ceil(r["c"] / 2) for r in hands)


def test_split_sample_and_repeat(spark):
    df = spark.range(101).withColumnRenamed("id", "row_id")
    assert {r["part"]: r["count"] for r in sampling.split(df, 0.8).groupBy("part").count().collect()} == {1: 80, 2: 21}
    assert sampling.split(df, 7).where("part = 1").count() == 7 and sampling.sample(df, 9).count() == 9
    assert sampling.repeat_factor(10, 90, 0.5, 20) == 9 and sampling.repeat_factor(10, 90, 0.5, 3) == 3 and sampling.repeat_factor(0, 9, 0.5, 3) == 1
    assert sampling.upweighted(df.limit(5), df.limit(2), 3).count() == 11


def test_quantiles_use_the_floor_index(spark):
    rng = random.Random(3)
    v = [round(rng.random(), 2) for _ in range(333)]
    got = ranking.quantiles(spark.createDataFrame([(x,) for x in v] + [(None,)], "x double"), "x", [0.0, 0.05, 0.5, 0.99, 1.0]).first()
    assert [got[i + 1] for i in range(5)] == [sorted(v)[int(q * 332)] for q in (0, 0.05, 0.5, 0.99, 1)] and got["n"] == 333


def test_knn_and_cap(spark):
    rng = random.Random(4)
    unit = lambda: (lambda x: [a / math.sqrt(sum(b * b for b in x)) for a in x])([rng.gauss(0, 1) for _ in range(8)])
    v, q = [(i, unit()) for i in range(60)], [(100 + i, unit()) for i in range(9)]
    V, Q = (spark.createDataFrame(x, "vec_id long, embedding array<double>") for x in (v, q))
    got = {r["vec_id"]: r for r in selection.nearest(V, Q, 3).collect()}
    for i, a in v:
        c = sorted(((sum(x * y for x, y in zip(a, b)), -j) for j, b in q), reverse=True)
        assert got[i]["score"] == pytest.approx(sum(x[0] for x in c[:3]) / 3, abs=1e-6) and got[i]["query_id"] == -c[0][1]
    assert rows(selection.nearest(V, Q, 3, block=4)) == rows(selection.nearest(V, Q, 3))
    scored = selection.nearest(V, Q, 3)
    seen, want = {}, []
    for r in sorted(scored.collect(), key=lambda r: (-r["score"], r["vec_id"])):
        if seen.get(r["query_id"], 0) < 4 and len(want) < 20:
            seen[r["query_id"]] = seen.get(r["query_id"], 0) + 1
            want.append(r["vec_id"])
    assert sorted(want) == [x[0] for x in rows(selection.capped(scored, 4, 20), "vec_id")]


def test_lexicon(spark):
    texts = [(1, "کِتاب اَور"), (2, "کِتاب  ب"), (3, "کُتاب ا"), (4, "کُتاب"), (5, "")]
    df = spark.createDataFrame(texts, "row_id long, text string")
    w = lexicon.word_rows(df)
    assert rows(w.where("row_id = 1"), "pos", "key", "prev", "next") == [(0, "کتاب", "<s>", "اور"), (1, "اور", "کتاب", "</s>")]
    assert rows(lexicon.majority(w, ["key"], 3), "key", "form", "n", "total") == [("کتاب", "کِتاب", 2, 4)]  # tie to the first met
    assert lexicon.majority(w, ["key"], 3, 0.6).count() == 0
    lex = lexicon.build(df, context=("both", "left", "right"), context_least=1, least=1)
    assert rows(lexicon.restored(spark.createDataFrame([(1, "کَتاب   ا zz")], "row_id long, text string"), lex)) == [(1, "کُتاب ا zz")]
    assert rows(lexicon.restored(spark.createDataFrame([(1, "zz کتاب")], "row_id long, text string"), lexicon.Lexicon(lex.unigram))) == [(1, "zz کِتاب")]
    found = lexicon.looked_up(w, lexicon.Lexicon(lex.unigram))
    cov = lexicon.coverage(found).first()
    assert (cov["words"], cov["substituted"], cov["by_context"]) == (7, 5, 0)
    m = found.withColumn("model", F.lit("M"))
    assert [r[0] for r in m.where("row_id = 2").orderBy("pos").select(lexicon.merged(m, "model", "known")).collect()] == ["کِتاب", "M"]


def test_ngram_metrics():
    assert N.pairwise_chrf(["a b", "a b", "zz"])[0, 1] == pytest.approx(100) and N.pairwise_chrf(["ab", "cd"])[0, 1] == 0
    assert N.metric_words("Hi, (you) . x") == ["Hi", ",", "(you", ")", ".", "x"]
    assert N.tokenize_13a("It's 3.5, no-one (ok).") == ["It's", "3.5", ",", "no-one", "(", "ok", ")", "."]
    # by hand: hyp "ab", ref "abc": chars 1: 2/2, 2/3; chars 2: 1/1, 1/2; the words "ab" and "abc" differ
    p, r = (1 + 1 + 0) / 3, (2 / 3 + 1 / 2 + 0) / 3
    assert N.pairwise_chrf(["ab", "abc"])[0, 1] == pytest.approx(100 * 5 * p * r / (4 * p + r))


def shared(a, b):
    a, b = Counter(a), Counter(b)
    return [sum(min(n, b[g]) for g, n in a.items()), sum(a.values()), sum(b.values())]


def counted(hyp, ref):
    """Match, hypothesis and reference of chrF++ for every order, by counting."""
    out = []
    for n in range(1, 7):
        out += shared(*([x[i : i + n] for i in range(len(x) - n + 1)] for x in ("".join(t.split()) for t in (hyp, ref))))
    for n in range(1, 3):
        out += shared(*([tuple(x[i : i + n]) for i in range(len(x) - n + 1)] for x in map(N.metric_words, (hyp, ref))))
    return out


def test_pair_statistics_against_counting():
    rng = random.Random(8)
    texts = ["".join(rng.choices("ab c,.-1", k=rng.randrange(0, 40))) for _ in range(60)]
    hyps, refs = texts[:30], texts[30:]
    assert N.chrf_pairs(hyps, refs).tolist() == [counted(h, r) for h, r in zip(hyps, refs)]
    for row, h, r in zip(N.bleu_pairs(hyps, refs).tolist(), hyps, refs):
        a, b = N.tokenize_13a(h), N.tokenize_13a(r)
        want = [len(a), len(b)]
        for n in range(1, 5):
            want += shared(*([tuple(x[i : i + n]) for i in range(len(x) - n + 1)] for x in (a, b)))[:2]
        assert row == want
    assert N.chrf_pairs([], []).shape == (0, 24) and N.bleu_pairs([], []).shape == (0, 10)


def test_pools_against_counted_pairs():
    rng = random.Random(6)
    pools = [["".join(rng.choices("abc ,.é", k=rng.randrange(0, 30))) for _ in range(rng.randrange(1, 6))] for _ in range(40)]
    for texts, got in zip(pools, N.pools_chrf(pools)):
        for i, h in enumerate(texts):
            for j, r in enumerate(texts):
                s = np.array(counted(h, r)).reshape(-1, 3)
                assert got[i, j] == pytest.approx(float(N.f_score(s[:, 0], s[:, 1], s[:, 2])))
    assert N.pools_chrf([]) == []


def test_consensus_and_rerank(spark):
    cand = [(1, 0, "ab cd"), (1, 1, "ab cd"), (1, 2, "ab ce"), (1, 3, ""), (2, 0, "x"), (3, 0, None), (4, 0, "aa"), (4, 1, "bb")]
    pooled = scoring.pools(spark.createDataFrame(cand, "pool long, j int, text string"))
    won = {r["pool"]: r["j"] for r in scoring.mbr_select(pooled).collect()}
    assert won == {1: 0, 2: 0, 4: 0}
    brute = N.pairwise_chrf(["ab cd", "ab cd", "ab ce"])
    u = {(r["pool"], r["j"]): r["utility"] for r in scoring.consensus(pooled).collect()}
    assert u[1, 2] == pytest.approx((brute[2, 0] + brute[2, 1]) / 2, abs=1e-6) and u[2, 0] == 0
    f = spark.createDataFrame([(1, 0, 0.1, 0.0), (1, 1, 0.1, 0.5), (2, 1, 0.3, 0.0), (2, 0, 0.3, 0.0)], "pool long, j long, consensus double, length double")
    assert rows(scoring.rerank(f, {"consensus": 1.0, "length": 0.0}), "pool", "j") == [(1, 0), (2, 0)]
    assert rows(scoring.rerank(f, {"length": 1.0}), "pool", "j") == [(1, 1), (2, 0)]
    with pytest.raises(ValueError):
        scoring.rerank(f, {"marker": 1.0})
    f = spark.createDataFrame([(1, 0, "K A"), (1, 1, "k b"), (1, 2, "k b"), (1, 3, "?!")], "pool long, j int, text string")
    by_key = scoring.mbr_select(scoring.pools(f, lambda c: F.lower(F.regexp_replace(c, "[?!]", "")))).first()
    assert by_key["j"] == 1
    keys = [x["key"] for x in scoring.pools(f, lambda c: F.regexp_replace(c, "[?!]", "")).first()["candidates"]]
    assert keys == ["K A", "k b", "k b", "?!"]  # a key that is blank is the text


def tuned(spark):
    rng = random.Random(9)
    refs, cands, feats = [], [], []
    for p in range(40):
        ref = " ".join(rng.choices(["ab", "cd", "ef", "gh", "ij", "kl"], k=8))
        refs.append((p, ref))
        for j in range(5):
            words = [w if rng.random() > 0.15 * j else "zz" for w in ref.split()]
            rng.shuffle(words) if j == 4 else None
            cands.append((p, (j + 3) % 5, " ".join(words), "s"))
            feats.append((p, (j + 3) % 5, rng.random(), rng.random(), rng.random(), -0.1 * j, rng.random()))
    c = spark.createDataFrame(cands, "pool long, j int, text string, src string")
    f = spark.createDataFrame(feats, "pool long, j long, " + ", ".join(f"{x} double" for x in scoring.FEATURES))
    return c, spark.createDataFrame(refs, "pool long, ref string"), f


def test_tuning(spark):
    c, refs, f = tuned(spark)
    stats = scoring.candidate_statistics(c, refs)
    pools = scoring.Weighted(f, stats.select("pool", "j", "sums"))
    ways = [{"length": 1.0}, {}, {"consensus": 1.0, "marker": -0.5}]
    for w, geo in zip(ways, pools.geo(ways)):
        won = scoring.rerank(f, dict.fromkeys(scoring.FEATURES, 0.0) | w)
        pairs = won.join(c.select("pool", F.col("j").cast("long").alias("j"), "text"), ["pool", "j"]).join(refs, "pool")
        assert geo == pytest.approx(scoring.corpus_scores(pairs, "text", "ref").first()["geo"], abs=1e-4)
    weights, score, tried = scoring.tune(pools, draws=20, starts=2, passes=1)
    assert score == pytest.approx(float(pools.geo([weights])[0])) and score >= pools.geo(ways).max() - 1e-9 and tried > 26
    pools.release()
    report_ = scoring.tuning_report(c, refs, f, F.col("pool") % 10 < 7, draws=10, starts=1, passes=1)
    by = {r["name"]: r for r in report_}
    assert by["only_length"]["all"] > by["first"]["all"] and by["best"]["all"] >= by["fit"]["all"] and by["fit"]["tuned"] >= by["only_length"]["tuned"]
    assert by["without_length"]["weights"]["length"] == 0.0


def test_corpus_scores(spark):
    same = spark.createDataFrame([("a b c d e", "a b c d e")], "hyp string, ref string")
    r = scoring.corpus_scores(same).first()
    assert r["bleu"] == pytest.approx(100) and r["chrf"] == pytest.approx(100) and r["geo"] == pytest.approx(100)
    none = scoring.corpus_scores(spark.createDataFrame([("a b c d e", "v w x y z"), (None, "a")], "hyp string, ref string")).first()
    assert none["bleu"] == 0 and none["chrf"] == 0 and none["geo"] == 0
    # by hand: 4 of 5, 3 of 4, 2 of 3 and 1 of 2 n-grams match; no brevity penalty
    part = scoring.corpus_scores(spark.createDataFrame([("a b c d x", "a b c d e")], "hyp string, ref string")).first()
    assert part["bleu"] == pytest.approx(100 * (4 / 5 * 3 / 4 * 2 / 3 * 1 / 2) ** 0.25, abs=1e-5)


def test_spearman_and_marks(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, 5.0), (1, 2.0, 2.0, 6.0), (1, 3.0, 2.0, 7.0), (2, 1.0, 1.0, 2.0), (2, 1.0, 2.0, 1.0), (3, 1.0, 1.0, 1.0)], "g long, a double, b double, y double")
    assert rows(scoring.mean_spearman(df, "g", ["a", "b"], "y")) == [("a", pytest.approx(1 / 3, abs=1e-6)), ("b", pytest.approx(-1 / 3, abs=1e-6))]
    pairs = spark.createDataFrame([("کِتَب", "کِتُب"), ("اَ", "ا"), ("x", "y")], "gold string, pred string")
    got = {r["mark"]: (r["gold"], r["pred"], r["hit"]) for r in scoring.mark_scores(pairs).collect()}
    assert got == {"kasra": (1, 1, 1), "fatha": (2, 0, 0), "damma": (0, 1, 0), "MICRO": (3, 2, 1)}
    assert rows(scoring.unalignable(pairs)) == [("all", 3, 1)]


def test_alignment(spark):
    rng = random.Random(5)
    data = [(i, i % 7 + 1, (i % 7 + 1) * 2 if i < 50 else rng.randrange(1, 9), 5) for i in range(149)]
    df = spark.createDataFrame(data, "p long, x int, y int, c int")
    got = {r["block"]: (r["n"], r["r"], r["keep"]) for r in align.block_correlation(df, F.col("x"), F.col("y"), F.col("p"), 50).collect()}
    assert got[0][1] == pytest.approx(1) and got[0][2] and got[2][0] == 49 and got[2][2]
    assert all(r["r"] == 0 for r in align.block_correlation(df, F.col("x"), F.col("c"), F.col("p"), 50).collect())
    values = [rng.choice([-1, 0, 1]) for _ in range(95)]
    v = spark.createDataFrame(list(enumerate(values)), "vec_id long, o int")
    got = [r["regime"] for r in align.rolling_majority(v, "o", [-1, 0, 1], window=9, block=13).orderBy("vec_id").collect()]
    want = []
    for i in range(95):
        part = values[max(0, i - 4) : i + 5]
        want.append(max([-1, 0, 1], key=lambda x: (part.count(x), -x)))
    assert got == want
    e = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert rows(align.shifted_cosines(e, e)) == [(0, -1.0, 1.0, 0.0), (1, 0.0, 1.0, 0.0), (2, 0.0, 1.0, -1.0)]


def test_reports(spark):
    src = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "row_id long, pos long")
    sub = spark.createDataFrame([(1, 1, "اَب"), (3, 2, "اَب"), (4, 3, " nan ")], "row_id long, pos long, text string")
    got = {r["check"]: (r["n"], r["pass"]) for r in report.validate(src, sub).collect()}
    assert got["missing_ids"] == (1, False) and got["extra_ids"] == (1, False) and got["order"] == (1, False) and got["row_count"] == (0, True)
    assert got["empty"] == (1, False) and got["nan_like"] == (1, False) and got["duplicates"] == (1, False) and got["latin_share"][1] is False
    with pytest.raises(AssertionError):
        report.no_op_guard(5.0, 5.0)
    df = spark.createDataFrame([(["a:x", "b"],), (["c"],), ([],)], "s array<string>")
    assert [r["share_alike"] for r in report.share_alike(df, "s", ["a"]).collect()] == [True, False, False]
    v = spark.range(1).select(report.verdict(F.lit(10.0), F.lit(8.0), F.lit(90.0), F.lit(70.0)).alias("v")).select("v.*").first()
    assert (v["ratio"], v["marks"], v["map_punctuation"]) == (0.8, "mismatch", True)
    p = report.profile(spark.createDataFrame([("a b", "کِ", "x"), ("c", "کک", None)], "s string, t string, k string"), "s", "t", "k")
    assert rows(p, "k", "pairs", "mean_words") == [("(all)", 2, 1.5), ("(none)", 1, 1.0), ("x", 1, 2.0)]
    assert T is not None
