import json

import pytest
from pyspark.sql import functions as F

from weftline.operators import lexicon, models
from weftline.plans import pipelines
from weftline.sources import readers, writers
from weftline.streaming import streams


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_tsv_takes_the_dialect_that_fits(spark, tmp_path):
    quoted, plain = tmp_path / "q.tsv", tmp_path / "p.tsv"
    quoted.write_text('tgt\tsrc\tsrc_lang\ttgt_lang\n"x\ny"\ta\te\tk\nz\tb\te\tk\nshort\trow\n')
    plain.write_text('src_lang\ttgt_lang\tsrc\ttgt\ne\tk\t"a\tx\ne\tk\tb\ty\ne\tk\tc"\tz\n')
    assert rows(readers.tsv(spark, str(quoted))) == [("e", "k", "a", "x\ny"), ("e", "k", "b", "z")]
    assert [r[2] for r in rows(readers.tsv(spark, str(plain)))] == ['"a', "b", 'c"']
    with pytest.raises(ValueError):
        readers.tsv(spark, str(plain), ("nope",))


def test_text_formats(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\n\ny\n")
    (tmp_path / "b.txt").write_text("1\n2\n")
    (tmp_path / "c.csv").write_text('﻿ID,sentence\n1,"a, ""b"""\n2,nan\n3,\n')
    (tmp_path / "d.jsonl").write_text('{"tgt": "q", "config": "c"}\n\n{"tgt": "r"}\n')
    assert readers.lines(spark, str(tmp_path / "a.txt")).count() == 2 and readers.lines(spark, str(tmp_path / "a.txt"), True).count() == 3
    assert rows(readers.twins(spark, str(tmp_path / "a.txt"), str(tmp_path / "b.txt"))) == [(1, "x", "1"), (2, "y", "2")]
    assert rows(readers.csv_text(spark, str(tmp_path / "c.csv"))) == [("1", 'a, "b"'), ("2", "nan"), ("3", "")]
    assert rows(readers.any_text(spark, str(tmp_path / "d.jsonl"), "s")) == [("q", "s", "s:c"), ("r", "s", None)]
    (tmp_path / "b2.txt").write_text("1\n2\n3\n4\n")
    with pytest.raises(ValueError):
        readers.twins(spark, str(tmp_path / "a.txt"), str(tmp_path / "b2.txt"))
    (tmp_path / "e.txt").write_text("x\n\ny\n")
    same = {r["path"].rsplit("/", 1)[1]: r["first"].rsplit("/", 1)[1] for r in readers.distinct_files(spark, str(tmp_path / "*.txt")).collect()}
    assert same["e.txt"] == "a.txt" and same["b.txt"] == "b.txt"


def test_pools_and_lexicon_files(spark, tmp_path):
    wide = spark.createDataFrame([(1, "s", ["a", "b"])], "pool long, src string, candidates array<string>")
    writers.pools(wide, str(tmp_path / "p1"), "sys", {"n": 1})
    writers.pools(wide, str(tmp_path / "p2"), "sys")
    assert rows(readers.pools(spark, str(tmp_path / "p1"), str(tmp_path / "p2"))) == [(1, "s", ["a", "b", "a", "b"])]
    other = spark.createDataFrame([(1, "z", ["a"])], "pool long, src string, candidates array<string>")
    writers.pools(other, str(tmp_path / "p3"), "sys")
    with pytest.raises(ValueError):
        readers.pools(spark, str(tmp_path / "p1"), str(tmp_path / "p3"))
    uni = spark.createDataFrame([("k", "f")], "key string, form string")
    left = spark.createDataFrame([("p", "k", "g")], "prev string, key string, form string")
    writers.lexicon(lexicon.Lexicon(uni, left=left), str(tmp_path / "l.json"), {"lines": 3})
    back = readers.lexicon_json(spark, str(tmp_path / "l.json"))
    assert rows(back.unigram) == [("k", "f")] and rows(back.left) == [("p", "k", "g")] and back.both.count() == 0
    (tmp_path / "old.json").write_text(json.dumps({"lexicon": {"k": "f"}, "context": {"p\tk": "g"}}))
    assert rows(readers.lexicon_json(spark, str(tmp_path / "old.json")).left) == [("p", "k", "g")]


def test_ordered_files_and_caches(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", "y"), (1, "a", "x")], "row_id long, s string, t string")
    facts = writers.twins(df, str(tmp_path), "dev")
    assert (tmp_path / "dev.eng_Latn").read_text() == "a\nb\n" and facts["sha256"]["dev.kas_Arab"] == writers.file_hash(str(tmp_path / "dev.kas_Arab"))
    sub = spark.createDataFrame([(2, "q", 'x,"y"'), (1, "p", "z")], "pos long, ID string, kashmiri_text string")
    writers.submission(sub, str(tmp_path / "s.csv"))
    assert (tmp_path / "s.csv").read_text() == 'ID,kashmiri_text\np,z\nq,"x,""y"""\n'
    calls = []

    def score(new):
        calls.append(new.count())
        return new.select("key", F.length("src").alias("score"))

    pairs = spark.createDataFrame([("aa", "b"), ("aa", "b"), ("c", "d")], "src string, tgt string")
    for _ in range(2):
        out = writers.cached_scores(spark, pairs, score, str(tmp_path / "cache"))
        assert sorted(r["score"] for r in out.collect()) == [1.0, 2.0, 2.0]
    assert calls == [2, 0]


def test_models(spark):
    df = spark.createDataFrame([(1, "ab c"), (2, None)], "row_id long, text string")
    assert [r["translation"] for r in models.translate(df, lambda: lambda xs: [x.upper() for x in xs]).orderBy("row_id").collect()] == ["AB C", ""]
    assert [len(r["embedding"]) for r in models.embed(df, lambda: lambda xs: [[float(len(x)), 1.0] for x in xs]).collect()] == [2, 2]
    tagger = lambda: lambda xs: [[[0.0, 9.0, 0.0, 0.0] for _ in x] for x in xs]
    assert models.tag(df, tagger).orderBy("row_id").first()["restored"] == "aِbِ cِ"
    with pytest.raises(ValueError):
        models.configured(models.Sampling, {"nope": 1})
    with pytest.raises(ValueError):
        models.Sampling(method="nope")
    assert models.calibrate(lambda b: 10 - b, 7.0) == pytest.approx(3.0, abs=1e-4)


def test_settings_vectors_and_restoration(spark, tmp_path):
    writers.tuned({"length": 0.5}, str(tmp_path / "w.yaml"), "found by search")
    assert readers.settings(str(tmp_path / "w.yaml")) == {"w_length": 0.5}
    (tmp_path / "n.yaml").write_text("# how\na:\n  b: 1  # one\n  c:\n    d: x\nlist:\n  - 1\n  - 2.5\nflat: [a, 3, true]\nnone:\nurl: 'a:b'\n")
    assert readers.settings(str(tmp_path / "n.yaml")) == {"a": {"b": 1, "c": {"d": "x"}}, "list": [1, 2.5], "flat": ["a", 3, True], "none": None, "url": "a:b"}
    for bad in ("a: 1\na: 2\n", "a: 1\n  b: 2\n", "word\n", "a:b\n"):
        (tmp_path / "n.yaml").write_text(bad)
        with pytest.raises(ValueError):
            readers.settings(str(tmp_path / "n.yaml"))
    (tmp_path / "n.yaml").write_text("")
    assert readers.settings(str(tmp_path / "n.yaml")) == {}
    with pytest.raises(ValueError):
        readers.prefix_candidates(spark.range(1), 2, files=2)
    df = spark.createDataFrame([("ab",), ("ab",), ("c",)], "text string")
    calls = []

    def embed(new):
        calls.append(new.count())
        return new.select("key", F.array(F.length("text").cast("float")).alias("embedding"))

    for _ in range(2):
        assert sorted(r["embedding"][0] for r in writers.cached_vectors(spark, df, embed, str(tmp_path / "v")).collect()) == [1.0, 2.0, 2.0]
    assert calls == [2, 0]
    gold = spark.createDataFrame([("کِتِ",)], "text string")
    tagger = lambda: lambda xs: [[[0.0, 1.0, 0.0, 0.0] for _ in x] for x in xs]
    got = {(r["bias"], r["mark"]): (r["hit"], r["density_pred"]) for r in pipelines.evaluate_restoration(gold, tagger, [0.0, 9.0]).collect()}
    assert got[0.0, "kasra"] == (2, 50.0) and got[9.0, "kasra"] == (0, 0.0)
    with pytest.raises(AssertionError):
        pipelines.guarded_restoration(gold, lambda x: x)


def test_pipelines(spark):
    text = "اب اب اب اب"
    pairs = spark.createDataFrame([(i, f"word{i} two three", text + " " + chr(0x628 + i), "bpcc-seed-v1" if i % 2 else "bpcc-seed-latest", "human") for i in range(20)], "row_id long, src string, tgt string, config string, provenance string")
    clean = pipelines.load_and_clean(pairs)
    assert clean.count() == 20
    like = spark.createDataFrame([("a b c",)], "line string")
    held = pipelines.hold_out(clean, like, "line", pipelines.HoldOutConfig(total=4))
    assert held.count() == 4 and held.where("hand = 'A'").count() == 2
    lines = spark.createDataFrame([(1, "eng_Latn", held.select("src").first()[0] + " and more of it"), (2, "eng_Latn", "Word1, TWO three"), (3, "eng_Latn", "word2 two three")], "item_id long, side string, line string")
    parts = pipelines.build_corpus(clean, held, lines, 0.25)
    n = {k: v.count() for k, v in parts.items()}
    assert n["dev"] + n["train"] + n["leaked"] == 16 and n["leaked"] <= 2
    e = spark.createDataFrame([(i, [float(i == j) for j in range(6)]) for i in range(6)], "vec_id long, embedding array<double>")
    ids, times = pipelines.select_like(e, e.where("vec_id < 2"), 1, 2, 0.5, 5)
    assert ids.count() <= 2 and times >= 1
    c = pipelines.Checks()
    c.equal("x", 1, 2)
    with pytest.raises(AssertionError):
        c.done()


def test_stream(spark, tmp_path):
    batch = spark.createDataFrame([(1, "abcd", "اب"), (2, "abcd", "اَب"), (3, "abcd", ""), (4, "efgh", "اب")], "row_id long, src string, tgt string").withColumn("landed_at", F.lit("2025-01-01").cast("timestamp")).withColumn("config", F.lit("c"))
    batch.write.parquet(str(tmp_path / "in"))
    q = streams.write_append(streams.curated(streams.pairs(spark, str(tmp_path / "in"), batch.schema)), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    kept = {r["row_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert 4 in kept and len(kept & {1, 2}) == 1 and 3 not in kept
