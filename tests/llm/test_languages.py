import random

import pyarrow as pa
import pytest

from weftline.llm import languages as L

WORDS = {
    "aaa": "the of and with from into over under before after this that which when where".split(),
    "bbb": "la el los las con desde sobre bajo antes este que cual cuando donde para".split(),
    "ccc": "और में के लिए पर से नहीं यह वह जो कि था थी हैं एक".split(),
}


def sentence(rng, lang, n=9):
    names = ["".join(rng.choices("bdgklmnprst", k=2)) + rng.choice("aeiou") for _ in range(2)]
    return " ".join(rng.choices(WORDS[lang], k=n - 2) + names) + "."


@pytest.fixture(scope="module")
def model():
    rng = random.Random(3)
    texts = [(sentence(rng, k) + " " + sentence(rng, k), k) for k in WORDS for _ in range(150)]
    for i in range(0, len(texts), 23):  # wrong labels
        texts[i] = (texts[i][0], "bbb")
    return L.fit(*zip(*texts))


def test_held_out_accuracy(model):
    rng = random.Random(4)
    texts = [(sentence(rng, k), k) for k in WORDS for _ in range(300)]
    got = L.labelled(model, pa.array([t for t, _ in texts]))
    assert sum([s[0] for s in g] == [k] for g, (_, k) in zip(got, texts)) / len(texts) > 0.99


def test_segments_and_void(model):
    rng = random.Random(5)
    a, b, c = (sentence(rng, k) for k in WORDS)
    no_ends = " ".join(sentence(rng, "aaa").rstrip(".") for _ in range(9)) + " " + " ".join(sentence(rng, "ccc").rstrip(".") for _ in range(9))
    texts = [f"{a} {b}", f"{a}\n{c} {a}", a.replace(" ", "\n"), no_ends, "12 34 | 56", "AB-12 ", "x" * 400, "", None, " ".join([a] * 3000)]
    got = [[s[0] for s in g] for g in L.labelled(model, pa.array(texts))]
    assert got[:4] == [["aaa", "bbb"], ["aaa", "ccc", "aaa"], ["aaa"], ["aaa", "ccc"]]
    assert got[4:9] == [[]] * 5 and got[9] == ["aaa"]


def test_query_rows(spark, model):
    rng = random.Random(6)
    rows = [("t", 1, None, sentence(rng, "aaa"), "x"), ("t", 2, "zz", sentence(rng, "aaa"), "x"), ("t", 2, "zz", sentence(rng, "aaa"), "x"), ("t", 3, "aaa", None, "x"), ("t", 4, "aaa", "nan", "x")]
    df = spark.createDataFrame(rows, "tbl string, rec_id long, label string, text string, lang string")
    out = L.identify(df, model).collect()
    assert sorted((r["rec_id"], r["seg_no"], r["lang"]) for r in out) == [(1, 1, "aaa"), (2, 1, "aaa"), (2, 1, "aaa")]
    assert all(0.5 <= r["confidence"] <= 1 for r in out)
    assert L.identify(df.limit(0), model).count() == 0


def test_training_without_labels(spark):
    df = spark.createDataFrame([(1, None, "a b c")], "rec_id long, lang string, text string")
    assert L.train(df) is None


def test_codewords_are_far_apart():
    for n in (2, 7, 11):
        c = L.code(n)
        least = min((c[i] != c[j]).sum() for i in range(n) for j in range(i))
        assert least >= (7 if n >= 5 else 1)


def test_codewords_of_many_languages():
    for n in (12, 15, 16, 20, 100):
        c = L.code(n)
        assert min((c[i] != c[j]).sum() for i in range(n) for j in range(i)) >= 7
        assert len({tuple(c[:, k]) for k in range(c.shape[1])}) == c.shape[1]


def test_twenty_languages(spark):
    rng = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {f"l{k:02d}": ["".join(rng.choices(rng.sample(letters, 6), k=rng.randrange(3, 7))) for _ in range(40)] for k in range(20)}
    text = lambda k: " ".join(rng.choices(words[k], k=9)) + "."
    rows = [(i, k, text(k) + " " + text(k)) for i, k in enumerate(list(words) * 40)]
    model = L.train(spark.createDataFrame(rows, "rec_id long, lang string, text string"))
    assert model.languages == sorted(words)
    texts = [(text(k), k) for k in words for _ in range(20)]
    got = L.labelled(model, pa.array([t for t, _ in texts]))
    assert sum([s[0] for s in g] == [k] for g, (_, k) in zip(got, texts)) / len(texts) > 0.98


def test_scripts_without_blanks():
    rng = random.Random(8)
    made = {"one": "日本語文字列漢字仮名", "two": "กขคงจฉชซญฎ"}
    texts = [("".join(rng.choices(made[k], k=60)), k) for k in made for _ in range(60)]
    model = L.fit(*zip(*texts))
    assert [[s[0] for s in g] for g in L.labelled(model, pa.array(["".join(rng.choices(made[k], k=80)) for k in made] + ["x" * 80]))] == [["one"], ["two"], []]


def test_training_takes_the_sample_by_hash_in_one_scan(spark):
    rows = [(i, f"l{i % 3}", f"text number {i}") for i in range(900)]
    df = spark.createDataFrame(rows, "rec_id long, lang string, text string")
    assert L.train(df, texts=20).languages == ["l0", "l1", "l2"]
    rows = df.selectExpr("lang", "xxhash64(rec_id) h", "rec_id", "text").coalesce(1)
    for n in (1, 7, 400):
        got = sorted(tuple(r) for r in rows.mapInArrow(L.least_of_each(n), rows.schema).collect())
        every = sorted(tuple(r) for r in rows.collect())
        assert got == [r for i, r in enumerate(every) if sum(q[0] == r[0] for q in every[:i]) < n]
