"""Problem 2: missing or wrong document language labels.

Error-correcting output codes: every language has a codeword; for each bit of it a binary classifier
over hashed n-grams of characters (naive Bayes, of all languages with the bit set, each with equal weight, against
the others) votes with a margin. Loss-weighted decoding takes the codeword nearest to the margins, each
bit weighted by how well its classifier did on the training texts of that language; the distance to the
next codeword gives the confidence and flags ambiguity. Sentences (or windows of words, where a text
has no sentence ends) are decoded, and a text's most likely sequence of languages is found with a
cost for each change, so that names or a stray word do not make a segment.

The classifiers are fitted on a bounded sample of labelled rows, TRAIN_TEXTS a label, and refitted
without the rows that they contradict. Everything else runs over whole texts of all rows.

Defined cases: null, blank and `nan` texts have no language; nor have texts of codes, digits or runs of
over LONG_WORD letters only (but in scripts written without blanks), which give no row; a null or unknown label is wrong for any language;
ties go to the language first in the alphabet; repeated rows each give theirs; an empty table gives an
empty result; with no labelled rows there is no model, and no rows come out.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import flat
from weftline.llm.common import has_text, table

#: The bounded sample of labelled rows: rows a label, and the most characters of such a row.
TRAIN_TEXTS, TRAIN_CHARS = 400, 4000
BUCKETS = 1 << 16
#: Characters in the n-grams of a word, its ends marked; the whole word is a feature too.
ORDERS = (1, 2, 3)
LONG_WORD = 30
#: A sentence of more words than LONG_SENTENCE is cut into windows of WINDOW words.
LONG_SENTENCE, WINDOW = 40, 10
#: A change of language must pay for so many words of the usual difference between languages.
CHANGE_WORDS = 2.5
#: Below this confidence a text counts as ambiguous.
AMBIGUOUS = 0.6
#: Rows of the Hadamard matrix of 16 whose columns are all different: the codewords of up to 11 languages.
CODE_ROWS = (1, 2, 4, 8, 7, 11, 13, 14, 3, 5, 9)
#: Different labels from which on the column is taken for something else than languages, which is an error.
MOST_LABELS = 1000
#: Ranges of code points of scripts that are written without blanks.
UNSPACED = ((0x0E00, 0x0F00), (0x1000, 0x10A0), (0x1780, 0x1800), (0x3040, 0x3100), (0x3400, 0xA000), (0xF900, 0xFB00), (0x20000, 0x32000))

SKIP, BLANK, BREAK, LETTER, DIGIT, STOP, OTHER = range(7)
_tables: tuple[np.ndarray, np.ndarray] | None = None


def tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: its kind, and its lower-case, width-folded form."""
    global _tables
    if _tables is None:
        kind, fold = np.full(0x110000, LETTER, np.uint8), np.arange(0x110000, dtype=np.uint32)
        for cp in range(0x110000):
            if 0x3400 <= cp < 0xA000 or 0xAC00 <= cp < 0xF900 or 0x20000 <= cp < 0xE0000 or cp >= 0xF0000:
                continue
            ch = chr(cp)
            c = unicodedata.category(ch)
            if ch in "\n\r\v\f\u0085  ":
                kind[cp] = BREAK
            elif ch.isspace() or c[0] == "Z":
                kind[cp] = BLANK
            elif c[0] == "C":
                kind[cp] = SKIP
            elif c[0] == "N":
                kind[cp] = DIGIT
            elif ch in ".!?۔؟।॥…":
                kind[cp] = STOP
            elif c[0] in "PS":
                kind[cp] = OTHER
            fold[cp] = ord((unicodedata.normalize("NFKC", ch)[:1] or ch).lower()[0])
        _tables = kind, fold
    return _tables


def code(n: int) -> np.ndarray:
    """Codewords of n languages, -1 or 1: Hadamard rows without columns in which all agree.

    Any two differ in half of the bits; there are 15 bits for up to 15 languages, and less than twice as many as languages for more.
    """
    size = max(16, 1 << n.bit_length())
    rows = CODE_ROWS[:n] if n <= len(CODE_ROWS) else range(1, n + 1)
    h = np.array([[1 - 2 * ((i & j).bit_count() % 2) for j in range(1, size)] for i in rows], np.float32)
    return h[:, np.abs(h.sum(0)) < n] if n > 1 else h


@dataclass
class Units:
    """Words of a batch with language, and the sentences or windows (units) and rows they are in."""

    letters: np.ndarray  # folded letters of all kept words
    word: np.ndarray  # starts of the words among the letters
    unit: np.ndarray  # starts of the units among the words
    row: np.ndarray  # starts of the rows among the units


def units(part: pa.Array) -> Units:
    kind_of, fold = tables()
    cps, starts = flat.decode(part)
    kind = kind_of[cps]
    cps, starts = flat.compact(cps, starts, kind != SKIP)
    kind = kind_of[cps]
    n = len(cps)
    solid = np.zeros(n + 2, bool)
    solid[1:-1] = kind > BREAK
    new_row = np.zeros(n + 1, bool)
    new_row[starts] = True
    begin = np.flatnonzero(solid[1:-1] & (~solid[:-2] | new_row[:-1]))
    end = np.flatnonzero(solid[1:-1] & (~solid[2:] | new_row[1:])) + 1
    count = lambda flags: np.concatenate([[0], np.cumsum(flags)])
    letter, digit, line = count(kind == LETTER), count(kind == DIGIT), count(kind == BREAK)
    n_letters = letter[end] - letter[begin]
    unspaced = np.zeros(n, bool)
    for low, high in UNSPACED:
        unspaced |= (cps >= low) & (cps < high)
    dense = count(unspaced)
    kept = (n_letters > 0) & (digit[end] == digit[begin]) & ((n_letters <= LONG_WORD) | (2 * (dense[end] - dense[begin]) > n_letters))
    # a sentence ends with a stop at the end of a word, perhaps before a closing sign, or at a line end
    last, last2 = kind[end - 1], kind[np.maximum(end - 2, begin)]
    stop = (last == STOP) | ((last == OTHER) & (last2 == STOP))
    following = np.append(begin[1:], n)
    stop |= line[np.maximum(following, end)] > line[end]
    row_of = np.searchsorted(starts, begin, "right") - 1
    first = np.ones(len(begin), bool)
    first[1:] = stop[:-1] | (row_of[1:] != row_of[:-1])
    sentence = np.cumsum(first)[kept]
    begin, end, row_of = begin[kept], end[kept], row_of[kept]
    m = len(begin)
    head = np.ones(m, bool)
    head[1:] = sentence[1:] != sentence[:-1]
    # windows in long sentences
    at = np.flatnonzero(head)
    size = np.diff(np.append(at, m))
    offset = np.arange(m) - np.repeat(at, size)
    long = np.repeat(size > LONG_SENTENCE, size)
    left = np.repeat(size, size) - offset
    head |= long & (offset % WINDOW == 0) & (left >= WINDOW // 2)
    unit = np.flatnonzero(head)
    inside = np.zeros(n + 1, np.int64)
    np.add.at(inside, begin, 1)
    np.add.at(inside, end, -1)
    keep = (np.cumsum(inside)[:n] > 0) & (kind == LETTER)
    letters, word = flat.compact(fold[cps], np.append(begin, n) if m else np.zeros(1, np.int64), keep)
    if m:
        word[-1] = len(letters)
    return Units(letters, word, np.append(unit, m), np.searchsorted(row_of[unit], np.arange(len(starts))))


def distinct_words(u: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of each word among the distinct ones, features of these, starts of the features)."""
    h = flat.span_hash(flat.prefix_hash(u.letters), u.word[:-1], u.word[1:])
    _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    begin, size = u.word[first], u.word[first + 1] - u.word[first]
    # the letters of distinct words with a mark at both ends, value 1
    total = size + 2
    at = np.concatenate([[0], np.cumsum(total)])
    word = np.repeat(np.arange(len(size)), total)
    offset = np.arange(at[-1]) - at[word] - 1
    edge = (offset < 0) | (offset >= size[word])
    chars = np.where(edge, np.uint32(1), u.letters[np.minimum(begin[word] + np.maximum(offset, 0), max(len(u.letters) - 1, 0))])
    prefix = flat.prefix_hash(chars)
    out, owner = [h[first]], [np.arange(len(size))]
    for k in ORDERS:
        i = np.flatnonzero(np.arange(at[-1]) + k <= at[word + 1])
        i = i[~edge[i]] if k == 1 else i
        out.append(flat.span_hash(prefix, i, i + k) + np.uint64(k))
        owner.append(word[i])
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    features = (np.concatenate(out)[order] >> np.uint64(48)).astype(np.int64) % BUCKETS
    return inverse, features, np.searchsorted(owner[order], np.arange(len(size)))


@dataclass
class Model:
    languages: list[str]
    bits: np.ndarray  # codewords, languages x bits
    weights: np.ndarray  # BUCKETS x bits: the binary classifiers
    trust: np.ndarray  # languages x bits: weight of a bit's loss for a language
    gap: float  # usual difference a word between the best and the next language

    def costs(self, u: Units) -> tuple[np.ndarray, np.ndarray]:
        """Decoding costs of all units, units x languages, and their numbers of words."""
        n = np.diff(u.unit)
        if not len(n):
            return np.zeros((0, len(self.languages)), np.float32), n
        inverse, features, at = distinct_words(u)
        margins = np.add.reduceat(self.weights[features], at, axis=0)
        margins /= np.diff(np.append(at, len(features)))[:, None]
        margins = np.add.reduceat(margins[inverse], u.unit[:-1], axis=0) / n[:, None]
        cost = np.zeros((len(n), len(self.languages)), np.float32)
        for k in range(len(self.languages)):
            cost[:, k] = np.logaddexp(0, -SHARP * margins * self.bits[k]) @ self.trust[k]
        return cost * n[:, None].astype(np.float32), n


#: Scale of the mean margins in the loss log(1 + exp(-SHARP * margin)).
SHARP = 4.0


def fit(texts: list[str], labels: list[str]) -> Model | None:
    """From labelled texts; texts that the first fit contradicts are left out of the second."""
    names = sorted(set(labels))
    if not names:
        return None
    u = units(pa.array(texts, pa.large_string()))
    y = np.array([names.index(x) for x in labels])
    row_words = u.unit[u.row]
    inverse, features, at = distinct_words(u)
    sizes = np.diff(np.append(at, len(features)))
    word_row = np.repeat(np.arange(len(texts)), np.diff(row_words))
    good, model = np.ones(len(texts), bool), None
    bits = code(len(names))
    for _ in range(3):
        prob = np.zeros((len(names), BUCKETS))
        for k in range(len(names)):
            mine = np.bincount(inverse[(good & (y == k))[word_row]], minlength=len(sizes)).astype(np.float64)
            c = np.bincount(features, np.repeat(mine, sizes), BUCKETS)
            prob[k] = (c + 0.02) / (c.sum() + 0.02 * BUCKETS)
        weights = np.zeros((BUCKETS, bits.shape[1]), np.float32)
        for b in range(bits.shape[1]):
            weights[:, b] = np.log(prob[bits[:, b] > 0].mean(0) / prob[bits[:, b] < 0].mean(0))
        model = Model(names, bits, weights, np.full(bits.shape, 1 / bits.shape[1], np.float32), 1.0)
        cost, n = model.costs(u)
        unit_row = np.repeat(np.arange(len(texts)), np.diff(u.row))
        total = np.zeros((len(texts), len(names)))
        np.add.at(total, unit_row, cost)
        good = total.argmin(1) == y
    # trust in a bit for a language: one minus its error on the language's sentences
    margin = np.add.reduceat(weights[features], at, axis=0) / sizes[:, None]
    margin = np.add.reduceat(margin[inverse], u.unit[:-1], axis=0)
    for k in range(len(names)):
        own = (good & (y == k))[unit_row]
        if own.any():
            model.trust[k] = np.maximum(0.05, (margin[own] * bits[k] > 0).mean(0))
    model.trust /= model.trust.sum(1, keepdims=True)
    cost, n = model.costs(u)
    own = good[unit_row] & (n > 3)
    if own.any() and len(names) > 1:
        per_word = np.sort(cost[own] / n[own, None], axis=1)
        model.gap = float(np.median(per_word[:, 1] - per_word[:, 0]))
    return model


def best_path(cost: np.ndarray, change: float) -> np.ndarray:
    """The cheapest sequence of languages, each change costing so much; ties to the first language."""
    back = np.zeros(cost.shape, np.int64)
    total = cost[0].astype(np.float64)
    for i in range(1, len(cost)):
        best = int(total.argmin())
        stay = total <= total[best] + change
        back[i] = np.where(stay, np.arange(len(total)), best)
        total = np.where(stay, total, total[best] + change) + cost[i]
    path = np.zeros(len(cost), np.int64)
    path[-1] = total.argmin()
    for i in range(len(cost) - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def labelled(model: Model, part: pa.Array) -> list[list[tuple[str, float]]]:
    """For each text its segments in order: (language, confidence)."""
    u = units(part)
    cost, n = model.costs(u)
    change = CHANGE_WORDS * model.gap
    rows = len(u.row) - 1
    out: list[list[tuple[str, float]]] = [[] for _ in range(rows)]
    some = np.flatnonzero(np.diff(u.row))
    if not len(some):
        return out
    total = np.add.reduceat(cost, u.row[some], axis=0)
    words = np.add.reduceat(n, u.row[some])
    best = total.argmin(1)
    unit_row = np.repeat(np.arange(len(some)), np.diff(u.row)[some])
    gain = cost[np.arange(len(cost)), best[unit_row]] - cost.min(1)
    may_change = np.add.reduceat(gain, u.row[some]) > change
    sure = confidence(model, total, words)
    for k, row in enumerate(some):
        if not may_change[k]:
            out[row] = [(model.languages[best[k]], float(sure[k]))]
            continue
        a, b = u.row[row], u.row[row + 1]
        path = best_path(cost[a:b], change)
        at = np.concatenate([[0], np.flatnonzero(np.diff(path)) + 1])
        part_cost, part_words = np.add.reduceat(cost[a:b], at, axis=0), np.add.reduceat(n[a:b], at)
        out[row] = [(model.languages[path[i]], float(s)) for i, s in zip(at, confidence(model, part_cost, part_words))]
    return out


def confidence(model: Model, cost: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Between 0.5 for two equally near codewords and 1: by the mean difference a word to the next one."""
    if cost.shape[1] < 2:
        return np.ones(len(cost))
    two = np.partition(cost, 1, axis=1)[:, :2]
    return 1 / (1 + np.exp(-4 * np.minimum(5, np.abs(two[:, 1] - two[:, 0]) / np.maximum(words, 1) / max(model.gap, 1e-6))))


SEGMENTS = "tbl string, rec_id long, label string, seg_no int, segments int, lang string, confidence double, ambiguous boolean"


def segmented(shared) -> object:
    """mapInArrow: (tbl, rec_id, label, text) -> SEGMENTS, a row for each single-language stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            for first, part in flat.slices(batch.column(3)):
                rows = batch.slice(first, len(part))
                found = labelled(model, part)
                n = np.array([len(f) for f in found])
                take = pa.array(np.repeat(np.arange(len(found)), n))
                flatly = [s for f in found for s in f]
                sure = np.array([s[1] for s in flatly], np.float64)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(rows.column(k).take(take) for k in range(3)),
                        pa.array([i for f in found for i in range(1, len(f) + 1)], pa.int32()), pa.array(np.repeat(n, n).astype(np.int32)),
                        pa.array([s[0] for s in flatly], pa.string()), pa.array(sure), pa.array(sure < AMBIGUOUS),
                    ],
                    ["tbl", "rec_id", "label", "seg_no", "segments", "lang", "confidence", "ambiguous"],
                )

    return run


def least_of_each(n: int):
    """mapInArrow: (lang, h, rec_id, text) -> the n rows of the least h, then rec_id, of each label of the partition.

    Some n rows a label are held at most; texts that cannot be among them are not looked at.
    """

    def cut(kept: list[pa.RecordBatch]) -> tuple[pa.Table, dict[str, int]]:
        rows = pa.Table.from_batches(kept).sort_by([("lang", "ascending"), ("h", "ascending"), ("rec_id", "ascending")])
        label = rows.column("lang").combine_chunks().dictionary_encode().indices.to_numpy()
        place = np.arange(len(label)) - np.searchsorted(label, label)
        rows, last = rows.filter(pa.array(place < n)), rows.filter(pa.array(place == n - 1))
        return rows, dict(zip(last.column("lang").to_pylist(), last.column("h").to_pylist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        most: dict[str, int] = {}
        for batch in batches:
            label = batch.column(0).dictionary_encode()
            limit = np.array([most.get(x, np.iinfo(np.int64).max) for x in label.dictionary.to_pylist()], np.int64)
            rows = batch.filter(pa.array(batch.column(1).to_numpy() <= limit[label.indices.to_numpy()]))
            if len(rows):
                kept.append(rows)
            if sum(map(len, kept)) > 4 * n * max(1, len(most)):
                rows, most = cut(kept)
                kept = rows.combine_chunks().to_batches()
        if kept:
            yield from cut(kept)[0].to_batches()

    return run


def train(labels: DataFrame, texts: int = TRAIN_TEXTS, chars: int = TRAIN_CHARS) -> Model | None:
    """(rec_id, lang, text): a model from at most `texts` rows a label, chosen by a hash of rec_id, in one scan."""
    ok = labels.where(has_text("text") & F.col("lang").isNotNull() & (F.length("text") <= chars))
    few = ok.select("lang", F.xxhash64("rec_id").alias("h"), "rec_id", "text").mapInArrow(least_of_each(texts), "lang string, h long, rec_id long, text string")
    order = Window.partitionBy("lang").orderBy("h", "rec_id")
    rows = few.withColumn("n", F.row_number().over(order)).where(F.col("n") <= texts).select("text", "lang").limit(MOST_LABELS * texts).collect()
    names = {r["lang"] for r in rows}
    if len(names) >= MOST_LABELS:
        raise ValueError(f"{len(names)} labels or more are no languages")
    rows.sort()
    return fit([r["text"] for r in rows], [r["lang"] for r in rows])


def identify(texts: DataFrame, model: Model) -> DataFrame:
    """(tbl, rec_id, label, text) -> SEGMENTS."""
    shared = texts.sparkSession.sparkContext.broadcast(model)
    return texts.select("tbl", "rec_id", "label", "text").where(has_text("text")).mapInArrow(segmented(shared), SEGMENTS)


def all_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda t, i, lab, x: table(spark, sf_dir, t).select(F.lit(t).alias("tbl"), F.col(i).alias("rec_id"), F.col(lab).alias("label"), F.col(x).alias("text"))
    return one("raw_pairs", "row_id", "tgt_lang", "tgt").unionByName(one("pool_pairs", "row_id", "t_lang", "t")).unionByName(one("documents", "doc_id", "lang", "text"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("rec_id"), "lang", "text")
    model = train(docs)
    if model is None:
        return spark.createDataFrame([], SEGMENTS)
    return identify(all_texts(spark, sf_dir), model)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrong = F.col("label").isNull() | (F.col("label") != F.col("lang")) | (F.col("segments") > 1)
    return segments(spark, sf_dir).where(wrong).select("tbl", "rec_id", "seg_no", "lang")


def p2_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment of every text with its language and confidence."""
    found = segments(spark, sf_dir)
    return found.select("tbl", "rec_id", "seg_no", "lang", F.round("confidence", 6).alias("confidence"), "ambiguous")


QUERIES = {"p2_found": p2_found, "p2_labels": p2_labels}
