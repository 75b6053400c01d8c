"""Text functions. All are built-in column expressions but for Unicode normal forms and case folding,
which Spark lacks and Arrow UDFs supply."""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from weftline.functions import flat

#: Blanks of Unicode as one class: Java's \s and that of other engines leave some out.
WS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Kasra, damma, fatha, in the order of their labels 1, 2, 3.
MARKS = ["ِ", "ُ", "َ"]
MARK_NAMES = ["kasra", "damma", "fatha"]
ALL_MARKS = "".join(MARKS)
#: Code point ranges of scripts, as character classes.
ARABIC = r"\x{600}-\x{6ff}\x{750}-\x{77f}\x{8a0}-\x{8ff}\x{fb50}-\x{fdff}\x{fe70}-\x{feff}"
ARABIC_BASIC = r"\x{600}-\x{6ff}"
ARABIC_WIDE = r"\x{600}-\x{6ff}\x{fb50}-\x{feff}"
DEVANAGARI = r"\x{900}-\x{97f}"
LATIN_PUNCT, TARGET_PUNCT = ".,?!;:", "؛،٫؟۔٪"
#: Latin signs and the target script's.
PUNCT_FROM, PUNCT_TO = ".,?;%", "۔،؟؛٪"
ASCII_PUNCT = r"""!-/:-@\[-`{-~"""
#: Function words that mark text as Urdu.
MARKER_WORDS = (
    "ہے سے میں ہوا کا ایک تک دو سب کو میری جو کرنا وہ نے بہت اس لیے ساتھ گے گئی جاتا رہا گیا گا میرا بھی "
    "کچھ جاتی تھا آپ میرے نہیں گئے تھی لئے تھے کرتے اپنی ہوں اپنے جب کرتا ہوتا ہوئی سکتی کرتی لیکن اپنا سکتے "
    "چاہیے رہے ہوتے جاتے ہمارے ہوتی اسے سکتا ہمارا رہی ہوئے اسکا"
).split()
#: Signs taken from the ends of a word before it is compared with them.
EDGE_SIGNS = "۔،؟!.,?؛:\"'()«»…؍٫٪"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def flatten(c: Column | str) -> Column:
    """Every run of blanks as one space, none at the ends; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), WS + "+", " "))


def clean(c: Column | str) -> Column:
    """flatten, and the word nan in any case as empty."""
    flat = flatten(c)  # used twice on every row, so it is computed once
    return F.repeat(flat, (F.lower(flat) != "nan").cast("int"))


def not_blank(c: Column | str) -> Column:
    """Does the text hold more than blanks? A search that ends at the first other character: cheap in filters."""
    return F.coalesce(col(c).rlike(f"[^{WS[1:-1]}]"), F.lit(False))


def has_text(c: Column | str) -> Column:
    """Is clean(c) not empty? Without making it."""
    return F.coalesce(~col(c).rlike(f"^{WS}*(?i:nan)?{WS}*$"), F.lit(False))


def is_nan_like(c: Column | str) -> Column:
    return F.lower(flatten(c)).isin("", "nan", "none", "null")


def words(c: Column | str) -> Column:
    """Words between blanks; an empty array for an empty text."""
    return F.filter(F.split(flatten(c), " "), lambda x: x != "")


def n_words(c: Column | str) -> Column:
    """Runs of other characters than blanks; one search, nothing is flattened."""
    return F.regexp_count(F.coalesce(col(c), F.lit("")), F.lit(f"[^{WS[1:-1]}]+")).cast("long")


def count_of(c: Column | str, chars: str) -> Column:
    """Number of characters in the class, by what is left without runs of others."""
    return F.length(F.regexp_replace(col(c), f"[^[{chars}]]+", "")).cast("long")


def letterish(c: Column | str) -> Column:
    """What is neither blank nor punctuation, number, separator or control: letters, marks, symbols."""
    return F.regexp_replace(F.coalesce(col(c), F.lit("")), r"[^\p{L}\p{M}\p{S}]+", "")


def script_counts(c: Column | str) -> Column:
    """struct(letters, arabic, devanagari, latin, other) over letterish characters."""
    s = letterish(c)
    n, a, d, la = F.length(s).cast("long"), count_of(s, ARABIC), count_of(s, DEVANAGARI), count_of(s, "A-Za-z")
    return F.struct(n.alias("letters"), a.alias("arabic"), d.alias("devanagari"), la.alias("latin"), (n - a - d - la).alias("other"))


def arabic_share(c: Column | str, variant: str = "basic") -> Column:
    """Share of the Arabic script, in the named variant: basic and wide of letters, all of every character."""
    c = F.coalesce(col(c), F.lit(""))
    if variant == "all":
        return count_of(c, ARABIC_BASIC) / F.greatest(F.length(c), F.lit(1))
    range_ = ARABIC_BASIC if variant == "basic" else ARABIC_WIDE
    return count_of(c, rf"\p{{L}}&&[{range_}]") / F.greatest(count_of(c, r"\p{L}"), F.lit(1))


def has_devanagari(c: Column | str) -> Column:
    return F.coalesce(col(c).rlike(f"[{DEVANAGARI}]"), F.lit(False))


def strip_key(c: Column | str) -> Column:
    """Without the three restorable marks."""
    return F.translate(col(c), ALL_MARKS, "")


def mark_count(c: Column | str, every: bool = False) -> Column:
    return count_of(c, r"\p{Mn}" if every else ALL_MARKS)


def density(c: Column | str, every: bool = True) -> Column:
    """Marks per 100 characters of the text; 0 for an empty one."""
    return F.when(F.length(col(c)) > 0, mark_count(c, every) * 100.0 / F.length(col(c))).otherwise(0.0)


def map_punctuation(c: Column | str) -> Column:
    return F.translate(col(c), PUNCT_FROM, PUNCT_TO)


def loose_key(c: Column | str) -> Column:
    """Lower case, marks dropped, whatever is no letter or digit as one space. Precomposed letters stay."""
    s = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"\p{Mn}", "")
    return F.trim(F.lower(F.regexp_replace(s, r"[^\p{L}\p{N}_]+", " ")))


def exact_key(t: str) -> str:
    """loose_key of one text by Unicode's rules: decomposed, combining marks dropped, recomposed, case-folded."""
    t = "".join(x for x in unicodedata.normalize("NFD", t) if not unicodedata.combining(x))
    t = unicodedata.normalize("NFC", t)
    return " ".join("".join(x if x.isalnum() or x == "_" else " " for x in t).split()).casefold()


@functools.cache
def _joining() -> frozenset[int]:
    """Code points without a class that compose with the one before them, from Unicode's tables."""
    parts = (unicodedata.decomposition(chr(cp)).split() for cp in range(0x110000))
    seconds = {int(p[1], 16) for p in parts if len(p) == 2 and p[0][0] != "<"}
    return frozenset(cp for cp in seconds if not unicodedata.combining(chr(cp))) | frozenset([*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)])


#: What a code point becomes in exact_key, once it was met: itself folded, 0 for nothing, 32 for a blank, ODD where its text
#: must be taken as a whole.
UNMET, ODD = 0xFFFFFFFF, 0xFFFFFFFE
_folded: np.ndarray | None = None


def _fold(cps: np.ndarray) -> np.ndarray:
    global _folded
    if _folded is None:
        _folded = np.full(0x110000, UNMET, np.uint32)
    for cp in np.flatnonzero(np.bincount(cps[_folded[cps] == UNMET])).tolist():
        key = exact_key(f"a{chr(cp)}a")[1:-1]  # between letters, so that a blank stays
        _folded[cp] = ODD if cp in _joining() or len(key) > 1 else ord(key) if key else 0
    return _folded[cps]


@F.arrow_udf(StringType())
def loose_key_exact(c: pa.Array) -> pa.Array:
    """exact_key of a column, all texts of a part at once but for those with a code point that depends on its neighbours."""
    out: list[str] = []
    for _, part in flat.slices(c):
        cps, starts = flat.decode(part)
        value = _fold(cps)
        odd = np.add.reduceat(np.append(value == ODD, False), starts[:-1]) * (np.diff(starts) > 0)
        value, starts = flat.compact(value, starts, (value != 0) & (value != ODD))
        row = flat.row_ids(starts)
        solid = value != 32
        after = np.append(True, (row[1:] != row[:-1]) | ~solid[:-1]) if len(row) else np.zeros(0, bool)  # at the start or after a blank
        value, starts = flat.compact(value, starts, solid | ~after)
        text, ends = value.tobytes().decode("utf-32-le", "surrogatepass"), starts.tolist()
        keys = [text[a:b].rstrip(" ") for a, b in zip(ends, ends[1:])]
        whole = np.flatnonzero(odd)
        for k, t in zip(whole.tolist(), part.take(pa.array(whole)).to_pylist()):
            keys[k] = exact_key(t)
        out += keys
    return pa.array([None if null else x for x, null in zip(out, c.is_null().to_pylist())], pa.string())


def normal_form(c: Column | str, form: str) -> Column:
    """NFC, NFD, NFKC or NFKD."""

    @F.arrow_udf("string")
    def run(t: pa.Array) -> pa.Array:
        return pa.array([None if x is None else unicodedata.normalize(form, x) for x in t.to_pylist()], pa.string())

    return run(col(c))


def grams(c: Column | str, n: int = 5) -> Column:
    """Distinct runs of n characters; a shorter text is its only run, an empty one has none. Give it a plain column."""
    s = col(c)
    all_ = F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - (n - 1), F.lit(1))), lambda i: F.substr(s, i, F.lit(n)))
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.array_distinct(all_))


def marker_fraction(c: Column | str) -> Column:
    """Share of the words that are marker words once signs at their ends are taken off."""
    w = words(c)
    known = F.array(*(F.lit(x) for x in MARKER_WORDS))
    hits = F.size(F.filter(w, lambda x: F.array_contains(known, F.btrim(x, F.lit(EDGE_SIGNS)))))
    return F.when(F.size(w) > 0, hits / F.size(w)).otherwise(0.0)


def normalize(
    c: Column | str, unicode_form: str | None = None, strip_joiner: bool = False, punctuation: bool = False,
    scorer=None, collapse: bool = True,
) -> Column:
    """One cell: null and nan as empty, then the steps chosen, in this order; scorer is any column function."""
    c = col(c)
    c = F.when(c.isNull() | (F.lower(c) == "nan"), "").otherwise(c)
    if unicode_form:
        c = normal_form(c, unicode_form)
    if strip_joiner:
        c = F.replace(c, F.lit("‍"), F.lit(""))
    if punctuation:
        c = map_punctuation(c)
    if scorer:
        c = scorer(c)
    if collapse:
        c = F.regexp_replace(c, r"[ \t]{2,}", " ")
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def composition_counts(c: Column | str, pairs: list[tuple[str, str]]) -> Column:
    """struct of occurrences of each precomposed letter and its sequence."""
    out = []
    for pre, seq in pairs:
        out += [F.regexp_count(col(c), F.lit(pre)).alias(f"pre_{ord(pre):04x}"), F.regexp_count(col(c), F.lit(seq)).alias(f"seq_{ord(pre):04x}")]
    return F.struct(*out)


def is_nfc(c: Column | str) -> Column:
    @F.arrow_udf("boolean")
    def run(t: pa.Array) -> pa.Array:
        return pa.array([None if x is None else unicodedata.is_normalized("NFC", x) for x in t.to_pylist()], pa.bool_())

    return run(col(c))
