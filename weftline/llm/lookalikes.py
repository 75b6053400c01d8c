"""Problem 1: visually identical text with different characters.

Look-alike strings (single code points and sequences) form classes: union-find closes over canonical
and presentation-form decompositions, kinds of blanks, invisible characters and a table of letters
and digits of one shape. The representative of a class is its most frequent member in the corpus,
counted over all rows. Texts are rewritten greedily (leftmost, longest) by an Aho-Corasick automaton
over all members that are not representatives, between canonical decomposition (which also sorts
the marks) and composition. Texts without any such member, the usual case, never reach the automaton.

Letters and digits that only some typefaces draw alike (l, I and 1; O and 0) are not linked, nor are quotation marks
or dashes of different lengths.

Defined cases: null texts stay null and, like blank ones and the word `nan`, are in no pair; an empty
text is rewritten to itself; texts are taken whole, however long; a tie in frequency goes to the
string of more code points and then to the lower one; repeated rows form pairs only with rows that
differ; columns other than those named are ignored; empty tables give empty results.
"""

from __future__ import annotations

import functools
import hashlib
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import flat
from weftline.llm.common import has_text, join_groups, sql_has_text, stored, table, unlike_pairs

#: Letters and digits of one shape, each line one class.
SAME_SHAPE = """
A Α А
B Β В
C С Ϲ
E Ε Е
H Η Н
I Ι І
J Ј
K Κ К
M Μ М
N Ν
O Ο О
P Ρ Р
S Ѕ
T Τ Т
X Χ Х
Y Υ Ү
Z Ζ
a а
c с ϲ
e е
h һ
i і
j ј
o ο о
p р
s ѕ
x х
y у
ی ي ى
ک ك
ہ ه
۰ ٠
۱ ١
۲ ٢
۳ ٣
۷ ٧
۸ ٨
۹ ٩
"""
#: Hyphens that are drawn as the one of the keyboard.
HYPHENS = "-\u2010\u2011"
#: Decompositions under these tags change the form of a letter or blank, not its look.
FORM_TAGS = {"<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>", "<noBreak>", "<font>"}
#: Invisible besides the format characters: joiners, fillers and variation selectors.
INVISIBLE = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
#: Format characters that show: signs spanning numbers or marking verses.
VISIBLE_FORMAT = {*range(0x0600, 0x0606), 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD}


class UnionFind:
    """Disjoint sets of strings, with path compression."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        root = x
        while self.parent.setdefault(root, root) != root:
            root = self.parent[root]
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def classes(self) -> list[list[str]]:
        out: dict[str, list[str]] = {}
        for x in list(self.parent):
            out.setdefault(self.find(x), []).append(x)
        return [sorted(m) for m in out.values()]


def links(cp: int) -> str | None:
    """The string that this code point looks like by its Unicode properties, if any; in NFD."""
    ch = chr(cp)
    kind = unicodedata.category(ch)
    if kind in {"Zs", "Zl", "Zp"} or ch in "\t\n\r\v\f\x1c\x1d\x1e\x1f\x85":
        return " "
    if cp in INVISIBLE or kind == "Cf" and cp not in VISIBLE_FORMAT:
        return ""
    tag, _, rest = unicodedata.decomposition(ch).partition(" ")
    if ch in HYPHENS:
        return HYPHENS[0]
    parts = "".join(chr(int(x, 16)) for x in rest.split()) if tag in FORM_TAGS or tag == "<compat>" else ""
    # of the looser kind only joined letters, dots in a row and Roman numerals are drawn as their parts
    drawn = parts.replace(".", "").isalpha() or set(parts) == {"."}
    if tag in FORM_TAGS or parts.isascii() and drawn and (len(parts) > 1 or 0x2160 <= cp < 0x2180):
        return unicodedata.normalize("NFD", parts)
    return None


@functools.cache
def known_strings() -> tuple[str, ...]:
    """Sequences of two or more code points that look like a single one, in NFD; a table of Unicode."""
    found = {s for cp in range(0x110000) if not 0xD800 <= cp < 0xE000 and (s := links(cp)) and len(s) > 1}
    return tuple(sorted(found))


@functools.cache
def decomposed() -> tuple[tuple[int, list[int]], ...]:
    """Code points with a canonical decomposition, and its code points; a table of Unicode."""
    every = ((cp, unicodedata.normalize("NFD", chr(cp))) for cp in range(0x110000) if not 0xD800 <= cp < 0xE000)
    return tuple((cp, [ord(c) for c in s]) for cp, s in every if s != chr(cp))


def count_strings(text: DataFrame) -> dict[str, int]:
    """Frequencies of all code points and known sequences over all rows of the one column given.

    The result is bounded by the size of Unicode, not by the data.
    """
    pairs = sorted({s[:2] for s in known_strings()})
    firsts = np.array(sorted({ord(p[0]) for p in pairs}), np.uint32)
    keys = np.array(sorted((ord(p[0]) << 21) | ord(p[1]) for p in pairs), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ones, twos = np.zeros(0x110000, np.int64), np.zeros(len(keys), np.int64)
        lead = np.zeros(0x110000, bool)
        lead[firsts] = True
        for batch in batches:
            for _, part in flat.slices(batch.column(0)):
                cps, _ = flat.decode(part)
                n = np.bincount(cps)
                ones[: len(n)] += n
                at = np.flatnonzero(lead[cps[:-1]])
                key = (cps[at].astype(np.int64) << 21) | cps[at + 1]
                slot = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                twos += np.bincount(slot[keys[slot] == key], minlength=len(keys))
        cp, two = np.flatnonzero(ones), np.flatnonzero(twos)
        names = [chr(c) if not 0xD800 <= c < 0xE000 else "�" for c in cp] + [chr(k >> 21) + chr(k & 0x1FFFFF) for k in keys[two]]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate([ones[cp], twos[two]]))], ["string", "n"])

    counted = text.mapInArrow(run, "string string, n long").groupBy("string").agg(F.sum("n").alias("n"))
    return {r["string"]: r["n"] for r in counted.toLocalIterator()}


def rewrites(counts: dict[str, int]) -> dict[str, str]:
    """Member -> representative for every look-alike string that is not a representative itself."""
    sets = UnionFind()
    for line in SAME_SHAPE.split("\n"):
        for x in line.split()[1:]:
            sets.union(line.split()[0], x)
    for s in counts:
        if len(s) == 1 and (like := links(ord(s))) is not None and like != s:
            sets.union(s, like)
    for s in known_strings():  # sequences are the same if their parts are, part by part
        if s in sets.parent:
            sets.union(s, "".join(sets.find(c) if len(sets.find(c)) == 1 else c for c in s))

    def weight(s: str) -> int:  # a sequence also counts where it is written as one composed character
        whole = unicodedata.normalize("NFC", s)
        return counts.get(s[:2] if len(s) > 1 else s, 0) + (counts.get(whole, 0) if len(whole) == 1 and whole != s else 0)

    out = {}
    for members in sets.classes():
        best = "" if "" in members else " " if " " in members else max(members, key=lambda s: (weight(s), len(s), s[::-1]))
        out |= {m: best for m in members if m != best and m}
    for m, best in out.items():  # parts of a chosen sequence are brought to their own representatives
        out[m] = "".join(out.get(c, c) for c in best) if len(best) > 1 else best
    return out


class Canonicaliser:
    """Rewrites texts by the given map; picklable, the automaton is built once in each worker."""

    def __init__(self, table: dict[str, str]) -> None:
        self.table = table

    def __reduce__(self):
        return Canonicaliser, (self.table,)

    @functools.cached_property
    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for member, best in self.table.items():
            found.add_word(member, (len(member), best))
        found.make_automaton()
        return found

    @functools.cached_property
    def touched(self) -> np.ndarray:
        """By code point: does its canonical decomposition hold the first character of a member?

        Ordinary blanks count as the space, which they become in any case.
        """
        flags = np.zeros(0x110000, bool)
        for member in self.table:
            flags[ord(member[0])] = True
        for cp, parts in decomposed():
            flags[cp] |= flags[parts].any()
        flags[[9, 10, 11, 12, 13]] = flags[32]
        return flags

    def rewrite(self, text: str) -> str:
        """Greedy passes until nothing changes: what stood around an invisible character may form a member."""
        while True:
            text = unicodedata.normalize("NFD", text)
            out, at = [], 0
            for end, (n, best) in self.automaton.iter_long(text):
                out += [text[at : end + 1 - n], best]
                at = end + 1
            if not out:
                return unicodedata.normalize("NFC", text)
            new = unicodedata.normalize("NFD", "".join([*out, text[at:]]))
            if new == text:
                return unicodedata.normalize("NFC", text)
            text = new

    def many(self, part: pa.Array) -> list[str | None]:
        """The canonical texts; blanks are single spaces, none at the ends."""
        cps, starts = flat.decode(part)
        hits = np.zeros(len(cps) + 1, np.int64)
        np.cumsum(self.touched[cps], out=hits[1:])
        slow = hits[starts[1:]] > hits[starts[:-1]]
        out: list[str | None] = []
        for text, hard in zip(part.to_pylist(), slow.tolist()):
            if text is not None:
                text = self.rewrite(text) if hard else text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
                text = " ".join(text.split())
            out.append(text)
        return out


def canonicaliser(text: DataFrame) -> Canonicaliser:
    """Fitted to the frequencies of the one column given, over all rows."""
    return Canonicaliser(rewrites(count_strings(text)))


def canonical_text(fitted: Canonicaliser):
    """A column function: text -> its consistent form."""

    @F.arrow_udf("string")
    def run(text: pa.Array) -> pa.Array:
        out: list[str | None] = []
        for _, part in flat.slices(text):
            out += fitted.many(part)
        return pa.array([None if null else x for x, null in zip(out, text.is_null().to_pylist())], pa.string())

    return run


def digests(fitted: Canonicaliser):
    """mapInArrow function: (tbl, id, text) -> (tbl, id, look, chars).

    look is the digest of the canonical form, chars that of the characters; ordinary blanks count as
    one space in both.
    """

    def digest(x: bytes) -> bytes:
        return hashlib.blake2b(x, digest_size=16).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            look, chars = [], []
            for _, part in flat.slices(batch.column(2)):
                for raw, text in zip(part.cast(pa.large_binary()).to_pylist(), fitted.many(part)):
                    plain, best = b" ".join(raw.split()), text.encode()
                    look.append(digest(best))
                    chars.append(look[-1] if plain == best else digest(plain))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(look, pa.binary()), pa.array(chars, pa.binary())], ["tbl", "id", "look", "chars"])

    return run


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "raw_pairs").select(F.lit("raw_pairs").alias("tbl"), F.col("row_id").alias("id"), F.col("tgt").alias("text"))
    pool = table(spark, sf_dir, "pool_pairs").select(F.lit("pool_pairs").alias("tbl"), F.col("row_id").alias("id"), F.col("t").alias("text"))
    return raw.unionByName(pool).where(has_text("text"))


def lookalike_pairs(texts: DataFrame) -> DataFrame:
    """(tbl, id, text) -> (tbl, id_a, id_b): rows that look the same and are not the same characters."""
    fitted = canonicaliser(texts.select("text"))
    keys = stored(texts.select("tbl", "id", "text").mapInArrow(digests(fitted), "tbl string, id long, look binary, chars binary"))
    groups = keys.groupBy("tbl", "look").agg(F.min("chars").alias("low"), F.max("chars").alias("high"), F.count("*").alias("n"))
    mixed = stored(groups.where("low <> high").select("tbl", "look", "n"))
    rows = stored(join_groups(keys, mixed, ["tbl", "look"], "n").select("tbl", "look", "chars", "id"))
    pairs = unlike_pairs(rows, ["tbl", "look"], "chars", "id").where("a_id <> b_id")
    return pairs.select("tbl", F.least("a_id", "b_id").alias("id_a"), F.greatest("a_id", "b_id").alias("id_b"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike_pairs(targets(spark, sf_dir))


def p1_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every target in its consistent form."""
    texts = targets(spark, sf_dir)
    return texts.select("tbl", "id", canonical_text(canonicaliser(texts.select("text")))("text").alias("text"))


def _drawn() -> str:
    """Rows (a, b) of SQL: characters that are drawn as other ones, one by one, by the rules above."""
    same = {c: line.split()[0] for line in SAME_SHAPE.split("\n") for c in line.split()}

    def drawn(c: str) -> str:
        like = links(ord(c))
        return same.get(c, c) if like is None or like == c else "".join(drawn(x) for x in like)

    rows = []
    for cp in (x for x in range(1, 0x110000) if not 0xD800 <= x < 0xE000 and unicodedata.category(chr(x)) != "Cn"):
        parts = unicodedata.normalize("NFD", chr(cp))
        if (b := "".join(map(drawn, parts))) != parts:
            quoted = b.replace("'", "''")
            rows.append(f"(chr({cp}), '{quoted}')")
    return ", ".join(rows)


@functools.cache
def _sql() -> str:
    """All texts rewritten character by character and joined by what they look like."""
    plain = "trim(regexp_replace(v, '[\\t-\\r ]+', ' ', 'g'))"
    return f"""WITH m(a, b) AS (VALUES {_drawn()}),
x AS (SELECT row_number() OVER () AS i, tbl, id, v FROM (SELECT 'raw_pairs' AS tbl, row_id AS id, tgt AS v FROM raw_pairs UNION ALL SELECT 'pool_pairs', row_id, t FROM pool_pairs) WHERE {sql_has_text("v")}),
c AS (SELECT i, unnest(string_split(v, '')) AS c, unnest(range(1, length(v) + 1)) AS p FROM x),
l AS (SELECT i, nfc_normalize(string_agg(coalesce(b, c), '' ORDER BY p)) AS s FROM c LEFT JOIN m ON a = c GROUP BY 1),
k AS (SELECT tbl, id, trim(regexp_replace(s, ' +', ' ', 'g')) AS look, {plain} AS chars FROM x JOIN l USING (i))
SELECT a.tbl, a.id AS id_a, b.id AS id_b FROM k a JOIN k b ON a.tbl = b.tbl AND a.look = b.look AND a.id < b.id AND a.chars <> b.chars"""


SQL = {"p1_found": _sql}
QUERIES = {"p1_found": p1_found, "p1_forms": p1_forms}
