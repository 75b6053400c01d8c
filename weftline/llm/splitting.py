"""Problem 9: splitting oversized items at natural boundaries.

The least number of pieces that the limit and the overlap allow is computed, cut targets are placed at
equal lengths, and each is snapped to the strongest boundary nearby: paragraph end, line end,
sentence end, blank, then any character. A plan in which a piece, tokenised by itself, breaks the
limit is made again with one piece more; so is, up to EXTRA times, one with a cut at no natural end.

Each piece begins `overlap` tokens before the end of the one before (at the nearest earlier token if
that one begins inside a character), so the texts without their overlaps join to the whole text.

Defined cases: texts of at most `limit` tokens, null, blank and `nan` texts give no piece; a run without
blanks is cut between characters; a text is held whole in memory, one at a time; repeated rows each
give their pieces; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from weftline.functions import flat
from weftline.llm.common import has_text, table
from weftline.llm.languages import BLANK, BREAK, OTHER, STOP, tables
from weftline.llm.tokens import Tokenizer, tokenizer

LIMIT, OVERLAP, EXTRA = 512, 64, 2
ANY, WORD, SENTENCE, LINE, PARAGRAPH = range(5)


def boundary_strength(text: str) -> np.ndarray:
    """For every character position 0..n: what ends there; a lone blank belongs to the word after it."""
    cps = flat.of_strings([text])[0]
    kind = tables()[0][cps]
    n = len(cps)
    strength = np.zeros(n + 1, np.int8)
    gap = (kind == BLANK) | (kind == BREAK)
    edge = np.diff(np.concatenate([[0], gap.astype(np.int8), [0]]))
    begin, end = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
    keep = (begin > 0) & (end < n)
    begin, end = begin[keep], end[keep]
    line = np.concatenate([[0], np.cumsum(cps == 10)])
    breaks = line[end] - line[begin]
    breaks += (breaks == 0) & (np.concatenate([[0], np.cumsum(kind == BREAK)])[end] > np.concatenate([[0], np.cumsum(kind == BREAK)])[begin])
    last, last2 = kind[begin - 1], kind[np.maximum(begin - 2, 0)]
    stop = (last == STOP) | ((last == OTHER) & (last2 == STOP))
    at = end - (cps[end - 1] == 32)
    strength[at] = np.where(breaks > 1, PARAGRAPH, np.where(breaks > 0, LINE, np.where(stop, SENTENCE, WORD)))
    return strength


def plan(strength: np.ndarray, whole: np.ndarray, n: int, m: int, limit: int, overlap: int) -> list[int] | None:
    """Token positions of the ends of m pieces of n tokens, or None if they can't be placed.

    strength and whole are by token position; whole tells whether a character begins there.
    """
    size = (n + (m - 1) * overlap) / m
    near = max(1, limit // 4)
    ends: list[int] = []
    start = 0
    for i in range(1, m):
        target = i * size - (i - 1) * overlap
        low, high = max(start + overlap + 1, n - (m - i) * (limit - overlap)), min(start + limit, n - 1)
        if low > high:
            low = max(start + overlap + 1, int(target) - near)
        at = np.arange(max(low, int(target) - near), min(high, int(target) + near) + 1)
        if not len(at) or strength[at].max() < SENTENCE:  # nothing natural nearby: anywhere within the limit
            at = np.arange(low, high + 1)
        at = at[whole[at]]
        if not len(at):
            return None
        fits = whole[np.maximum(at - overlap, 0)]
        order = np.lexsort((at, np.abs(at - target), ~fits, -strength[at]))
        end = int(at[order[0]])
        ends.append(end)
        start = end - overlap
    return [*ends, n]


def pieces(text: str, own: Tokenizer, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, int]]:
    """(start, end, first new position, tokens) of each piece in characters; none for a text within the limit."""
    ids = own.encode(text)
    n = len(ids)
    if n <= limit:
        return []
    cps = flat.of_strings([text])[0]
    byte = np.zeros(len(cps) + 1, np.int64)
    np.cumsum(1 + (cps > 0x7F) + (cps > 0x7FF) + (cps > 0xFFFF), out=byte[1:])
    offset = np.zeros(n + 1, np.int64)
    np.cumsum(own.sizes[ids], out=offset[1:])
    char = np.searchsorted(byte, offset)
    whole = byte[np.minimum(char, len(cps))] == offset
    strength = np.where(whole, boundary_strength(text)[np.minimum(char, len(cps))], 0)
    least = -(-(n - overlap) // (limit - overlap))

    def weak(ends: list[int]) -> int:
        return len(ends) - sum(end == n or strength[end] >= SENTENCE for end in ends)

    def made(ends: list[int]) -> list[tuple[int, int, int, int]] | None:
        """The pieces, or None if one of them, tokenised by itself, breaks the limit."""
        out, begin = [], 0
        for k, end in enumerate(ends):
            start = begin if k == 0 else begin - overlap
            while start > 0 and not whole[start]:
                start -= 1
            a, b = int(char[start]), int(char[end])
            size = own.count(text[a:b])
            if size > limit:
                return None
            out.append((a, b, int(char[begin]), size))
            begin = end
        return out

    # plans of up to EXTRA pieces more, those with the fewest cuts at no natural end first; then of ever more pieces
    plans = [x for m in range(least, least + EXTRA + 1) if m <= n and (x := plan(strength, whole, n, m, limit, overlap)) is not None]
    for ends in sorted(plans, key=weak):
        if (out := made(ends)) is not None:
            return out
    for m in range(least + EXTRA + 1, n + 1):
        if (ends := plan(strength, whole, n, m, limit, overlap)) is not None and (out := made(ends)) is not None:
            return out
    raise ValueError(f"no pieces of {limit} tokens with an overlap of {overlap} can be made")


PIECES = "doc_id long, piece_no int, pieces int, n_tokens int, start_char long, new_from long, end_char long, text string"


def splitter(limit: int, overlap: int, path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for batch in batches:
            for first, part in flat.slices(batch.column(1)):
                ids = batch.column(0).slice(first, len(part)).to_pylist()
                rows = []
                for i, text in zip(ids, part.to_pylist()):
                    if len(text.encode("utf-8", "replace")) > limit:  # a token has a byte at least
                        found = pieces(text, own, limit, overlap)
                        rows += [(i, k, len(found), size, a, new, b, text[a:b]) for k, (a, b, new, size) in enumerate(found, 1)]
                cols = list(zip(*rows)) if rows else [()] * 8
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [x.split()[0] for x in PIECES.split(", ")])

    return run


def split(docs: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, tokenizer_path: str | None = None) -> DataFrame:
    """(doc_id, text) -> PIECES, for texts of more than `limit` tokens. No shuffle."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    return docs.select("doc_id", "text").where(has_text("text")).mapInArrow(splitter(limit, overlap, tokenizer_path), PIECES)


def p9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split(table(spark, sf_dir, "documents"))


QUERIES = {"p9_pieces": p9_pieces}
