"""Marks as labels of the characters they follow: coding, decoding, chunks, decision rules."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.text import ALL_MARKS, MARKS, WS, col, strip_key


def base_text(c: Column | str) -> Column:
    """The text without restorable marks."""
    return strip_key(c)


def labels(c: Column | str) -> Column:
    """One label for each character of base_text: the mark right after it, 0 for none.

    Only the first of several marks counts; marks at the start or after a blank are dropped.
    """
    parts = F.regexp_extract_all(col(c), F.lit(rf"(?s)([^{ALL_MARKS}])([{ALL_MARKS}]?)"), F.lit(0))
    return F.transform(parts, lambda x: F.when(F.length(x) < 2, 0).otherwise(_position(x)).cast("int"))


def _position(x: Column) -> Column:
    mark, at = F.substr(x, F.lit(2), F.lit(1)), F.lit(0)
    for i, m in enumerate(MARKS, 1):
        at = F.when(mark == m, i).otherwise(at)
    return F.when(F.substr(x, F.lit(1), F.lit(1)).rlike(WS), 0).otherwise(at)


def apply_labels(base: Column | str, labels_: Column | str) -> Column:
    """The inverse of coding; raises where the lengths differ."""
    b, y = col(base), col(labels_)
    chars = F.filter(F.split(b, ""), lambda x: x != "")
    marks = F.array(F.lit(""), *(F.lit(m) for m in MARKS))
    joined = F.array_join(F.zip_with(chars, y, lambda ch, k: F.concat(ch, F.element_at(marks, k + 1))), "")
    return F.when(F.size(chars) == F.size(y), joined).otherwise(F.raise_error(F.lit("labels and characters differ in number")))


def insertion_only(before: Column | str, after: Column | str) -> Column:
    """True if nothing but restorable marks differs."""
    return strip_key(before) == strip_key(after)


def chunk(c: Column | str, most: int) -> Column:
    """array<struct<piece, before>>: pieces of at most `most` characters, cut at spaces where possible.

    before is the separator that stood there, so before + piece of all pieces joins to the text.
    """

    def cut(t: str | None) -> list[tuple[str, str]] | None:
        if t is None:
            return None
        out, start, before = [], 0, ""
        while len(t) - start > most:
            end = t.rfind(" ", start, start + most + 1)
            if end < start or (end == start and not out):
                end = start + most if end < start else end
            if end == start:  # a space right here: an empty piece would follow
                out.append(("", before))
            else:
                out.append((t[start:end], before))
            before = " " if t[end : end + 1] == " " else ""
            start = end + len(before)
        out.append((t[start:], before))
        return out

    @F.arrow_udf("array<struct<piece: string, before: string>>")
    def run(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("piece", pa.string()), ("before", pa.string())]))
        rows = [None if (x := cut(t)) is None else [{"piece": p, "before": b} for p, b in x] for t in texts.to_pylist()]
        return pa.array(rows, kind)

    return run(col(c))


def softmax(logits: Column | str, none_bias: float = 0.0) -> Column:
    """Probabilities of the four labels; none_bias is added to the first logit."""
    x = F.transform(col(logits), lambda v, i: v.cast("double") + F.when(i == 0, F.lit(float(none_bias))).otherwise(0.0))
    top = F.array_max(x)
    e = F.transform(x, lambda v: F.exp(v - top))
    total = F.aggregate(e, F.lit(0.0), lambda s, v: s + v)
    return F.transform(e, lambda v: v / total)


def _argmax(a: Column) -> Column:
    """Position from 0 of the first greatest."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def decide(probs: Column | str, threshold: float | None = None, per_mark: list[float] | None = None) -> Column:
    """The label: by each mark's own threshold and the widest relative margin, by one threshold, or the likeliest."""
    p = col(probs)
    marks = F.slice(p, 2, 3)
    if per_mark:
        least = F.array(*(F.lit(max(float(t), 1e-9)) for t in per_mark))
        ratio = F.zip_with(marks, least, lambda a, b: a / b)
        return F.when(F.array_max(ratio) >= 1.0, _argmax(ratio) + 1).otherwise(0)
    if threshold is not None:
        return F.when(1 - F.element_at(p, 1) >= threshold, _argmax(marks) + 1).otherwise(0)
    return _argmax(p)
