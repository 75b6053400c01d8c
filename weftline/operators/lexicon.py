"""Lexicons of marked forms: building by majority, applying with back-off, coverage, merging."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as T

BOS, EOS = "<s>", "</s>"


def word_rows(texts: DataFrame, text: str = "text", id_: str = "row_id", key=T.strip_key) -> DataFrame:
    """(id, pos, form, key, prev, next): words with their keys and neighbours' keys, made within the row."""
    one = texts.where(T.not_blank(text)).select(id_, T.words(text).alias("w"))
    one = one.select(id_, "w", F.transform("w", lambda x: key(x)).alias("k"))
    n = F.size("k")
    before, after = F.concat(F.array(F.lit(BOS)), F.slice("k", F.lit(1), n - 1)), F.concat(F.slice("k", F.lit(2), n), F.array(F.lit(EOS)))
    zipped = one.select(id_, F.arrays_zip(F.col("w").alias("form"), F.col("k").alias("key"), before.alias("prev"), after.alias("next")).alias("z"))
    # outer: an inner explode implies a filter on the array, which would be made twice
    rows = zipped.select(id_, F.posexplode_outer("z").alias("pos", "x"))
    return rows.select(id_, F.col("pos").cast("long").alias("pos"), *(F.col("x").getField(c).alias(c) for c in ("form", "key", "prev", "next")))


def form_counts(rows: DataFrame, keys: list[str], id_: str = "row_id") -> DataFrame:
    """(keys, form, n, first): how often and where first each form stands for the keys."""
    return rows.groupBy(*keys, "form").agg(F.count("*").alias("n"), F.min(F.struct(F.col(id_).alias("row"), "pos")).alias("first"))


def majority_of(counts: DataFrame, keys: list[str], least: int, dominance: float = 0.0, drop_same: bool = False) -> DataFrame:
    """(keys, form, n, total) from form_counts of these keys or finer ones; ties go to the form met first.

    The majority is an aggregate, not a sort.
    """
    counts = counts.groupBy(*keys, "form").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    best = F.max_by(F.struct("form", "n"), F.struct("n", (-F.col("first.row")).alias("a"), (-F.col("first.pos")).alias("b"))).alias("b")
    top = counts.groupBy(*keys).agg(best, F.sum("n").alias("total"))
    out = top.select(*keys, F.col("b.form").alias("form"), F.col("b.n").alias("n"), "total")
    out = out.where((F.col("total") >= least) & (F.col("n") >= F.col("total") * F.lit(dominance)))
    return out.where("form <> key") if drop_same else out


def majority(rows: DataFrame, keys: list[str], least: int, dominance: float = 0.0, drop_same: bool = False, id_: str = "row_id") -> DataFrame:
    """majority_of the forms of word_rows."""
    return majority_of(form_counts(rows, keys, id_), keys, least, dominance, drop_same)


@dataclass
class Lexicon:
    """unigram (key, form) and context tables keyed by (prev, key, next), (prev, key), (key, next)."""

    unigram: DataFrame
    both: DataFrame | None = None
    left: DataFrame | None = None
    right: DataFrame | None = None


def pruned(context: DataFrame, unigram: DataFrame) -> DataFrame:
    """Context entries that say more than the unigram; safe only for a single context table."""
    uni = unigram.select("key", F.col("form").alias("_u"))
    return context.join(uni, "key", "left").where(F.col("form") != F.coalesce("_u", "key")).drop("_u")


def build(texts: DataFrame, least: int = 3, dominance: float = 0.0, context_least: int = 2, context: tuple[str, ...] = (), prune: bool = True) -> Lexicon:
    """context: any of both, left, right. With a single one it is pruned, with several kept whole."""
    # one pass over the words: coarser counts are sums of the finest ones, whose shuffle all tables read
    counts = form_counts(word_rows(texts), ["prev", "key", "next"] if context else ["key"])
    uni = majority_of(counts, ["key"], least, dominance, drop_same=True)
    keys = {"both": ["prev", "key", "next"], "left": ["prev", "key"], "right": ["key", "next"]}
    tables = {}
    for name in context:
        t = majority_of(counts, keys[name], context_least)
        tables[name] = pruned(t, uni) if prune and len(context) == 1 else t
    return Lexicon(uni, **tables)


#: The tables in the order in which they are asked.
LEVELS = (("both", ["prev", "key", "next"]), ("left", ["prev", "key"]), ("right", ["key", "next"]), ("unigram", ["key"]))


def looked_up(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """word_rows with form taken from the first table that knows the word, null if none; level says which.

    The distinct words with their neighbours are looked up, each once, so a frequent word is no hot key of the tables;
    the rows are joined once, with what was found.
    """
    tables = [(name, keys, getattr(lexicon, name)) for name, keys in LEVELS if getattr(lexicon, name) is not None]
    finest = [c for c in LEVELS[0][1] if any(c in keys for _, keys, _ in tables)]
    out = rows.select(*finest).distinct()
    for name, keys, t in tables:
        out = out.join(t.select(*keys, F.col("form").alias(f"_{name}")), keys, "left")
    form = F.coalesce(*(F.col(f"_{x}") for x, _, _ in tables))
    level = F.coalesce(*(F.when(F.col(f"_{x}").isNotNull(), F.lit(x)) for x, _, _ in tables))
    known = out.select(*finest, form.alias("found"), level.alias("level")).where("found is not null")
    return rows.join(known, finest, "left").select(*rows.columns, "found", "level")


def restored(texts: DataFrame, lexicon: Lexicon, text: str = "text", id_: str = "row_id") -> DataFrame:
    """(id, text): marks stripped and put back from the lexicon; words are joined by single spaces."""
    found = looked_up(word_rows(texts, text, id_), lexicon)
    return joined(found, F.coalesce("found", "key"), id_)


def joined(rows: DataFrame, word: Column, id_: str = "row_id") -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("pos", word.alias("w"))))
    return rows.groupBy(id_).agg(F.array_join(F.transform(parts, lambda x: x["w"]), " ").alias("text"))


def coverage(found: DataFrame) -> DataFrame:
    """(words, substituted, by_context, pct): words known to the lexicon, and those known by their neighbours."""
    by_context = F.coalesce(F.col("level") != "unigram", F.lit(False))
    sums = found.agg(F.count("*").alias("words"), F.count("found").alias("substituted"), F.coalesce(F.sum(by_context.cast("long")), F.lit(0)).alias("by_context"))
    return sums.withColumn("pct", F.when(F.col("words") > 0, F.round(100.0 * F.col("substituted") / F.col("words"), 6)).otherwise(0.0))


def merged(found: DataFrame, model: str, mode: str) -> Column:
    """The word of a merged restoration: known takes the lexicon's wherever it has one, changed where it differs."""
    lex = F.coalesce("found", "key")
    if mode == "lexicon":
        return lex
    if mode == "model":
        return F.col(model)
    if mode == "known":
        return F.when(F.col("found").isNotNull(), F.col("found")).otherwise(F.col(model))
    if mode == "changed":
        return F.when(lex != F.col("key"), lex).otherwise(F.col(model))
    raise ValueError(f"unknown mode {mode}")
