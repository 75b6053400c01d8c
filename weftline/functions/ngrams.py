"""n-gram statistics of translation metrics: chrF++ and BLEU, over Arrow batches.

Counting and matching multisets of n-grams of every pair is the one place where built-in functions
need an explosion of rows; here a pool of candidates is scored in one pass of vectorised counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

from weftline.functions import flat

CHAR_ORDER, WORD_ORDER, BETA = 6, 2, 2.0
_PUNCT = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def metric_words(text: str) -> list[str]:
    """Words, with one punctuation sign at the end or else at the start as a word of its own."""
    out: list[str] = []
    for w in text.split():
        if len(w) > 1 and w[-1] in _PUNCT:
            out += [w[:-1], w[-1]]
        elif len(w) > 1 and w[0] in _PUNCT:
            out += [w[0], w[1:]]
        else:
            out.append(w)
    return out


def f_score(match: np.ndarray, hyp: np.ndarray, ref: np.ndarray, beta: float = BETA) -> np.ndarray:
    """chrF from statistics whose last axis is the order: mean precision and recall of the orders both sides have."""
    have = (hyp > 0) & (ref > 0)
    n = np.maximum(have.sum(-1), 1)
    p = np.where(have, match / np.maximum(hyp, 1), 0).sum(-1) / n
    r = np.where(have, match / np.maximum(ref, 1), 0).sum(-1) / n
    b = beta * beta
    down = b * p + r
    return np.where(down > 0, 100 * (1 + b) * p * r / np.where(down > 0, down, 1), 0.0)


#: Pairs of candidates scored at once.
PAIRS = 200_000


def _shared(gram: np.ndarray, text: np.ndarray, pool: np.ndarray, place: np.ndarray, pairs: int) -> np.ndarray:
    """Sum over the grams of each pool of the lesser count, for every pair of its texts.

    gram: hashes; text: whose; pool, place: of each text, the first pair of its pool's row and its column.
    """
    order = np.lexsort((text, gram))
    gram, text = gram[order], text[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(gram)))
    gram, text = gram[at], text[at]
    first = np.ones(len(gram), bool)
    first[1:] = gram[1:] != gram[:-1]
    start = np.flatnonzero(first)
    size = np.diff(np.append(start, len(gram)))
    times = np.repeat(size, size)  # each text of a gram meets all texts of the gram
    mine = np.repeat(np.arange(len(gram)), times)
    other = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(np.repeat(start, size), times)
    return np.bincount(pool[text[mine]] + place[text[other]], np.minimum(count[mine], count[other]), pairs)


def hashed_matches(lengths: np.ndarray, first: np.ndarray, prefix: np.ndarray, n: int, text_salt: np.ndarray, row: np.ndarray, place: np.ndarray, pairs: int) -> tuple[np.ndarray, np.ndarray]:
    """Shared n-grams of every pair of texts of a pool, and the number of each text's; symbols are given by prefix digests."""
    count = np.maximum(lengths - n + 1, 0)
    text = np.repeat(np.arange(len(lengths)), count)
    begin = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[text]
    gram = flat.span_hash(prefix, begin, begin + n)
    return _shared(flat.mix(gram ^ text_salt[text]), text, row, place, pairs), count


def pools_statistics(pools: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(match, total, base): by pair of texts of a pool and order the shared n-grams, by text the number of its own.

    base: the first pair of each pool; its pairs follow row by row.
    """
    sizes = np.array([len(p) for p in pools], np.int64)
    texts = [t for p in pools for t in p]
    base, row, place, salt = _places(sizes)
    cps, starts = flat.of_strings(["".join(t.split()) for t in texts])
    word, word_at = _numbered([metric_words(t) for t in texts])
    match, total = np.zeros((int(base[-1]), CHAR_ORDER + WORD_ORDER)), np.zeros((len(texts), CHAR_ORDER + WORD_ORDER), np.int64)
    for o in range(CHAR_ORDER + WORD_ORDER):
        n, (prefix, first) = (o + 1, (flat.prefix_hash(cps), starts)) if o < CHAR_ORDER else (o + 1 - CHAR_ORDER, (flat.prefix_hash(word), word_at))
        match[:, o], total[:, o] = hashed_matches(np.diff(first), first, prefix, n, salt, row, place, len(match))
    return match, total, base


def _places(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For pools of the sizes: the first pair of each; of each text the first pair of its row, its column, and its pool's salt."""
    base = np.concatenate([[0], np.cumsum(sizes**2)])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return base, base[owner] + place * sizes[owner], place, flat.mix(owner.astype(np.uint64) + np.uint64(1))


def _numbered(lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Words of all lists as numbers, and the starts of the lists among them."""
    ids: dict[str, int] = {}
    word = np.array([ids.setdefault(w, len(ids)) for x in lists for w in x], np.uint64)
    return word, np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)


def pools_chrf(pools: list[list[str]]) -> list[np.ndarray]:
    """For each pool scores[h, r]: chrF++ of text h as a hypothesis for text r. Many pools in one pass."""
    if sum(len(p) ** 2 for p in pools) > PAIRS and len(pools) > 1:
        half = len(pools) // 2
        return pools_chrf(pools[:half]) + pools_chrf(pools[half:])
    match, total, base = pools_statistics(pools)
    out, at = [], 0
    for p, k in enumerate(map(len, pools)):
        own = total[at : at + k]
        out.append(f_score(match[base[p] : base[p + 1]].reshape(k, k, -1), own[:, None, :], own[None, :, :]))
        at += k
    return out


def halves(hyps: list[str], most: int = 20_000) -> Iterator[slice]:
    for k in range(0, len(hyps), most):
        yield slice(k, k + most)


def chrf_pairs(hyps: list[str], refs: list[str]) -> np.ndarray:
    """By pair of texts match, hypothesis and reference for every order, one after another."""
    out = [np.zeros((0, 3 * (CHAR_ORDER + WORD_ORDER)), np.int64)]
    for part in halves(hyps):
        match, total, base = pools_statistics([[h, r] for h, r in zip(hyps[part], refs[part])])
        out.append(np.stack([match[base[:-1] + 1], total[0::2], total[1::2]], axis=2).reshape(len(base) - 1, -1).astype(np.int64))
    return np.concatenate(out)


def bleu_pairs(hyps: list[str], refs: list[str], order: int = 4) -> np.ndarray:
    """By pair of texts the lengths of both, then match and total for each order."""
    out = [np.zeros((0, 2 + 2 * order), np.int64)]
    for part in halves(hyps):
        word, at = _numbered([tokenize_13a(t) for pair in zip(hyps[part], refs[part]) for t in pair])
        n = (len(at) - 1) // 2
        base, row, place, salt = _places(np.full(n, 2))
        prefix, size = flat.prefix_hash(word), np.diff(at)
        columns = [size[0::2], size[1::2]]
        for k in range(1, order + 1):
            match, total = hashed_matches(size, at[:-1], prefix, k, salt, row, place, int(base[-1]))
            columns += [match[base[:-1] + 1], total[0::2]]
        out.append(np.column_stack(columns).astype(np.int64))
    return np.concatenate(out)


def bleu_score(sums: np.ndarray) -> np.ndarray:
    """Corpus BLEU of sums as in bleu_pairs; the k-th order without a match counts 1 / (2^k total)."""
    sums = np.asarray(sums, float)
    match, total = sums[..., 2::2], sums[..., 3::2]
    smooth = 2.0 ** np.cumsum(match == 0, axis=-1)
    p = np.where(match == 0, 1 / (smooth * np.maximum(total, 1)), match / np.maximum(total, 1))
    short = np.where(sums[..., 0] < sums[..., 1], np.exp(1 - sums[..., 1] / np.maximum(sums[..., 0], 1)), 1.0)
    void = (total == 0).any(-1) | (sums[..., 0] == 0) | (match[..., 0] == 0)
    return np.where(void, 0.0, 100 * short * np.exp(np.log(p).mean(-1)))


def pairwise_chrf(texts: list[str]) -> np.ndarray:
    """pools_chrf of one pool."""
    return pools_chrf([texts])[0]


def tokenize_13a(text: str) -> list[str]:
    """The mteval-13a tokenisation."""
    t = text.replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    for a, b in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        t = t.replace(a, b)
    t = f" {t} "
    t = re.sub(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 ", t)
    t = re.sub(r"([^0-9])([\.,])", r"\1 \2 ", t)
    t = re.sub(r"([\.,])([^0-9])", r" \1 \2", t)
    t = re.sub(r"([0-9])(-)", r"\1 \2 ", t)
    return t.split()
