"""Public tokenizers, loaded from a given path once in each worker.

A vocabulary is a file of ranks (base64 of the token, its id); how texts are cut before they are encoded is a regular
expression. Where path or pattern is not given they are taken from `public_tokenizers`, the module beside the vocabulary
files of /opt/tokenizers, which its README there describes; nothing of it is in this repository.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions import flat

#: The vocabulary used where no path is given.
DEFAULT = "byte_bpe_multi_50k.tiktoken"


class Tokenizer:
    """Byte-level BPE of a ranks file; ids, byte lengths of tokens, and counts."""

    def __init__(self, path: str, pattern: str | None = None) -> None:
        if pattern is None:
            import public_tokenizers

            pattern = public_tokenizers.PATTERN
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.sizes[i] = len(token)

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def count(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text))


@functools.cache
def tokenizer(path: str | None = None, pattern: str | None = None) -> Tokenizer:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(DEFAULT)
    return Tokenizer(path, pattern)


def strings(col: pa.Array) -> Iterator[str]:
    """The texts of a column a slice at a time, nulls as empty."""
    for _, part in flat.slices(col):
        yield from part.to_pylist()


def token_count(text: str | Column, path: str | None = None) -> Column:
    """Tokens of a whole text; 0 for null."""

    @F.arrow_udf("long")
    def run(col: pa.Array) -> pa.Array:
        own = tokenizer(path)
        return pa.array([own.count(t) for t in strings(col)], pa.int64())

    return run(text)
