"""Interfaces of models. They are given by the user; only their place in a plan is here."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import labels as L
from weftline.functions import text as T

#: Encoder: texts -> unit vectors. Translator: texts -> texts. Sampler: texts -> lists of candidates.
#: Tagger: texts -> for each, four logits for each character.
Encoder = Callable[[list[str]], list[list[float]]]
Translator = Callable[[list[str]], list[str]]
Sampler = Callable[[list[str]], list[list[str]]]
Tagger = Callable[[list[str]], list[list[list[float]]]]


def configured(kind: type, values: dict):
    """An instance of the dataclass; unknown keys are an error."""
    unknown = set(values) - {f.name for f in fields(kind)}
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return kind(**values)


@dataclass(frozen=True)
class Sampling:
    """How candidates are drawn; the sampler reads what concerns it."""

    method: str = "beam"
    number: int = 32
    temperature: float = 1.0
    top_k: int = 0
    top_p: float = 1.0
    epsilon: float = 0.0

    def __post_init__(self) -> None:
        if self.method not in {"beam", "ancestral", "epsilon", "topk", "topp", "diverse_beam"}:
            raise ValueError(f"unknown sampling method {self.method}")


def _map(df: DataFrame, text: str, name: str, kind: str, load: Callable[[], Callable], batch: int) -> DataFrame:
    """Adds a column computed by the model over batches; load() runs once in each worker."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for part in parts:
            texts = part.fillna("").tolist()
            out: list = []
            order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))  # like lengths together
            done: dict[int, object] = {}
            for i in range(0, len(order), batch):
                done |= dict(zip(order[i : i + batch], model([texts[k] for k in order[i : i + batch]])))
            out = [done[i] for i in range(len(texts))]
            yield pd.Series(out)

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(name, F.pandas_udf(run, kind)(text))


def embed(df: DataFrame, load: Callable[[], Encoder], text: str = "text", batch: int = 256) -> DataFrame:
    return _map(df, text, "embedding", "array<float>", load, batch)


def translate(df: DataFrame, load: Callable[[], Translator], text: str = "text", batch: int = 16) -> DataFrame:
    return _map(df, text, "translation", "string", load, batch)


def sample_candidates(df: DataFrame, load: Callable[[], Sampler], text: str = "text", batch: int = 4) -> DataFrame:
    return _map(df, text, "candidates", "array<string>", load, batch)


def tag(df: DataFrame, load: Callable[[], Tagger], text: str = "text", none_bias: float = 0.0, batch: int = 64, **rules) -> DataFrame:
    """Adds restored: marks put into the stripped text by the tagger's logits, none after a blank."""
    base = df.withColumn("_base", T.strip_key(F.coalesce(text, F.lit(""))))
    with_logits = _map(base, "_base", "_logits", "array<array<double>>", load, batch)
    decided = F.transform("_logits", lambda x: L.decide(L.softmax(x, none_bias), **rules))
    chars = F.filter(F.split("_base", ""), lambda x: x != "")
    allowed = F.zip_with(chars, decided, lambda ch, y: F.when(ch.rlike(T.WS), 0).otherwise(y))
    restored = with_logits.withColumn("restored", L.apply_labels("_base", allowed))
    return restored.drop("_base", "_logits")


def calibrate(density: Callable[[float], float], target: float, low: float = -8.0, high: float = 8.0, steps: int = 24) -> float:
    """The bias at which a density that falls with it meets the target, by bisection; each step is one aggregate."""
    for _ in range(steps):
        mid = (low + high) / 2
        if density(mid) > target:
            low = mid
        else:
            high = mid
    return (low + high) / 2
