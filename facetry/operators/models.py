"""Hooks for user models: batches of rows through Arrow, one model per worker.

A hook is a function ``Column -> Column`` made from a factory.  The factory runs on
the worker, so weights are never shipped and libraries are imported only there.
Both are iterator pandas UDFs: filters and column pruning still reach the scan.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from facetry.functions.polarity import normalize_label

MAX_MODELS = 2
_models: OrderedDict[str, Any] = OrderedDict()


def cached_model(name: str, factory: Callable[[], Any]) -> Any:
    """The model of this worker process, loaded on first use; at most two are kept."""
    if name not in _models:
        _models[name] = factory()
        while len(_models) > MAX_MODELS:
            _models.popitem(last=False)
    _models.move_to_end(name)
    return _models[name]


def _run(model: Callable[[list], Sequence], items: list, batch: int) -> list:
    out: list = []
    for at in range(0, len(items), batch):
        chunk = items[at:at + batch]
        result = list(model(chunk))
        if len(result) != len(chunk):
            raise ValueError(f"model returned {len(result)} results for {len(chunk)} inputs")
        out.extend(result)
    return out


def extractor_hook(
    name: str, factory: Callable[[], Callable[[list[str]], Sequence[Sequence[str]]]], batch: int = 32
) -> Callable[[Column], Column]:
    """Sentence column -> ``array<string>`` of terms; blank sentences get none."""

    @F.pandas_udf("array<string>")
    def extract(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = cached_model(name, factory)
        for part in parts:
            texts = ["" if t is None else t for t in part]
            yield pd.Series(_run(model, texts, batch), index=part.index, dtype=object)

    def column(sentence: Column) -> Column:
        terms = extract(sentence)
        return F.array_distinct(F.filter(F.transform(terms, lambda t: F.lower(F.trim(t))), lambda t: t != ""))

    return column


def scorer_hook(
    name: str,
    factory: Callable[[], Callable[[list[tuple[str, str]]], Sequence[tuple[str, float]]]],
    batch: int = 16,
) -> Callable[[Column, Column], Column]:
    """(sentence, aspect) columns -> ``struct<label:string,score:double>``."""

    @F.pandas_udf("label string, score double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        model = cached_model(name, factory)
        for sentence, aspect in parts:
            rows = _run(model, list(zip(sentence, aspect)), batch)
            yield pd.DataFrame(rows, columns=["label", "score"])

    def column(sentence: Column, aspect: Column) -> Column:
        return F.transform(
            F.array(score(sentence, aspect)),
            lambda r: F.struct(normalize_label(r["label"]).alias("label"), r["score"].alias("score")),
        )[0]

    return column
