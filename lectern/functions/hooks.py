"""Hooks for the steps that a model may take over.

No model is shipped.  A hook is a function of columns that returns a column, as a rule
an Arrow UDF of :func:`model_udf`.  Every step has a deterministic result without one,
so :func:`available` is the capability flag that is asked once, while planning.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: detect (text -> STRUCT<language, confidence>), translate (text), embed (text -> array), abstractive (text), final_response (title, authors, year, extract), rewrite (title,
#: authors, year, facets), keywords (text -> array), bertscore (candidate, reference -> precision, recall, f1).
NAMES = ("detect", "translate", "embed", "abstractive", "final_response", "rewrite", "keywords", "bertscore")

_plugged: dict[str, Callable[..., Column]] = {}
_loaded: dict[str, object] = {}


def plug(name: str, make: Callable[..., Column] | None) -> None:
    """Use ``make`` for a step from now on; None takes it out again."""
    if name not in NAMES:
        raise ValueError(f"unknown hook {name!r}; known: {list(NAMES)}")
    if make is None:
        _plugged.pop(name, None)
    else:
        _plugged[name] = make


def available(name: str) -> bool:
    """Whether a step has a model."""
    return name in _plugged


def answer(name: str, *columns: Column) -> Column | None:
    """The model's answer, or None without a model."""
    return _plugged[name](*columns) if name in _plugged else None


def first_that_loads(key: str, loaders: list[Callable[[], object]]):
    """The result of the first loader that doesn't fail, kept for the life of the worker; None if all fail."""
    if key not in _loaded:
        _loaded[key] = None
        for load in loaders:
            try:
                _loaded[key] = load()
                break
            except Exception:  # noqa: BLE001 - the next one is tried
                continue
    return _loaded[key]


def model_udf(key: str, loaders: list[Callable[[], object]], returns: str, run: Callable[[object, pd.Series], pd.Series]):
    """An Arrow UDF ``run(model, batch)``; nulls if no loader works."""

    @F.pandas_udf(returns)
    def call(batch: pd.Series) -> pd.Series:
        model = first_that_loads(key, loaders)
        return pd.Series([None] * len(batch), dtype=object) if model is None else run(model, batch)

    return call
