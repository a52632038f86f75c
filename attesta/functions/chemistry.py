"""Hooks for structure functions that need a chemistry toolkit, which is not part of this engine."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.operators.learning import DependencyUnavailable

_HOOKS: dict[str, tuple[Callable[[str], object], str]] = {}
NAMES = ("canonical", "scaffold", "descriptors", "fingerprint", "pattern_presence", "graph_facts", "embedding")


def register(name: str, function: Callable[[str], object], returns: str) -> None:
    """Provides a structure function of one structure, and the Spark type it returns."""
    if name not in NAMES:
        raise ValueError(f"name one of {NAMES}")
    _HOOKS[name] = (function, returns)


def structure_function(name: str) -> Callable[[Column | str], Column]:
    """A registered function on a column; without one, an error that names it: nothing is made up."""
    if name not in _HOOKS:
        raise DependencyUnavailable(f"no chemistry toolkit provides {name}; no fallback")
    function, returns = _HOOKS[name]

    @F.pandas_udf(returns)
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else function(v))

    return run


def once_each(rows: DataFrame, column: str, name: str, out: str) -> DataFrame:
    """``rows`` with ``out``: the function is called once for each distinct structure."""
    distinct = rows.select(column).where(F.col(column).isNotNull()).distinct()
    return rows.join(distinct.withColumn(out, structure_function(name)(column)), column, "left")
