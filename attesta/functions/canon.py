"""Canonical JSON and digests: keys sorted, compact, no NaN; several variants that differ in escapes."""

from __future__ import annotations

import hashlib
import json
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _unique(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("a JSON object repeats a key")
    return out


def _finite(text: str) -> object:
    value = float(text)
    if not math.isfinite(value):
        raise ValueError("a JSON number is not finite")
    return value


def _never(text: str) -> object:
    raise ValueError(f"{text} is no JSON")


def strict_loads(text: str) -> object:
    """JSON without repeated keys, NaN, infinities or numbers that overflow."""
    return json.loads(text, object_pairs_hook=_unique, parse_constant=_never, parse_float=_finite)


def canonical(value: object, ascii_only: bool = False, spaced: bool = False) -> str:
    """A value's one JSON spelling."""
    return json.dumps(value, sort_keys=True, ensure_ascii=ascii_only, allow_nan=False, separators=(", ", ": ") if spaced else (",", ":"))


def digest(value: object, ascii_only: bool = False, spaced: bool = False) -> str:
    return hashlib.sha256(canonical(value, ascii_only, spaced).encode()).hexdigest()


@F.pandas_udf(StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """The canonical spelling of JSON texts; null stays null, invalid JSON fails."""
    return pd.Series([None if t is None else canonical(strict_loads(t)) for t in texts], dtype=object)


@F.pandas_udf(StringType())
def json_pointer(texts: pd.Series, pointers: pd.Series) -> pd.Series:
    """The value at a JSON pointer, as text if it is text, else as canonical JSON; null if it isn't there."""
    return pd.Series([None if t is None or p is None else _pointed(strict_loads(t), p) for t, p in zip(texts, pointers, strict=True)], dtype=object)


def _pointed(value: object, pointer: str) -> str | None:
    for part in pointer.split("/")[1:]:
        key = part.replace("~1", "/").replace("~0", "~")
        if isinstance(value, dict) and key in value:
            value = value[key]
        elif isinstance(value, list) and key.isdigit() and int(key) < len(value):
            value = value[int(key)]
        else:
            return None
    return value if isinstance(value, str) else canonical(value)


def same_keys(json_column: str, keys: list[str]) -> Column:
    """Whether a JSON object has exactly these keys."""
    return F.array_sort(F.json_object_keys(json_column)) == F.array(*[F.lit(k) for k in sorted(keys)])
