"""JSON text in and out, and pandas UDFs over it."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def load(text: str | None) -> Any:
    """The value, or None for null and for text that isn't JSON."""
    try:
        return None if text is None else json.loads(text)
    except ValueError:
        return None


def dump(value: Any) -> str:
    """Compact, keys sorted, characters as they are."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def over(kind: str, f: Callable[..., Any], *cols: Column) -> Column:
    """Applies f to the values of each row, a batch at a time; null where the first is null."""

    @F.pandas_udf(kind)
    def run(*series: pd.Series) -> pd.Series:
        out = [None if row[0] is None else f(*row) for row in zip(*series, strict=True)]
        return pd.Series(out, dtype=object)

    return run(*cols)


def objects(value: Any) -> list[dict]:
    """The objects in a list; none if it isn't a list."""
    return [x for x in value if isinstance(x, dict)] if isinstance(value, list) else []


def text_at(value: Any, key: str, default: str | None = None) -> Any:
    got = value.get(key) if isinstance(value, dict) else None
    return got if isinstance(got, str) else default


def whole(value: Any) -> int | None:
    return value if isinstance(value, int) and not isinstance(value, bool) and 0 <= value < 1 << 64 else None
