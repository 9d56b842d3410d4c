"""Metadata that is written as a Python literal."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.session import ship


def literal_map(text: str | None) -> dict[str, str | None]:
    """The entries of a dict literal, keys and values as strings (a string as it is, None as null, others as JSON where JSON
    has them, else as Python writes them); no entries for anything that is no dict literal, and keys that are no strings go."""
    try:
        value = ast.literal_eval((text or "").lstrip(" \t"))
    except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError):
        return {}
    if not isinstance(value, dict):
        return {}

    def written(v):
        if v is None or isinstance(v, str):
            return v
        try:
            return json.dumps(v, ensure_ascii=False)
        except TypeError:
            return repr(v)

    return {k: written(v) for k, v in value.items() if isinstance(k, str)}


def _mapped(text: pd.Series) -> pd.Series:
    return pd.Series([literal_map(t) for t in text], dtype=object)


literal_map_of = F.pandas_udf(_mapped, T.MapType(T.StringType(), T.StringType()))

ship(__name__)
