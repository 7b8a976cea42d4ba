"""Raw sources taken out of JSON texts of any shape and depth; every other field stays."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _kept(name: str, value: object, of: dict) -> bool:
    """Whether an object keeps a field: not the source of a file (a path, a source and no symbol's name), nor a list
    `files` with any entry that has a source."""
    text = lambda key: isinstance(of.get(key), str)
    if name == "source":
        return not (text("source") and text("relativePath") and not text("fqn"))
    return not (name == "files" and isinstance(value, list) and any(isinstance(x, dict) and "source" in x for x in value))


def redacted(value: object) -> object:
    if isinstance(value, list):
        return [redacted(x) for x in value]
    if isinstance(value, dict):
        return {k: redacted(v) for k, v in value.items() if _kept(k, v, value)}
    return value


def _constant(name: str) -> None:
    raise ValueError(name)


def redacted_text(text: str | None) -> str | None:
    """None for what isn't JSON, or is nested deeper than it can be read."""
    try:
        return None if text is None else json.dumps(redacted(json.loads(text, parse_constant=_constant)), separators=(",", ":"))
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(T.StringType())
def without_sources(texts: pd.Series) -> pd.Series:
    """JSON texts without raw sources, written compactly in ASCII, fields in their order (of repeated names the last
    value counts); null for null and for what isn't JSON."""
    return texts.map(redacted_text, na_action="ignore").astype(object)
