"""Text for search and embeddings."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_form(text: str | None) -> str:
    """Without accents, lower case, everything but letters and digits as single spaces, trimmed."""
    out = []
    for c in unicodedata.normalize("NFD", text or ""):
        kind = unicodedata.category(c)
        if kind == "Mn":
            continue
        out.append(c.lower() if kind[0] == "L" else c if kind == "Nd" else " ")
    return " ".join("".join(out).split())


def _normal_forms(texts: pd.Series) -> pd.Series:
    return texts.map(normal_form)


def normalize(text: Column, ascii_only: bool = False) -> Column:
    """normal_form of a column, "" for null. Pure ASCII columns stay in generated code; others go through Arrow."""
    if ascii_only:
        return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))
    return F.pandas_udf(_normal_forms, "string")(text)


def _as_text(value: Column) -> Column:
    return value.cast("string")


def embedding_text(fields: dict[str, Column], ascii_only: bool = False) -> Column:
    """`path:normalized` of each field that has text, joined by commas."""
    parts = []
    for path, column in fields.items():
        own = normalize(_as_text(column), ascii_only)
        parts.append(F.when(own != "", F.concat(F.lit(path + ":"), own)))
    return F.concat_ws(",", *parts)


def source_text(fields: Sequence[tuple[Column, str, str]], separator: str = " ") -> Column:
    """prefix + value + suffix of each (value, prefix, suffix) that has text, joined."""
    parts = [F.when(_as_text(c) != "", F.concat(F.lit(prefix), _as_text(c), F.lit(suffix))) for c, prefix, suffix in fields]
    return F.concat_ws(separator, *parts)


def like(text: Column, pattern: str) -> Column:
    """% is any run, _ any character; there is no escape character."""
    return text.like(pattern.replace("\\", "\\\\"))
