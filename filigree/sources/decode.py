"""Bytes to text: charsets and HTML character references (Arrow functions; the rest of the library is native)."""

from __future__ import annotations

import codecs
import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DECLARED = re.compile(rb'charset="?([^"]*)"')


def _decode(raw: bytes | None) -> tuple[str | None, str | None]:
    if raw is None:
        return None, None
    found = DECLARED.search(raw)
    if found:
        name = found[1].decode("ascii", "replace").strip()
        try:
            return raw.decode(codecs.lookup(name).name), None
        except (LookupError, UnicodeDecodeError) as failure:
            return None, f"{type(failure).__name__}: {name}"
    try:
        return raw.decode("utf-8"), None
    except UnicodeDecodeError:
        return raw.decode("cp1252", "replace"), None


def decode_bytes(raw: Column) -> Column:
    """struct<text, failure>: by the declared charset, else as UTF-8 if valid, else as windows-1252.

    A charset that is unknown or cannot decode the bytes gives a failure and no text. Null gives nulls.
    """

    def run(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_decode(r) for r in values], columns=["text", "failure"])

    return F.pandas_udf(run, "text string, failure string")(raw)


def unescape(text: Column) -> Column:
    """HTML character references resolved."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda t: None if t is None else html.unescape(t))

    return F.pandas_udf(run, "string")(text)
