"""Keys that are compared loosely."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from papergrid.functions.udf import vectorised


@vectorised("string")
def _composed(texts: pd.Series) -> pd.Series:
    """NFC of the few strings that need it; null for the rest, which the caller leaves as they are."""
    out = pd.Series([None] * len(texts), dtype=object)
    for i in texts.to_numpy().nonzero()[0] if texts.notna().any() else ():
        if isinstance(t := texts.iloc[i], str):
            out.iloc[i] = unicodedata.normalize("NFC", t)
    return out


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def loose(text: Column) -> Column:
    """Trimmed, lower-cased, NFC; null if nothing is left. Only strings with characters from U+0300 on go through Python."""
    low = F.lower(strip(text))
    high = F.when(low.rlike(r"[^\x00-˿]"), low)
    return F.nullif(F.coalesce(_composed(high), low), F.lit(""))
