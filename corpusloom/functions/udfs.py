"""The few functions that Spark has no expression for, as Arrow-batched pandas UDFs."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Unicode normal form C; null stays null."""
    return texts.map(lambda t: unicodedata.normalize("NFC", t) if isinstance(t, str) else None)
