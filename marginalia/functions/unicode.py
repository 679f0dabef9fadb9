"""Compatibility normalisation, the one text rule Spark has no built-in for."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from marginalia import constants as C


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


def sheet_name_key(col: Column) -> Column:
    """NFKC form without white space."""
    return F.regexp_replace(_nfkc(F.coalesce(col, F.lit(""))), f"{C.WS}+", "")
