"""Unicode normal forms, which Spark has no built-in for; used only where a cheap test says that a text needs it."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Combining marks and compatibility characters: a text without them is NFC and NFKC for the scripts in use.
SUSPECT = r"[\x{300}-\x{36F}\x{A0}\x{A8}\x{AA}\x{AF}\x{B2}-\x{B5}\x{B8}-\x{BA}\x{BC}-\x{BE}\x{2000}-\x{2BFF}\x{3000}\x{FB00}-\x{FFFF}]"


def _normal(form: str):
    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize(form, t), na_action="ignore")

    return run


def normalized(df: DataFrame, column: str, form: str = "NFC") -> DataFrame:
    """df with the column in a normal form; rows that cannot need it don't pass through Python."""
    odd = F.coalesce(F.col(column).rlike(SUSPECT), F.lit(False))
    return df.where(~odd).unionByName(df.where(odd).withColumn(column, _normal(form)(F.col(column))))


def nfc(x: Column) -> Column:
    return _normal("NFC")(x)
