"""Functions of the user's own over columns, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def elementwise(function: Callable[..., object], kind: str, *columns: Column) -> Column:
    """``function`` of the values of each row, nulls as None; for what no built-in expression can say."""

    def batch(*series: pd.Series) -> pd.Series:
        values = [s.astype(object).where(s.notna(), None) for s in series]
        return pd.Series([function(*row) for row in zip(*values)], dtype=object)

    # One typed signature for any number of columns: Arrow's scalar form is inferred from it.
    batch.__annotations__ = {"series": pd.Series, "return": pd.Series}
    return F.pandas_udf(batch, kind)(*columns)


def vectorised(function: Callable[..., pd.Series], kind: str, *columns: Column) -> Column:
    """``function`` of whole batches of the columns, as pandas series."""

    def batch(*series: pd.Series) -> pd.Series:
        return function(*series)

    batch.__annotations__ = {"series": pd.Series, "return": pd.Series}
    return F.pandas_udf(batch, kind)(*columns)
