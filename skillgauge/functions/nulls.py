"""Row filters on missing values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def where_present(df: DataFrame, columns) -> DataFrame:
    """Rows in which none of the columns is null.

    Spelled as plain IS NOT NULL tests: unlike `dropna`, the optimizer knows the
    columns are present from here on and adds no filters of its own later, which
    lets two uses of the result share one shuffle.
    """
    for c in columns:
        df = df.where(F.col(c).isNotNull())
    return df
