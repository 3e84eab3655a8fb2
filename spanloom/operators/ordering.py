"""Ordering rule of result tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sort_table(df: DataFrame, column: str, descending: bool = True) -> DataFrame:
    """Sort by one column; a descending sort is the exact reverse, so NULLs come first there."""
    order = F.col(column).desc_nulls_first() if descending else F.col(column).asc_nulls_last()
    return df.orderBy(order)
