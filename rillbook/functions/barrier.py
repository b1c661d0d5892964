"""Keep expensive columns from being evaluated again by a filter above them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def evaluated_once(df: DataFrame) -> DataFrame:
    """The same rows, with every column computed once.

    The optimizer pushes a filter on a computed column below the projection and repeats the whole
    expression there, several times when columns build on each other. A filter on the output of a
    generator stays above it.
    """
    return df.select(F.inline_outer(F.array(F.struct(*df.columns))))
