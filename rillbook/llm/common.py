"""Helpers the operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from rillbook.sources.storage import scratch

#: The separators of words: space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: cuts lineage and fixes what was computed."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_in_buckets(df: DataFrame, name: str, column: str) -> DataFrame:
    """As :func:`stored`, in as many buckets by ``column`` as there are shuffle partitions.

    A join on this column with a small table deals out only the small one. Nothing is shuffled here: where a
    task holds few values of the column, it writes few files.
    """
    spark, table = df.sparkSession, f"rillbook_{uuid.uuid4().hex}"
    df.write.bucketBy(shuffles(df), column).option("path", scratch(spark, name)).format("parquet").saveAsTable(table)
    return spark.table(table)


def packed(df: DataFrame, name: str = "row") -> DataFrame:
    """All columns as one struct, so that no name of the caller can clash with an operator's own."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name))


def unpacked(df: DataFrame, name: str = "row", replaced: dict[str, Column] | None = None) -> DataFrame:
    """The columns of a frame made by :func:`packed`, some of them with new values."""
    new = replaced or {}
    fields = df.schema[name].dataType.names
    return df.select(*[(new[c] if c in new else F.col(name).getField(c)).alias(c) for c in fields])


def shuffles(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
