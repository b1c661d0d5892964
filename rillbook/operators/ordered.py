"""Running windows, latest-N and joins per key that survive hot keys, with one plan at all sizes.

A plain window sorts all rows of a key in one task. Where one user holds a third of the table that task
never ends. Here rows are dealt over ranges of (key, order); each range is a task of its own, and what
earlier ranges of its first key contribute (a maximum, a count, the last value) comes from one summary
row per range. A null key is a key like any other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rillbook.sources.storage import fixed

#: First cut of latest-N: a key's rows are ranked in so many shares before the best of all shares are.
SHARES = 64
_PART = "_part"


@dataclass(frozen=True)
class Running:
    """One running value: ``how`` is ``sum``, ``max`` or ``lag``; ``inclusive`` counts the row itself."""

    name: str
    col: Column
    how: str
    inclusive: bool = False


def join_per_key(rows: DataFrame, per_key: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join rows with a table of one row per key; null keys meet null keys.

    The table is stored first: run-time skew handling cuts a hot key only where both sides are dealt
    out for the join, which an aggregate on the same key is not.
    """
    mine = fixed(per_key.withColumnsRenamed({k: f"_k_{k}" for k in keys}), "per-key")
    on = [F.col(f"`{k}`").eqNullSafe(F.col(f"`_k_{k}`")) for k in keys]
    return rows.join(mine, on, how).drop(*[f"_k_{k}" for k in keys])


def in_ranges(df: DataFrame, keys: list[str], order: list[Column], ranges: int | None = None) -> DataFrame:
    """``df`` dealt over ranges of (keys, order), with the range's number as ``_part``.

    Stored, so that every later pass sees the same ranges. A boundary parts at most one key.
    """
    ways = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(ways, *[F.col(f"`{k}`") for k in keys], *order)
    return fixed(dealt.withColumn(_PART, F.spark_partition_id()), "ranges")


def running(df: DataFrame, keys: list[str], order: list[Column], values: list[Running], ranges: int | None = None) -> DataFrame:
    """Add running values per key in ascending ``order``; rows equal in it may come in any order."""
    cols = df.columns
    rows = in_ranges(df, keys, order, ranges)
    w = W.partitionBy(*keys, _PART).orderBy(*order)
    local = rows.select(*cols, _PART, *[_local(v, w).alias(f"_l_{v.name}") for v in values], F.row_number().over(w).alias("_rn"))
    summary = rows.groupBy(*keys, _PART).agg(*[_block_value(v, order) for v in values])
    wb = W.partitionBy(*keys).orderBy(_PART)
    carry = summary.select(
        *[F.col(f"`{k}`").alias(f"_k_{k}") for k in keys],
        F.col(_PART).alias("_k_part"),
        *[_carry(v, wb).alias(f"_c_{v.name}") for v in values],
        F.row_number().over(wb).alias("_nth"),
    ).filter("_nth > 1")
    # A key's second and later ranges start at a boundary: fewer rows than ranges, so broadcasting is safe.
    on = [F.col(f"`{k}`").eqNullSafe(F.col(f"`_k_{k}`")) for k in keys] + [F.col(_PART) == F.col("_k_part")]
    joined = local.join(F.broadcast(carry), on, "left")
    return joined.select(*cols, *[_combine(v).alias(v.name) for v in values])


def _local(v: Running, w) -> Column:
    if v.how == "lag":
        return F.lag(v.col).over(w)
    frame = w.rowsBetween(W.unboundedPreceding, 0 if v.inclusive else -1)
    return F.coalesce(F.sum(v.col).over(frame), F.lit(0)) if v.how == "sum" else F.max(v.col).over(frame)


def _block_value(v: Running, order: list[Column]) -> Column:
    if v.how == "lag":
        return F.max_by(F.struct(v.col.alias("v")), F.struct(*order)).alias(v.name)
    return (F.sum(v.col) if v.how == "sum" else F.max(v.col)).alias(v.name)


def _carry(v: Running, wb) -> Column:
    if v.how == "lag":
        return F.lag(F.col(v.name)).over(wb)["v"]
    frame = wb.rowsBetween(W.unboundedPreceding, -1)
    return F.sum(v.name).over(frame) if v.how == "sum" else F.max(v.name).over(frame)


def _combine(v: Running) -> Column:
    local, carry = F.col(f"_l_{v.name}"), F.col(f"_c_{v.name}")
    if v.how == "lag":
        return F.when(F.col("_rn") == 1, carry).otherwise(local)
    if v.how == "sum":
        return local + F.coalesce(carry, F.lit(0))
    return F.greatest(local, carry)


def latest_per_key(df: DataFrame, keys: list[str], newest_first: list[Column], n: int, rank: str = "rank_in_key") -> DataFrame:
    """The newest ``n`` rows of every key, numbered from 1.

    Rows are first ranked within shares of each key, so the last task of a hot key sees ``n`` rows per
    share. No job runs before the result is asked for.
    """
    cols = df.columns
    shared = df.withColumn("_share", F.pmod(F.monotonically_increasing_id(), F.lit(SHARES)))
    few = shared.withColumn("_r", F.row_number().over(W.partitionBy(*keys, "_share").orderBy(*newest_first))).filter(F.col("_r") <= n)
    w = W.partitionBy(*keys).orderBy(*newest_first)
    return few.select(*cols, F.row_number().over(w).cast("bigint").alias(rank)).filter(F.col(rank) <= n)
