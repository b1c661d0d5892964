"""The stored journal: appends that look only where their keys may lie, in batches or as a stream, and truncation.

Beside the rows, in folders by day, lies an index with one row per id and day and append: the lowest and the
highest number. Rows that go on where their id ended touch no span, so such an append reads no stored row.
One writer at a time.
"""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from rillbook.operators.journal import KEY, insertable, newest_snapshot, next_snapshots, refused, restore
from rillbook.schemas import JOURNAL
from rillbook.sources.storage import append_version, delete_folder, fixed, read_version, replace_table, write_batch

SPANS = "day DATE, persistence_id STRING, low BIGINT, high BIGINT"
SNAPSHOTS = "persistence_id STRING, snapshot_nr BIGINT, event_type STRING, n BIGINT, first_ts TIMESTAMP_NTZ, last_ts TIMESTAMP_NTZ"


def _beside(path: str, name: str) -> str:
    return f"{path.rstrip('/')}-{name}"


def conflicts_path(path: str) -> str:
    """The table beside a stored journal that holds the rows it refused."""
    return _beside(path, "conflicts")


def stream_conflicts_path(path: str) -> str:
    """The same for rows refused from a stream, in folders by micro-batch."""
    return _beside(path, "stream-conflicts")


def _by_day(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(T.StructType([*JOURNAL.fields, T.StructField("day", T.DateType())])).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def stored_journal(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows in storage, None before the first append."""
    table = _by_day(spark, path)
    return None if table is None else table.drop("day")


def stored_snapshots(spark: SparkSession, path: str) -> DataFrame:
    return read_version(spark, _beside(path, "snapshots"), SNAPSHOTS)


# ------------------------------------------------------------------------- index


def _spans(rows: DataFrame) -> DataFrame:
    """Null keys equal no key and are not indexed."""
    keyed = rows.dropna(subset=KEY).withColumn("day", F.to_date("ts"))
    return keyed.groupBy("day", "persistence_id").agg(F.min("sequence_nr").alias("low"), F.max("sequence_nr").alias("high"))


def stored_spans(spark: SparkSession, path: str) -> DataFrame:
    return read_version(spark, _beside(path, "spans"), SPANS)


def compact_spans(spark: SparkSession, path: str) -> None:
    """Spans of an id and day that follow each other become one, in the next version of the index.

    A group is the spans of one id and day: at most one for each append on that day.
    """
    of = W.partitionBy("day", "persistence_id")
    before = F.max("high").over(of.orderBy("low").rowsBetween(W.unboundedPreceding, -1))
    gaps = stored_spans(spark, path).withColumn("gap", F.coalesce((F.col("low") > before + 1).cast("int"), F.lit(0)))
    spans = gaps.withColumn("part", F.sum("gap").over(of.orderBy("low").rowsBetween(W.unboundedPreceding, 0)))
    spans = spans.groupBy("day", "persistence_id", "part").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("part")
    replace_table(spans, _beside(path, "spans"))


def touched_days(new: DataFrame, path: str) -> list[dt.date | None]:
    """The days that may hold a key of ``new``: a short list, as a journal has few thousand days."""
    asked = new.dropna(subset=KEY).groupBy("persistence_id").agg(F.min("sequence_nr").alias("from"), F.max("sequence_nr").alias("to"))
    spans = stored_spans(new.sparkSession, path).join(asked, "persistence_id")
    days = spans.filter((F.col("low") <= F.col("to")) & (F.col("high") >= F.col("from"))).select("day").distinct()
    return [r.day for r in days.collect()]


def _on_days(table: DataFrame, days: list[dt.date | None]) -> DataFrame:
    known = F.col("day").isin([d for d in days if d is not None])
    return table.filter(known | F.col("day").isNull() if None in days else known)


def taken_keys(new: DataFrame, path: str) -> DataFrame:
    """Keys and ``seq`` of the stored rows of the days that may hold a key of ``new``."""
    table = _by_day(new.sparkSession, path)
    names = [*KEY, "seq"]
    return new.filter(F.lit(False)).select(*names) if table is None else _on_days(table, touched_days(new, path)).select(*names)


def _uncovered(new: DataFrame, path: str) -> DataFrame:
    """Rows above the newest snapshot of their id; keys below it are taken though their rows may be gone."""
    last = newest_snapshot(stored_snapshots(new.sparkSession, path)).select(F.col("persistence_id").alias("_id"), "snapshot_nr")
    covered = (F.col("persistence_id") == F.col("_id")) & (F.col("sequence_nr") <= F.col("snapshot_nr"))
    return new.join(last, covered, "left_anti")


# ----------------------------------------------------------------------- appends


def _add(rows: DataFrame, path: str) -> None:
    """The index first: a span without its rows costs a read, rows without their span would cost a key.

    Folders by day serve reads by time; inside a folder the files are sorted by key, so that Parquet
    statistics serve reads of one id. Rebalancing by day gives files of even size: a full day is cut
    into several tasks, small days share one.
    """
    append_version(_spans(rows), _beside(path, "spans"))
    (
        rows.withColumn("day", F.to_date("ts"))
        .hint("rebalance", "day")
        .sortWithinPartitions("day", *KEY)
        .write.mode("append")
        .partitionBy("day")
        .parquet(path)
    )


def append_journal(new: DataFrame, path: str) -> None:
    """Append to the stored journal, keeping its key unique; rows whose key is taken go to the table of conflicts."""
    rows = insertable(_uncovered(new, path), taken_keys(new, path)).select(*JOURNAL.names)
    # Fixed first: both writes must see the same decision, and the append changes what it was made from.
    rows = fixed(rows, "journal-append")
    refused(new, rows).select(*JOURNAL.names).write.mode("append").parquet(conflicts_path(path))
    _add(rows, path)


def append_batch(new: DataFrame, batch_id: int, path: str) -> None:
    """The append of one micro-batch; a batch given again adds and reports what it did the first time.

    Rows that an earlier try stored are known by key and ``seq`` and are no conflicts; rows without a key are
    refused, as nothing could tell them from their repeats.
    """
    new = new.select(*JOURNAL.names)
    taken = fixed(taken_keys(new, path).join(new.select(*KEY), KEY, "left_semi"), "journal-taken")
    rows = fixed(insertable(_uncovered(new.dropna(subset=KEY), path), taken).select(*JOURNAL.names), "journal-append")
    write_batch(refused(new, taken.unionByName(rows.select(*taken.columns))), stream_conflicts_path(path), batch_id)
    _add(rows, path)


# -------------------------------------------------------------------- truncation


def live_rows(spark: SparkSession, path: str) -> DataFrame | None:
    """Stored rows above the newest snapshot of their id."""
    table = _by_day(spark, path)
    return None if table is None else _uncovered(table, path)


def truncate_journal(spark: SparkSession, path: str) -> None:
    """Take the snapshots that are due and delete the rows they cover.

    Snapshots come from the last ones and the rows above them, and are whole before any row goes. Only days
    that hold covered rows are rewritten, those without other rows are deleted. Stopped at any point before
    the days are swapped, nothing is lost, and a repeat ends where a single call would.
    """
    rows = live_rows(spark, path)
    if rows is None:
        return
    replace_table(next_snapshots(stored_snapshots(spark, path), rows.drop("day")), _beside(path, "snapshots"))
    last = newest_snapshot(stored_snapshots(spark, path))
    spans = fixed(stored_spans(spark, path).join(last, "persistence_id", "left"), "journal-spans")
    days = [r.day for r in spans.filter("low <= snapshot_nr").select("day").distinct().collect()]
    if not days:
        return
    held = fixed(_on_days(live_rows(spark, path), days).hint("rebalance", "day").sortWithinPartitions("day", *KEY), "journal-live")
    left = {r.day for r in held.select("day").distinct().collect()}
    held.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    for day in days:
        if day not in left:
            delete_folder(spark, f"{path.rstrip('/')}/day={day or '__HIVE_DEFAULT_PARTITION__'}")
    rest = spans.filter("snapshot_nr is null or high > snapshot_nr")
    low = F.greatest("low", F.coalesce(F.col("snapshot_nr") + 1, F.col("low")))
    replace_table(rest.select("day", "persistence_id", low.alias("low"), "high"), _beside(path, "spans"))


def restored_state(spark: SparkSession, path: str) -> DataFrame | None:
    """User state from the snapshots and the rows above them."""
    rows = live_rows(spark, path)
    return None if rows is None else restore(stored_snapshots(spark, path), rows.drop("day"))
