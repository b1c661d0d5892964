"""The append-only journal: keys, appends, snapshots, replay, pages and inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rillbook.functions.text import ratio
from rillbook.operators.ingest import user_journal, user_of
from rillbook.operators.ordered import Running, join_per_key, running
from rillbook.operators.state import merge_states, user_type_counts
from rillbook.schemas import PERSISTENCE_PREFIX, SNAPSHOT_EVERY, SNAPSHOTS_KEPT


def persistence_id(user: Column) -> Column:
    return F.concat(F.lit(PERSISTENCE_PREFIX), user)


# --------------------------------------------------------------------- history


def history_counts(journal: DataFrame) -> DataFrame:
    """Events per user and type with the time of the newest."""
    return user_journal(journal).groupBy("user_id", "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_updated")
    )


def user_history(journal: DataFrame, user_id: str) -> DataFrame:
    """The same for one user; the key equality reaches the scan."""
    rows = journal.filter(F.col("persistence_id") == PERSISTENCE_PREFIX + user_id)
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_updated"))


# --------------------------------------------------------------------- appends


def highest_sequence(journal: DataFrame) -> DataFrame:
    return journal.groupBy("persistence_id").agg(F.max("sequence_nr").alias("highest"))


def assign_sequence(new: DataFrame, journal: DataFrame | None = None, ranges: int | None = None) -> DataFrame:
    """Number new rows per id after the highest number already taken."""
    rows = new.withColumn("persistence_id", persistence_id(F.col("user_id"))).drop("user_id")
    numbered = running(
        rows, ["persistence_id"], [F.col("ts"), F.col("seq")],
        [Running("sequence_nr", F.lit(1).cast("bigint"), "sum", True)], ranges,
    )
    if journal is None:
        return numbered
    return (
        join_per_key(numbered, highest_sequence(journal), ["persistence_id"], "left")
        .withColumn("sequence_nr", F.col("sequence_nr") + F.coalesce("highest", F.lit(0)))
        .drop("highest")
    )


KEY = ["persistence_id", "sequence_nr"]


def key_conflicts(new: DataFrame, journal: DataFrame) -> DataFrame:
    """New rows whose key is taken."""
    return new.join(journal.select(*KEY), KEY, "left_semi")


def insertable(new: DataFrame, journal: DataFrame) -> DataFrame:
    """New rows whose key is free; of several new rows with one key the lowest ``seq`` stays."""
    rest = [c for c in new.columns if c not in KEY]
    one = new.groupBy(*KEY).agg(F.min_by(F.struct(*rest), "seq").alias("r")).select(*KEY, "r.*")
    return one.select(*new.columns).join(journal.select(*KEY), KEY, "left_anti")


def refused(new: DataFrame, added: DataFrame) -> DataFrame:
    """New rows that were not added; null keys meet null keys."""
    names = [*KEY, "seq"]
    have = added.select(*[F.col(c).alias(f"_a_{c}") for c in names])
    on = [F.col(c).eqNullSafe(F.col(f"_a_{c}")) for c in names]
    return new.join(have, on, "left_anti")


# -------------------------------------------------------- snapshots and replay


def _with_last_snapshot(journal: DataFrame) -> DataFrame:
    last = highest_sequence(journal).select(
        "persistence_id", (F.floor(F.col("highest") / SNAPSHOT_EVERY) * SNAPSHOT_EVERY).alias("last_snapshot")
    )
    return join_per_key(journal, last, ["persistence_id"])


def snapshots(journal: DataFrame) -> DataFrame:
    """State by type at the newest snapshot points of every id, long form.

    An event enters the kept snapshots at one point and stays in all later ones, so the events are
    first counted by entry point (a few rows per id and type) and only those counts are spread.
    """
    rows = _with_last_snapshot(journal)
    first = F.ceil(F.col("sequence_nr") / SNAPSHOT_EVERY) * SNAPSHOT_EVERY
    oldest_kept = F.greatest(
        F.lit(SNAPSHOT_EVERY).cast("bigint"), F.col("last_snapshot") - SNAPSHOT_EVERY * (SNAPSHOTS_KEPT - 1)
    )
    entered = (
        rows.withColumn("entry", F.greatest(first, oldest_kept))
        .filter(F.col("entry") <= F.col("last_snapshot"))
        .groupBy("persistence_id", "event_type", "last_snapshot", "entry")
        .agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    )
    points = F.sequence("entry", "last_snapshot", F.lit(SNAPSHOT_EVERY).cast("bigint"))
    return (
        entered.withColumn("snapshot_nr", F.explode(points))
        .groupBy("persistence_id", "snapshot_nr", "event_type")
        .agg(F.sum("n").alias("n"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))
    )


def newest_snapshot(snapshot_rows: DataFrame) -> DataFrame:
    return snapshot_rows.groupBy("persistence_id").agg(F.max("snapshot_nr").alias("snapshot_nr"))


def next_snapshots(old: DataFrame, tail: DataFrame) -> DataFrame:
    """The snapshots to keep after the rows of ``tail``, made from the kept ones and these rows only.

    ``tail`` holds the rows above the newest snapshot of their id. Ids that reach no new point keep theirs.
    """
    every = F.lit(SNAPSHOT_EVERY).cast("bigint")
    last = highest_sequence(tail).select(
        "persistence_id", (F.floor(F.col("highest") / SNAPSHOT_EVERY) * SNAPSHOT_EVERY).alias("last_snapshot")
    )
    ids = (
        last.join(newest_snapshot(old), "persistence_id", "left")
        .withColumn("base", F.coalesce("snapshot_nr", F.lit(0)))
        .filter(F.col("last_snapshot") > F.col("base"))
        .withColumn("first_new", F.greatest(F.col("base") + every, F.col("last_snapshot") - every * (SNAPSHOTS_KEPT - 1)))
        .select("persistence_id", "last_snapshot", "base", "first_new")
    )
    first = F.ceil(F.col("sequence_nr") / SNAPSHOT_EVERY) * SNAPSHOT_EVERY
    added = (
        join_per_key(tail, ids, ["persistence_id"])
        .withColumn("entry", F.greatest(first, "first_new"))
        .filter(F.col("entry") <= F.col("last_snapshot"))
        .groupBy("persistence_id", "event_type", "last_snapshot", "entry")
        .agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    )
    base = old.join(ids, "persistence_id").filter(F.col("snapshot_nr") == F.col("base"))
    entered = added.unionByName(base.withColumn("entry", F.col("first_new")).select(*added.columns))
    new = (
        entered.withColumn("snapshot_nr", F.explode(F.sequence("entry", "last_snapshot", every)))
        .groupBy("persistence_id", "snapshot_nr", "event_type")
        .agg(F.sum("n").alias("n"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))
    )
    oldest = F.coalesce(F.col("last_snapshot") - every * (SNAPSHOTS_KEPT - 1), F.lit(0))
    kept = old.join(ids.select("persistence_id", "last_snapshot"), "persistence_id", "left").filter(F.col("snapshot_nr") >= oldest)
    return new.unionByName(kept.select(*new.columns))


def live_journal(journal: DataFrame) -> DataFrame:
    """Rows no snapshot covers; the others may be deleted."""
    return _with_last_snapshot(journal).filter(F.col("sequence_nr") > F.col("last_snapshot")).select(*journal.columns)


def replay(journal: DataFrame) -> DataFrame:
    """User state from every journal row."""
    return user_type_counts(user_journal(journal))


def restore(snapshot_rows: DataFrame, tail: DataFrame) -> DataFrame:
    """User state from the newest snapshot of each id and the rows after it."""
    base = snapshot_rows.join(newest_snapshot(snapshot_rows), ["persistence_id", "snapshot_nr"], "left_semi").select(
        user_of(F.col("persistence_id")).alias("user_id"), "event_type", "n", "first_ts", "last_ts"
    )
    return merge_states(base, replay(tail))


# ------------------------------------------------------------ pages and reports


def page(journal: DataFrame, pid: str, from_sequence: int, limit: int) -> DataFrame:
    return journal.filter((F.col("persistence_id") == pid) & (F.col("sequence_nr") >= from_sequence)).orderBy("sequence_nr").limit(limit)


def latest_rows(journal: DataFrame, limit: int = 10) -> DataFrame:
    return journal.orderBy(F.desc("ts"), "persistence_id", "sequence_nr").limit(limit)


def latest_rows_of(journal: DataFrame, pid: str, limit: int = 10) -> DataFrame:
    return journal.filter(F.col("persistence_id") == pid).orderBy(F.desc("sequence_nr")).limit(limit)


def persistence_ids(journal: DataFrame) -> DataFrame:
    return journal.select("persistence_id").distinct().orderBy("persistence_id")


def summary(journal: DataFrame) -> DataFrame:
    """Count, first and last per id, largest first."""
    return (
        journal.groupBy("persistence_id")
        .agg(F.count(F.lit(1)).alias("event_count"), F.min("ts").alias("first_event"), F.max("ts").alias("last_event"))
        .orderBy(F.desc("event_count"), "persistence_id")
    )


def summary_totals(journal: DataFrame) -> DataFrame:
    per_id = journal.groupBy("persistence_id").agg(F.count(F.lit(1)).alias("n"))
    return per_id.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_events"), F.count(F.lit(1)).alias("total_ids"))


def inventory(journal: DataFrame) -> DataFrame:
    """Events and highest sequence number per id."""
    return journal.groupBy("persistence_id").agg(
        F.count(F.lit(1)).alias("event_count"), F.max("sequence_nr").alias("highest_sequence_nr")
    ).withColumn("user_id", user_of(F.col("persistence_id")))


def stream_statistics(journal: DataFrame) -> DataFrame:
    """Ids, events, and the mean per id both as whole number and exactly."""
    t = summary_totals(journal)
    whole = F.when(F.col("total_ids") > 0, F.floor(F.col("total_events") / F.col("total_ids"))).otherwise(F.lit(0))
    return t.select(
        "total_ids", "total_events", whole.cast("bigint").alias("avg_events_whole"),
        ratio(F.col("total_events"), F.col("total_ids")).alias("avg_events"),
    )
