"""Readers of broker topics, as batch or stream, from a broker or from files with the same columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rillbook.schemas import BROKER, RECEIVED


def kafka_options(servers: str, topics: list[str], starting: str = "earliest", max_per_batch: int | None = None) -> dict[str, str]:
    """Options of the broker source. Positions live in the checkpoint; nothing is committed to the broker.

    ``max_per_batch`` bounds the messages of a micro-batch over all partitions; choose it by the memory of the executors.
    """
    if starting not in ("earliest", "latest"):
        raise ValueError("start from earliest or latest")
    opts = {
        "kafka.bootstrap.servers": servers,
        "subscribe": ",".join(topics),
        "startingOffsets": starting,
        "failOnDataLoss": "true",
    }
    if max_per_batch:
        opts["maxOffsetsPerTrigger"] = str(max_per_batch)
    return opts


def kafka_stream(spark: SparkSession, servers: str, topics: list[str], with_time: bool = False, **kw) -> DataFrame:
    raw = spark.readStream.format("kafka").options(**kafka_options(servers, topics, **kw)).load()
    return broker_columns(raw, with_time)


def broker_columns(raw: DataFrame, with_time: bool = False) -> DataFrame:
    """Text key and value with their position, and on request the time the broker took them in."""
    time = [F.col("timestamp").alias("received")] if with_time else []
    return raw.select("topic", "partition", "offset", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), *time)


def file_stream(spark: SparkSession, path: str, topics: list[str] | None = None, max_files: int | None = None, with_time: bool = False) -> DataFrame:
    """Parquet files carrying the broker columns; ``max_files`` bounds each micro-batch."""
    reader = spark.readStream.schema(RECEIVED if with_time else BROKER)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    rows = reader.parquet(path)
    return rows.filter(F.col("topic").isin(topics)) if topics else rows


def file_batch(spark: SparkSession, path: str, topics: list[str] | None = None) -> DataFrame:
    rows = spark.read.schema(BROKER).parquet(path)
    return rows.filter(F.col("topic").isin(topics)) if topics else rows


def jdbc_journal(spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int, partitions: int) -> DataFrame:
    """A journal kept in a database, read in parallel by ranges of a numeric key.

    Filters, column lists and grouped counts are pushed into the database by Spark.
    """
    return (
        spark.read.format("jdbc")
        .option("url", url)
        .option("dbtable", table)
        .option("partitionColumn", key)
        .option("lowerBound", lower)
        .option("upperBound", upper)
        .option("numPartitions", partitions)
        .option("pushDownAggregate", "true")
        .load()
    )
