"""Session settings every job of this package relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Settings that may be changed on a running session.
RUNTIME_CONF = {
    # Journal times are stored without a zone; UTC makes casts between the two timestamp types neutral.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot user must be split even where the split costs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Keyed state larger than the heap, kept on executor disks and saved to the checkpoint folder.
    "spark.sql.streaming.stateStore.providerClass": STATE_STORE,
}

#: Settings that may be changed on a running session; for tables of long texts. A task then holds less of them at once,
#: on both sides of Python. No result depends on them.
LONG_TEXT_CONF = {
    # Rows that go to a Python worker together; the default is 10,000 rows or 64 MB.
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
    # Rows that are decoded together.
    "spark.sql.parquet.columnarReaderBatchSize": "512",
    # A writer holds a row group, a reader its columns.
    "parquet.block.size": str(16 << 20),
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def configure_long_texts(spark: SparkSession) -> SparkSession:
    """Apply the settings for long texts to a session."""
    for key, value in LONG_TEXT_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(
    cores: str | int = "*", shuffle_partitions: int = 8, app: str = "rillbook", checkpoint_dir: str | None = None
) -> SparkSession:
    """A single-JVM session for tests and benchmarks; ``checkpoint_dir`` holds intermediate tables."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
