"""Where jobs keep intermediate tables and stream checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared folder named by ``spark.checkpoint.dir``.

    Only a local session that names none falls back to the temporary folder of this machine; on a
    cluster a lost executor must still be able to read what another one wrote.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="rillbook-")
    return f"{base.rstrip('/')}/rillbook/{name}-{uuid.uuid4().hex}"


def fixed(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh folder and read it back: later passes see the same rows and do not compute them again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def delete_folder(spark: SparkSession, path: str) -> None:
    store, folder = _file_system(spark, path)
    store.delete(folder, True)


def versions(spark: SparkSession, path: str, whole: bool = True) -> list[int]:
    """Numbers of a table's versions, ascending; a version is whole once its mark is there."""
    store, folder = _file_system(spark, path)
    if not store.exists(folder):
        return []
    names = [s.getPath().getName() for s in store.listStatus(folder)]
    found = [n for n in names if n.startswith("version=")]
    if whole:
        found = [n for n in found if store.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_WHOLE"))]
    return sorted(int(n.removeprefix("version=")) for n in found)


def replace_table(df: DataFrame, path: str, keep: int = 2) -> DataFrame:
    """Write ``df`` as the next version of a Parquet table and read it back.

    Readers take the newest whole version, so a writer that dies leaves the last one as it was. Older
    versions than the newest ``keep`` are deleted; readers of an old one should have finished by then.
    """
    spark = df.sparkSession
    number = max(versions(spark, path, whole=False), default=-1) + 1
    df.write.parquet(f"{path}/version={number}")
    store, mark = _file_system(spark, f"{path}/version={number}/_WHOLE")
    store.createNewFile(mark)
    for old in versions(spark, path)[:-keep]:
        delete_folder(spark, f"{path}/version={old}")
    return spark.read.schema(df.schema).parquet(f"{path}/version={number}")


def append_version(df: DataFrame, path: str) -> None:
    """Add rows to the newest version of a table, or make its first."""
    there = versions(df.sparkSession, path)
    if there:
        df.write.mode("append").parquet(f"{path}/version={there[-1]}")
    else:
        replace_table(df, path)


def read_version(spark: SparkSession, path: str, schema) -> DataFrame:
    """The newest whole version of a table; without one, no rows."""
    there = versions(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/version={there[-1]}") if there else spark.createDataFrame([], schema)


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write one micro-batch under its own folder.

    A batch replayed after a failure overwrites its own folder, so the table holds every row once.
    """
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_batches(spark: SparkSession, path: str, schema) -> DataFrame:
    """All micro-batches written by :func:`write_batch`, with their ``batch_id``."""
    return spark.read.schema(f"{_ddl(schema)}, batch_id BIGINT").parquet(path)


def _ddl(schema) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
