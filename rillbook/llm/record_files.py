"""Token sequences in length-delimited binary record files with masked checksums and an offset index.

A record is: length (8 bytes), masked checksum of these (4), payload, masked checksum of the payload (4),
all little-endian. The payload is flags (1 byte: whether there is an id, whether token ids are wide), the
id (8) and the token ids (4 bytes each if any is over 65535, else 2). An index file beside each record file holds the offset of every record, so
that a reader can take records in any order. Files hold consecutive ranges of ids.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from rillbook.llm.chunks import ChunkEncoder, pack_each
from rillbook.llm.common import scratch, shuffles, stored

#: A record file is closed once it holds so many bytes; one longer document is one record all the same.
FILE_BYTES = 32 << 20
#: Fixed value: what is added to a rotated checksum, so that checksums of data with checksums stay good.
MASK = 0xA282EAD8
HEAD, HEAD_BYTES = "<QI", 12
ID, ID_BYTES = "<Bq", 9


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def payloads(data: bytes) -> Iterator[tuple[int, memoryview]]:
    """(offset, payload) of every record; raises where a checksum or length does not fit."""
    at, view = 0, memoryview(data)
    while at < len(data):
        if at + HEAD_BYTES > len(data):
            raise ValueError(f"record at {at} is cut off")
        length, check = struct.unpack_from(HEAD, data, at)
        end = at + HEAD_BYTES + length
        if check != masked(data[at : at + 8]) or end + 4 > len(data):
            raise ValueError(f"bad length of the record at {at}")
        payload = view[at + HEAD_BYTES : end]
        if struct.unpack_from("<I", data, end)[0] != masked(payload):
            raise ValueError(f"bad checksum of the record at {at}")
        yield at, payload
        at = end + 4


def record(data: bytes, offset: int) -> memoryview:
    """One record by its offset, as a shuffled reader takes it."""
    length, _ = struct.unpack_from(HEAD, data, offset)
    return next(payloads(data[offset : offset + HEAD_BYTES + length + 4]))[1]


def sequence(payload: memoryview) -> tuple[int | None, np.ndarray]:
    """(doc_id, token ids) of a record."""
    flags, doc_id = struct.unpack_from(ID, payload)
    return doc_id if flags & 1 else None, np.frombuffer(payload[ID_BYTES:], "<u4" if flags & 2 else "<u2").astype("<u4")


#: Chunks per call of the library.
CALL = 2_000


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ChunkEncoder:
    """One per Python worker. Only a tokenizer that splits like the chunks may be used: byte-level, by pattern.

    Texts that hold the literal of an added token are encoded whole, as such a token ends a chunk anywhere.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(path)

    def encode(chunks: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(chunks), CALL):
            out += pack_each([e.ids for e in one.encode_batch_fast(chunks[at : at + CALL], add_special_tokens=False)])
        return out

    return ChunkEncoder(encode, [t.content for t in one.get_added_tokens_decoder().values()])


def _put(folder: str, name: str, parts: list[bytes]) -> None:
    """Write a file under a name of its own, then move it: a repeated task leaves one whole file."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    spare = f"{root}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(spare) as out:
        for part in parts:
            out.write(part)
    store.move(spare, f"{root}/{name}")


_WRITTEN = "file string, part int, piece int, n_records bigint, n_ids bigint, n_bytes bigint"


def write_records(docs: DataFrame, folder: str, path: str, end_id: int, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encode all texts and write record files in ascending order of doc_id; one row per file.

    Null ids come first, a null text is empty, rows of one id are ordered by their text's hash. The
    content of a file depends on its rows only, so a repeated task writes the same files again.
    """
    spark = docs.sparkSession
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(folder)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(place)
    # A folder without a scheme lies where Spark's own readers look for it.
    qualified = store.makeQualified(place).toString()
    uri = qualified if "://" in qualified else qualified.replace("file:", "file://", 1)
    end = np.array([end_id], "<u4")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encoder = TaskContext.get().partitionId(), tokenizer(path)
        done, frames, offsets, size, ids = [], [], [], 0, 0

        def close():
            nonlocal frames, offsets, size, ids
            name = f"part-{part:06d}-{len(done):05d}"
            _put(uri, f"{name}.rec", frames)
            _put(uri, f"{name}.idx", [np.array(offsets, "<u8").tobytes()])
            done.append((f"{name}.rec", part, len(done), len(frames), ids, size))
            frames, offsets, size, ids = [], [], 0, 0

        for batch in batches:
            known, doc_id, text = batch.columns
            for k, i, own in zip(known.to_pylist(), doc_id.to_pylist(), encoder.encode(text)):
                packed = np.concatenate((own, end))
                wide = int(packed.max()) > 0xFFFF
                framed = frame(struct.pack(ID, k | wide << 1, i) + packed.astype("<u4" if wide else "<u2").tobytes())
                if frames and size + len(framed) > file_bytes:
                    close()
                offsets.append(size)
                frames.append(framed)
                size, ids = size + len(framed), ids + len(packed)
        if frames:
            close()
        kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}
        kept = pa.schema([(name, kinds[kind]) for name, kind in map(str.split, _WRITTEN.split(", "))])
        yield pa.RecordBatch.from_pylist([dict(zip(kept.names, row)) for row in done], kept)

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").isNotNull().cast("int").alias("known"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("doc_id"),
        text.alias("text"), F.xxhash64(text).alias("tie"),
    )
    order = ["known", "doc_id", "tie"]
    ranged = rows.repartitionByRange(max(1, shuffles(docs)), *order).sortWithinPartitions(*order).drop("tie")
    return stored(ranged.mapInArrow(write, _WRITTEN), "record-list")


_READ = "file string, place bigint, doc_id bigint, before bigint, n_tokens bigint, ids_crc32 bigint"


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """(file, place, doc_id, before, n_tokens, ids_crc32) of every record; ``before`` counts ids in the file."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch.path, batch.content):
                rows, before = [], 0
                for place, (_, payload) in enumerate(payloads(data)):
                    doc_id, ids = sequence(payload)
                    rows.append((name.rpartition("/")[2], place, doc_id, before, len(ids), zlib.crc32(ids.tobytes())))
                    before += len(ids)
                out = pd.DataFrame(rows, columns=[c.split()[0] for c in _READ.split(", ")])
                yield out.astype({"doc_id": "Int64"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.rec").load(folder)
    return files.select("path", "content").mapInPandas(parse, _READ)


def document_records(docs: DataFrame, path: str, end_id: int, file_bytes: int = FILE_BYTES, folder: str | None = None) -> DataFrame:
    """Write all documents as record files, read the files back, and give where each document's ids lie.

    ``start`` counts the ids of all records before a document's own: files in order, records in file
    order. An empty table writes no file and gives no row. Repeated rows are repeated records.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark, "records")
    written = write_records(docs, folder, path, end_id, file_bytes)
    # One row per file: sums per part first, then within a part.
    parts = written.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    whole = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("part_ids").over(whole), F.lit(0)).alias("part_start"))
    within = W.partitionBy("part").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    starts = written.join(parts, "part").select(
        "file", (F.col("part_start") + F.coalesce(F.sum("n_ids").over(within), F.lit(0))).alias("file_start")
    )
    starts = stored(starts, "record-starts")
    return (
        read_records(spark, folder)
        .join(starts, "file")
        .select("doc_id", (F.col("file_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
    )
