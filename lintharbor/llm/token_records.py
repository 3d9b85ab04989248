"""Token ids as length-delimited binary records with masked checksums, and an offset index.

A record is, in bytes, little-endian:

    8   length of the payload
    4   masked CRC-32 of those 8 bytes
    n   payload: 8 bytes doc_id, 1 byte flags (1: doc_id is NULL), 1 byte width of an id, ids
    4   masked CRC-32 of the payload
    1   line feed, which ends the record

Files are written by Spark's own writer and commit protocol, in ascending order of doc_id over the
file names, so a retried task leaves no torn file, and any Hadoop file system will do. The index
(file, offset, length, doc_id, start, n_tokens) is a Parquet table beside them: a reader that
shuffles takes records by file and offset.

Defined results: NULL and empty texts are the end id alone. Rows with a NULL doc_id come first, and
rows with the same doc_id are ordered by a hash of their text; each row is its own record. An empty
table gives no records. Other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_sized, shared_dir, stored
from .tokens import encoder, vocabulary_path

_HEAD, _TAIL = 12, 5
INDEX = "file string, doc_id bigint, offset bigint, length bigint, n_tokens bigint, ids_crc32 bigint, start_in_file bigint"


def masked(crc: int) -> int:
    """Rotated and shifted, so that a checksum of data that holds checksums stays sound."""
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """A record without its last byte, which Spark's writer adds."""
    length = len(payload).to_bytes(8, "little")
    return b"".join((
        length, masked(zlib.crc32(length)).to_bytes(4, "little"),
        payload, masked(zlib.crc32(payload)).to_bytes(4, "little")))


def frames_in(content: memoryview):
    """(offset, payload) of each record of a file; raises where a checksum or border is wrong."""
    at, end = 0, len(content)
    while at < end:
        length = int.from_bytes(content[at: at + 8], "little")
        stop = at + _HEAD + length
        if masked(zlib.crc32(content[at: at + 8])) != int.from_bytes(content[at + 8: at + 12], "little"):
            raise ValueError(f"length checksum differs at {at}")
        payload = content[at + _HEAD: stop]
        if len(payload) != length or stop + _TAIL > end or content[stop + 4] != 10:
            raise ValueError(f"record at {at} is cut short")
        if masked(zlib.crc32(payload)) != int.from_bytes(content[stop: stop + 4], "little"):
            raise ValueError(f"payload checksum differs at {at}")
        yield at, payload
        at = stop + _TAIL


def ids_of(payload: memoryview) -> tuple[int | None, np.ndarray]:
    doc_id = None if payload[8] else int.from_bytes(payload[:8], "little", signed=True)
    return doc_id, np.frombuffer(payload[10:], dtype=f"<u{payload[9]}")


def write_records(docs: DataFrame, out: str, path: str | None = None, end_id: int = 0, text: str = "text") -> None:
    """Encode each text of `docs`, end it with `end_id`, and write the record files and their index below `out`."""
    path = path or vocabulary_path()

    def encoded(batches):
        import pyarrow as pa

        encode = encoder(path)
        end = np.array([end_id], dtype=encode.dtype).tobytes()
        width = bytes([encode.dtype.itemsize])
        for batch in batches:
            made = []
            for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                key = (doc_id or 0).to_bytes(8, "little", signed=True) + bytes([doc_id is None])
                made.append(frame(b"".join((key, width, encode(body.as_py()).tobytes(), end))))
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["frame"])

    order = ["doc_id", "_h"]
    placed = (
        docs.select("doc_id", F.col(text).alias("_t")).withColumn("_h", F.xxhash64("_t"))
        .repartitionByRange(*order).sortWithinPartitions(*order))
    (placed.select("doc_id", "_t").mapInArrow(encoded, "frame binary")
     .select(F.col("frame").cast("string").alias("value")).write.text(f"{out}/records"))
    build_index(docs.sparkSession, out)


def build_index(spark: SparkSession, out: str) -> None:
    """Read every record, check it, and write the index table."""

    def parsed(batches):
        import pyarrow as pa

        names = [f.split()[0] for f in INDEX.split(", ")]
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1)):
                rows, start = [], 0
                for at, payload in frames_in(memoryview(content.as_buffer())):
                    doc_id, ids = ids_of(payload)
                    crc = zlib.crc32(ids.astype("<u4").tobytes())
                    rows.append((file.as_py(), doc_id, at, len(payload), len(ids), crc, start))
                    start += len(ids)
                columns = list(zip(*rows)) or [()] * len(names)
                kinds = [pa.string()] + [pa.int64()] * (len(names) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{out}/records")
    rows = stored(files.select(F.substring_index("path", "/", -1).alias("file"), "content").mapInArrow(parsed, INDEX))
    # One row a file: the running sum over files is short however many records they hold.
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    starts = stored(totals.select("file", before.alias("_before")))
    (join_sized(rows, starts, ["file"], "inner", 50_000)
     .select("file", "offset", "length", "doc_id", (F.col("_before") + F.col("start_in_file")).alias("start"),
             "n_tokens", "ids_crc32")
     .write.parquet(f"{out}/index"))


def read_index(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/index")


def read_records(spark: SparkSession, out: str, wanted: DataFrame) -> DataFrame:
    """Records of `wanted` (rows of the index, in any order): its columns and `ids`, array of int.

    The record bytes are cut out by offset in the JVM; only they reach Python.
    """

    def opened(batches):
        import pyarrow as pa

        for batch in batches:
            ids = [ids_of(next(frames_in(memoryview(v.as_buffer())))[1])[1].astype(np.int32) for v in batch.column("_record")]
            kept = [i for i, n in enumerate(batch.schema.names) if n != "_record"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in kept), pa.array(ids, pa.list_(pa.int32()))],
                [*(batch.schema.names[i] for i in kept), "ids"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{out}/records")
    named = files.select(F.substring_index("path", "/", -1).alias("file"), "content")
    record = F.substring("content", F.col("offset").cast("int") + 1, F.col("length").cast("int") + _HEAD + _TAIL)
    cut = named.join(wanted, "file").select(*wanted.columns, record.alias("_record"))
    return cut.mapInArrow(opened, f"{', '.join(f'{n} {t}' for n, t in wanted.dtypes)}, ids array<int>")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
