"""Token ids as length-delimited binary records, with a separate offset index.

A data file is a run of records:

    length    8 bytes  little-endian, bytes of the payload
    check     4 bytes  masked CRC-32 of those 8 bytes
    payload   8 bytes  doc_id (signed; the lowest number: none), 4 bytes width of an id (2 or 4), then the ids
    check     4 bytes  masked CRC-32 of the payload
    newline   1 byte   0x0A, written by Spark's text sink between records

The mask rotates the CRC right by 15 bits and adds a constant, so that a checksum stored
in checked data does not check itself. Every number is little-endian. Files are written
and read by Spark alone, so they can lie in any store that Spark reaches; a file holds
at most ``RECORDS_PER_FILE`` records. The index has one row per record with file, byte
offset and length, so that a shuffled reader can fetch records in any order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from companylens.llm.kernels import blocks, text_bytes
from companylens.llm.tokenise import piece_encoder, vocabulary_path
from companylens.operators.distributed import fresh_path

# Rotation and constant of the mask.
MASK_BITS = 15
MASK_ADD = 0xA282EAD8

RECORDS_PER_FILE = 4_000
END_ID = 1
# In the place of a null doc_id.
NO_ID = -(1 << 63)

INDEX_SCHEMA = (
    "file string, offset long, length long, doc_id long, n_tokens long, ids_crc32 long"
)


def masked(crc: int) -> int:
    return (((crc >> MASK_BITS) | (crc << (32 - MASK_BITS))) + MASK_ADD) & 0xFFFFFFFF


def frame(doc_id: int, ids: np.ndarray, width: int) -> bytes:
    """One record without the newline."""
    payload = (
        int(doc_id).to_bytes(8, "little", signed=True)
        + width.to_bytes(4, "little")
        + ids.astype(f"<u{width}").tobytes()
    )
    length = len(payload).to_bytes(8, "little")
    return b"".join(
        (
            length,
            masked(zlib.crc32(length)).to_bytes(4, "little"),
            payload,
            masked(zlib.crc32(payload)).to_bytes(4, "little"),
        )
    )


def read_records(content: bytes) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """Offset, length, doc_id and ids of each record of a file; raises on damage."""
    at, view = 0, memoryview(content)
    while at < len(view):
        head = bytes(view[at : at + 8])
        size = int.from_bytes(head, "little")
        end = at + 12 + size
        if masked(zlib.crc32(head)) != int.from_bytes(view[at + 8 : at + 12], "little"):
            raise ValueError(f"damaged length at byte {at}")
        payload = view[at + 12 : end]
        if len(payload) < size or masked(zlib.crc32(payload)) != int.from_bytes(
            view[end : end + 4], "little"
        ):
            raise ValueError(f"damaged record at byte {at}")
        doc_id = int.from_bytes(payload[:8], "little", signed=True)
        width = int.from_bytes(payload[8:12], "little")
        yield at, end + 4 - at, doc_id, np.frombuffer(payload[12:], f"<u{width}")
        if bytes(view[end + 4 : end + 5]) != b"\n":
            raise ValueError(f"no record end at byte {end + 4}")
        at = end + 5


def write_records(
    docs: DataFrame,
    path: str,
    vocabulary: str | None = None,
    end_id: int = END_ID,
    partitions: int | None = None,
) -> None:
    """Encode all texts and write them in ascending ``doc_id`` order.

    Rows are range-partitioned on ``doc_id``; file names ascend with the partition, so
    files in name order hold ascending ids. Repeated ids stay, ordered by text. Rows
    without a doc_id come first, with NO_ID in its place; only a true id of that value
    raises. A null text counts as empty.
    """
    spark = docs.sparkSession
    vocabulary = vocabulary or vocabulary_path()
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        docs.select(
            F.when(F.col("doc_id").cast("long") == NO_ID, F.raise_error(F.lit("doc_id is reserved")))
            .otherwise(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
            .alias("doc_id"),
            F.col("text").cast("string").alias("text"),
        )
        .repartitionByRange(partitions, "doc_id")
        .sortWithinPartitions("doc_id", "text")
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(vocabulary)
        width = 2 if len(encoder.closes) <= 1 << 16 and end_id < 1 << 16 else 4
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            doc_ids = batch.column("doc_id").to_pylist()
            for low, high in blocks(offsets):
                part = slice(offsets[low], offsets[high])
                ids, bounds = encoder.encode(data[part], offsets[low : high + 1] - offsets[low])
                framed = [
                    frame(doc_ids[low + i], np.append(ids[bounds[i] : bounds[i + 1]], end_id), width)
                    for i in range(high - low)
                ]
                yield pa.RecordBatch.from_arrays([pa.array(framed, pa.binary())], ["record"])

    records = ordered.mapInArrow(encode, "record binary")
    (
        records.select(F.col("record").cast("string").alias("value"))
        .write.option("lineSep", "\n")
        .option("maxRecordsPerFile", RECORDS_PER_FILE)
        .text(path)
    )


def build_index(spark: SparkSession, path: str) -> DataFrame:
    """Read all data files back, check them, and return one row per record.

    A folder without records gives an empty index.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "part-*")
        .load(path)
        .select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("file"), batch.column("content"), strict=True):
                rows = [
                    (offset, length, None if doc_id == NO_ID else doc_id, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
                    for offset, length, doc_id, ids in read_records(content.as_buffer())
                ]
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file.as_py()] * len(rows), pa.string())]
                    + [pa.array(c, pa.int64()) for c in columns],
                    ["file", "offset", "length", "doc_id", "n_tokens", "ids_crc32"],
                )

    return files.mapInArrow(scan, INDEX_SCHEMA)


def token_starts(index: DataFrame) -> DataFrame:
    """Add ``start``: the ids of all records before, files in name order.

    Totals per file (one row each) give a file its start; the running sum goes per file.
    """
    totals = index.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("file_start")
    )
    inside = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    return (
        index.join(starts, "file")
        .withColumn(
            "start", F.col("file_start") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
        )
        .drop("file_start")
    )


def encode_corpus(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write the records and the index below ``path``; return the stored index with starts.

    Nulls: a null text is empty; records without a doc_id come first and stay without. Other columns are ignored. An
    empty table gives an empty index.
    """
    spark = docs.sparkSession
    path = path or fresh_path(spark, "token-records")
    write_records(docs, f"{path}/data")
    build_index(spark, f"{path}/data").write.parquet(f"{path}/index")
    return token_starts(spark.read.schema(INDEX_SCHEMA).parquet(f"{path}/index"))


def op5_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_corpus(docs).select("doc_id", "start", "n_tokens", "ids_crc32")
