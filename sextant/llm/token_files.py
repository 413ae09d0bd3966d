"""Token-ID files: Parquet with list columns, written in id order.

Ids are dictionary coded, row addresses delta coded; row groups and pages
have controlled sizes and page indexes, so that readers take metadata
without ids, or the ids of a few documents, without reading the rest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import loaded, tokenizer_path
from .common import new_folder, small_or_shuffled

#: Parquet settings of the format.
LAYOUT = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#offset": "false",
    "parquet.enable.dictionary#n_tokens": "false",
}
FILE_SCHEMA = "part int, doc_id long, offset long, n_tokens long, ids array<int>"


def write_tokens(docs: DataFrame, folder: str, path: str, end_id: int = 0) -> None:
    """Encode ``docs(doc_id, text)`` and write them in ascending ``doc_id`` order.

    Null text is empty; every document ends with ``end_id``. Rows are dealt
    out by range, files follow each other in that order: null ids first,
    repeated ids next to each other by text. ``offset`` counts the ids before
    a document in its file, ``part`` is the file's place. Texts of any length
    are encoded whole. An empty table writes files without rows; other columns
    of ``docs``, whatever their names, are not written.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, offset = loaded(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            held: list[np.ndarray] = []
            first = 0
            size = 0

            def pack(upto: int, held: list[np.ndarray], first: int) -> pa.RecordBatch:
                nonlocal offset
                sizes = np.fromiter(map(len, held), np.int64, len(held)) + 1
                ends = np.cumsum(sizes)
                flat = np.full(ends[-1], end_id, np.int32)
                keep = np.ones(len(flat), bool)
                keep[ends - 1] = False
                flat[keep] = np.concatenate(held)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(flat))
                ids = batch.column("doc_id").slice(first, upto - first)
                begin = offset + ends - sizes
                offset += int(ends[-1])
                return pa.RecordBatch.from_arrays([pa.array(np.full(len(held), part, np.int32)), ids, pa.array(begin), pa.array(sizes), lists], ["part", "doc_id", "offset", "n_tokens", "ids"])

            for i, ids in enumerate(bpe.encode(texts, forced=False)):
                held.append(ids)
                size += len(ids) + 1
                if size > 1 << 20:
                    yield pack(i + 1, held, first)
                    held, first, size = [], i + 1, 0
            if held:
                yield pack(len(texts), held, first)

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    dealt.mapInArrow(encode, FILE_SCHEMA).write.options(**LAYOUT).parquet(folder)


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids``; ``start`` counts the ids of all documents before.

    Without ids only the narrow columns are read. The files' totals, one row
    for each file, give the starts.
    """
    files = spark.read.schema(FILE_SCHEMA).parquet(folder)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over files, not rows
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    columns = ["doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens"] + ["ids"] * with_ids
    return files.join(small_or_shuffled(bases), "part").select(*columns)


def with_crc32(tokens: DataFrame) -> DataFrame:
    """Replace ``ids`` by ``ids_crc32``, of the ids as little-endian unsigned 32-bit integers."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            offsets = lists.offsets.to_numpy()
            data = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)).cast("B")
            sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as token files, written and read back: where each starts, its length and
    a checksum. Null texts are empty and hold the end id alone; see ``write_tokens``."""
    folder = new_folder(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), folder, tokenizer_path())
    return with_crc32(read_tokens(spark, folder))
