"""Token ids as Parquet files that can be read in part.

A document is a row: doc_id, part (its file), at (ids before it in the file), n_tokens
and the list column ids, in ascending order of doc_id over all files.  Ids are
dictionary encoded, since a vocabulary is small beside its text; the integer columns,
which ascend or nearly repeat, are delta encoded.  Row groups and pages have bounded
sizes and carry page indexes, so a reader of some documents, or of a window of the
token stream, touches their pages alone, and a reader of lengths and places touches no
token.  `layout` adds up the files: the ids before a document are those before its
file and those before it in the file.

The files are written in one pass: rows are dealt into ranges of doc_id by Spark's own
sample, sorted inside each range and encoded in that order, one file to a range.  Rows
of one id are dealt by a hash of their text too, so an id that a third of all rows
share does not make one range.  Texts are shuffled once, ids never.

Defined results: a null text counts as empty and an empty text is its end id alone; null
ids come first; rows of one id are ordered by a hash of their text, equal rows are rows
of their own; an empty table gives an empty folder of tables with the same columns;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fallow.llm.packing import END, VOCABULARY, encoder
from fallow.session import ship_package

TOKENS = "doc_id long, part int, at long, n_tokens int, ids array<int>"
LAYOUT = "part int, first long, n_docs long, n_tokens long"
SLICE = 256  # texts handed to the encoder at a time


class Sizes(NamedTuple):
    """Bounds of files, row groups and pages."""

    file_rows: int = 65_536
    group_bytes: int = 8 << 20
    page_bytes: int = 256 << 10
    page_rows: int = 1_024

    def options(self) -> dict[str, str]:
        plain = ("doc_id", "part", "at", "n_tokens")
        return {
            "parquet.writer.version": "v2",
            "parquet.enable.dictionary": "true",
            "parquet.block.size": str(self.group_bytes),
            "parquet.page.size": str(self.page_bytes),
            "parquet.page.row.count.limit": str(self.page_rows),
            "parquet.page.size.row.check.min": "10",
            "parquet.dictionary.page.size": str(1 << 20),
            **{f"parquet.enable.dictionary#{c}": "false" for c in plain},
        }


_BATCH = pa.schema([
    ("doc_id", pa.int64()), ("part", pa.int32()), ("at", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.list_(pa.int32())),
])


def _encode(vocabulary: str, end: int):
    """Encode rows in the order given; `at` is the running sum within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, enc = TaskContext.get().partitionId(), 0, encoder(vocabulary)
        last = np.array([end], "<u4").tobytes()
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE):
                piece = batch.slice(first, SLICE)
                ids = [x + last for x in enc.encode(piece["text"].to_pylist())]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                ends = np.cumsum(n)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                starts = pa.array(at + ends - n)
                yield pa.record_batch([piece["doc_id"], pa.array(np.full(len(n), part, np.int32)), starts, pa.array(n, pa.int32()), lists], schema=_BATCH)
                at += int(ends[-1])

    return run


def write_tokens(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, end: int = END, sizes: Sizes = Sizes(), key: str = "doc_id", text: str = "text") -> None:
    """Write the token files of `docs` to `folder`/tokens and their table of places to `folder`/layout."""
    spark = docs.sparkSession
    ship_package(spark)
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("mix", F.xxhash64("text"))
    files = max(spark.sparkContext.defaultParallelism, -(-docs.count() // sizes.file_rows))
    ordered = own.repartitionByRange(files, "doc_id", "mix").sortWithinPartitions("doc_id", "mix").drop("mix")
    encoded = ordered.mapInArrow(_encode(vocabulary, end), TOKENS)
    encoded.write.options(**sizes.options()).parquet(f"{folder}/tokens")
    # lengths alone are read back; one row per file goes through the running sum
    parts = read_tokens(spark, folder).groupBy("part").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts.select("part", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long").alias("first"), "n_docs", "n_tokens").write.parquet(f"{folder}/layout")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the files; selections and filters reach the pages."""
    return spark.read.schema(TOKENS).parquet(f"{folder}/tokens")


def layout(spark: SparkSession, folder: str) -> DataFrame:
    """One row per file: the ids before it, its documents and its ids."""
    return spark.read.schema(LAYOUT).parquet(f"{folder}/layout")


def places(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens; reads no token."""
    own = read_tokens(spark, folder).select("doc_id", "part", "at", F.col("n_tokens").cast("long").alias("n_tokens"))
    return own.join(layout(spark, folder).select("part", "first"), "part").select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens")


def window(spark: SparkSession, folder: str, first: int, last: int) -> DataFrame:
    """The ids at places first <= place < last of the whole stream: doc_id, start and the ids of each piece.

    The files are those between two numbers, found in the table of places, and are left out by their statistics otherwise.
    """
    meets = (F.col("first") < last) & (F.col("first") + F.col("n_tokens") > first)
    low, high = layout(spark, folder).where(meets).agg(F.min("part"), F.max("part")).first()
    low, high = (0, -1) if low is None else (low, high)
    own = read_tokens(spark, folder).where(F.col("part").between(low, high)).join(layout(spark, folder).select("part", "first"), "part")
    start = F.col("first") + F.col("at")
    skip = F.greatest(F.lit(first) - start, F.lit(0))
    size = F.least(F.lit(last) - start, F.col("n_tokens")) - skip
    own = own.where((start < last) & (start + F.col("n_tokens") > first))
    return own.select("doc_id", (start + skip).alias("start"), F.slice("ids", (skip + 1).cast("int"), size.cast("int")).alias("ids"))


def digests(tokens: DataFrame, ids: str = "ids") -> DataFrame:
    """`tokens` with the list column replaced by ids_crc32, of its ids as little-endian unsigned 32-bit integers."""
    keep = [c for c in tokens.columns if c != ids]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema if f.name != ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids))
            ends = lists.offsets.to_numpy().astype(np.int64) * 4
            data = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)).cast("B")
            sums = [zlib.crc32(data[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sums, pa.int64())], names=[*keep, "ids_crc32"])

    return tokens.select(*keep, ids).mapInArrow(run, ", ".join([*fields, "ids_crc32 long"]))


def read_back(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    own = digests(read_tokens(spark, folder).select("doc_id", "part", "at", "n_tokens", "ids"))
    own = own.join(layout(spark, folder).select("part", "first"), "part")
    start: Column = F.col("first") + F.col("at")
    return own.select("doc_id", start.alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids_crc32")
