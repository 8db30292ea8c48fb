"""Sharding by proportional stratified interleaving.

Within each source rows are ranked in a seeded shuffle.  Row r of a source with n
rows stands at the fraction (2r - 1) / 2n; sorting all rows by fraction interleaves
the sources in proportion, and cutting the sorted rows evenly gives shards whose
counts differ by one at most and whose mixture is that of the whole.

Ranks need no task that sees a whole source: rows fall into buckets by their hash
(later by their fraction), each with a few thousand rows, and a row's rank is the
number of rows in earlier buckets plus its place in its own.  Only the counts per
bucket, one row for some thousands of documents, are summed in one window.

Defined results: a null text counts as empty; a null source is a source of its own;
null and repeated ids are spread by their texts; rows equal in id, text and source
are interchangeable; an empty table gives an empty result; with fewer rows than shards
some shards are empty; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fallow.session import settle


def _running(counts: DataFrame, bucket: str, source: list[str]) -> DataFrame:
    """Per bucket the rows before it, and per source its rows."""
    by = Window.partitionBy(*source) if source else Window.partitionBy()
    return counts.withColumn("before", F.sum("n").over(by.orderBy(bucket)) - F.col("n")).withColumn("total", F.sum("n").over(by))


def shuffled(seed: int) -> Column:
    """The place of a row in the seeded shuffle; texts tell rows of one id apart."""
    return F.xxhash64(F.lit(seed), "__key", "text_crc32", "size")


def assign_shards(docs: DataFrame, shards: int = 16, seed: int = 20, key: str = "doc_id", text: str = "text", source: str = "source", bucket_rows: int = 2048) -> DataFrame:
    """Per row: key, source, size, text_crc32, shard (0 to shards - 1) and slot (its place there, gapless from 0)."""
    content = F.coalesce(F.col(text), F.lit(""))
    own = settle(docs.select(
        F.col(key).alias("__key"),
        F.col(source).alias("__source"),
        (F.octet_length(content) + 1).cast("long").alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"),
    ).withColumn("shuffled", shuffled(seed)))
    rows = own.count()
    buckets = max(1, -(-rows // bucket_rows))

    # ranges of the hash, so that the order, and with it the result, does not depend on how many there are
    by_hash = F.least(F.floor((F.col("shuffled") / 2.0**64 + 0.5) * buckets), F.lit(buckets - 1))
    own = own.withColumn("stratum", F.coalesce(F.concat(F.lit("s"), F.col("__source")), F.lit("-"))).withColumn("bucket", by_hash)
    counts = _running(own.groupBy("stratum", "bucket").agg(F.count("*").alias("n")), "bucket", ["stratum"])
    inside = Window.partitionBy("stratum", "bucket").orderBy("shuffled", "__key", "text_crc32", "size")
    ranked = own.withColumn("place", F.row_number().over(inside)).join(counts, ["stratum", "bucket"])
    fraction = (2 * (F.col("before") + F.col("place")) - 1) / (2 * F.col("total"))
    ranked = settle(ranked.select("__key", "__source", "size", "text_crc32", "shuffled", "stratum", fraction.alias("fraction")))

    ranked = ranked.withColumn("bucket", F.least(F.floor(F.col("fraction") * buckets), F.lit(buckets - 1)))
    counts = _running(ranked.groupBy("bucket").agg(F.count("*").alias("n")), "bucket", [])
    inside = Window.partitionBy("bucket").orderBy("fraction", "shuffled", "stratum", "__key", "text_crc32", "size")
    placed = ranked.withColumn("place", F.row_number().over(inside)).join(counts.drop("total"), "bucket")
    position = F.col("before") + F.col("place") - 1
    # whole numbers only; a shard begins at the first position that is not below shard * rows / shards
    placed = placed.withColumn("position", position).withColumn("shard", F.expr(f"{shards} * position div {max(rows, 1)}"))
    first = F.expr(f"(shard * {rows} + {shards - 1}) div {shards}")
    return placed.select(
        F.col("__key").alias(key),
        F.col("__source").alias(source),
        "size",
        "text_crc32",
        F.col("shard").cast("int").alias("shard"),
        (F.col("position") - first).cast("long").alias("slot"),
    )
