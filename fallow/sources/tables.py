"""Panel, water, expense and polygon files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fallow.session import settle

WATER_SCHEMA = "GEOID string, Yr int, avg_water double, range_water double, volume string"
POLYGON_SCHEMA = "GEOID string, STATEFP int, part int, ring int, seq int, x double, y double"
ROW_ID = "row_id"


def read_crop_panels(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """One table from one parquet folder per crop, tagged with its crop."""
    out = None
    for crop, path in paths.items():
        part = spark.read.parquet(path).withColumn("crop", F.lit(crop))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no crop given")
    return out.withColumn("GEOID", F.col("GEOID").cast("string"))


def read_stage(spark: SparkSession, path: str, crop: str | None = None) -> DataFrame:
    """A saved stage table, or one crop of it (only that folder is read)."""
    rows = spark.read.parquet(path)
    return rows if crop is None else rows.where(F.col("crop") == crop)


def write_stage(df: DataFrame, path: str) -> None:
    """One folder per crop; adaptive execution splits the large ones among tasks."""
    rows = df.hint("rebalance", F.col("crop"))
    rows.write.mode("overwrite").partitionBy("crop").parquet(path)


def read_water_csv(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """Water files per crop, taken by position.

    The third and fourth column are named after the crop's product in each
    file, so the header is skipped; so is a byte order mark in it.
    """
    schema = T._parse_datatype_string(WATER_SCHEMA)
    out = None
    for crop, path in paths.items():
        part = spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)
        part = part.withColumn("crop", F.lit(crop))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no crop given")
    return out


def read_checked_csv(spark: SparkSession, path: str, schema: str, required: Sequence[str] = (), header: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected) of CSV files, some of whose lines are damaged; with ``header``, the first line of each file is none.

    ``rows`` has the columns of ``schema``.  ``rejected`` has the fields as they stand in the file, as text,
    with the ``file`` and a ``reason``: a wrong number of fields, a field that is not of its type, or a
    required field that is empty; the first that applies, fields from left to right.  Lines are read and
    judged once and stored, so both tables come from one reading.
    """
    fields = T._parse_datatype_string(schema).fields
    as_text = T.StructType([T.StructField(f.name, T.StringType()) for f in fields] + [T.StructField("__damaged", T.StringType())])
    lines = spark.read.schema(as_text).option("header", header).option("enforceSchema", True).option("mode", "PERMISSIVE")
    lines = lines.option("columnNameOfCorruptRecord", "__damaged").csv(path)
    reason = F.when(F.col("__damaged").isNotNull(), F.lit("wrong number of fields"))
    for f in fields:
        text, kind = F.col(f"`{f.name}`"), f.dataType.simpleString()
        if f.name in required:
            reason = reason.when(text.isNull(), F.lit(f"{f.name}: missing"))
        if kind != "string":
            reason = reason.when(text.isNotNull() & text.try_cast(f.dataType).isNull(), F.lit(f"{f.name}: not {kind}"))
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    judged = settle(lines.select("*", name.alias("__file"), reason.alias("__reason")))
    good = judged.where("__reason is null").select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in fields])
    bad = judged.where("__reason is not null").select(*[F.col(f"`{f.name}`") for f in fields], F.col("__file").alias("file"), F.col("__reason").alias("reason"))
    return good, bad


def read_expense_csv(spark: SparkSession, path: str) -> DataFrame:
    """A wide-by-year expense file: entity ``X`` and one column ``X<year>`` per year.

    The first column of the file has no name and the others are bare years.
    """
    header = spark.read.option("header", True).csv(path).columns
    names = ["X"] + [c if c.startswith("X") else f"X{c}" for c in header[1:]]
    fields = [T.StructField("X", T.StringType())]
    fields += [T.StructField(c, T.DoubleType()) for c in names[1:]]
    schema = T.StructType(fields)
    return spark.read.schema(schema).option("header", True).option("nullValue", "NA").csv(path)


def year_headers(wide: DataFrame, first: int, last: int) -> list[str]:
    """The year columns present between two years."""
    return [f"X{y}" for y in range(first, last + 1) if f"X{y}" in wide.columns]


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POLYGON_SCHEMA).parquet(path)


def write_csv(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """CSV with a header; with ``order``, rows carry their number in that order.

    The numbering sorts by range partitions and counts their rows first, so
    that the table is never in one task.
    """
    out = df if order is None else with_row_id(df, order)
    out.write.mode("overwrite").option("header", True).csv(path)


def with_row_id(df: DataFrame, order: list[str], range_rows: int = 1_000_000) -> DataFrame:
    """Number all rows 1..N in the order of a unique key.

    Rows are sorted by ranges of at most about ``range_rows`` rows, as many as the table needs, and written
    once; a row's number is the rows of earlier ranges plus its place in its own.
    """
    stored = settle(df)
    spark = df.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-stored.count() // range_rows))
    sorted_rows = stored.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    placed = settle(sorted_rows.withColumn("__at", F.monotonically_increasing_id()))
    in_range, place = F.shiftright("__at", 33).alias("__range"), F.col("__at").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(in_range).agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = counts.select("__range", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
    numbered = placed.withColumn("__range", F.shiftright("__at", 33)).join(starts, "__range")
    return numbered.select((F.col("__start") + place + 1).alias(ROW_ID), *df.columns)
