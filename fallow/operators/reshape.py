"""Wide-by-year tables to rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fallow.functions.scalars import entity_year_key, year_of_header


def years_to_rows(
    wide: DataFrame,
    value: str,
    headers: Sequence[str],
    year0: int,
    entity: str = "X",
) -> DataFrame:
    """One row per entity and year header; cells without a value stay as rows."""
    rows = wide.unpivot([entity], list(headers), "year", value)
    return rows.select(
        F.col(entity).cast("string").alias("GEOID"),
        year_of_header("year").alias("year"),
        (year_of_header("year") - year0).alias("Yr"),
        F.col(value).cast("double").alias(value),
    ).withColumn("Cnty_yr", entity_year_key("GEOID", "Yr"))
