"""Fitted results as tables partitioned by model."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT_TABLES = ["fit_rows", "fit_effects", "fit_hyper", "fit_model"]


def save_results(tables: Mapping[str, DataFrame], path: str) -> None:
    """Write result tables, one folder per model; saved models are replaced.

    Rows are gathered by model before the write, and adaptive execution splits
    the models that are too large for one task.
    """
    for name, df in tables.items():
        if name not in RESULT_TABLES:
            raise ValueError(f"unknown result table {name}")
        (
            df.hint("rebalance", F.col("model_id"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("model_id")
            .parquet(f"{path}/{name}")
        )


def load_results(
    spark: SparkSession, path: str, name: str, model_id: str | None = None
) -> DataFrame:
    """A result table, or the rows of one model (only its folder is read)."""
    rows = spark.read.parquet(f"{path}/{name}")
    return rows if model_id is None else rows.where(F.col("model_id") == model_id)
