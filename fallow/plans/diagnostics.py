"""Fit diagnostics of any number of models in one grouped pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def diagnostics(scored: DataFrame, by: Sequence[str] = ("model_id",)) -> DataFrame:
    """cpo, mse, mse_obs, mean_p_value and r2 per model.

    ``cpo`` is the sum of log densities.  ``mse`` divides by all rows of the
    model, those without a response included; ``mse_obs`` by the observed ones.
    ``r2`` is the spread of the fitted values about the mean response over the
    spread of the responses, so it may exceed one.
    """
    seen = F.col("y").isNotNull()
    y, fitted = F.col("y"), F.when(seen, F.col("mean"))
    off = y - F.col("mean")
    sums = scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("y").alias("n"),
        F.sum("log_cpo").alias("cpo"),
        F.sum(off * off).alias("sse"),
        F.avg("p_value").alias("mean_p_value"),
        F.avg(y).alias("y_mean"),
        F.var_pop(y).alias("y_var"),
        F.avg(fitted).alias("f_mean"),
        F.var_pop(fitted).alias("f_var"),
    )
    gap = F.col("f_mean") - F.col("y_mean")
    return sums.select(
        *by,
        "n_rows",
        "n",
        "cpo",
        (F.col("sse") / F.col("n_rows")).alias("mse"),
        F.try_divide("sse", "n").alias("mse_obs"),
        "mean_p_value",
        F.try_divide(F.col("f_var") + gap * gap, F.col("y_var")).alias("r2"),
    )


def compare_models(scored: DataFrame, fit: DataFrame, by: Sequence[str] = ("model_id",)) -> DataFrame:
    """One row per model: DIC next to the other diagnostics."""
    return diagnostics(scored, by).join(fit.select(*by, "dic"), list(by))


def equal_bins(x: Column, low: Column, high: Column, bins: int) -> Column:
    """Number 1..bins of the equal-width bin of x between low and high, both ends included; else NULL.

    Of two equal ends there is one bin, number 1, which holds that value.
    """
    inside = F.least(F.floor(F.try_divide(x - low, high - low) * bins) + 1, F.lit(bins))
    return F.when((low == high) & (x == low), 1).when((low < high) & x.between(low, high), inside).cast("int")


def histogram(
    df: DataFrame, column: str, by: Sequence[str], bins: int, low: float, high: float
) -> DataFrame:
    """Rows per equal-width bin between fixed ends, missing values left out."""
    bin_ = equal_bins(F.col(column), F.lit(low), F.lit(high), bins)
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(*by, bin_.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def observed_vs_fitted(scored: DataFrame, panel: DataFrame) -> DataFrame:
    """Observed and fitted values of the rows whose YIELD is known.

    The filter is on YIELD for every response, so rows without a change or a
    stability value stay in, with a missing observed value.
    """
    known = panel.where(F.col("YIELD").isNotNull()).select("crop", "GEOID", "YEAR")
    return scored.join(known, ["crop", "GEOID", "YEAR"]).select(
        "model_id", "crop", "GEOID", "YEAR", F.col("y").alias("observed"), F.col("mean").alias("fitted")
    )


def parameter_summary(fixed: DataFrame, hyper: DataFrame) -> DataFrame:
    """Fixed effects and hyperparameters of all models, stacked."""
    columns = ["model_id", "name", "mean", "sd", "q025", "q50", "q975"]
    return fixed.select(*columns).unionByName(hyper.select(*columns))
