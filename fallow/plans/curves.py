"""Effect curves of model terms as plot-ready tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fallow.functions.scalars import relabel, replace_in_order

CURVE = ["x", "q025", "q50", "q975"]

# Label texts, applied as ordered replacements.
TERM_LABELS = {
    "LSM_SIDI_ALL": "Diversity",
    "aveSIDI2yr": "Average Diversity (2 years)",
    "dfert": "Change in Fertilizer",
    "dherb": "Change in Herbicide & Insecticide",
    "dVol": "Change in Irrigation Water Volume",
    "dTP": "Change in Total Precipitation",
    "dGDD": "Change in Growing Degree Days",
    "dSDD": "Change in Stress Degree Days",
    "dSIDI": "Change in Diversity",
    "aveSIDI3yr": "Average Diversity (3 years)",
    "covSIDI": "Coefficient of Variation \n for Diversity",
    "covfert": "Coefficient of Variation \n for Fertlizer",
    "covherb": "Coefficient of Variation \n for Herbicide & Insecticide",
    "covVol": "Coefficient of Variation \n for Irrigation Water Volume",
    "covTP": "Coefficient of Variation \n for Total Precipiation",
    "covGDD": "Coefficient of Variation \n for Growing Degree Days",
    "covSDD": "Coefficient of Variation \n for Stress Degree Days",
    "fert": "Fertilizer Expenses",
    "herb": "Herbicide & Insecticide Expenses",
    "volume": "Irrigation Water Volume",
    "TP": "Total Precipitation",
    "SDD": "Stress Degree Days",
    "GDD": "Growing Degree Days",
}
CROP_LABELS = {"wheat": "Winter wheat", "wwheat": "Winter wheat", "corn": "Corn", "soy": "Soy"}
CONTROLS = ["TP", "GDD", "SDD", "SOIL", "fert", "herb", "volume"]


def smooth_effect(effects: DataFrame, model_id: str, term: str) -> DataFrame:
    """Curve of one term of one model."""
    return effects.where((F.col("model_id") == model_id) & (F.col("term") == term)).select(*CURVE)


def curves_across_crops(
    effects: DataFrame,
    dependents: Mapping[str, str],
    terms: Sequence[str],
    x_range: tuple[float, float] = (-3, 3),
    y_range: tuple[float, float] = (-0.5, 0.5),
    crop_labels: Mapping[str, str] = CROP_LABELS,
) -> DataFrame:
    """Curves of several terms of any number of families, all crops together.

    ``dependents`` maps each wanted family to the name of its response on the axis.  Crops or terms that
    were not fitted are simply absent.  ``in_view`` tells which points lie inside the plot; the rows stay.
    """
    wanted = effects.where(F.col("family").isin(*dependents) & F.col("term").isin(*terms))
    return wanted.select(
        "family",
        "term",
        replace_in_order("term", TERM_LABELS).alias("label"),
        F.concat(F.lit("Effect on "), relabel("family", dependents)).alias("effect_on"),
        relabel("crop", crop_labels).alias("Crop"),
        *CURVE,
        (F.col("q50").between(*y_range) & F.col("x").between(*x_range)).alias("in_view"),
    )


def curve_bands(curves: DataFrame) -> DataFrame:
    """Mean of x per family, term and crop, and one standard deviation to each side."""
    stats = curves.groupBy("family", "term", "Crop").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"))
    return stats.select(
        "family", "term", "Crop", "mean", "sd",
        (F.col("mean") - F.col("sd")).alias("low"), (F.col("mean") + F.col("sd")).alias("high"),
    )


def control_curves(
    effects: DataFrame,
    families: Sequence[str],
    controls: Sequence[str] = CONTROLS,
    crop_labels: Mapping[str, str] = CROP_LABELS,
    x_range: tuple[float, float] = (-3, 3),
    y_range: tuple[float, float] = (-0.5, 0.5),
) -> DataFrame:
    """Curves of the control terms for every crop and several families at once, with their place in the plot."""
    wanted = effects.where(F.col("family").isin(*families) & F.col("term").isin(*controls))
    return wanted.select(
        relabel("crop", crop_labels).alias("Crop"),
        F.col("term").alias("control"),
        F.upper("family").alias("Metric"),
        *CURVE,
        (F.col("q50").between(*y_range) & F.col("x").between(*x_range)).alias("in_view"),
    )


def fitted_only(wanted: DataFrame, fit: DataFrame) -> DataFrame:
    """The wanted models that have been fitted; the others are skipped."""
    return wanted.join(fit.select("model_id"), "model_id", "left_semi")
