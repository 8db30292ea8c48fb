"""Within-entity regression from grouped sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TINY = 1e-12


def within_slope(df: DataFrame, by: Sequence[str], entity: str, y: str, x: str) -> DataFrame:
    """Slope of y on x with one free level per entity, for any number of entities.

    The spread of x and its product with y about the entity means are summed
    over the entities; no demeaned row is formed.  An x that does not vary within
    any entity, but for rounding (``TINY`` of its squares), has no slope.
    """
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    per_entity = known.groupBy(*by, entity).agg(
        F.count(F.lit(1)).alias("n"),
        (F.covar_pop(x, y) * F.count(F.lit(1))).alias("sxy"),
        (F.var_pop(x) * F.count(F.lit(1))).alias("sxx"),
        F.sum(F.col(x) * F.col(x)).alias("squares"),
    )
    return per_entity.groupBy(*by).agg(
        F.sum("n").alias("n"), F.when(F.sum("sxx") > TINY * F.sum("squares"), F.sum("sxy") / F.sum("sxx")).alias("slope")
    )
