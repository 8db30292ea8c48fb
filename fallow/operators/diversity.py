"""Class-share diversity per entity and time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diversity_indices(
    df: DataFrame, by: Sequence[str], category: str, amount: str, sums: Sequence[str] = ()
) -> DataFrame:
    """Simpson 1 - sum p^2, Shannon -sum p ln p and richness of class shares.

    With q = amount per class and Q = sum q, p = q / Q, both indices follow from
    sums over the classes, so no second pass over the shares is needed.  The columns ``sums`` are added up per group on the way.
    """
    also = [F.sum(c).alias(c) for c in sums]
    per_class = df.groupBy(*by, category).agg(F.sum(amount).cast("double").alias("__q"), *also)
    q = F.when(F.col("__q") > 0, F.col("__q"))
    total = F.sum(q)
    return per_class.groupBy(*by).agg(
        (1 - F.try_divide(F.sum(q * q), total * total)).alias("simpson"),
        (F.ln(total) - F.try_divide(F.sum(q * F.ln(q)), total)).alias("shannon"),
        F.count(q).alias("richness"),
        *also,
    )
