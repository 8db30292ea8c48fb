"""Approximate counts and quantiles from stored sketches that merge.

A table is read once and reduced to one small sketch row per group and column; any
coarser grouping is answered by merging these rows, without reading the table again.
Sketches are built by partial aggregation and have a bounded size, so a group that
holds a third of all rows is no larger than any other.

Distinct counts (HyperLogLog, 2^``LOG_SLOTS`` slots) have a relative standard error of
1.04 / sqrt(2^LOG_SLOTS): 1.6 %.  Quantiles (KLL) are values whose rank is off by at
most ``RANK_ERROR`` of the rows with a confidence of 99 % at the given ``DEPTH``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fallow.operators.quantiles import AT_ONCE

LOG_SLOTS = 12
DEPTH = 400
RANK_ERROR = 0.01
DISTINCT_ERROR = 4 * 1.04 / 2 ** (LOG_SLOTS / 2)  # four standard errors


def sketch_table(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(by, column, n, distinct_sketch, quantile_sketch) of the known values of ``columns``; store it to merge it.

    A group is a row of sketches, for ``AT_ONCE`` columns a scan: were columns groups, too, Spark would sort
    all values of a task that meets more than 128 of them.
    """
    out = None
    for start in range(0, len(columns), AT_ONCE):
        names = columns[start : start + AT_ONCE]
        each = F.array(*[_sketches(c) for c in names])
        part = df.groupBy(*by).agg(each.alias("each")).select(*by, F.explode("each").alias("s")).select(*by, "s.*")
        out = part if out is None else out.unionByName(part)
    return out.where("n > 0")


def _sketches(column: str) -> Column:
    x = F.col(column).cast("double")
    return F.struct(
        F.lit(column).alias("column"),
        F.count(x).alias("n"),
        F.hll_sketch_agg(F.when(x.isNotNull(), F.xxhash64(x)), LOG_SLOTS).alias("distinct_sketch"),
        F.kll_sketch_agg_double(x, DEPTH).alias("quantile_sketch"),
    )


def merged(table: DataFrame, by: Sequence[str]) -> DataFrame:
    """The sketches of coarser groups: ``by`` is a part of the keys of ``table``, and may include its column."""
    return table.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.kll_merge_agg_double("quantile_sketch", DEPTH).alias("quantile_sketch"),
    )


def distinct_estimate() -> Column:
    return F.hll_sketch_estimate("distinct_sketch")


def quantile_estimate(prob: float) -> Column:
    return F.kll_sketch_get_quantile_double("quantile_sketch", F.lit(prob))
