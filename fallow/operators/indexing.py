"""Dense 1..N numbering of sorted keys without a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fallow.session import settle


def dense_index(
    df: DataFrame, key: str, name: str, by: Sequence[str] = (), splits: int = 128
) -> DataFrame:
    """Distinct (by, key) rows numbered 1..N in key order within ``by``.

    The keys are cut into about ``splits`` even ranges by split points drawn
    from the keys themselves (those with the smallest hash, hence the same on
    every run).  A key's number is the count of keys in earlier ranges plus its
    position in its own range, so no task sorts more than one range.  The keys
    in ``by`` must not be missing.
    """
    if not by:
        one = df.select(F.lit(1).alias("__all"), key)
        return dense_index(one, key, name, ["__all"], splits).drop("__all")
    by = list(by)
    keys = settle(df.select(*by, key).distinct())
    pick = Window.partitionBy(*by).orderBy(F.xxhash64(key), key)
    points = (
        keys.withColumn("__n", F.row_number().over(pick))
        .where(F.col("__n") < splits)
        .groupBy(*by)
        .agg(F.array_sort(F.collect_list(key)).alias("__points"))
    )
    tagged = keys.join(points, by).select(
        *by, key, F.size(F.filter("__points", lambda p: p < F.col(key))).alias("__range")
    )
    per_range = tagged.groupBy(*by, "__range").agg(F.count(F.lit(1)).alias("__size"))
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_range.select(
        *by, "__range", F.coalesce(F.sum("__size").over(earlier), F.lit(0)).alias("__start")
    )
    inside = Window.partitionBy(*by, "__range").orderBy(key)
    return tagged.join(starts, [*by, "__range"]).select(
        *by,
        key,
        (F.col("__start") + F.row_number().over(inside)).cast("int").alias(name),
    )
