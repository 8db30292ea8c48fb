"""Quantile binning and standardising of many columns at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fallow.functions.scalars import INF
from fallow.operators.quantiles import OrderStatistics, column_sketches, cuts_below, exact_quantiles
from fallow.session import settle


def bin_probs(n: int) -> list[tuple[int, int]]:
    """The n + 1 break probabilities of n groups as exact fractions.

    0 and 1, and between them the plotting positions of n - 1 points:
    (i - 1/2) / m for more than ten points, (i - 3/8) / (m + 1/4) otherwise.
    """
    m = n - 1
    if m > 10:
        inner = [(2 * i - 1, 2 * m) for i in range(1, m + 1)]
    else:
        inner = [(8 * i - 3, 8 * m + 2) for i in range(1, m + 1)]
    return [(0, 1), *inner, (1, 1)]


def to_long(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(by, place, x): one row per row and column, ``place`` being the column's index.

    Only these columns are read.  Exploding one array of numbers compiles to a
    small loop, whereas ``unpivot`` compiles one branch per column.
    """
    values = F.array(*[F.col(c).cast("double") for c in columns])
    return df.select(*by, F.posexplode(values).alias("place", "x"))


class QuantileBins:
    """Quantile bins of ``columns``, taken within each ``by`` group.

    Bin k of a column holds the values above break k-1 up to break k (the
    lowest break belongs to bin 1); its label is the median of its values.
    Equal breaks leave bins empty.  A column of equal values has one bin.

    ``table``: (by, column, bin, rows, value, scaled), one row per non-empty
    bin, where ``scaled`` is the bin value standardised by the mean and sd of
    the binned column.  Mean and sd need no pass over the rows: a binned column
    takes at most n values, whose counts are known.
    """

    def __init__(self, df: DataFrame, by: Sequence[str], columns: Sequence[str], n: int = 20):
        self.by = list(by)
        self.columns = list(columns)
        self.n = n
        keys = [*self.by, "place"]
        names = F.array(*[F.lit(c) for c in self.columns])
        long = to_long(df, self.by, self.columns)
        probs = bin_probs(n)
        p = [a / b for a, b in probs]
        centres = [(a + b) / 2 for a, b in zip(p, p[1:])]
        sketch = lambda near: column_sketches(df, self.by, self.columns, near)
        stats = OrderStatistics(long, keys, "x", p + centres, sketch)
        per_break = exact_quantiles(long, keys, "x", probs, stats)
        listed = F.array_sort(F.collect_list(F.struct("k", "q", "upto")))
        breaks = per_break.groupBy(*keys).agg(listed.alias("b"))
        # The lowest value belongs to the first bin that is not empty: breaks
        # equal to it are opened downwards.
        lowest = F.col("b.q")[0]
        self.breaks = settle(
            breaks.select(
                *keys,
                F.get(names, F.col("place")).alias("column"),
                F.transform("b", lambda e: F.when(e.q == lowest, -INF).otherwise(e.q)).alias("cuts"),
                F.transform("b", lambda e: F.when(e.q == lowest, 0).otherwise(e.upto)).alias("upto"),
                F.col("b.upto")[n].alias("rows"),
            )
        )
        named = F.get(names, F.col("place")).alias("column")
        self.table = settle(
            self._labels(stats, keys).select(*self.by, named, "bin", "rows", "value", "scaled")
        )

    def _labels(self, stats: OrderStatistics, keys: list[str]) -> DataFrame:
        def span(k: Column) -> Column:
            end = F.when(k <= self.n, F.get("upto", k)).otherwise(F.col("rows"))
            return F.struct(k.alias("bin"), F.get("upto", k - 1).alias("start"), end.alias("end"))

        numbers = F.sequence(F.lit(1), F.lit(self.n + 1))
        spans = self.breaks.select(*keys, F.explode(F.transform(numbers, span)).alias("s"))
        bins = (
            spans.select(*keys, "s.*")
            .where("end > start")
            .select(
                *keys,
                "bin",
                F.expr("end - start").alias("rows"),
                F.expr("start + (end - start + 1) div 2").alias("lo"),
                F.expr("start + (end - start) div 2 + 1").alias("hi"),
            )
        )
        found = stats.lookup(bins.select(*keys, F.explode(F.array("lo", "hi")).alias("rank")))
        low, high = F.col("at")[F.col("lo")]["x"], F.col("at")[F.col("hi")]["x"]
        labels = bins.join(found, keys).select(
            *keys, "bin", "rows", (low + (high - low) * 0.5).alias("value")
        )
        return standardise_bins(labels, keys)

    def apply(
        self,
        df: DataFrame,
        number: str = "",
        value: str = "",
        scaled: str = "",
        columns: Sequence[str] | None = None,
    ) -> DataFrame:
        """Add per column the bin number, bin value and scaled bin value.

        Each argument is a name pattern such as ``"{}_bin"``; an empty one adds
        nothing and ``"{}"`` replaces the column.  ``columns`` narrows the work to
        some of the columns.  One join with one small row per ``by`` group, no
        shuffle of ``df`` and no reshaping.
        """
        columns = list(columns or self.columns)
        by_bin = F.map_from_entries(
            F.collect_list(F.struct("bin", F.struct("value", "scaled")))
        )
        per_column = self.table.groupBy(*self.by, "column").agg(by_bin.alias("m"))
        slots = F.sequence(F.lit(1), F.lit(self.n + 1))
        packed = F.struct(
            "cuts",
            F.transform(slots, lambda k: F.col("m")[k]["value"]).alias("value"),
            F.transform(slots, lambda k: F.col("m")[k]["scaled"]).alias("scaled"),
        )
        lookup = settle(
            self.breaks.join(per_column, [*self.by, "column"])
            .groupBy(*self.by)
            .pivot("column", columns)
            .agg(F.first(packed))
            .withColumnsRenamed({c: f"__{c}" for c in columns})
        )
        joined = df.join(lookup, self.by, "left")
        out: dict[str, Column] = {}
        for c in columns:
            at = F.when(F.col(c).isNotNull(), cuts_below(f"cast(`{c}` as double)", f"`__{c}`.cuts", self.n + 1))
            if number:
                out[number.format(c)] = at
            if value:
                out[value.format(c)] = F.get(f"__{c}.value", at - 1)
            if scaled:
                out[scaled.format(c)] = F.get(f"__{c}.scaled", at - 1)
        return joined.withColumns(out).drop(*[f"__{c}" for c in columns])


def standardise_bins(bins: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Standardised bin values, weighted by the rows of each bin (n - 1 in the sd)."""
    packed = bins.groupBy(*keys).agg(
        F.collect_list(F.struct("bin", "rows", "value")).alias("b"),
        F.sum("rows").alias("n"),
        F.try_divide(F.sum(F.col("rows") * F.col("value")), F.sum("rows")).alias("mean"),
    )
    squares = F.aggregate(
        "b", F.lit(0.0), lambda a, e: a + e.rows * F.pow(e.value - F.col("mean"), F.lit(2.0))
    )
    sd = F.sqrt(F.try_divide(squares, F.col("n") - 1))
    rows = packed.withColumn("sd", sd).select(*keys, "mean", "sd", F.explode("b").alias("e"))
    scaled = F.try_divide(F.col("e.value") - F.col("mean"), F.col("sd"))
    return rows.select(*keys, "e.bin", "e.rows", "e.value", scaled.alias("scaled"))


def standardise(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(x - mean) / sd of each column within ``by``, missing values skipped.

    One aggregate with map-side combine, then one join with its few rows.
    """
    stats = settle(
        df.groupBy(*by).agg(
            *[F.avg(c).alias(f"__mean_{c}") for c in columns],
            *[F.stddev_samp(c).alias(f"__sd_{c}") for c in columns],
        )
    )
    joined = df.join(stats, list(by), "left")
    scaled = {
        c: F.try_divide(F.col(c) - F.col(f"__mean_{c}"), F.col(f"__sd_{c}")) for c in columns
    }
    return joined.withColumns(scaled).select(*df.columns)
