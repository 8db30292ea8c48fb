"""Exact order statistics of large groups.

Spark's exact ``percentile`` and ``median`` hold every distinct value of a
group in one buffer, which fails when one group is a third of a large table.
Here a group is never gathered:

1. a bounded sketch (``approx_percentile``) proposes cut points close to the
   wanted quantiles;
2. one pass counts the rows between consecutive cut points ("slots"), which
   says exactly in which slot each wanted rank lies;
3. one pass keeps only the rows of the wanted slots, counted per distinct value;
4. a slot that may hold more than ``SLOT_VALUES`` distinct values is cut again, by a
   sketch of its distinct values, and only its wanted parts are kept, until every
   part is below that bound; then the value at each rank is found inside its part.

The sketches only decide how narrow the slots are.  The result is exact whatever
their error, because slots are chosen by exact counts.  No task holds more than
``SLOT_VALUES`` values of one group, however many equal values surround a quantile.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fallow.session import settle

ACCURACY = 10_000
SLOT_VALUES = 1 << 20
AT_ONCE = 11  # columns whose sketches one scan makes
PARTS = 64  # a slot that is cut again is cut into so many parts


def halving_steps(size: int) -> list[int]:
    """Step lengths of a binary search among ``size`` cuts."""
    return [1 << k for k in reversed(range(size.bit_length()))]


def cuts_below(x: str, cuts: str, size: int) -> Column:
    """How many of the ``size`` sorted ``cuts`` are less than x, as one short expression.

    For wide tables, where the search is repeated for many columns.
    """
    steps = ", ".join(map(str, halving_steps(size)))
    return F.expr(
        f"aggregate(array({steps}), 0, (p, s) -> "
        f"if(coalesce(get({cuts}, p + s - 1) < {x}, false), p + s, p))"
    )


def with_cuts_below(df: DataFrame, name: str, x: str, cuts: str, size: int) -> DataFrame:
    """Add ``name``, the number of ``cuts`` less than x, for one column.

    One projection per search step: each step is compiled, and uses the one
    before it twice, so the optimizer keeps them apart.  Several times faster
    than one nested expression, which grows beyond what the JVM compiles.
    """
    at = "0"
    steps = halving_steps(size)
    for k, s in enumerate(steps):
        df = df.withColumn(f"__{name}{k}", F.expr(f"if(get({cuts}, {at} + {s - 1}) < {x}, {at} + {s}, {at})"))
        at = f"__{name}{k}"
    return df.withColumn(name, F.col(at)).drop(*[f"__{name}{k}" for k in range(len(steps))])


def column_sketches(df: DataFrame, by: Sequence[str], columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(by, place, cuts, n) of the ``columns`` of a wide table, ``place`` being the column's index.

    Spark sorts all rows of an aggregate of sketches where a task meets more than 128 groups, as groups times
    columns of a long table soon are.  Here a group is a row of sketches, for ``AT_ONCE`` columns a scan.
    """
    out = None
    for start in range(0, len(columns), AT_ONCE):
        x = [F.col(c).cast("double") for c in columns[start : start + AT_ONCE]]
        each = F.array(*[F.struct(F.approx_percentile(c, list(probs), ACCURACY).alias("cuts"), F.count(c).alias("n")) for c in x])
        part = df.groupBy(*by).agg(each.alias("each")).select(*by, F.posexplode("each").alias("place", "s"))
        part = part.select(*by, (F.col("place") + start).alias("place"), "s.cuts", "s.n").where("n > 0")
        out = part if out is None else out.unionByName(part)
    return out


class OrderStatistics:
    """Order statistics of ``value`` per ``keys`` group of a long table.

    ``probs`` are the quantiles around which the cut points are placed; any
    rank can be asked for, those near ``probs`` read the fewest rows.  ``table``
    holds one row per group: the row count ``n``, the ``cuts``, and the
    ``spans`` (slot, start, end) of the slots that have rows: those with the
    ranks start + 1 to end.  ``sketch``, where given, makes (keys, cuts, n) of the probabilities of the cuts.
    """

    def __init__(
        self, long: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
        sketch: Callable[[list[float]], DataFrame] | None = None,
    ):
        self.keys = list(keys)
        self.value = value
        self.rows = long.where(F.col(value).isNotNull())
        margin = 3.0 / ACCURACY
        near = {min(max(p + d, 0.0), 1.0) for p in probs for d in (-margin, margin)}
        self.near = sorted(near | {0.0, 1.0})
        if sketch is None:
            found = self.rows.groupBy(*self.keys).agg(
                F.approx_percentile(value, self.near, ACCURACY).alias("cuts"),
                F.count(value).alias("n"),
            )
        else:
            found = sketch(self.near)
        sketch = settle(found)
        per_slot = (
            self._with_slot(self.rows.join(sketch, self.keys))
            .groupBy(*self.keys, "slot")
            .agg(F.count(F.lit(1)).alias("rows"))
        )
        run = (
            Window.partitionBy(*self.keys)
            .orderBy("slot")
            .rowsBetween(Window.unboundedPreceding, 0)
        )
        ended = per_slot.withColumn("end", F.sum("rows").over(run))
        span = F.struct("slot", (F.col("end") - F.col("rows")).alias("start"), "end")
        spans = ended.groupBy(*self.keys).agg(F.array_sort(F.collect_list(span)).alias("spans"))
        self.table = settle(sketch.join(spans, self.keys))

    def _with_slot(self, df: DataFrame) -> DataFrame:
        return with_cuts_below(df, "slot", self.value, "cuts", len(self.near))

    def at(self, ranks: DataFrame) -> DataFrame:
        """``ranks`` (keys, rank; 1 = smallest) with the value ``x`` at that rank

        and ``upto``, the number of rows of the group whose value is at most x.
        """
        rank = F.col("rank")
        hit = F.get(F.filter("spans", lambda s: (s.start < rank) & (rank <= s.end)), F.lit(0))
        wanted = (
            ranks.select(*self.keys, "rank")
            .distinct()
            .join(self.table, self.keys)
            .select(
                *self.keys,
                "rank",
                hit["slot"].alias("slot"),
                hit["start"].alias("start"),
                (hit["end"] - hit["start"]).alias("rows"),
            )
        )
        # the rows of a slot are an upper bound of its values
        needed = settle(wanted.groupBy(*self.keys, "slot").agg(F.max("rows").alias("slot_rows")))
        # An inner join, not a filter: a filter on the slot would be pushed
        # below the search steps and repeat them.
        per_value = (
            self._with_slot(self.rows.join(self.table.select(*self.keys, "cuts"), self.keys))
            .join(needed.drop("slot_rows"), [*self.keys, "slot"])
            .groupBy(*self.keys, "slot", F.col(self.value).alias("x"))
            .agg(F.count(F.lit(1)).alias("rows"))
        )
        wanted = wanted.drop("rows")
        if not needed.where(F.col("slot_rows") > SLOT_VALUES).isEmpty():
            per_value, wanted = self._refined(settle(per_value), settle(wanted))
        run = (
            Window.partitionBy(*self.keys, "slot")
            .orderBy("x")
            .rowsBetween(Window.unboundedPreceding, 0)
        )
        running = per_value.withColumn("to", F.sum("rows").over(run))
        place = F.col("rank") - F.col("start")
        return (
            running.join(wanted, [*self.keys, "slot"])
            .where((place > F.col("to") - F.col("rows")) & (place <= F.col("to")))
            .select(*self.keys, "rank", "x", (F.col("start") + F.col("to")).alias("upto"))
        )

    def _refined(self, per_value: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Both tables with large slots cut until none holds more than ``SLOT_VALUES`` values.

        ``per_value`` (keys, slot, x, rows) and ``wanted`` (keys, rank, slot, start) are stored; a part of a
        slot is named after it.  A sketch of the distinct values cuts a slot into parts of
        about as many values each, so few rounds are needed: each divides the bound by some ``PARTS``.
        """
        at = [*self.keys, "slot"]
        edges = [i / PARTS for i in range(1, PARTS)]
        name = F.col("slot").cast("string").alias("slot")
        per_value, wanted = per_value.withColumn("slot", name), wanted.withColumn("slot", name)
        small = per_value.limit(0)
        while True:
            sizes = settle(per_value.groupBy(*at).agg(
                F.count(F.lit(1)).alias("values"), F.approx_percentile("x", edges, ACCURACY).alias("cuts")
            ))
            large = sizes.where(F.col("values") > SLOT_VALUES)
            if large.isEmpty():
                return small.unionByName(per_value), wanted
            small = small.unionByName(per_value.join(large.select(*at), at, "left_anti"))
            parted = with_cuts_below(per_value.join(large.drop("values"), at), "part", "x", "cuts", len(edges))
            counts = parted.groupBy(*at, "part").agg(F.sum("rows").alias("rows"))  # at most PARTS rows per slot
            run = Window.partitionBy(*at).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
            spans = counts.withColumn("end", F.sum("rows").over(run)).select(*at, "part", (F.col("end") - F.col("rows")).alias("begin"), "end")
            place = F.col("rank") - F.col("start")
            number = F.concat_ws(".", "slot", "part")
            moved = wanted.join(spans, at).where((place > F.col("begin")) & (place <= F.col("end")))
            moved = moved.select(*self.keys, "rank", number.alias("slot"), (F.col("start") + F.col("begin")).alias("start"))
            kept = wanted.join(large.select(*at), at, "left_anti")
            wanted = settle(kept.unionByName(moved))
            per_value = settle(parted.select(*self.keys, number.alias("slot"), "x", "rows").join(wanted.select(*at).distinct(), at))
            small = settle(small)

    def lookup(self, ranks: DataFrame) -> DataFrame:
        """One row per group with ``at``: rank -> (x, upto)."""
        pair = F.struct("rank", F.struct("x", "upto"))
        return self.at(ranks).groupBy(*self.keys).agg(
            F.map_from_entries(F.collect_list(pair)).alias("at")
        )


def type7_position(n: Column, num: Column, den: Column) -> tuple[Column, Column]:
    """1-based lower rank and fraction of quantile num/den among n rows.

    Integer arithmetic, so that a position that is a whole number has an exact
    zero fraction.
    """
    at = num * (n - 1)
    return (at - at % den) / den + 1, (at % den) / den


def exact_quantiles(
    long: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[tuple[int, int]],
    stats: OrderStatistics | None = None,
) -> DataFrame:
    """Linearly interpolated (type 7) quantiles at the fractions ``probs``.

    One row per group and entry of ``probs``: ``k`` (its position, from 0),
    ``q`` and ``upto``, the number of rows whose value is at most ``q``.
    """
    keys = list(keys)
    stats = stats or OrderStatistics(long, keys, value, [a / b for a, b in probs])
    wanted = F.array(
        *[
            F.struct(F.lit(k).alias("k"), F.lit(a).alias("num"), F.lit(b).alias("den"))
            for k, (a, b) in enumerate(probs)
        ]
    )
    places = stats.table.select(*keys, "n", F.explode(wanted).alias("p"))
    low, part = type7_position(F.col("n"), F.col("p.num"), F.col("p.den"))
    places = places.select(
        *keys,
        F.col("p.k").alias("k"),
        low.cast("long").alias("lo"),
        F.least(low.cast("long") + 1, F.col("n")).alias("hi"),
        part.cast("double").alias("part"),
    )
    found = stats.lookup(places.select(*keys, F.explode(F.array("lo", "hi")).alias("rank")))
    low, high = F.col("at")[F.col("lo")], F.col("at")[F.col("hi")]
    q = low["x"] + (high["x"] - low["x"]) * F.col("part")
    return places.join(found, keys).select(*keys, "k", q.alias("q"), low["upto"].alias("upto"))
