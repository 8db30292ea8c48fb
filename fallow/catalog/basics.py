"""Catalogue: panel building, windows, reshaping, binning, geometry."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fallow.catalog import analog as a
from fallow.catalog import sql as s
from fallow.functions import frames
from fallow.functions.scalars import (
    INF,
    area_normalise,
    entity_year_key,
    ratio,
    scrub_nonfinite,
    to_number,
)
from fallow.operators import binning, diversity, joins, reshape, sketches, spatial
from fallow.operators.windows import PanelWindow, Rolling
from fallow.plans import panel as p
from fallow.session import settle

KEYS = a.KEYS


@dataclass
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


CATALOG: dict[str, Query] = {}


def query(sql: str | None = None):
    """Register a function as a catalogue query under its own name."""

    def add(run):
        CATALOG[run.__name__] = Query(run, sql)
        return run

    return add


def tidy(df: DataFrame, nine: tuple[str, ...] = ()) -> DataFrame:
    """Doubles rounded to six decimals, in arithmetic every engine shares.

    The columns ``nine`` keep nine: plain sums of measures stored with nine
    decimals may lie half-way between two values of six, where the order of
    summation would decide.
    """
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    scale = {c: 1e9 if c in nine else 1e6 for c in doubles}
    return df.withColumns(
        {c: F.floor(F.col(f"`{c}`") * k + 0.5).cast("double") / k for c, k in scale.items()}
    )


def built(spark: SparkSession, d: str) -> DataFrame:
    return p.build_panel(a.input_panel(spark, d), a.water(spark, d), a.YEAR0)


def built_stage(spark: SparkSession, d: str) -> DataFrame:
    return a.stage(spark, d, "built", lambda: built(spark, d))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    # of the built panel as a plan, not as a stored table: of its columns only the keys and the outcome are computed
    return a.stage(
        spark, d, "nodes", lambda: p.area_index(built(spark, d), a.county(spark, d))
    )


def prepared(spark: SparkSession, d: str) -> DataFrame:
    rows = p.prepare_panel(
        built_stage(spark, d), nodes(spark, d), a.fertilizer(spark, d), a.herbicide(spark, d),
        a.headers(spark, d), a.YEAR0,
    )
    measures = [*s.OUTCOMES, *p.MODEL_COLUMNS]
    return rows.withColumns({c: F.round(c, 9) for c in measures})


def prepared_stage(spark: SparkSession, d: str) -> DataFrame:
    return a.stage(spark, d, "prepared", lambda: prepared(spark, d))


_bins: dict[tuple[str, str, str], binning.QuantileBins] = {}


def bins(spark: SparkSession, d: str) -> binning.QuantileBins:
    key = a.stage_key(spark, d, "bins")
    if key not in _bins:
        _bins[key] = binning.QuantileBins(prepared_stage(spark, d), ["crop"], p.MODEL_COLUMNS)
    return _bins[key]


def edges(spark: SparkSession, d: str) -> DataFrame:
    rook = spatial.contiguity(a.county(spark, d), "GEOID")
    return spatial.index_edges(rook, nodes(spark, d), "GEOID", "CNTY", ["crop"])


def columns_sql(table: str, columns: list[str], where: str = "") -> str:
    return s.statement(
        f"select crop, GEOID, YEAR, {', '.join(s.r6(c) for c in columns)} from {table} {where}"
    )


# ---- panel building -------------------------------------------------------


@query(
    s.statement(
        f"select crop, GEOID, YEAR, Yr, Cnty_yr, STATE, {s.r6('YIELD')}, {s.r6('PERC_IRR')} "
        "from panel where STATE = 'ASIA' and YIELD is not null"
    )
)
def panel_filter_project(spark, d):
    rows = p.year_index(p.select_panel(a.input_panel(spark, d), "ASIA"), a.YEAR0)
    rows = joins.drop_missing(rows, "YIELD")
    return tidy(rows.select(*KEYS, "Yr", "Cnty_yr", "STATE", "YIELD", "PERC_IRR"))


@query(
    s.statement(
        "select crop, GEOID, YEAR, "
        + ", ".join(s.r6(c) for c in ["YIELD", "LSM_SIDI_ALL", "SDD", "TOTAL_ACRES"])
        + " from panel order by crop, GEOID, YEAR limit 6"
    )
)
def panel_head(spark, d):
    rows = a.input_panel(spark, d).orderBy(*KEYS).limit(6)
    return tidy(rows.select(*KEYS, "YIELD", "LSM_SIDI_ALL", "SDD", "TOTAL_ACRES"))


@query(
    s.statement(
        f"select crop, GEOID, YEAR, Cnty_yr, {s.r6('avg_water')}, {s.r6('range_water')}, volume, "
        f"{s.r6('try_cast(volume as double)', 'amount')} from watered"
    )
)
def panel_natural_left_join(spark, d):
    rows = p.join_water(a.input_panel(spark, d), a.water(spark, d), a.YEAR0)
    rows = rows.withColumn("amount", to_number("volume"))
    return tidy(rows.select(*KEYS, "Cnty_yr", "avg_water", "range_water", "volume", "amount"))


@query(
    s.statement(
        "select f.Cnty_yr, f.GEOID as GEOID_x, h.GEOID as GEOID_y, f.Yr as Yr_x, h.Yr as Yr_y, "
        f"{s.r6('fert')}, {s.r6('herb')} "
        "from fert_long f left join herb_long h on f.Cnty_yr = h.Cnty_yr"
    )
)
def expense_join_suffixes(spark, d):
    fert = reshape.years_to_rows(a.fertilizer(spark, d), "fert", a.headers(spark, d), a.YEAR0)
    herb = reshape.years_to_rows(a.herbicide(spark, d), "herb", a.headers(spark, d), a.YEAR0)
    both = joins.suffixed_left_join(fert, herb, ["Cnty_yr"])
    return tidy(both.select("Cnty_yr", "GEOID_x", "GEOID_y", "Yr_x", "Yr_y", "fert", "herb"))


@query(s.statement("select crop, GEOID, CNTY from nodes"))
def panel_semi_index(spark, d):
    return p.area_index(built(spark, d), a.county(spark, d)).select("crop", "GEOID", "CNTY")


@query(
    s.statement(
        "select crop, count(distinct GEOID) as areas, count(distinct YEAR) as years, "
        "count(*) as n_rows, count(YIELD) as n_outcome from panel group by crop"
    )
)
def panel_counts(spark, d):
    return a.input_panel(spark, d).groupBy("crop").agg(
        F.countDistinct("GEOID").alias("areas"),
        F.countDistinct("YEAR").alias("years"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count("YIELD").alias("n_outcome"),
    )


@query(
    s.statement(
        f"select crop, GEOID, YEAR, coalesce(isinf(YIELD), false) as no_yield, "
        f"coalesce(isinf(volume), false) as no_water, "
        f"{s.r6(s.finite('YIELD'), 'YIELD')}, {s.r6(s.finite('volume'), 'volume')} from logged"
    )
)
def log_and_scrub(spark, d):
    rows = p.log_outcome_and_water(p.join_water(a.input_panel(spark, d), a.water(spark, d), a.YEAR0))
    flagged = rows.select(
        *KEYS,
        F.coalesce(F.col("YIELD") == -INF, F.lit(False)).alias("no_yield"),
        F.coalesce(F.col("volume") == -INF, F.lit(False)).alias("no_water"),
        "YIELD",
        "volume",
    )
    return tidy(scrub_nonfinite(flagged))


@query(
    s.statement(
        "select crop, GEOID, YEAR, "
        + s.r6("YIELD / nullif(try_cast(volume as double), 0)", "per_volume")
        + ", "
        + ", ".join(s.r6(f"{c} / nullif(TOTAL_ACRES, 0)", c) for c in ("fert", "herb", "ACRES"))
        + " from watered left join (select Cnty_yr, fert from fert_long) using (Cnty_yr)"
        " left join (select Cnty_yr, herb from herb_long) using (Cnty_yr)"
    )
)
def area_normalised(spark, d):
    rows = p.join_water(a.input_panel(spark, d), a.water(spark, d), a.YEAR0)
    rows = p.join_expenses(rows, a.fertilizer(spark, d), a.herbicide(spark, d), a.headers(spark, d), a.YEAR0)
    rows = rows.withColumn("per_volume", ratio("YIELD", to_number("volume")))
    rows = area_normalise(rows, ["fert", "herb", "ACRES"], "TOTAL_ACRES")
    return tidy(rows.select(*KEYS, "per_volume", "fert", "herb", "ACRES"))


# ---- windows --------------------------------------------------------------

CHANGES = [c for c in s.BUILT if c.startswith("d")]
LAGS = [c for c in s.BUILT if c.startswith("lag")]
MEANS2 = [c for c in s.BUILT if c.endswith("2yr")]
MEANS3 = [c for c in s.BUILT if c.endswith("3yr")]
CVS = [c for c in s.BUILT if c.startswith("cov")]


def _window_query(spark, d, columns):
    return tidy(scrub_nonfinite(built(spark, d).select(*KEYS, *columns)))


@query(columns_sql("built", CHANGES))
def change_lead(spark, d):
    return _window_query(spark, d, CHANGES)


@query(columns_sql("built", LAGS))
def lag_one(spark, d):
    return _window_query(spark, d, LAGS)


@query(columns_sql("built", MEANS2))
def rolling_mean2(spark, d):
    return _window_query(spark, d, MEANS2)


@query(columns_sql("built", MEANS3))
def rolling_mean3(spark, d):
    return _window_query(spark, d, MEANS3)


@query(columns_sql("built", CVS))
def rolling_cv3(spark, d):
    return _window_query(spark, d, CVS)


@query(
    s.statement(
        f"select crop, GEOID, YEAR, Yr, STATE, {s.r6(s.finite('YIELD'), 'YIELD')}, "
        f"{s.r6(s.finite('volume'), 'volume')}, "
        + ", ".join(s.r6(c) for c in s.BUILT)
        + " from built"
    )
)
def built_panel(spark, d):
    rows = built(spark, d).select(*KEYS, "Yr", "STATE", "YIELD", "volume", *s.BUILT)
    return tidy(scrub_nonfinite(rows))


_EVENTS = "partition by event_type order by ts, event_id"


@query(
    "select event_id, event_type, "
    + s.r6(f"lead(value) over ({_EVENTS}) - value", "d_value")
    + ", "
    + s.r6(f"lag(value) over ({_EVENTS})", "lag_value")
    + ", "
    + s.r6(
        f"case when count(*) over ({_EVENTS} {s.FRAMES[3]}) = 3 "
        f"then avg(value) over ({_EVENTS} {s.FRAMES[3]}) end",
        "mean3",
    )
    + ", "
    + s.r6(
        f"case when count(*) over ({_EVENTS} {s.FRAMES[3]}) = 3 "
        f"then stddev_samp(value) over ({_EVENTS} {s.FRAMES[3]}) "
        f"/ nullif(avg(value) over ({_EVENTS} {s.FRAMES[3]}), 0) end",
        "cv3",
    )
    + " from events"
)
def long_series_windows(spark, d):
    """Few entities with very long series: chunked by the hour, with border rows."""
    events = a.table(spark, d, "events").select("event_id", "event_type", "ts", "value")
    w = PanelWindow(["event_type"], ["ts", "event_id"], chunk=F.date_trunc("hour", "ts"))
    out = w.with_columns(
        events,
        {
            "d_value": w.change("value"),
            "lag_value": w.lag("value"),
            "mean3": w.rolling_mean("value", 3),
            "cv3": w.rolling_cv("value"),
        },
    )
    return tidy(out.select("event_id", "event_type", "d_value", "lag_value", "mean3", "cv3"))


def _list_mad(values: str) -> str:
    known = f"list_filter({values}, lambda v: v is not null)"
    return f"list_median(list_transform({known}, lambda v: abs(v - list_median({known}))))"


_FRAME5, _FRAME7 = (f"array_agg(value) over ({_EVENTS} rows between {k} preceding and {k} following)" for k in (2, 3))


@query(
    "select event_id, event_type, "
    + s.r6(f"case when len(five) = 5 then {_list_mad('five')} end", "mad5")
    + ", "
    + s.r6(
        "case when len(seven) = 7 then list_sum(list_transform(range(1, 7), lambda i: (seven[i] - list_avg(seven)) * (seven[i + 1] - list_avg(seven)))) "
        "/ nullif(list_sum(list_transform(seven, lambda v: (v - list_avg(seven)) * (v - list_avg(seven)))), 0) end",
        "autocorrelation7",
    )
    + ", "
    + s.r6("case when len(five) = 5 then list_avg(list_sort(five)[2:4]) end", "trimmed5")
    + f" from (select event_id, event_type, {_FRAME5} as five, {_FRAME7} as seven from events)"
)
def rolling_any(spark, d):
    """Functions that are no built-in, over the frames of a few very long series."""
    events = a.table(spark, d, "events").select("event_id", "event_type", "ts", "value")
    w = PanelWindow(["event_type"], ["ts", "event_id"], chunk=F.date_trunc("hour", "ts"))
    out = w.with_rolling(events, {
        "mad5": Rolling("value", frames.median_absolute_deviation, 5),
        "autocorrelation7": Rolling("value", frames.autocorrelation(1), 7),
        "trimmed5": Rolling("value", frames.trimmed_mean(0.2), 5),
    })
    return tidy(out.select("event_id", "event_type", "mad5", "autocorrelation7", "trimmed5"))


@query(
    s.statement(
        "select crop, GEOID, YEAR, " + s.r6(f"case when len(l) = 3 and len(list_filter(l, lambda v: isinf(v))) = 0 then {_list_mad('l')} end", "madYIELD")
        + f" from (select crop, GEOID, YEAR, array_agg(YIELD) over ({s.OVER} {s.FRAMES[3]}) as l from logged)"
    )
)
def rolling_any_panel(spark, d):
    """The same over very many short series."""
    rows = p.log_outcome_and_water(p.join_water(a.input_panel(spark, d), a.water(spark, d), a.YEAR0))
    out = PanelWindow(p.KEYS, "Yr").with_rolling(rows, {"madYIELD": Rolling("YIELD", frames.median_absolute_deviation, 3)})
    return tidy(scrub_nonfinite(out.select(*KEYS, "madYIELD")))


# ---- reshape, preparation, binning ---------------------------------------


@query(
    s.statement(
        f"select 'fert' as kind, GEOID, year, Yr, Cnty_yr, {s.r6('fert', 'amount')} from fert_long "
        f"union all select 'herb', GEOID, year, Yr, Cnty_yr, {s.r6('herb', 'amount')} from herb_long"
    )
)
def expense_unpivot(spark, d):
    parts = [
        reshape.years_to_rows(wide(spark, d), "amount", a.headers(spark, d), a.YEAR0).withColumn(
            "kind", F.lit(kind)
        )
        for kind, wide in (("fert", a.fertilizer), ("herb", a.herbicide))
    ]
    return tidy(parts[0].unionByName(parts[1]))


@query(
    s.statement(
        "select crop, GEOID, YEAR, Yr, CNTY, Yr as YEAR_id, Yr * Yr as YEAR_id2, "
        + ", ".join(s.r6(c) for c in [*s.OUTCOMES, *p.MODEL_COLUMNS])
        + " from prepared"
    )
)
def prepared_panel(spark, d):
    columns = ["Yr", "CNTY", "YEAR_id", "YEAR_id2", *s.OUTCOMES, *p.MODEL_COLUMNS]
    return tidy(prepared(spark, d).select(*KEYS, *columns))


@query(
    s.statement(
        f"select crop, col, cast(row_number() over (partition by crop, col order by bin) as integer) as place, "
        f"count(*) as n_rows, {s.r6('min(x)', 'low')}, {s.r6('max(x)', 'high')}, {s.r6('any_value(v)', 'v')} "
        "from binned group by crop, col, bin"
    )
)
def bin_table(spark, d):
    """The bins themselves: rows, lowest and highest value and label."""
    from pyspark.sql import Window

    found = bins(spark, d)
    numbered = found.apply(prepared_stage(spark, d), number="no_{}").select(
        "crop", *p.MODEL_COLUMNS, *[f"no_{c}" for c in p.MODEL_COLUMNS]
    )
    pairs = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("col"), F.col(c).alias("x"), F.col(f"no_{c}").alias("bin"))
                for c in p.MODEL_COLUMNS
            ]
        )
    )
    ranges = (
        numbered.select("crop", pairs.alias("e"))
        .select("crop", "e.*")
        .where(F.col("x").isNotNull())
        .groupBy("crop", "col", "bin")
        .agg(F.min("x").alias("low"), F.max("x").alias("high"))
    )
    labels = found.table.withColumnRenamed("column", "col")
    place = F.row_number().over(Window.partitionBy("crop", "col").orderBy("bin"))
    return tidy(
        labels.join(ranges, ["crop", "col", "bin"]).select(
            "crop",
            "col",
            place.alias("place"),
            F.col("rows").alias("n_rows"),
            "low",
            "high",
            F.col("value").alias("v"),
        )
    )


def _long(df: DataFrame, value: str) -> DataFrame:
    return df.select(*KEYS, *p.MODEL_COLUMNS).unpivot(KEYS, p.MODEL_COLUMNS, "col", value)


@query(s.statement(f"select crop, GEOID, YEAR, col, {s.r6('v')} from binned"))
def quantile_bins20(spark, d):
    rows = bins(spark, d).apply(prepared_stage(spark, d), value="{}")
    return tidy(_long(rows, "v").where(F.col("v").isNotNull()))


@query(s.statement(f"select crop, GEOID, YEAR, col, {s.r6('z')} from scaled"))
def binned_and_scaled(spark, d):
    rows = bins(spark, d).apply(prepared_stage(spark, d), number="no_{}", scaled="z_{}")
    pairs = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("col"), F.col(f"no_{c}").alias("no"), F.col(f"z_{c}").alias("z"))
                for c in p.MODEL_COLUMNS
            ]
        )
    )
    return tidy(
        rows.select(*KEYS, pairs.alias("e")).where("e.no is not null").select(*KEYS, "e.col", "e.z")
    )


@query(
    s.statement(
        "select crop, GEOID, YEAR, col, "
        + s.r6(
            "(x - avg(x) over (partition by crop, col)) "
            "/ nullif(stddev_samp(x) over (partition by crop, col), 0)",
            "z",
        )
        + " from cols_long"
    )
)
def standardise(spark, d):
    rows = binning.standardise(prepared_stage(spark, d), ["crop"], p.MODEL_COLUMNS)
    return tidy(_long(rows, "z").where(F.col("z").isNotNull()))


@query(
    s.statement(
        "select GEOID, YEAR, "
        + s.r6("1 - sum(p * p)", "simpson")
        + ", "
        + s.r6("-sum(p * ln(p))", "shannon")
        + ", count(*) as richness from "
        "(select GEOID, YEAR, p_type, cast(sum(qty) as double) / "
        "sum(cast(sum(qty) as double)) over (partition by GEOID, YEAR) as p "
        "from lines group by GEOID, YEAR, p_type) group by GEOID, YEAR"
    )
)
def diversity_indices(spark, d):
    return tidy(diversity.diversity_indices(a.lines(spark, d), ["GEOID", "YEAR"], "p_type", "qty"))


PROBS = (0.05, 0.25, 0.5, 0.75, 0.95)
DISTINCT_ROWS = 50_000


@query(s.statement("select crop, col, count(*) as n, true as distinct_within, true as ranks_within from cols_long group by all"))
def sketched_columns(spark, d):
    """Distinct counts and quantiles per crop from sketches stored per crop and year, held against all rows."""
    rows = prepared_stage(spark, d)
    table = a.stage(spark, d, "sketches", lambda: sketches.sketch_table(rows, ["crop", "YEAR"], p.MODEL_COLUMNS))
    found = sketches.merged(table, ["crop", "column"]).select(
        "crop", F.col("column").alias("col"), "n", sketches.distinct_estimate().alias("distinct_about"),
        F.array(*[sketches.quantile_estimate(q) for q in PROBS]).alias("q"),
    )
    found = settle(found)
    # As many tasks as the panel needs: a task makes the values of some `DISTINCT_ROWS` rows distinct.  Counts go apart from them.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // DISTINCT_ROWS))
    long = lambda of: binning.to_long(of, ["crop"], p.MODEL_COLUMNS).where("x is not null")
    named = lambda df: df.withColumn("col", F.get(F.array(*[F.lit(c) for c in p.MODEL_COLUMNS]), F.col("place"))).drop("place")
    dealt = rows.select(*KEYS, *p.MODEL_COLUMNS).repartition(tasks, *KEYS)
    values = named(long(dealt).distinct().groupBy("crop", "place").agg(F.count(F.lit(1)).alias("values")))
    below = [F.count(F.when(F.col("x") < F.col("q")[i], 1)).alias(f"below{i}") for i in range(len(PROBS))]
    upto = [F.count(F.when(F.col("x") <= F.col("q")[i], 1)).alias(f"upto{i}") for i in range(len(PROBS))]
    counts = named(long(rows)).join(found.select("crop", "col", "q"), ["crop", "col"]).groupBy("crop", "col").agg(*below, *upto)
    counts = counts.join(values, ["crop", "col"])
    margin = sketches.RANK_ERROR * F.col("n") + 1
    inside = [(F.col(f"below{i}") - margin <= q * F.col("n")) & (q * F.col("n") <= F.col(f"upto{i}") + margin) for i, q in enumerate(PROBS)]
    close = F.abs(F.col("distinct_about") - F.col("values")) <= sketches.DISTINCT_ERROR * F.col("values")
    both = found.join(counts, ["crop", "col"])
    return both.select("crop", "col", "n", close.alias("distinct_within"), reduce(and_, inside).alias("ranks_within"))


# ---- geometry -------------------------------------------------------------


@query(s.statement("select i, j from rook"))
def rook_edges(spark, d):
    return spatial.contiguity(a.county(spark, d), "GEOID").select("i", "j")


@query(s.statement("select i, j from queen"))
def queen_edges(spark, d):
    return spatial.contiguity(a.county(spark, d), "GEOID", rook=False).select("i", "j")


@query(
    s.statement(
        "select i, j from rook where (cast(i as bigint) % 11 = 0) = (cast(j as bigint) % 11 = 0)"
    )
)
def snapped_edges(spark, d):
    """Neighbours among squares at fractional places that miss each other by less than the tolerance.

    Corners are off by up to six billionths; every eleventh square is off by five tolerances and meets only
    its like.
    """
    key = F.col("GEOID").cast("long")
    off = (key % 7) * 1e-9 + F.when(key % 11 == 0, 5e-7).otherwise(0.0)
    moved = a.county(spark, d).withColumns({"x": F.col("x") * 0.37 + off, "y": F.col("y") * 0.37 + off})
    return spatial.contiguity(moved, "GEOID").select("i", "j")


@query(s.statement("select crop, i, j, 1.0::double as w from edges"))
def crop_adjacency(spark, d):
    return edges(spark, d)


@query(
    s.statement(
        "select n.crop, n.CNTY as i, n.CNTY as j, cast(count(e.j) as double) as q "
        "from nodes n left join edges e on e.crop = n.crop and e.i = n.CNTY group by n.crop, n.CNTY "
        "union all select crop, i, j, -1.0::double from edges"
    )
)
def graph_laplacian(spark, d):
    return spatial.graph_laplacian(edges(spark, d), nodes(spark, d), "CNTY", ["crop"])


@query(
    s.statement(
        "select n.crop, n.CNTY, min(reach.j) as part, count(*) as size, count(*) = 1 as isolated from nodes n "
        "join reach on reach.crop = n.crop and reach.i = n.CNTY group by n.crop, n.CNTY",
        homes="select n.crop, CNTY, n_regionkey as home from nodes n join supplier on cast(s_suppkey as varchar) = n.GEOID "
        "join nation on s_nationkey = n_nationkey",
        inner_edges="select e.crop, e.i, e.j from edges e join homes h on h.crop = e.crop and h.CNTY = e.i "
        "join homes k on k.crop = e.crop and k.CNTY = e.j where h.home = k.home",
        reach="select crop, CNTY as i, CNTY as j from nodes union "
        "select r.crop, r.i, e.j from reach r join inner_edges e on e.crop = r.crop and e.i = r.j",
    )
)
def area_components(spark, d):
    """Connected parts of the contiguity graph inside each state, isolated areas included."""
    areas = nodes(spark, d)
    homes = areas.join(a.county(spark, d).select("GEOID", "STATEFP").distinct(), "GEOID").select("crop", "CNTY", "STATEFP")
    one = homes.select("crop", F.col("CNTY").alias("i"), F.col("STATEFP").alias("of_i"))
    two = homes.select("crop", F.col("CNTY").alias("j"), F.col("STATEFP").alias("of_j"))
    inside = edges(spark, d).join(one, ["crop", "i"]).join(two, ["crop", "j"]).where("of_i = of_j")
    return spatial.components(areas, inside, "CNTY", ["crop"])
