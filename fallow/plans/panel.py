"""Build and prepare the entity x year x crop panel.

One code path serves all crops: ``crop`` is a key column, not a loop.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fallow.functions.scalars import (
    area_normalise,
    entity_year_key,
    log_keep_inf,
    scrub_nonfinite,
    to_number,
)
from fallow.operators.binning import QuantileBins
from fallow.operators.indexing import dense_index
from fallow.operators.joins import drop_missing, keep_members, natural_left_join
from fallow.operators.reshape import years_to_rows
from fallow.operators.windows import PanelWindow
from fallow.session import settle

KEYS = ["crop", "GEOID"]

# Short names used in derived columns, and their source columns.
DIVERSITY = {"SIDI": "LSM_SIDI_ALL", "SHDI": "LSM_SHDI_ALL", "RICH": "LSM_RICH_ALL"}
CLIMATE = {"GDD": "GDD", "SDD": "SDD", "TP": "TP"}
WATER = {"Vol": "volume"}
EXPENSES = {"fert": "fert", "herb": "herb"}

# The columns that are binned and standardised.
MODEL_COLUMNS = [
    "fert", "herb", "volume", "TP", "GDD", "SDD", "SOIL", "PERC_IRR", "ACRES",
    *DIVERSITY.values(),
    "lagvolume", *[f"lag{m}" for m in ("TP", "GDD", "SDD", "SIDI", "SHDI", "RICH")],
    *[f"d{m}" for m in ("SIDI", "SHDI", "RICH", "GDD", "SDD", "TP", "Vol", "fert", "herb")],
    *[f"ave{m}{k}yr" for k in (2, 3) for m in ("SIDI", "SHDI", "RICH")],
    *[f"ave{m}{k}yr" for k in (2, 3) for m in ("GDD", "SDD", "TP", "Vol")],
    *[f"ave{m}{k}yr" for k in (2, 3) for m in ("fert", "herb")],
    *[f"cov{m}" for m in ("SIDI", "SHDI", "RICH", "GDD", "SDD", "TP", "Vol", "fert", "herb")],
]


def change_and_spread(w: PanelWindow, measures: Mapping[str, str]) -> dict[str, Column]:
    """Change, two- and three-row mean and coefficient of variation per measure."""
    out: dict[str, Column] = {}
    for short, source in measures.items():
        out[f"d{short}"] = w.change(source)
        out[f"ave{short}2yr"] = w.rolling_mean(source, 2)
        out[f"ave{short}3yr"] = w.rolling_mean(source, 3)
        out[f"cov{short}"] = w.rolling_cv(source)
    return out


def year_index(df: DataFrame, year0: int) -> DataFrame:
    return df.withColumn("Yr", F.col("YEAR") - year0).withColumn(
        "Cnty_yr", entity_year_key("GEOID", "Yr")
    )


def select_panel(
    panel: DataFrame, state: str | None = None, drop: Sequence[str] = ("LSM_ENN_ALL", "geometry")
) -> DataFrame:
    """One state (or all) without the columns no later step reads."""
    rows = panel if state is None else panel.where(F.col("STATE") == state)
    return rows.drop(*drop)


def join_water(panel: DataFrame, water: DataFrame, year0: int) -> DataFrame:
    """Attach irrigation water by (crop, entity-year key)."""
    keyed = water.withColumn("Cnty_yr", entity_year_key("GEOID", "Yr")).drop("GEOID", "Yr")
    return natural_left_join(year_index(panel, year0), keyed)


def log_outcome_and_water(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {"YIELD": log_keep_inf("YIELD"), "volume": log_keep_inf(to_number("volume"))}
    )


def add_panel_windows(df: DataFrame) -> DataFrame:
    """The 37 window columns of the built panel, in one window stage."""
    w = PanelWindow(KEYS, "Yr")
    columns = {"dYield": w.change("YIELD"), "covYield": w.rolling_cv("YIELD")}
    measures = {**DIVERSITY, **CLIMATE, **WATER}
    columns |= change_and_spread(w, measures)
    columns |= {f"lag{source if s == 'Vol' else s}": w.lag(source) for s, source in measures.items()}
    return w.with_columns(df, columns)


def build_panel(
    panel: DataFrame, water: DataFrame, year0: int, state: str | None = None
) -> DataFrame:
    """Panel + water -> logged outcome and water -> window columns."""
    joined = join_water(select_panel(panel, state), water, year0)
    return add_panel_windows(log_outcome_and_water(joined))


def area_index(built: DataFrame, county: DataFrame) -> DataFrame:
    """Areas of each crop with an outcome and a polygon, numbered by GEOID."""
    areas = drop_missing(built, "YIELD").select(*KEYS).distinct()
    return dense_index(keep_members(areas, county, ["GEOID"]), "GEOID", "CNTY", ["crop"])


def join_expenses(
    df: DataFrame, fertilizer: DataFrame, herbicide: DataFrame, headers: Sequence[str], year0: int
) -> DataFrame:
    """Attach the two wide-by-year expense tables by entity-year key.

    Their rows are stored first: Spark takes an unpivoted table for a multiple of its size, and would shuffle
    the panel to meet one that it can send to every task.
    """
    for value, wide in (("fert", fertilizer), ("herb", herbicide)):
        long = settle(years_to_rows(wide, value, headers, year0).select("Cnty_yr", value))
        df = df.join(long, "Cnty_yr", "left")
    return df


def prepare_panel(
    built: DataFrame,
    nodes: DataFrame,
    fertilizer: DataFrame,
    herbicide: DataFrame,
    headers: Sequence[str],
    year0: int,
    three_year_sources: Mapping[str, str] | None = None,
) -> DataFrame:
    """Rows with an outcome, indexed, scrubbed, with expenses and their windows.

    The missing-outcome filter runs before the scrub, and the windows after it,
    so a logged zero outcome keeps its row and neighbours may skip years.
    ``three_year_sources`` overrides the source of single three-year means, for
    instance ``{"avefert3yr": "SDD", "aveherb3yr": "TP"}`` to repeat results
    made with those two columns crossed.
    """
    rows = drop_missing(built, "YIELD").join(nodes, KEYS, "left")
    rows = rows.withColumns({"YEAR_id": F.col("Yr"), "YEAR_id2": F.col("Yr") * F.col("Yr")})
    rows = join_expenses(scrub_nonfinite(rows), fertilizer, herbicide, headers, year0)
    rows = area_normalise(rows, ["fert", "herb", "volume"], "TOTAL_ACRES")
    w = PanelWindow(KEYS, "Yr")
    columns = change_and_spread(w, {**WATER, **EXPENSES})
    for name, source in (three_year_sources or {}).items():
        columns[name] = w.rolling_mean(source, 3)
    return w.with_columns(rows, columns)


def bin_and_scale(prepared: DataFrame, n: int = 20) -> tuple[DataFrame, QuantileBins]:
    """Replace the model columns by their standardised bin values, per crop.

    ``prepared`` should be a stored table: the bins take several passes over it.
    """
    bins = QuantileBins(prepared, ["crop"], MODEL_COLUMNS, n)
    return bins.apply(prepared, scaled="{}"), bins
