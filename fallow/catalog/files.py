"""Catalogue: every source and sink, as given tables written in the file form and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fallow.catalog import analog as a
from fallow.catalog import models as m
from fallow.catalog import sql as s
from fallow.catalog.basics import KEYS, edges, prepared_stage, query, tidy
from fallow.plans import curves, fit
from fallow.plans import panel as p
from fallow.session import app_dir
from fallow.sources import results, tables

def folder(spark, name: str) -> str:
    return f"{app_dir(spark)}/{name}-{uuid.uuid4().hex}"


def crops(rows: DataFrame) -> list[str]:
    """The crops of a table: one file name each."""
    return [r.crop for r in rows.select("crop").distinct().where("crop is not null").orderBy("crop").collect()]


@query(s.statement(f"select crop, GEOID, YEAR, STATE, {s.r6('YIELD')}, {s.r6('GDD')} from panel"))
def files_crop_panels(spark, d):
    """One parquet folder per crop, read back as one panel."""
    out = folder(spark, "panels")
    rows = a.input_panel(spark, d)
    names = crops(rows)
    for crop in names:
        rows.where(F.col("crop") == crop).drop("crop").write.parquet(f"{out}/{crop}")
    back = tables.read_crop_panels(spark, {c: f"{out}/{c}" for c in names})
    return tidy(back.select(*KEYS, "STATE", "YIELD", "GDD"))


@query(s.statement(f"select crop, GEOID, YEAR, Yr, CNTY, {s.r6('YIELD')}, {s.r6('volume')} from prepared where crop = 'BUILDING'"))
def files_prepared_of_crop(spark, d):
    """The prepared panel saved by crop, and one crop of it."""
    out = folder(spark, "prepared")
    tables.write_stage(prepared_stage(spark, d), out)
    return tidy(tables.read_stage(spark, out, "BUILDING").select(*KEYS, "Yr", "CNTY", "YIELD", "volume"))


@query(s.statement("select crop, i, j from edges where crop = 'FURNITURE'"))
def files_adjacency_of_crop(spark, d):
    out = folder(spark, "edges")
    tables.write_stage(edges(spark, d), out)
    return tables.read_stage(spark, out, "FURNITURE").select("crop", "i", "j")


@query(
    s.statement(
        "select crop, split_part(Cnty_yr, '_', 1) as GEOID, cast(split_part(Cnty_yr, '_', 2) as integer) as Yr, "
        f"{s.r6('avg_water')}, {s.r6('range_water')}, volume from water"
    )
)
def files_water_csv(spark, d):
    """Water files per crop with a byte order mark and columns named after the crop."""
    out = folder(spark, "water")
    rows = a.water(spark, d)
    names = crops(rows)
    for crop in names:
        own = rows.where(F.col("crop") == crop).select(
            F.col("GEOID").alias("\ufeffGEOID"), "Yr", F.col("avg_water").alias(f"avg_{crop}"), F.col("range_water").alias(f"range_{crop}"), "volume"
        )
        own.write.option("header", True).csv(f"{out}/{crop}")
    return tidy(tables.read_water_csv(spark, {c: f"{out}/{c}" for c in names}))


@query(
    s.statement(
        f"select GEOID, year, Yr, Cnty_yr, {s.r6('fert', 'amount')} from fert_long"
    )
)
def files_expense_csv(spark, d):
    """A wide expense file without a name for its first column, read back and unpivoted."""
    from fallow.operators import reshape

    out = folder(spark, "expenses")
    years = a.headers(spark, d)
    wide = a.fertilizer(spark, d).withColumnsRenamed({"X": " ", **{h: h[1:] for h in years}})
    wide.write.option("header", True).option("nullValue", "NA").csv(out)
    back = tables.read_expense_csv(spark, out)
    found = tables.year_headers(back, int(years[0][1:]), int(years[-1][1:]))
    return tidy(reshape.years_to_rows(back, "amount", found, a.YEAR0))


@query(
    "select cast(s_suppkey as varchar) as GEOID, n_regionkey as STATEFP, count(*) as corners, "
    f"cast(min(s_suppkey % {s.GRID}) as double) as x0, cast(max(s_suppkey // {s.GRID} + 1) as double) as y1 "
    "from supplier join nation on s_nationkey = n_nationkey, range(5) group by s_suppkey, n_regionkey"
)
def files_polygons(spark, d):
    out = folder(spark, "polygons")
    a.county(spark, d).write.parquet(out)
    back = tables.read_polygons(spark, out)
    return back.groupBy("GEOID", "STATEFP").agg(F.count(F.lit(1)).alias("corners"), F.min("x").alias("x0"), F.max("y").alias("y1"))


@query(
    s.statement(
        f"select row_number() over (order by crop, GEOID, YEAR) as row_id, crop, GEOID, YEAR, STATE, {s.r6('SOIL')} from panel"
    )
)
def files_csv_row_ids(spark, d):
    """A CSV file whose rows carry their number."""
    out = folder(spark, "csv")
    tables.write_csv(a.input_panel(spark, d).select(*KEYS, "STATE", "SOIL"), out, KEYS)
    schema = "row_id long, crop string, GEOID string, YEAR int, STATE string, SOIL double"
    return tidy(spark.read.schema(schema).option("header", True).csv(out))


@query(m.fit_sql("select model_id, term, " + ", ".join(s.r6(c) for c in ("x", "mean", "sd")) + " from quantiled where model_id = 'BUILDING_dyield_dSIDI_bym'"))
def files_model_results(spark, d):
    """Results saved by model, saved again, and one model read back."""
    out = folder(spark, "results")
    found = m.effects(spark, d)
    for _ in range(2):  # saved models are replaced
        results.save_results({"fit_effects": found}, out)
    return tidy(results.load_results(spark, out, "fit_effects", "BUILDING_dyield_dSIDI_bym").select("model_id", "term", "x", "mean", "sd"))


@query(
    m.fit_sql(
        "select distinct crop || '_' || family as model_id from (select distinct family from spec), (select distinct crop from prepared) "
        "where family like 'yield%'"
    )
)
def files_fitted_only(spark, d):
    """Of the models wanted, some of which were never fitted, those that have results."""
    fitted = fit.model_fit(m.scored(spark, d), ["model_id", "family"]).where("family like 'yield%'")
    wanted = m.model_keys(spark, d).select("model_id").unionByName(m.model_keys(spark, d).select(F.concat("model_id", F.lit("_absent")).alias("model_id")))
    return curves.fitted_only(wanted, fitted)


@query(
    s.statement(
        "select crop, GEOID, YEAR, STATE, SOIL_2 as third, YIELD_2 as fourth from "
        f"(select crop, GEOID, YEAR, STATE, {s.r6('SOIL', 'SOIL_2')}, {s.r6('YIELD', 'YIELD_2')} from panel)"
    )
)
def positional_columns(spark, d):
    """Columns of a table with a geometry column, chosen by position after it is dropped."""
    from fallow.operators import joins

    rows = a.input_panel(spark, d).select(*KEYS, F.array(F.lit(0.0)).alias("geometry"), "STATE", "SOIL", "YIELD")
    bare = p.select_panel(rows)
    picked = joins.select_at(bare, [0, 1, 2, 3, 4, 5])
    return tidy(picked.withColumnsRenamed({"SOIL": "third", "YIELD": "fourth"}))


CHECKED = "GEOID string, Yr int, avg_water double, range_water double"


@query(
    s.statement(
        "select 'row' as kind, GEOID, cast(Yr as varchar) as Yr, " + s.r6("avg_water") + ", null as reason from keyed where no > 3 "
        "union all select 'rejected', case when no = 3 then null else GEOID end, case when no = 1 then 'soon' else cast(Yr as varchar) end, "
        "null, case no when 0 then 'wrong number of fields' when 1 then 'Yr: not int' when 2 then 'avg_water: not double' else 'GEOID: missing' end "
        "from keyed where no <= 3",
        keyed="select split_part(Cnty_yr, '_', 1) as GEOID, cast(split_part(Cnty_yr, '_', 2) as integer) as Yr, avg_water, "
        "cast(split_part(Cnty_yr, '_', 1) as integer) % 9 as no from water",
    )
)
def files_damaged(spark, d):
    """Water files of which some lines are cut, hold words for numbers or lack the area, read into rows and rejects."""
    out = folder(spark, "damaged")
    no = F.col("GEOID").cast("int") % 9
    fields = [
        F.when(no == 3, "").otherwise(F.col("GEOID")), F.when(no == 1, "soon").otherwise(F.col("Yr").cast("string")),
        F.when(no == 2, "many").otherwise(F.col("avg_water").cast("string")), F.when(no != 0, F.col("range_water").cast("string")),
    ]
    lines = a.water(spark, d).select(F.concat_ws(",", *fields).alias("line"))  # a missing last field is left out
    lines.write.text(out)
    rows, rejected = tables.read_checked_csv(spark, out, CHECKED, required=["GEOID"], header=False)
    good = rows.select(F.lit("row").alias("kind"), "GEOID", F.col("Yr").cast("string").alias("Yr"), "avg_water", F.lit(None).cast("string").alias("reason"))
    bad = rejected.select(F.lit("rejected").alias("kind"), "GEOID", "Yr", F.lit(None).cast("double").alias("avg_water"), "reason")
    return tidy(good.unionByName(bad))
