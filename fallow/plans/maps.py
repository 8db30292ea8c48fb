"""Area effects on the map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fallow.operators.joins import left_join_keys


def outlines(vertices: DataFrame) -> DataFrame:
    """One row per area with its outline as an array of (part, ring, seq, x, y).

    An outline is one value, bounded by the area's own vertices; copies of
    vertex rows are dropped first.
    """
    vertices = vertices.select("GEOID", "STATEFP", "part", "ring", "seq", "x", "y").distinct()
    points = F.array_sort(F.collect_list(F.struct("part", "ring", "seq", "x", "y")))
    return vertices.groupBy("GEOID", "STATEFP").agg(points.alias("geometry"))


def area_effect_map(
    vertices: DataFrame,
    panel: DataFrame,
    effects: DataFrame,
    crop: str,
    model_id: str,
    state: int | None = None,
) -> DataFrame:
    """(CNTY, GEOID, Mean, Standard_Deviation, geometry), one row per area of the map.

    The panel is reduced to one row per area before it is joined, so the map
    has no row per year.  Areas without data, or without an effect of their own
    (the reference level of a free area term), keep their outline with a
    missing effect.
    """
    shapes = outlines(vertices)
    if state is not None:
        shapes = shapes.where(F.col("STATEFP") == state)
    areas = panel.where(F.col("crop") == crop).select("GEOID", "CNTY").distinct()
    own = effects.where((F.col("model_id") == model_id) & (F.col("term") == "CNTY")).select(
        F.col("level").alias("ID"), F.col("mean").alias("Mean"), F.col("sd").alias("Standard_Deviation")
    )
    placed = shapes.drop("STATEFP").join(areas, "GEOID", "left")
    return left_join_keys(placed, own, {"CNTY": "ID"}).select(
        "CNTY", "GEOID", "Mean", "Standard_Deviation", "geometry"
    )


def area_effect_maps(vertices: DataFrame, panel: DataFrame, effects: DataFrame, models: dict[str, str]) -> DataFrame:
    """Maps of several models and all crops at once: (crop, type, CNTY, GEOID, Mean, Standard_Deviation, geometry).

    ``models`` maps each wanted family to the type it is shown as.  Every area stands on every map.
    """
    crops = panel.select("crop", "GEOID", "CNTY").distinct()
    kinds = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(t).alias("type")) for f, t in models.items()])
    wanted = F.explode(F.flatten(F.transform("crops", lambda c: F.transform(kinds, lambda k: F.struct(c.alias("crop"), k["family"].alias("family"), k["type"].alias("type"))))))
    listed = crops.select("crop").distinct().groupBy().agg(F.sort_array(F.collect_set("crop")).alias("crops")).first()["crops"]  # one value per crop
    shapes = outlines(vertices).drop("STATEFP").withColumn("crops", F.array(*[F.lit(c) for c in listed]))
    placed = shapes.select("GEOID", "geometry", wanted.alias("m")).select("GEOID", "geometry", "m.*").join(crops, ["crop", "GEOID"], "left")
    own = effects.where(F.col("family").isin(*models) & (F.col("term") == "CNTY")).select(
        "crop", "family", F.col("level").alias("ID"), F.col("mean").alias("Mean"), F.col("sd").alias("Standard_Deviation")
    )
    own = own.withColumnsRenamed({"crop": "own_crop", "family": "own_family"})
    same = (F.col("crop") == F.col("own_crop")) & (F.col("family") == F.col("own_family")) & (F.col("CNTY") == F.col("ID"))
    return placed.join(own, same, "left").select("crop", "type", "CNTY", "GEOID", "Mean", "Standard_Deviation", "geometry")
