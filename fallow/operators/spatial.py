"""Contiguity of polygons given as vertex rows, and its graph Laplacian."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fallow.operators.graph import connected_parts
from fallow.session import settle

CELL = 64  # width of a cell in units of the snap distance


def contiguity(
    vertices: DataFrame, entity: str, rook: bool = True, snap: float = 1e-7
) -> DataFrame:
    """Neighbour pairs (i, j), both directions, with the number of vertices they share.

    Queen neighbours share a vertex, rook neighbours more than one.  Two vertices are one place when they
    lie within ``snap`` of each other, on whichever side of a cell border: each vertex is sought in all cells
    that its surroundings touch, and the distance decides.  A cell is ``CELL`` times ``snap`` wide, so that
    few vertices lie near a border and are sought more than once.  Vertices are made distinct per area first, so
    repeated rings, parts or copies of an area do not multiply the work.  The group of a cell is the areas
    that meet there; each pair is built once and mirrored after it has been counted.
    """
    points = vertices.select(F.col(entity).alias("a"), "x", "y").distinct()
    cells = [F.floor(F.col(c) / (CELL * snap)).alias(f"g{c}") for c in ("x", "y")]
    other = points.select(F.col("a").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), *cells)
    reach = 1.5 * snap  # more than snap, so that rounding loses no cell
    low, high = ([F.floor((F.col(c) + r) / (CELL * snap)) for c in ("x", "y")] for r in (-reach, reach))
    sought = points.select("a", "x", "y", F.explode(F.sequence(low[0], high[0])).alias("gx"))
    sought = sought.select("a", "x", "y", "gx", F.explode(F.sequence(low[1], high[1])).alias("gy"))
    apart = F.hypot(F.col("x") - F.col("bx"), F.col("y") - F.col("by"))
    met = sought.join(other, ["gx", "gy"]).where((F.col("a") < F.col("b")) & (apart <= snap))
    shared = F.least(F.count_distinct("x", "y"), F.count_distinct("bx", "by"))
    pairs = met.groupBy("a", "b").agg(shared.alias("shared")).where(F.col("shared") >= (2 if rook else 1))
    both = F.explode(F.array(F.struct(F.col("a").alias("i"), F.col("b").alias("j")),
                             F.struct(F.col("b").alias("i"), F.col("a").alias("j"))))
    return pairs.select(both.alias("e"), "shared").select("e.i", "e.j", "shared")


def index_edges(edges: DataFrame, nodes: DataFrame, entity: str, index: str, by: Sequence[str]) -> DataFrame:
    """Edges between entity keys as edges between the index numbers of each group.

    ``nodes`` (by, entity, index) names the areas of each group; pairs of which
    one end is not in the group are left out.  Weight 1 for every pair.
    """
    left = nodes.select(*by, F.col(entity).alias("i"), F.col(index).alias("__i"))
    right = nodes.select(*by, F.col(entity).alias("j"), F.col(index).alias("__j"))
    return (
        edges.join(left, "i")
        .join(right, [*by, "j"])
        .select(*by, F.col("__i").alias("i"), F.col("__j").alias("j"), F.lit(1.0).alias("w"))
    )


def graph_laplacian(edges: DataFrame, nodes: DataFrame, index: str, by: Sequence[str]) -> DataFrame:
    """Degree on the diagonal, minus the weight elsewhere, as (by, i, j, q) rows.

    Isolated areas keep a diagonal entry of zero.
    """
    degree = edges.groupBy(*by, "i").agg(F.sum("w").alias("q"))
    diagonal = (
        nodes.select(*by, F.col(index).alias("i"))
        .join(degree, [*by, "i"], "left")
        .select(*by, "i", F.col("i").alias("j"), F.coalesce("q", F.lit(0.0)).alias("q"))
    )
    return diagonal.unionByName(edges.select(*by, "i", "j", (-F.col("w")).alias("q")))


def components(nodes: DataFrame, edges: DataFrame, index: str, by: Sequence[str]) -> DataFrame:
    """(by, index, part, size, isolated): the connected part of each area, named after its smallest area.

    Areas without neighbours are parts of their own; see ``connected_parts``.
    """
    by = list(by)
    keys = [*by, index]
    found = connected_parts(edges, by).withColumnsRenamed({"id": index, "root": "part"})
    labels = nodes.select(*keys).distinct().join(found, keys, "left")
    labels = settle(labels.select(*keys, F.coalesce("part", index).alias("part"), F.col("part").isNull().alias("isolated")))
    sizes = labels.groupBy(*by, "part").agg(F.count(F.lit(1)).alias("size"))
    return labels.join(sizes, [*by, "part"]).select(*keys, "part", "size", "isolated")
