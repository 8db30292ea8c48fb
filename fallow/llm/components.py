"""Connected components of links between documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fallow.operators.graph import connected_parts


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root) of every id in `edges`; the root is the smallest id that can be reached."""
    return connected_parts(edges.select(F.col(a).alias("i"), F.col(b).alias("j")))
