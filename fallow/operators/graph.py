"""Connected parts of a graph by contraction, as Spark joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fallow.session import in_few_tasks, settle

BY_ID = 2  # first rounds, in the order of the ids


def connected_parts(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, id, root) of every id in ``edges`` (by, i, j); the root is the smallest id that can be reached.

    In each round an id points to the one of itself and its neighbours that comes first in an order,
    and edges are carried over to what their ends point to.  In the first ``BY_ID`` rounds that is the order of
    the ids, which brings together at once what is linked with its smallest id, as copies are.  Then it is
    drawn anew for each round: whatever the graph, a path in order of its ids included, such a round is
    expected to leave at most two thirds of the ids, so the rounds grow with the logarithm of the table.
    Neighbours are reduced by partial aggregation, so an id with very many edges is no larger a task than any
    other, and no part is ever gathered.  Pointers of the rounds shrink with the graph and are composed from
    the last to the first; rounds on few edges run in few tasks.
    """
    by = list(by)
    ends = [F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")]
    links = settle(edges.select(*by, *ends).where("i < j"))
    steps: list[DataFrame] = []
    sizes: list[int] = []  # ids of a step at most
    while edges_left := links.count():
        order = lambda c: F.xxhash64(F.col(c), F.lit(len(steps))) if len(steps) >= BY_ID else F.lit(0).cast("long")  # noqa: E731, B023
        drawn = lambda c: F.struct(order(c).alias("h"), F.col(c).alias("to"))  # noqa: E731, B023
        sizes.append(2 * edges_left)
        both = links.unionByName(links.select(*by, F.col("j").alias("i"), F.col("i").alias("j")))
        first = both.groupBy(*by, "i").agg(F.min(drawn("j")).alias("m"))
        step = settle(in_few_tasks(first.select(*by, "i", F.least(drawn("i"), F.col("m"))["to"].alias("to")), sizes[-1]))
        steps.append(step)
        left, right = step.withColumnRenamed("to", "to_i"), step.withColumnsRenamed({"i": "j", "to": "to_j"})
        moved = links.join(left, [*by, "i"]).join(right, [*by, "j"]).where("to_i <> to_j")
        links = moved.select(*by, F.least("to_i", "to_j").alias("i"), F.greatest("to_i", "to_j").alias("j")).distinct()
        links = settle(in_few_tasks(links, edges_left))
    if not steps:
        return links.select(*by, F.col("i").alias("id"), F.col("j").alias("root"))
    found = steps[-1].withColumnsRenamed({"i": "id", "to": "root"})
    for step, rows in zip(reversed(steps[:-1]), reversed(sizes[:-1]), strict=True):
        onward = found.withColumnRenamed("id", "to")
        found = step.join(onward, [*by, "to"], "left").select(*by, F.col("i").alias("id"), F.coalesce("root", "to").alias("root"))
        found = settle(in_few_tasks(found, rows))
    names = in_few_tasks(found.groupBy(*by, "root").agg(F.min("id").alias("name")), sizes[0])
    return found.join(names, [*by, "root"]).select(*by, "id", F.col("name").alias("root"))
