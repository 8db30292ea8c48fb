"""Plans and skew: a third of all rows under one key, and the shape of the plans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fallow import session
from fallow.catalog import analog, basics
from fallow.operators.binning import QuantileBins
from fallow.operators.windows import PanelWindow


def physical(df):
    plan = df._jdf.queryExecution().toString()
    return plan[plan.index("== Physical Plan =="):]


def skewed(spark, n=60_000):
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 50).cast("string"))).alias("g"),
        F.col("id").alias("t"),
        F.when(F.col("id") % 2 == 0, F.lit(1.0)).otherwise(F.sin("id")).alias("x"),
    )


def test_hot_group_bins_are_exact(spark):
    df = skewed(spark)
    got = QuantileBins(df, ["g"], ["x"], 20).apply(df, value="{}_v").where("g = 'hot'").toPandas()
    x = np.sort(got.x)
    probs = [0.0, *[(i - 0.5) / 19 for i in range(1, 20)], 1.0]
    cuts = np.unique(np.quantile(x, probs))
    k = np.maximum(np.searchsorted(cuts, got.x, side="left"), 1)
    for b in np.unique(k):
        assert got.x_v[k == b].unique() == pytest.approx([np.median(got.x[k == b])])


def test_hot_entity_window_is_spread(spark):
    df = skewed(spark)
    w = PanelWindow(["g"], "t", chunk=F.floor(F.col("t") / 2000))
    out = w.with_columns(df, {"d": w.change("x"), "m": w.rolling_mean("x", 3)})
    plain = PanelWindow(["g"], "t")
    want = plain.with_columns(df, {"d": plain.change("x"), "m": plain.rolling_mean("x", 3)})
    assert out.exceptAll(want).count() == 0 and out.count() == 60_000
    # No window task groups by the entity alone, but for the border rows.
    assert "__chunk" in physical(out)


def test_chunked_frames_reach_any_number_of_rows(spark, monkeypatch):
    from fallow.operators import windows

    monkeypatch.setattr(windows, "BLOCK", 7)
    df = skewed(spark, 900).unionByName(spark.range(5).select(F.lit(None).cast("string").alias("g"), F.col("id").alias("t"), F.lit(2.0).alias("x")))
    w = PanelWindow(["g"], "t", chunk=F.floor(F.col("t") / 10))
    out = w.with_columns(df, {"m": w.rolling_mean("x", 9), "r": w.roll("x", F.max, 5, "right"), "d": w.change("x"), "l": w.lag("x")})
    plain = PanelWindow(["g"], "t")
    want = plain.with_columns(df, {"m": plain.rolling_mean("x", 9), "r": plain.roll("x", F.max, 5, "right"), "d": plain.change("x"), "l": plain.lag("x")})
    rounded = lambda d: d.withColumn("m", F.round("m", 9))
    assert rounded(out).exceptAll(rounded(want)).count() == 0 and out.count() == 905


def test_vertices_meet_across_cell_borders(spark):
    """Two squares whose shared corners are 2e-9 apart, on two sides of a cell border."""
    from fallow.operators import spatial

    edge = 0.5e-7
    rows = [("a", 0.0, 0.0), ("a", edge - 1e-9, 0.0), ("a", edge - 1e-9, 1.0), ("a", 0.0, 1.0),
            ("b", edge + 1e-9, 0.0), ("b", 2.3, 0.0), ("b", 2.3, 1.0), ("b", edge + 1e-9, 1.0), ("c", 2.3 + 3e-7, 0.0), ("c", 2.3 + 3e-7, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = spatial.contiguity(df, "g").collect()
    assert {(r.i, r.j, r.shared) for r in got} == {("a", "b", 2), ("b", "a", 2)}


def test_panel_windows_are_one_stage(spark, sf_dir):
    analog.input_panel(spark, sf_dir), analog.water(spark, sf_dir)
    plan = physical(basics.built(spark, sf_dir))
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("+- Window") == 1
    assert "Python" not in plan and "CartesianProduct" not in plan


def test_only_needed_columns_are_read(spark, sf_dir):
    plan = physical(basics.CATALOG["lag_one"].run(spark, sf_dir))
    assert "PERC_IRR" not in plan
    state = physical(basics.CATALOG["panel_filter_project"].run(spark, sf_dir))
    assert "EqualTo(STATE,ASIA)" in state


def test_shared_folder_is_read_from_the_session(spark):
    assert session.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    stored = session.settle(spark.range(5))
    assert stored.count() == 5 and "FileScan parquet" in physical(stored)


def test_parts_of_a_graph(spark):
    """A long path, a hot star, a cycle, lone areas, and the same numbers in another group."""
    from fallow.operators import spatial

    path = [("p", i, i + 1) for i in range(1, 300)]
    star = [("s", 500, i) for i in range(501, 2000)]
    cycle = [("s", 1, 2), ("s", 2, 3), ("s", 3, 1), ("p", 1, 1)]
    pairs = [*path, *star, *cycle]
    edges = spark.createDataFrame(pairs + [(g, b, a) for g, a, b in pairs], "g string, i int, j int")
    listed = [("p", i) for i in range(1, 303)] + [("s", i) for i in [1, 2, 3, 4, *range(500, 2000)]]
    nodes = spark.createDataFrame(listed, "g string, k int")
    got = {(r.g, r.k): (r.part, r["size"], r.isolated) for r in spatial.components(nodes, edges, "k", ["g"]).collect()}
    assert len(got) == len(listed)
    assert all(got["p", i] == (1, 300, False) for i in range(1, 301)) and got["p", 302] == (302, 1, True)
    assert all(got["s", i] == (500, 1500, False) for i in range(500, 2000))
    assert got["s", 3] == (1, 3, False) and got["s", 4] == (4, 1, True)
    none = spatial.components(nodes, edges.limit(0), "k", ["g"])
    assert none.where("isolated and size = 1 and part = k").count() == len(listed)


def test_sketches_merge(spark):
    from fallow.operators import sketches

    df = spark.range(40_000).select(
        (F.col("id") % 7).alias("g"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5).alias("day"),
        (F.col("id") % 9000).cast("double").alias("x"), F.when(F.col("id") % 2 == 0, F.col("id") % 10).alias("few"),
    )
    stored = session.settle(sketches.sketch_table(df, ["g", "day"], ["x", "few"]))
    assert stored.count() == 7 * 5 * 2
    found = {r["column"]: r for r in sketches.merged(stored, ["column"]).select(
        "column", "n", sketches.distinct_estimate().alias("k"), *[sketches.quantile_estimate(q).alias(f"q{i}") for i, q in enumerate((0.1, 0.5, 0.9))]
    ).collect()}
    assert (found["x"].n, found["few"].n) == (40_000, 20_000)
    assert found["few"].k == 5 and abs(found["x"].k - 9000) <= sketches.DISTINCT_ERROR * 9000
    x = np.sort(df.toPandas().x)
    for i, q in enumerate((0.1, 0.5, 0.9)):
        assert abs(np.searchsorted(x, found["x"][f"q{i}"]) - q * len(x)) <= sketches.RANK_ERROR * len(x) + 10
