import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fallow.functions import scalars as s
from fallow.operators import joins
from fallow.operators.diversity import diversity_indices
from fallow.operators.reshape import years_to_rows
from fallow.operators.spatial import CELL, contiguity, graph_laplacian, index_edges


def column(df, expr):
    return [r[0] for r in df.select(expr).collect()]


def doubles(spark, xs):
    return spark.createDataFrame([(x,) for x in xs], "x double").coalesce(1)


def test_log_and_scrub(spark):
    df = doubles(spark, [0.0, 1.0, -1.0, None])
    assert column(df, s.log_keep_inf("x")) == [-math.inf, 0, None, None]
    df = doubles(spark, [math.inf, -math.inf, math.nan, 2.0, None])
    assert [r.x for r in s.scrub_nonfinite(df).collect()] == [None, None, None, 2, None]


def test_numbers_ratio_keys(spark):
    df = spark.createDataFrame([("12.5",), ("abc",), (None,)], "x string").coalesce(1)
    assert column(df, s.to_number("x")) == [12.5, None, None]
    df = spark.createDataFrame([(6.0, 3.0), (6.0, 0.0), (None, 3.0)], "a double, b double").coalesce(1)
    assert column(df, s.ratio("a", "b")) == [2, None, None]
    df = spark.createDataFrame([(20001.0, 0), (None, 0), (2.5, 1)], "g double, yr int").coalesce(1)
    assert column(df, s.entity_year_key("g", "yr", True)) == ["20001_0", "NA_0", "2.5_1"]


def test_normal_cdf(spark):
    xs = [x / 7 for x in range(-300, 301)]
    got = column(doubles(spark, xs), s.normal_cdf("x"))
    want = [0.5 * math.erfc(-x / math.sqrt(2)) for x in xs]
    assert got == pytest.approx(want, abs=1e-14)


def test_replace_in_order_and_relabel(spark):
    df = spark.createDataFrame([("dyield",), ("yield",), ("covyield",)], "x string").coalesce(1)
    pairs = {"yield": "YIELD", "dyield": "dYield", "covyield": "covYield"}
    assert column(df, s.replace_in_order("x", pairs)) == ["dYIELD", "YIELD", "covYIELD"]
    assert column(df, s.relabel("x", {"yield": "Yield"})) == ["dyield", "Yield", "covyield"]


def test_natural_join_matches_missing_keys(spark):
    left = spark.createDataFrame([("a_0", 1), ("NA_0", 2), (None, 3), ("z", 4)], "k string, a int")
    right = spark.createDataFrame([("a_0", 10), ("NA_0", 20), (None, 30)], "k string, v int")
    got = {(r.a, r.v) for r in joins.natural_left_join(left, right).collect()}
    assert got == {(1, 10), (2, 20), (3, 30), (4, None)}
    with pytest.raises(ValueError):
        joins.natural_left_join(left, right.select(F.col("v").alias("w")))


def test_other_joins(spark):
    left = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    right = spark.createDataFrame([(1, "p")], "k int, v string")
    out = joins.suffixed_left_join(left, right, ["k"])
    assert out.columns == ["k", "v_x", "v_y"]
    assert {tuple(r) for r in out.collect()} == {(1, "x", "p"), (2, "y", None)}
    named = right.withColumnsRenamed({"k": "ID", "v": "m"})
    out = joins.left_join_keys(left, named, {"k": "ID"})
    assert {tuple(r) for r in out.collect()} == {(1, "x", "p"), (2, "y", None)}
    assert joins.keep_members(left, right, ["k"]).count() == 1
    assert joins.select_at(left, [1]).columns == ["v"]


def test_unpivot_keeps_missing(spark):
    wide = spark.createDataFrame([(1, 2.0, None)], "X int, X2008 double, X2009 double")
    out = years_to_rows(wide, "fert", ["X2008", "X2009"], 2008).orderBy("Yr").collect()
    assert [(r.GEOID, r.Yr, r.fert, r.Cnty_yr) for r in out] == [("1", 0, 2.0, "1_0"), ("1", 1, None, "1_1")]


def test_diversity(spark):
    data = [("a", "w", 2.0), ("a", "c", 0.5), ("a", "c", 0.5), ("a", "s", 1.0), ("a", "none", 0.0), ("b", "w", 3.0)]
    df = spark.createDataFrame(data, "e string, cls string, amount double")
    got = {r.e: r for r in diversity_indices(df, ["e"], "cls", "amount").collect()}
    assert got["a"].simpson == pytest.approx(0.625)
    assert got["a"].shannon == pytest.approx(1.0397207708)
    assert got["a"].richness == 3
    assert (got["b"].simpson, got["b"].shannon, got["b"].richness) == pytest.approx((0, 0, 1))


def square(key, x, y):
    return [(key, float(x + a), float(y + b)) for a, b in [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]]


def test_contiguity(spark):
    grid = [v for i in range(25) for v in square(f"{i:02d}", i % 5, i // 5)]
    df = spark.createDataFrame(grid + square("far", 90, 90), "g string, x double, y double")
    assert contiguity(df, "g").count() == 80
    assert contiguity(df, "g", rook=False).count() == 144
    corner = spark.createDataFrame(square("p", 0, 0) + square("q", 1, 1), "g string, x double, y double")
    assert contiguity(corner, "g").count() == 0
    assert contiguity(corner, "g", rook=False).count() == 2
    nodes = df.select(F.lit("k").alias("crop"), "g").distinct().withColumn("n", F.xxhash64("g"))
    edges = index_edges(contiguity(df, "g"), nodes, "g", "n", ["crop"])
    lap = graph_laplacian(edges, nodes, "n", ["crop"])
    assert lap.count() == 80 + 26
    sums = lap.groupBy("i").agg(F.sum("q").alias("s")).where("s <> 0").count()
    assert sums == 0 and lap.where("i = j and q = 0").count() == 1


def test_vertices_meet_across_cell_borders(spark):
    rng, snap = np.random.default_rng(4), 0.5
    width = CELL * snap
    # around corners of cells, closer to one another than snap or a little farther
    rows = [(f"{a}", *(width * rng.integers(-2, 3, 2) + rng.choice([-0.6, -0.5, -0.1, 0.0, 0.25, 0.5, 0.7], 2)).tolist()) for a in range(6) for _ in range(25)]
    want = {}
    points = sorted(set(rows))
    for a, x, y in points:
        for b, u, v in points:
            if a < b and np.hypot(x - u, y - v) <= snap:
                left, right = want.setdefault((a, b), (set(), set()))
                left.add((x, y)), right.add((u, v))
    got = {(r.i, r.j): r.shared for r in contiguity(spark.createDataFrame(rows, "g string, x double, y double"), "g", rook=False, snap=snap).collect()}
    want = {pair: min(len(left), len(right)) for pair, (left, right) in want.items()}
    assert want and got == want | {(b, a): n for (a, b), n in want.items()}


def test_bind_columns_by_key(spark):
    rows = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 3.0), ("b", 1, None)], "g string, t int, y double")
    fitted = spark.createDataFrame([("a", 2, 2.5), ("b", 1, 0.5)], "g string, t int, fitted double")
    got = {(r.g, r.t): (r.y, r.fitted) for r in joins.bind_columns(rows, fitted, ["g", "t"]).collect()}
    assert got == {("a", 1): (2.0, None), ("a", 2): (3.0, 2.5), ("b", 1): (None, 0.5)}
    assert joins.drop_missing(rows, "y").count() == 2
