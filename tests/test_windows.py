import math

import pytest
from pyspark.sql import functions as F

from fallow.functions.scalars import log_keep_inf, scrub_nonfinite
from fallow.operators.windows import PanelWindow


def add_all(df, chunk=None):
    w = PanelWindow(["e"], "t", chunk)
    return w.with_columns(
        df,
        {
            "d": w.change("x"),
            "l": w.lag("x"),
            "m2": w.rolling_mean("x", 2),
            "m3": w.rolling_mean("x", 3),
            "cv": w.rolling_cv("x"),
        },
    )


def rows(df):
    return [tuple(r)[3:] for r in df.orderBy("e", "t").collect()]


def panel(spark, data):
    return spark.createDataFrame(data, "e int, t int, x double")


GAP = [(1, 0, 1.0), (1, 1, 2.0), (1, 2, None), (1, 4, 7.0), (2, 0, 5.0)]


def test_year_gap_and_null(spark):
    got = [r[:4] for r in rows(add_all(panel(spark, GAP)))]
    assert got == [
        (1, None, 1.5, None),
        (None, 1, 2, 1.5),
        (None, 2, 7, 4.5),
        (None, None, None, None),
        (None, None, None, None),
    ]


def test_cv(spark):
    data = [(1, 0, 1.0), (1, 1, 2.0), (1, 2, 3.0), (2, 0, 0.0), (2, 1, 0.0), (2, 2, 0.0)]
    assert [r[4] for r in rows(add_all(panel(spark, data)))] == [None, 0.5, None, None, None, None]


def test_log_zero_is_not_skipped(spark):
    data = [(1, 0, 0.0), (1, 1, math.e), (1, 2, math.e**2)]
    df = panel(spark, data).withColumn("x", log_keep_inf("x"))
    got = scrub_nonfinite(add_all(df)).orderBy("t").collect()
    assert [r.x for r in got] == [None, 1, 2]
    assert [r.d for r in got] == [None, 1, None]
    assert [r.m2 for r in got] == [None, 1.5, None]
    assert [r.m3 for r in got] == [None, None, None]
    assert [r.cv for r in got] == [None, None, None]


@pytest.mark.parametrize("width", [1, 2, 5, 1000])
def test_chunks_do_not_change_results(spark, width):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id") % 7 + 2).cast("int").alias("e"),
        (F.col("id") * F.col("id") % 100003).cast("int").alias("t"),
        F.when(F.col("id") % 11 > 0, F.sin("id")).alias("x"),
    ).groupBy("e", "t").agg(F.min("x").alias("x"))
    plain, chunked = rows(add_all(df)), rows(add_all(df, F.floor(F.col("t") / width)))
    assert len(plain) == len(chunked)
    for a, b in zip(plain, chunked):
        assert a == pytest.approx(b, nan_ok=True) or a == b


def test_alignment_and_wide_frames(spark):
    df = panel(spark, [(1, t, float(t)) for t in range(6)])
    w = PanelWindow(["e"], "t")
    out = w.with_columns(
        df,
        {"a": w.roll("x", F.sum, 4), "b": w.roll("x", F.sum, 3, "right"), "c": w.roll("x", F.max, 2, "left")},
    ).orderBy("t").collect()
    assert [r.a for r in out] == [None, 6, 10, 14, None, None]
    assert [r.b for r in out] == [None, None, 3, 6, 9, 12]
    assert [r.c for r in out] == [1, 2, 3, 4, 5, None]


def test_one_exchange(spark):
    plan = add_all(spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr(
        "cast(user_id as int) e", "cast(event_id as int) t", "value x"
    ))._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan =="):]
    assert physical.count("Exchange") == 1 and physical.count("+- Window") <= 1
    # The row count and the mean of the three-row frame are evaluated once.
    assert physical.count("count(1) windowspec") == 2 and physical.count("avg(x") == 2


def test_any_function_over_frames(spark):
    """Batches much smaller than a series, null keys and values, each alignment, plain and in blocks."""
    import math

    import numpy as np

    from fallow.functions import frames
    from fallow.operators import windows

    rng = np.random.default_rng(3)
    rows = [(k, t, None if rng.random() < 0.1 else float(rng.normal())) for k, n in (("a", 57), (None, 23), ("b", 2), ("c", 1), ("d", 9)) for t in range(n)]
    df = spark.createDataFrame(rows, "g string, t long, x double")
    kinds = {
        "mad": windows.Rolling("x", frames.median_absolute_deviation, 5),
        "trim": windows.Rolling("x", frames.trimmed_mean(0.25), 4, "right"),
        "auto": windows.Rolling("x", frames.autocorrelation(1), 6, "left"),
    }
    want = {}
    for g in {r[0] for r in rows}:
        x = np.array([math.nan if r[2] is None else r[2] for r in rows if r[0] == g])
        for t in range(len(x)):
            values = []
            for k in kinds.values():
                back, ahead = k.ends
                inside = t - back >= 0 and t + ahead < len(x)
                v = k.function(x[None, t - back : t + ahead + 1])[0] if inside else math.nan
                values.append(None if math.isnan(v) else v)
            want[g, t] = values
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        for chunk in (None, F.floor(F.col("t") / 10)):
            out = windows.PanelWindow(["g"], "t", chunk=chunk).with_rolling(df, kinds)
            assert out.columns == ["g", "t", "x", "mad", "trim", "auto"]
            got = {(r.g, r.t): [r.mad, r.trim, r.auto] for r in out.collect()}
            assert set(got) == set(want)
            for k, values in want.items():
                assert got[k] == [None if v is None else pytest.approx(v) for v in values], k
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert windows.PanelWindow(["g"], "t").with_rolling(df.limit(0), kinds).collect() == []
