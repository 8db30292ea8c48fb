import numpy as np
import pytest
from pyspark.sql import functions as F

from fallow.operators import quantiles
from fallow.operators.binning import QuantileBins, bin_probs, standardise
from fallow.operators.indexing import dense_index


def r_bins(x, n):
    """Direct statement of the binning rule on one array."""
    x = np.asarray(x, dtype=float)
    ok = ~np.isnan(x)
    s = np.sort(x[ok])
    cuts = []
    for a, b in bin_probs(n):
        lo, rest = divmod(a * (len(s) - 1), b)
        hi = min(lo + 1, len(s) - 1)
        cuts.append(s[lo] + (s[hi] - s[lo]) * (rest / b))
    cuts = np.unique(cuts)
    out = np.full(len(x), np.nan)
    if len(cuts) == 1:
        out[ok] = x[ok]
        return out
    k = np.maximum(np.searchsorted(cuts, x[ok], side="left"), 1)
    med = {b: np.median(x[ok][k == b]) for b in np.unique(k)}
    out[ok] = [med[b] for b in k]
    return out


def series(spark, groups):
    rows = [(g, i, None if v is None else float(v)) for g, xs in groups.items() for i, v in enumerate(xs)]
    return spark.createDataFrame(rows, "g string, i int, x double")


def binned(df, n, column="x"):
    bins = QuantileBins(df, ["g"], [column], n)
    out = bins.apply(df, value="{}_bin", scaled="{}_z", number="{}_no")
    return {(r.g, r.i): r for r in out.collect()}


def test_literal_bins(spark):
    got = binned(series(spark, {"a": [*range(1, 11), None]}), 3)
    assert [got["a", i].x_bin for i in range(11)] == [2, 2, 2, 5.5, 5.5, 5.5, 5.5, 9, 9, 9, None]
    z = [got["a", i].x_z for i in range(10)]
    assert z == pytest.approx([-1.224745] * 3 + [0] * 4 + [1.224745] * 3, abs=1e-6)


def test_ties_and_constant(spark):
    got = binned(series(spark, {"t": [1, 1, 1, 1, 5], "c": [4, 4, 4], "one": [7], "none": [None]}), 20)
    assert [got["t", i].x_bin for i in range(5)] == list(r_bins([1, 1, 1, 1, 5], 20))
    assert [got["c", i].x_bin for i in range(3)] == [4, 4, 4]
    assert got["c", 0].x_z is None
    assert got["one", 0].x_bin == 7
    assert got["none", 0].x_bin is None


@pytest.mark.parametrize("accuracy", [10_000, 20])
def test_bins_match_direct_rule(spark, monkeypatch, accuracy):
    # A poor sketch gives wide slots, and still the exact result.
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    rng = np.random.default_rng(3)
    groups = {
        "normal": rng.normal(size=3001),
        "skewed": np.exp(3 * rng.normal(size=1000)),
        "ties": rng.integers(0, 6, size=997),
        "spike": np.where(rng.random(2000) < 0.6, 0.0, rng.normal(size=2000)),
    }
    got = binned(series(spark, groups), 20)
    for g, xs in groups.items():
        want = r_bins(xs, 20)
        have = np.array([got[g, i].x_bin for i in range(len(xs))])
        assert np.allclose(have, want, rtol=0, atol=1e-12), g
        z = np.array([got[g, i].x_z for i in range(len(xs))])
        assert np.allclose(z, (want - want.mean()) / want.std(ddof=1)), g


def test_exact_quantiles(spark):
    rng = np.random.default_rng(5)
    xs = rng.normal(size=1234)
    df = series(spark, {"a": xs})
    probs = [(0, 1), (1, 3), (1, 2), (9, 10), (1, 1)]
    got = {r.k: r for r in quantiles.exact_quantiles(df, ["g"], "x", probs).collect()}
    for k, (a, b) in enumerate(probs):
        assert got[k].q == pytest.approx(np.quantile(xs, a / b), abs=1e-12)
        assert got[k].upto == (xs <= got[k].q).sum()


def test_standardise(spark):
    df = series(spark, {"a": [1, 2, 3, None], "b": [5, 5, 5]})
    got = {(r.g, r.i): r.x for r in standardise(df, ["g"], ["x"]).collect()}
    assert [got["a", i] for i in range(4)] == [-1, 0, 1, None]
    assert got["b", 0] is None


def test_dense_index(spark):
    df = spark.range(2000).select(
        F.concat(F.lit("k"), (F.col("id") * 7 % 1500).cast("string")).alias("key"),
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("g"),
    )
    got = dense_index(df, "key", "n", ["g"], splits=16).collect()
    for g in "ab":
        keys = sorted({r.key for r in df.where(F.col("g") == g).collect()})
        assert sorted((r.n, r.key) for r in got if r.g == g) == list(enumerate(keys, 1))
    assert dense_index(df, "key", "n").count() == 1500


def test_slots_are_cut_until_they_are_small(spark, monkeypatch):
    """5 % equal values in mid-range, a hot group, and a poor first sketch: exact, and no window over the bound."""
    monkeypatch.setattr(quantiles, "ACCURACY", 5)
    monkeypatch.setattr(quantiles, "SLOT_VALUES", 40)
    monkeypatch.setattr(quantiles, "PARTS", 4)
    seen = []
    refined = quantiles.OrderStatistics._refined

    def watched(self, per_value, wanted):
        out, places = refined(self, per_value, wanted)
        seen.append(out.groupBy(*self.keys, "slot").count().agg(F.max("count")).first()[0])
        assert out.groupBy(*self.keys, "slot", "x").count().where("count > 1").isEmpty()
        return out, places

    monkeypatch.setattr(quantiles.OrderStatistics, "_refined", watched)
    df = spark.range(12_000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("g"),
        F.when(F.col("id") % 20 == 0, F.lit(0.25)).otherwise(F.sin(F.col("id") * 1.7)).alias("x"),
    )
    probs = [(0, 1), (1, 38), (19, 38), (1, 2), (23, 40), (37, 38), (1, 1)]
    got = {(r.g, r.k): (r.q, r.upto) for r in quantiles.exact_quantiles(df, ["g"], "x", probs).collect()}
    rows = df.toPandas()
    for g, part in rows.groupby("g"):
        x = np.sort(part.x.to_numpy())
        for k, (a, b) in enumerate(probs):
            lo, rest = divmod(a * (len(x) - 1), b)
            q = x[lo] + (x[min(lo + 1, len(x) - 1)] - x[lo]) * (rest / b)
            assert got[g, k] == (pytest.approx(q), (x <= x[lo]).sum())
    assert seen and max(seen) <= 40
    binned_rows = QuantileBins(df, ["g"], ["x"], 20).apply(df, value="{}_v").toPandas()
    hot = binned_rows[binned_rows.g == "hot"]
    assert hot.x_v.to_numpy() == pytest.approx(r_bins(hot.x.to_numpy(), 20))
