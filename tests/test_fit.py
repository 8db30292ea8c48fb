import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fallow.catalog import models as m
from fallow.operators.binning import QuantileBins
from fallow.plans import design, diagnostics, fit, spec


def test_specs():
    specs = spec.report_families()
    assert len(specs) == 10 and len({s.family for s in specs}) == 10
    assert all(len(s.smooths) == 7 for s in specs)
    two = spec.change_model("two", ["dSIDI", "dRICH"], spec.CHANGE_CONTROLS, "factor")
    assert len(two.smooths) == 8 and two.response == "dYield"
    many = [f"cov{x}" for x in ("Vol", "TP", "GDD", "SDD", "fert", "herb")] + ["TP", "GDD", "SDD", "SOIL", "fert", "herb"]
    assert len(spec.stability_model("four", ["covSIDI", "covRICH"], many).terms) == 16
    mixed = spec.change_model("k", "dSIDI", spec.CHANGE_CONTROLS, "bym", {"dTP": "default", "area": "default"})
    assert [t.prior for t in mixed.terms[:3]] == ["pc", "default", "pc"] and mixed.area_prior == "default"
    with pytest.raises(ValueError):
        spec.change_model("bad", "dSIDI", ["All"], "bym2")
    with pytest.raises(ValueError):
        spec.yield_model("bad", area="none")


def test_leave_one_out_literal(spark):
    df = spark.createDataFrame([(1.0, 0.0, 0.5, 1.0), (None, 0.0, 0.5, 1.0), (1.0, 0.0, 1.0, 1.0)],
                               "y double, mean double, var double, tau double")
    got = fit.leave_one_out(df).collect()
    assert (got[0].cpo, got[0].pit) == pytest.approx((0.103777, 0.921350), abs=1e-6)
    assert got[0].p_value == pytest.approx(0.921350, abs=1e-6)
    assert (got[1].cpo, got[1].pit, got[1].p_value) == (None, None, None)
    assert got[0].log_cpo == pytest.approx(math.log(got[0].cpo))
    assert got[2].cpo is None and got[2].p_value is not None
    far = fit.leave_one_out(spark.createDataFrame([(100.0, 0.0, 0.5, 1.0)], df.schema)).first()
    assert far.cpo == 0 and far.log_cpo == pytest.approx(-(200.0**2) / 4 / 1 - math.log(math.sqrt(2 * math.pi * 2)))


def test_diagnostics_literal(spark):
    df = spark.createDataFrame(
        [("m", 1.0, 1.5), ("m", 2.0, 1.5), ("m", None, 9.0)], "model_id string, y double, mean double"
    ).withColumns({"log_cpo": F.ln(F.lit(0.5)), "p_value": F.lit(0.25)})
    got = diagnostics.diagnostics(df).first()
    assert (got.n_rows, got.n) == (3, 2)
    assert (got.mse, got.mse_obs, got.r2) == pytest.approx((1 / 6, 0.25, 0.0))
    assert got.cpo == pytest.approx(3 * math.log(0.5))


def test_histogram_ends_literal(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.1, 0.999, 1.0, -0.5, 1.5, 9.0, None)], "x double")
    got = [r.b for r in df.select(diagnostics.equal_bins(F.col("x"), F.lit(0.0), F.lit(1.0), 30).alias("b")).collect()]
    assert got == [1, 4, 30, 30, None, None, None, None]
    same = [r.b for r in df.select(diagnostics.equal_bins(F.col("x"), F.lit(1.0), F.lit(1.0), 30).alias("b")).collect()]
    assert same == [None, None, None, 1, None, None, None, None]


def test_sums_of_the_design(spark):
    rng = np.random.default_rng(2)
    n, size = 400, 9
    rows, x, y, area = [], np.zeros((n, size)), rng.normal(size=n), np.where(rng.random(n) < 0.4, 0, rng.integers(1, 7, n))
    for r in range(n):
        idx = [0, 1 + int(rng.integers(0, 4)), 5 + int(rng.integers(0, 4))]
        x[r, idx] = 1
        rows.append(("m", int(area[r]) or None, float(y[r]), idx))
    rows.append(("m", 1, None, [0, 1, 5]))
    df = spark.createDataFrame(rows, "design_id string, CNTY int, y double, idx array<int>")
    full = np.column_stack([y, x])
    want = full.T @ full
    products = design.gram(df)
    for r in products.collect():
        assert r.v == pytest.approx(want[r.i + 1, r.j + 1])
    assert products.count() == (np.triu(want) != 0).sum()
    for r in design.xty(df).collect():
        assert r.sum_y == pytest.approx(want[0, r.pos + 1])
    centred = full.copy()
    for k in np.unique(area):
        centred[area == k] -= full[area == k].mean(axis=0)
    for r in design.demeaned_xty(df).collect():
        assert r.sum_y == pytest.approx((centred.T @ centred)[0, r.pos + 1], abs=1e-9)


def random_walk(r, n, within):
    """Effects and the diagonal of their covariance for levels in order, by dense algebra."""
    seen = n > 0
    near = [i for i in range(len(n) - 1) if seen[i] and seen[i + 1]]
    steps = [(r[i] / n[i] - r[i + 1] / n[i + 1]) ** 2 - within * (1 / n[i] + 1 / n[i + 1]) for i in near]
    variance = max(0, np.mean(steps)) if steps else 0
    if not variance:
        return np.zeros(len(n)), np.zeros(len(n))
    d = np.diff(np.eye(len(n)), axis=0)
    inverse = np.linalg.inv(np.diag(n) + within / variance * d.T @ d)
    one = np.ones(len(n))
    held = inverse - np.outer(inverse @ n, inverse @ n) / (n @ inverse @ n)  # mean 0 over the rows
    assert one @ (n * (held @ r)) == pytest.approx(0, abs=1e-9)
    return held @ r, np.diag(held)


def by_definition(y, groups, area, edges, kind, smooth):
    """Fitted values and leverages of one model by the definition on rows; NaN responses are unseen."""
    seen = ~np.isnan(y)
    n = seen.sum()
    fitted = np.full(len(y), y[seen].mean())
    h = np.full(len(y), 1 / n)

    def variances(levels):
        e = (y - fitted)[seen]
        own = levels[seen]
        sums = {g: (e[own == g].sum(), (own == g).sum()) for g in set(own[own >= 0])}
        ss = sum(r * r / k for r, k in sums.values())
        within = max(0, (e * e).sum() - ss) / max(1, n - len(sums))
        between = max(0, (ss - len(sums) * within) / max(1, sum(k for _, k in sums.values())))
        return sums, within, between

    def weight(k, within, between):
        return between / (between * k + within) if between else 0.0

    sums, within, between = variances(area)
    effect, w = {}, {}
    raw = {}
    for g in set(area):
        r, k = sums.get(g, (0.0, 0))
        w[g] = (1 / k if k else None) if kind == "factor" else weight(k, within, between)
        raw[g] = (w[g] or 0) * r
    near = {g: [j for i, j in edges if i == g and sums.get(j, (0, 0))[1]] for g in raw}
    top = sum(raw[g] * raw[j] for g in raw for j in near[g] if sums.get(g, (0, 0))[1])
    bottom = sum(raw[g] ** 2 for g in raw for j in near[g] if sums.get(g, (0, 0))[1])
    phi = min(1, max(0, top / bottom)) if bottom and kind != "factor" else 0
    for g in raw:
        k = sums.get(g, (0, 0))[1]
        around = phi * np.mean([raw[j] for j in near[g]]) if near[g] else 0
        effect[g] = raw[g] if kind == "factor" else raw[g] + (1 - k * w[g]) * around
    fitted = fitted + np.array([effect[g] if w[g] is not None else 0 for g in area])
    h = h + np.array([w[g] or 0 for g in area])
    for k, levels in enumerate(groups):
        sums, within, between = variances(levels)
        if k < smooth:
            chain = sorted(g for g in set(levels) if g >= 0)
            r, n_of = (np.array([sums.get(g, (0.0, 0))[i] for g in chain], float) for i in (0, 1))
            m, v = random_walk(r, n_of, within)
            effect, step = dict(zip(chain, m, strict=True)), dict(zip(chain, v, strict=True))
            fitted = fitted + np.array([effect.get(g, 0) for g in levels])
            h = h + np.array([step.get(g, 0) for g in levels])
            continue
        step = {g: weight(sums.get(g, (0, 0))[1], within, between) for g in set(levels) if g >= 0}
        effect = {g: v * sums.get(g, (0, 0))[0] for g, v in step.items()}
        fitted = fitted + np.array([effect.get(g, 0) for g in levels])
        h = h + np.array([step.get(g, 0) for g in levels])
    sigma2 = ((y - fitted)[seen] ** 2).sum() / max(1, n - h[seen].sum())
    return fitted, np.sqrt(sigma2 * h)


@pytest.fixture(scope="module")
def fitted(spark, sf_dir):
    return m.fits(spark, sf_dir), m.scored(spark, sf_dir)


def test_centred_design_sums(spark):
    """Demeaned X'X with levels and a numeric column, against dense algebra; one area holds a third of all rows."""
    rng = np.random.default_rng(5)
    n, size = 300, 8
    rows, x, area = [], np.zeros((n, size)), np.where(rng.random(n) < 0.35, 0, rng.integers(1, 9, n))
    for r in range(n):
        idx, val = [0, 1 + int(rng.integers(0, 3)), 4 + int(rng.integers(0, 3)), 7], [1.0, 1.0, 1.0, float(rng.normal())]
        x[r, idx] = val
        rows.append(("m", int(area[r]) or None, float(rng.normal()), idx, val))
    y = np.array([r[2] for r in rows])
    rows.append(("m", 1, None, [0, 1, 4], [1.0, 1.0, 1.0]))
    df = spark.createDataFrame(rows, "design_id string, CNTY int, y double, idx array<int>, val array<double>")
    full = np.column_stack([y, x])
    for r in design.gram(df).collect():
        assert r.v == pytest.approx((full.T @ full)[r.i + 1, r.j + 1])
    for k in np.unique(area):
        full[area == k] -= full[area == k].mean(axis=0)
    want = full.T @ full
    got = design.demeaned_gram(df).collect()
    assert {(r.i, r.j) for r in got} >= {(i, j) for i in range(size) for j in range(i, size) if abs(want[i + 1, j + 1]) > 1e-9}
    assert all(r.i <= r.j and r.v == pytest.approx(want[r.i + 1, r.j + 1], abs=1e-9) for r in got)
    for r in design.demeaned_xty(df).collect():
        assert r.sum_y == pytest.approx(want[0, r.pos + 1], abs=1e-9)


def test_slopes_and_quadratic_trend(spark):
    """A response that is a quadratic in the year and linear in a covariate is found again."""
    panel = small_panel(spark, 60, 8).withColumn("YIELD", 3 + 0.5 * F.col("Yr") - 0.25 * F.col("Yr") * F.col("Yr") + 2 * F.col("TP"))
    panel = panel.cache()
    one = spec.model("q", "YIELD", "dSIDI", [], "factor", linear=["TP"], trend="quadratic")
    assert [(t.name, t.kind) for t in one.terms] == [("dSIDI", "rw1"), ("TP", "linear"), ("trend", "linear"), ("trend_squared", "linear")]
    with pytest.raises(ValueError):
        spec.model("q", "YIELD", "dSIDI", [], "factor", trend="cubic")
    levels = spec.model("l", "YIELD", "dSIDI", ["TP"], "factor")
    edges = spark.createDataFrame([], "crop string, i int, j int")
    fits = fit.fit_models(panel, QuantileBins(panel, ["crop"], ["TP", "dSIDI"]), edges, [one, levels])
    slopes = {r.term: r["mean"] for r in fits.levels.where("family = 'q' and x = 1").collect()}
    assert slopes["trend_squared"] == pytest.approx(-0.25, abs=0.02)
    assert slopes["trend"] == pytest.approx(0.5 - 0.25 * 7, abs=0.05)
    sd = panel.agg(F.stddev_samp("TP")).first()[0]
    assert slopes["TP"] == pytest.approx(2 * sd, rel=0.1)
    scored = fit.score_rows(fits)
    r2 = {r.family: r.r2 for r in diagnostics.diagnostics(scored, ["family"]).collect()}
    assert all(0.8 < v < 1.2 for v in r2.values())
    assert scored.where("sd is null or sd < 0").count() == 0


@pytest.mark.parametrize("model_id", ["BUILDING_yield_SIDI_fe", "FURNITURE_dyield_dSIDI_bym", "MACHINERY_yield_SIDI_bym"])
def test_fit_follows_its_definition(spark, sf_dir, fitted, model_id):
    fits, scored = fitted
    one = fits.models.where(F.col("model_id") == model_id).first()
    rows = fits.rows.where(F.col("design_id") == one.design_id).orderBy("GEOID", "YEAR").collect()
    s = next(x for x in m.SPECS if x.family == one.family)
    years = design.year_range(m.prepared_stage(spark, sf_dir))
    y = np.array([math.nan if r.y is None else r.y for r in rows])
    area = np.array([r.CNTY for r in rows])
    groups = [
        np.array([next((p for p in r.idx if b.start <= p < b.start + b.size), -1) for r in rows]) for b in design.blocks(s, 20, years)
    ]
    pairs = [(e.i, e.j) for e in m.edges(spark, sf_dir).where(F.col("crop") == one.crop).collect()]
    mean, sd = by_definition(y, groups, area, pairs, s.area, len(s.smooths))
    got = scored.where(F.col("model_id") == model_id).orderBy("GEOID", "YEAR").toPandas()
    assert got["mean"].to_numpy() == pytest.approx(mean, abs=1e-9)
    assert got["sd"].to_numpy() == pytest.approx(sd, abs=1e-9)


def small_panel(spark, areas, years):
    """A panel whose areas differ, along a chain, and whose response falls with TP."""
    rows = spark.range(areas * years).select(
        F.lit("c").alias("crop"), (F.col("id") % areas).cast("string").alias("GEOID"), F.floor(F.col("id") / areas).cast("int").alias("Yr"),
        (F.col("id") % areas).cast("int").alias("CNTY"), F.sin("id").alias("TP"), F.cos(F.col("id") * 7).alias("dSIDI"),
    ).withColumn("YEAR", F.col("Yr") + 2000)
    noise = F.pmod(F.xxhash64("GEOID", "Yr"), F.lit(1000)) / 10000
    return rows.withColumn("YIELD", F.sin(F.col("CNTY") / 50) - F.col("TP") / 2 + noise)


def test_more_areas_than_any_dense_system(spark):
    df = small_panel(spark, 6000, 4).cache()
    specs = [spec.yield_model(f"m_{a}", "dSIDI", a, ["TP"]) for a in ("factor", "bym2")]
    edges = spark.range(5999).select(F.lit("c").alias("crop"), F.explode(F.array(
        F.struct(F.col("id").cast("int").alias("i"), (F.col("id") + 1).cast("int").alias("j")),
        F.struct((F.col("id") + 1).cast("int").alias("i"), F.col("id").cast("int").alias("j")),
    )).alias("e")).select("crop", "e.*")
    fits = fit.fit_models(df, QuantileBins(df, ["crop"], ["TP", "dSIDI"]), edges, specs)
    scored = fit.score_rows(fits)
    assert fits.areas.count() == 12_000 and scored.count() == 48_000
    found = {r.model_id: r for r in diagnostics.diagnostics(scored).collect()}
    assert all(r.mse < 0.2 for r in found.values())
    assert fits.models.where("area = 'bym2'").first().phi > 0.9  # neighbours are alike
    effects = fit.effect_table(fits)
    assert effects.where("term = 'CNTY'").count() == 5999 + 6000
    curve = effects.where("term = 'TP' and family = 'm_bym2'").orderBy("x").collect()
    assert curve[0]["mean"] > 0.05 > -0.05 > curve[-1]["mean"]


def test_plans_hold_no_python(spark, fitted):
    fits, _ = fitted
    for df in (fit.score_rows(fits), fit.effect_table(fits), fit.hyper_table(fits)):
        plan = df._jdf.queryExecution().toString()
        assert "CoGroup" not in plan and "Python" not in plan and "Cartesian" not in plan and "Pandas" not in plan


def test_result_tables(spark, fitted):
    fits, scored = fitted
    table = fit.model_fit(scored)
    assert table.count() == 50 and table.where("dic is null or p_eff <= 0").count() == 0
    compared = diagnostics.compare_models(scored, table)
    assert compared.where("r2 is null or mse > mse_obs").count() == 0
    summary = diagnostics.parameter_summary(fit.intercept_table(fits), fit.hyper_table(fits))
    assert summary.where("name = '(Intercept)'").count() == 50
    assert summary.where("not (q025 <= q50 and q50 <= q975)").count() == 0
    assert scored.where("y is null and (cpo is not null or p_value is not null)").count() == 0


def test_two_terms_and_two_kinds_of_area(spark, sf_dir):
    rows, found = m.prepared_stage(spark, sf_dir), m.bins(spark, sf_dir)
    specs = [
        spec.yield_model("spatial", area="bym", priors="default"),
        spec.change_model("two_terms", ["dSIDI", "dRICH"], spec.CHANGE_CONTROLS, "factor", {"dTP": "default"}),
    ]
    fits = fit.fit_models(rows, found, m.edges(spark, sf_dir), specs)
    scored = fit.score_rows(fits)
    got = scored.groupBy("family").agg(F.count("y").alias("n"), F.avg(F.col("y") - F.col("mean")).alias("off")).collect()
    assert len(got) == 2 and all(r.n > 0 and abs(r.off) < 0.05 for r in got)
    terms = fit.effect_table(fits).where("family = 'two_terms'").select("term").distinct().count()
    assert terms == 8 + 2 + 1


def test_two_part_areas_follow_their_definition(spark):
    """Smooth and rough areas on a grid with an isolated one: sweeps by dense algebra, and another result than one part."""
    rng = np.random.default_rng(4)
    side = 6
    at = [(k % side, k // side) for k in range(side * side)]
    pairs = [(i, j) for i, p in enumerate(at) for j, q in enumerate(at) if abs(p[0] - q[0]) + abs(p[1] - q[1]) == 1]
    level = [math.sin(p[0]) + p[1] / 3 + rng.normal() / 4 for p in at] + [2.0]
    rows = [("c", str(k), 2000 + t, t, k, float(v + rng.normal() / 10) if (k, t) != (3, 0) and k != 7 else None, float(rng.normal())) for k, v in enumerate(level) for t in range(5)]
    panel = spark.createDataFrame(rows, "crop string, GEOID string, YEAR int, Yr int, CNTY int, YIELD double, TP double").cache()
    edges = spark.createDataFrame([("c", i, j) for i, j in pairs], "crop string, i int, j int")
    specs = [spec.model(f"m_{a}", "YIELD", "TP", [], a, linear=["TP"]) for a in ("bym", "bym2")]
    fits = fit.fit_models(panel, QuantileBins(panel, ["crop"], ["TP"]), edges, specs)
    got = {r.CNTY: r for r in fits.areas.where("family = 'm_bym'").collect()}

    y = np.array([np.nan if r[5] is None else r[5] for r in rows])
    area = np.array([r[4] for r in rows])
    seen = ~np.isnan(y)
    e = y - y[seen].mean()
    n = np.array([(seen & (area == k)).sum() for k in range(37)], float)
    r = np.array([e[seen & (area == k)].sum() for k in range(37)])
    has = n > 0
    ss = (r[has] ** 2 / n[has]).sum()
    within = ((e[seen] ** 2).sum() - ss) / (seen.sum() - has.sum())
    between = (ss - has.sum() * within) / n.sum()
    means = np.divide(r, n, out=np.full(37, np.nan), where=has)
    near = np.zeros((37, 37))
    for i, j in pairs:
        near[i, j] = 1
    shared = min(between, max(0, np.nanmean([means[i] * means[j] for i, j in pairs])))
    free = between - shared
    q = np.divide(1, free + within / np.where(has, n, 1)) * has
    s = np.zeros(37)
    for _ in range(fit.SWEEPS):
        s = (q * np.nan_to_num(means) + near @ s / shared) / (q + (near.sum(1) + 1) / shared)
    want = s + np.nan_to_num(free / (free + within / np.where(has, n, 1)) * (means - s))
    assert 0 < shared < between
    assert [got[k]["mean"] for k in range(37)] == pytest.approx(list(want), abs=1e-9)
    assert {round(g.phi, 9) for g in got.values()} == {round(shared / between, 9)}
    assert got[7]["mean"] != 0  # without observations: from its neighbours
    other = {r.CNTY: r["mean"] for r in fits.areas.where("family = 'm_bym2'").collect()}
    assert max(abs(other[k] - got[k]["mean"]) for k in other) > 1e-3
    names = {r["name"] for r in fit.hyper_table(fits).where("family = 'm_bym'").collect()}
    assert {"precision of CNTY", "precision of CNTY structured", "phi of CNTY"} <= names
    assert fit.score_rows(fits).where("sd is null").count() == 0
