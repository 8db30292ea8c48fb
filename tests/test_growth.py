"""Shapes of plans whose shuffles, sorts and memory once grew faster than the tables, with their results."""

import pytest
from pyspark.sql import functions as F

from fallow import session
from fallow.catalog import analog, basics
from fallow.operators import quantiles, sketches
from fallow.operators.diversity import diversity_indices
from fallow.plans import design, fit, panel

ORDERS = "o_orderkey long, o_custkey long, o_orderpriority string, o_orderdate timestamp_ntz, o_totalprice double"
LINES = (
    "l_orderkey long, l_partkey long, l_suppkey long, l_returnflag string, l_linestatus string, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double"
)


@pytest.fixture
def sales(spark, tmp_path):
    """Two suppliers, one of them with a line of a customer without a segment, lines without a supplier, a copy of a line."""
    tables = {
        "region": ([(0, "ASIA")], "r_regionkey int, r_name string"),
        "nation": ([(0, 0)], "n_nationkey int, n_regionkey int"),
        "supplier": ([(1, 0, 100.0), (2, 0, 200.0)], "s_suppkey long, s_nationkey int, s_acctbal double"),
        "customer": ([(1, "A"), (2, "B"), (3, None)], "c_custkey long, c_mktsegment string"),
        "part": ([(1, "t", 4), (2, "u", 6)], "p_partkey long, p_type string, p_size int"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    orders = [(k, k, "1-URGENT", "1996-05-05 00:00:00", 50.0) for k in (1, 2, 3)] + [(4, None, "2-HIGH", None, 5.0)]
    orders = spark.createDataFrame(orders, ORDERS.replace("timestamp_ntz", "string")).withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    line = lambda o, p, s, q: (o, p, s, "R", "F", q, 10.0 * q, 0.1, 0.02)
    rows = [line(1, 1, 1, 2.0), line(1, 1, 1, 2.0), line(1, 2, 1, 4.0), line(2, 1, 1, 3.0), line(3, 1, 1, 5.0), line(2, 2, 2, 1.0), line(1, 1, None, 7.0), line(4, 1, 1, 9.0)]
    spark.createDataFrame(rows, LINES).write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def below(plan: str, start: str) -> list[str]:
    """The lines of a plan under the first one that holds `start`."""
    lines = plan.splitlines()
    at = next(i for i, line in enumerate(lines) if start in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    out = []
    for line in lines[at + 1 :]:
        if depth(line) <= depth(lines[at]):
            break
        out.append(line)
    return out


def logical(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_orders_meet_customers_before_lines(spark, sales):
    met = below(logical(analog.lines(spark, sales)), "(o_custkey")
    assert met and not [line for line in met if "l_orderkey" in line]


def test_input_panel_shuffles_lines_once_to_group_them(spark, sales):
    panel_ = analog.build_input_panel(spark, sales)
    got = {(r.crop, r.GEOID, r.YEAR): r for r in panel_.collect()}
    assert set(got) == {("A", "1", 1996), ("B", "1", 1996), ("B", "2", 1996)}
    first = got["A", "1", 1996]
    assert (first.ACRES, first.TOTAL_ACRES, first.LSM_RICH_ALL) == (8.0, 16.0, 2.0)  # 5 of them without a segment
    assert first.LSM_SIDI_ALL == pytest.approx(0.5) and first.YIELD == pytest.approx(9.0) and first.LSM_ENN_ALL == pytest.approx(14 / 3)
    assert got["B", "2", 1996].TOTAL_ACRES == 1.0
    plan = physical(panel_)
    assert "REPARTITION_BY_COL" in plan and "hashpartitioning(crop" not in plan


def test_diversity_with_sums(spark):
    df = spark.createDataFrame([("e", "a", 1.0, 5), ("e", "a", 1.0, None), ("e", "b", 2.0, 7), (None, "b", 0.0, 1)], "e string, cls string, q double, n int")
    got = {r.e: r for r in diversity_indices(df, ["e"], "cls", "q", sums=["n", "q"]).collect()}
    assert (got["e"].n, got["e"].q, got["e"].richness, got["e"].simpson) == (12, 4.0, 2, 0.5)
    assert (got[None].n, got[None].richness) == (1, 0)


def test_expenses_are_stored_before_they_meet_the_panel(spark):
    rows = spark.createDataFrame([("1", 0, "1_0"), ("1", 0, "1_0"), (None, 1, "NA_1"), ("9", 0, "9_0")], "GEOID string, Yr int, Cnty_yr string")
    wide = spark.createDataFrame([("1", 5.0, 6.0), (None, 7.0, 8.0)], "X string, X2000 double, X2001 double")
    out = panel.join_expenses(rows, wide, wide, ["X2000", "X2001"], 2000)
    assert sorted((r.Cnty_yr, r.fert, r.herb) for r in out.collect() if r.fert) == [("1_0", 5.0, 5.0), ("1_0", 5.0, 5.0), ("NA_1", 8.0, 8.0)]
    assert out.count() == 4 and "Expand" not in physical(out)


def test_sketches_are_made_of_wide_rows(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "AT_ONCE", 2)
    monkeypatch.setattr(sketches, "AT_ONCE", 2)
    x = F.when(F.col("id") % 5 > 0, F.col("id") % 97)
    df = spark.range(4000).select((F.col("id") % 3).alias("g"), x.alias("a"), (-x).cast("double").alias("b"), F.lit(None).cast("double").alias("c"))
    cuts = quantiles.column_sketches(df, ["g"], ["a", "b", "c"], [0.0, 0.5, 1.0])
    table = sketches.sketch_table(df, ["g"], ["a", "b", "c"])
    for made in (cuts, table):  # values are not exploded under the aggregate, which Spark would sort
        assert not [line for line in below(physical(made), "ObjectHashAggregate") if "Generate" in line]
    assert {(r.g, r.place): (r.cuts[0], r.cuts[2], r.n) for r in cuts.collect()} == {
        (g, k): ((0.0, 96.0), (-96.0, 0.0))[k] + (df.where(f"g = {g} and a is not null").count(),) for g in range(3) for k in (0, 1)
    }
    found = sketches.merged(table, ["column"]).select("column", "n", sketches.distinct_estimate().alias("d"), sketches.quantile_estimate(0.5).alias("q"))
    got = {r.column: r for r in found.collect()}
    assert set(got) == {"a", "b"} and got["a"].n == got["b"].n == 3200
    assert got["a"].d == pytest.approx(97, abs=7) and abs(got["a"].q - 48) <= 3


def test_areas_need_no_stored_panel(spark, sales):
    """Areas come of the built panel's plan, which then has neither its windows nor the water join."""
    got = {(r.crop, r.GEOID, r.CNTY) for r in basics.nodes(spark, sales).collect()}
    assert analog.stage_key(spark, sales, "built") not in analog._stages
    stored = panel.area_index(basics.built_stage(spark, sales), analog.county(spark, sales))
    assert got and got == {(r.crop, r.GEOID, r.CNTY) for r in stored.collect()}
    plan = logical(basics.built(spark, sales).where("YIELD is not null").select(*panel.KEYS).distinct())
    assert "Window" not in plan and "Join" not in plan


def test_area_effects_meet_whole_design_rows(spark):
    """The sums behind the areas: positions are spread behind the join with the areas, and summed without one shuffle by area and position."""
    rows = spark.createDataFrame(
        [("d", 1, 2.0, [0, 1, 4]), ("d", 1, 3.0, [0, 2]), ("d", 2, 1.0, [0, 1]), ("d", 2, None, [0, 1]), ("d", None, 5.0, [0, 2]), ("d", 3, 1.0, [0, 4])],
        "design_id string, CNTY int, y double, idx array<int>",
    )
    areas = spark.createDataFrame(
        [("m", "d", 1, 0.5), ("m", "d", 2, 2.0), ("n", "d", 1, -1.0), ("n", "d", 3, 4.0)], "model_id string, design_id string, CNTY int, mean double"
    )
    found = design.area_effect_sums(rows, areas)
    assert {(r.model_id, r.pos): r.taken for r in found.collect()} == {
        ("m", 0): 3.0, ("m", 1): 2.5, ("m", 2): 0.5, ("m", 4): 0.5, ("n", 0): 2.0, ("n", 1): -1.0, ("n", 2): -1.0, ("n", 4): 3.0,
    }
    numbers = rows.withColumn("val", F.transform("idx", lambda i: i + 0.5))
    assert {(r.model_id, r.pos): r.taken for r in design.area_effect_sums(numbers, areas).collect()}[("n", 4)] == 13.5
    plan = fit._after_areas(
        rows, spark.createDataFrame([("d", -1, 1, 6.0), ("d", 0, 1, 3.0)], "design_id string, i int, j int, v double"),
        spark.createDataFrame([("m", "d", 1.0)], "model_id string, design_id string, m double"), areas,
    )
    assert [(r.model_id, r.pos, r.r) for r in plan.collect()] == [("m", 1, 6.0 - 3.0 - 2.5)]
    lines = logical(found).splitlines()
    assert next(i for i, line in enumerate(lines) if "Generate explode" in line) < next(i for i, line in enumerate(lines) if "Join" in line)


def test_sweeps_join_the_links_once_for_all_models(spark, monkeypatch):
    """Models of a crop lie side by side: no stored table has a row per link and model, and several sweeps are one plan."""
    stored = []
    real = fit.settle

    def noted(df, *more):
        out = real(df, *more)
        stored.append((df.columns, out.count()))
        return out

    own = spark.range(8).select(
        F.explode(F.array(*[F.struct(F.lit(f"c_{f}").alias("model_id"), F.lit(f).alias("family"), F.lit(k).alias("k")) for k, f in enumerate("abc")])).alias("m"),
        F.col("id").cast("int").alias("CNTY"),
    ).select("m.model_id", F.lit("c").alias("crop"), "m.family", F.lit("d").alias("design_id"), F.lit("bym").alias("area"), "CNTY", F.lit(4.0).alias("n"), ((F.col("CNTY") - 3.5) * (F.col("m.k") + 1)).alias("r"))
    own = own.where("not (family = 'c' and CNTY = 7)").cache()  # an area that one model lacks
    moments = spark.createDataFrame([(f"c_{f}", 8, 0.1, 5.0) for f in "abc"], "model_id string, groups long, within double, between double")
    edges = spark.createDataFrame([("c", i, j) for i in range(8) for j in range(8) if abs(i - j) == 1], "crop string, i int, j int")
    monkeypatch.setattr(fit, "settle", noted)
    effects, variances = fit._two_part_areas(own, moments, edges, ["a", "b", "c"])
    assert max(n for _, n in stored) <= 23 and len(stored) < fit.SWEEPS
    got = {(r.model_id, r.CNTY): r["mean"] for r in effects.collect()}
    for k, family in enumerate("abc"):
        areas = range(7 if family == "c" else 8)
        y = [(i - 3.5) * (k + 1) / 4 for i in areas]
        pairs = [(i, j) for i in areas for j in areas if abs(i - j) == 1]
        shared = min(5.0, max(0.0, sum(y[i] * y[j] for i, j in pairs) / len(pairs)))
        free, q = 5.0 - shared, 1 / (5.0 - shared + 0.1 / 4)
        s = [0.0 for _ in areas]
        for _ in range(fit.SWEEPS):
            near = [sum(s[j] for a, j in pairs if a == i) for i in areas]
            d = [sum(a == i for a, _ in pairs) for i in areas]
            s = [(q * y[i] + near[i] / shared) / (q + (d[i] + 1) / shared) for i in areas]
        want = [s[i] + free / (free + 0.1 / 4) * (y[i] - s[i]) for i in areas]
        assert [got[f"c_{family}", i] for i in areas] == pytest.approx(want, abs=1e-9)
    assert len(got) == 23 and variances.count() == 6


def test_zero_fields_of_many_areas_are_not_sent(spark, monkeypatch):
    """A field of zeros is small in files and large in memory: beyond `SENT_ROWS` rows no join by area sends a table to the driver."""
    plans = []
    real = fit.settle

    def noted(df, *more):
        plans.append(physical(df))
        return real(df, *more)

    # neighbours differ in sign, so there is no structured part; an area lacks one model, another has no rows, and a third no neighbour
    sign = F.when(F.col("id") % 2 == 0, 1.0).otherwise(-1.0)
    each = F.explode(F.array(*[F.struct(F.lit(f"c_{f}").alias("model_id"), F.lit(f).alias("family")) for f in "ab"])).alias("m")
    own = spark.range(60).select("id", each).where("not (id = 9 and m.family = 'b')").select(
        "m.model_id", F.lit("c").alias("crop"), "m.family", F.lit("d").alias("design_id"), F.lit("bym").alias("area"), F.col("id").cast("int").alias("CNTY"),
        F.when(F.col("id") == 7, 0.0).otherwise(4.0).alias("n"), F.when(F.col("id") == 7, 0.0).otherwise(sign * F.col("id")).alias("r"),
    ).cache()
    moments = spark.createDataFrame([(f"c_{f}", 59, 0.5, 5.0) for f in "ab"], "model_id string, groups long, within double, between double")
    edges = spark.createDataFrame([("c", i, j) for i in range(59) for j in range(59) if abs(i - j) == 1], "crop string, i int, j int").cache()
    monkeypatch.setattr(fit, "settle", noted)
    monkeypatch.setattr(session, "SENT_ROWS", 10, raising=False)
    effects, variances = fit._two_part_areas(own, moments, edges, ["a", "b"])
    plans.append(physical(effects))
    got = {(r.model_id, r.CNTY): (r["mean"], r.w, r.phi) for r in effects.collect()}
    w = 5.0 / (5.0 * 4 + 0.5)
    want = {(f"c_{f}", i): (w * (i if i % 2 == 0 else -i), w, 0.0) for f in "ab" for i in range(60) if (f, i) != ("b", 9)}
    want |= {(f"c_{f}", 7): (0.0, 5.0 / 0.5, 0.0) for f in "ab"}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert {(r.term, r.between) for r in variances.collect()} == {("CNTY", 5.0), ("CNTY structured", 0.0)}
    sent = [line for plan in plans for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert sent and not [line for line in sent if "CNTY" in line or "j#" in line]
