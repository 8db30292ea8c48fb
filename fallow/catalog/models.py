"""Catalogue: model terms, sufficient statistics, fits, diagnostics, curves, maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fallow.catalog import analog as a
from fallow.catalog import sql as s
from fallow.catalog.basics import (
    KEYS,
    bins,
    edges,
    prepared_stage,
    query,
    tidy,
)
from fallow.functions.scalars import CDF_DENOMINATOR, CDF_NUMERATOR, CDF_SPLIT, ROOT_TWO_PI
from fallow.operators import within
from fallow.operators.binning import to_long
from fallow.plans import curves, design, diagnostics, fit, maps, spec
from fallow.session import settle

SPECS = spec.report_families()

# ---- the report's models in SQL, written out apart from the plans -----------

SPEC_CTE = """
select family, response, area, ord, term, case when ord < 7 then 'rw1' else 'iid' end as kind,
  case when ord < 7 then 'pc' else 'default' end as prior
from (select family, response, area, unnest(range(9)) as ord,
    unnest(list_concat(controls, [diversity, 'YEAR_id', 'YEAR_id2'])) as term
  from (values
    ('yield', 'YIELD', ['fert', 'herb', 'volume', 'TP', 'GDD', 'SDD'], 'SIDI', 'LSM_SIDI_ALL'),
    ('dyield', 'dYield', ['dVol', 'dTP', 'dGDD', 'dSDD', 'dfert', 'dherb'], 'aveSIDI', 'aveSIDI2yr'),
    ('dyield', 'dYield', ['dVol', 'dTP', 'dGDD', 'dSDD', 'dfert', 'dherb'], 'dSIDI', 'dSIDI'),
    ('covyield', 'covYield', ['covVol', 'covTP', 'covGDD', 'covSDD', 'covfert', 'covherb'], 'aveSIDI', 'aveSIDI3yr'),
    ('covyield', 'covYield', ['covVol', 'covTP', 'covGDD', 'covSDD', 'covfert', 'covherb'], 'covSIDI', 'covSIDI')
  ) m(prefix, response, controls, short, diversity), (values ('fe', 'factor'), ('bym', 'bym2')) k(tag, area),
  lateral (select prefix || '_' || short || '_' || tag as family))"""
_responses = " union all ".join(
    f"select crop, GEOID, YEAR, CNTY, Yr, '{r}' as response, {r} as y from prepared"
    for r in s.OUTCOMES
)
# Active levels of every panel row and model, the intercept included.
DESIGN_CTES = {
    "spec": SPEC_CTE,
    "responses": _responses,
    "design": """
select r.crop || '_' || f.family as model_id, r.crop, r.GEOID, r.YEAR, r.CNTY, r.y,
  -1 as ord, '(Intercept)' as term, 0.0 as x
from responses r join (select distinct family, response from spec) f using (response)
union all
select r.crop || '_' || family, r.crop, r.GEOID, r.YEAR, r.CNTY, r.y, ord, term, z
from responses r join spec using (response)
join scaled c on c.crop = r.crop and c.GEOID = r.GEOID and c.YEAR = r.YEAR and c.col = term
where kind = 'rw1'
union all
select crop || '_' || family, crop, GEOID, YEAR, CNTY, y, ord, term,
  case term when 'YEAR_id2' then Yr * Yr else Yr end
from responses join spec using (response) where kind = 'iid'""",
    "observed": "select * from design where y is not null",
}


def design_sql(tail: str, **extra: str) -> str:
    return s.statement(tail, **DESIGN_CTES, **extra)


def model_keys(spark, d) -> DataFrame:
    """(model_id, design_id) of the report's models."""
    return a.stage(spark, d, "models", lambda: design.model_table(prepared_stage(spark, d), SPECS)).select("model_id", "design_id")


def design_stage(spark, d) -> DataFrame:
    """Design rows of the report's models."""
    rows = prepared_stage(spark, d)
    return a.stage(spark, d, "design", lambda: design.design_rows(rows, bins(spark, d), SPECS, design.year_range(rows)))


def level_names(spark, d) -> DataFrame:
    """(design_id, pos, term, x) of the report's models, the intercept included."""

    def build() -> DataFrame:
        names = design.level_table(bins(spark, d), SPECS, design.year_range(prepared_stage(spark, d)))
        names = names.select("design_id", "pos", "term", "x")
        intercept = names.select("design_id").distinct().select(
            "design_id", F.lit(design.INTERCEPT).alias("pos"), F.lit("(Intercept)").alias("term"), F.lit(0.0).alias("x")
        )
        return names.unionByName(intercept)

    return a.stage(spark, d, "level names", build)


@query(
    s.statement(
        "select crop, " + s.r6("stddev_samp(YIELD) / 0.31", "scale") + ", count(*) as n from prepared group by crop"
    )
)
def prior_scale(spark, d):
    return tidy(fit.prior_scale(prepared_stage(spark, d)))


@query(
    design_sql(
        "select crop, family, response, term, kind, prior, levels, "
        + ", ".join(s.r6(f"case when prior = 'pc' then {e} end", n) for e, n in (
            ("case when kind = 'rw1' then scale else 0.2 / 0.31 end", "u"), ("0.01", "alpha"),
            ("case when kind = 'bym2' then 0.5 end", "phi_u"), ("case when kind = 'bym2' then 2.0 / 3 end", "phi_alpha"),
        ))
        + " from ("
        "select c.crop, family, response, term, kind, prior, count(distinct c.z) as levels from spec join scaled c on c.col = term "
        "where kind = 'rw1' group by all "
        "union all select y.crop, family, response, term, kind, prior, y.n from spec, "
        "(select crop, (select max(Yr) - min(Yr) + 1 from prepared) as n from prepared group by crop) y where kind = 'iid' "
        "union all select n.crop, family, response, 'CNTY', area, case area when 'factor' then 'flat' else 'pc' end, n.n "
        "from (select distinct family, response, area from spec), "
        "(select crop, count(distinct CNTY) as n from prepared group by crop) n"
        ") join (select crop, stddev_samp(YIELD) / 0.31 as scale from prepared group by crop) using (crop)"
    )
)
def model_terms(spark, d):
    """Every term of every model, the area included, with its prior's constants and its levels in the data."""
    rows = prepared_stage(spark, d)
    years = design.year_range(rows)
    smooth = bins(spark, d).table.groupBy("crop", F.col("column").alias("term")).agg(F.count_distinct("scaled").alias("levels"))
    each = rows.groupBy("crop").agg(F.count_distinct("CNTY").alias("areas"), F.lit(years.size).cast("long").alias("years"))
    others = each.select("crop", F.explode(F.array(
        F.struct(F.lit("YEAR_id").alias("term"), F.col("years").alias("levels")),
        F.struct(F.lit("YEAR_id2").alias("term"), F.col("years").alias("levels")),
        F.struct(F.lit("CNTY").alias("term"), F.col("areas").alias("levels")),
    )).alias("t")).select("crop", "t.*")
    terms = spec.spec_table(spark, SPECS).join(smooth.unionByName(others), "term").join(fit.prior_scale(rows).drop("n"), "crop")
    return tidy(spec.with_constants(terms).select(
        "crop", "family", "response", "term", "kind", "prior", "levels", "u", "alpha", "phi_u", "phi_alpha"
    ))


@query(
    design_sql(
        "select model_id, count(*) as n_rows, count(y) as n, count(distinct CNTY) as areas, "
        + s.r6("avg(k)", "mean_terms")
        + " from (select model_id, GEOID, YEAR, any_value(y) as y, any_value(CNTY) as CNTY, count(*) as k "
        "from design group by model_id, GEOID, YEAR) group by model_id"
    )
)
def design_counts(spark, d):
    counts = design_stage(spark, d).groupBy("design_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("y").alias("n"),
        F.count_distinct("CNTY").alias("areas"),
        F.avg(F.size("idx")).alias("mean_terms"),
    )
    return tidy(counts.join(model_keys(spark, d), "design_id").drop("design_id"))


@query(
    design_sql(
        f"select p.model_id, p.term as term_i, {s.r6('p.x', 'x_i')}, q.term as term_j, "
        f"{s.r6('q.x', 'x_j')}, cast(count(*) as double) as n "
        "from observed p join observed q on p.model_id = q.model_id and p.GEOID = q.GEOID "
        "and p.YEAR = q.YEAR and p.ord <= q.ord group by p.model_id, p.term, p.x, q.term, q.x"
    )
)
def suff_stats_xtx(spark, d):
    names = level_names(spark, d)
    i = names.select("design_id", F.col("pos").alias("i"), F.col("term").alias("term_i"), F.col("x").alias("x_i"))
    j = names.select("design_id", F.col("pos").alias("j"), F.col("term").alias("term_j"), F.col("x").alias("x_j"))
    products = design.gram(design_stage(spark, d)).join(i, ["design_id", "i"]).join(j, ["design_id", "j"])
    return tidy(products.join(model_keys(spark, d), "design_id").select("model_id", "term_i", "x_i", "term_j", "x_j", F.col("v").alias("n")))


@query(
    design_sql(
        f"select model_id, term, {s.r6('x')}, {s.r9('sum(y)', 'sum_y')} "
        "from observed group by model_id, term, x"
    )
)
def suff_stats_xty(spark, d):
    sums = design.xty(design_stage(spark, d)).join(level_names(spark, d), ["design_id", "pos"])
    return tidy(sums.join(model_keys(spark, d), "design_id").select("model_id", "term", "x", "sum_y"), nine=("sum_y",))


@query(
    design_sql(
        "select model_id, CNTY, cast(count(*) as double) as n, "
        + s.r9("sum(y)", "sum_y")
        + " from observed where term = '(Intercept)' group by model_id, CNTY"
    )
)
def suff_stats_area(spark, d):
    areas = design.area_table(design_stage(spark, d)).where("n > 0").join(model_keys(spark, d), "design_id")
    return tidy(areas.select("model_id", "CNTY", "n", "sum_y"), nine=("sum_y",))


@query(
    design_sql(
        "select model_id, term, "
        + s.r6("x")
        + ", "
        + s.r6("sum(dy)", "sum_y")
        + " from (select o.model_id, o.term, o.x, o.y - avg(o.y) filter (o.term = '(Intercept)') "
        "over (partition by o.model_id, o.CNTY) as dy from observed o) "
        "where term <> '(Intercept)' group by model_id, term, x"
    )
)
def demeaned_xty(spark, d):
    """X'y after subtracting area means: sum over a level's rows of y minus its area mean."""
    sums = design.demeaned_xty(design_stage(spark, d)).where("pos > 0").join(level_names(spark, d), ["design_id", "pos"])
    return tidy(sums.join(model_keys(spark, d), "design_id").select("model_id", "term", "x", "sum_y"))


@query(
    design_sql(
        f"select c.model_id, c.term_i, {s.r6('c.x_i', 'x_i')}, c.term_j, {s.r6('c.x_j', 'x_j')}, {s.r6('coalesce(pairs, 0) - taken', 'v')} from ("
        "select p.model_id, p.term as term_i, p.x as x_i, q.term as term_j, q.x as x_j, sum(p.k * q.k / a.k) as taken "
        "from inside p join inside q on q.model_id = p.model_id and q.CNTY = p.CNTY and (p.ord < q.ord or (p.ord = q.ord and p.x <= q.x)) "
        "join inside a on a.model_id = p.model_id and a.CNTY = p.CNTY and a.ord = -1 where p.ord >= 0 group by all) c "
        "left join (select p.model_id, p.term as term_i, p.x as x_i, q.term as term_j, q.x as x_j, count(*) as pairs "
        "from observed p join observed q on p.model_id = q.model_id and p.GEOID = q.GEOID and p.YEAR = q.YEAR and p.ord <= q.ord group by all) b "
        "on b.model_id = c.model_id and b.term_i = c.term_i and b.x_i = c.x_i and b.term_j = c.term_j and b.x_j = c.x_j",
        inside="select model_id, CNTY, ord, term, x, count(*) as k from observed group by all",
    )
)
def demeaned_xtx(spark, d):
    """X'X after subtracting area means, for every pair of levels that one area holds."""
    names = level_names(spark, d)
    i = names.select("design_id", F.col("pos").alias("i"), F.col("term").alias("term_i"), F.col("x").alias("x_i"))
    j = names.select("design_id", F.col("pos").alias("j"), F.col("term").alias("term_j"), F.col("x").alias("x_j"))
    sums = design.demeaned_gram(design_stage(spark, d)).where("i > 0").join(i, ["design_id", "i"]).join(j, ["design_id", "j"])
    return tidy(sums.join(model_keys(spark, d), "design_id").select("model_id", "term_i", "x_i", "term_j", "x_j", "v"))


# Models with slopes and a quadratic trend, one per response: all controls and the diversity term enter as numbers.
NUMERIC_SPECS = [
    spec.model(f"{m.family}_numeric", m.response, m.smooths[-1], m.smooths[:-1], "factor", linear=m.smooths, trend="quadratic")
    for m in SPECS if m.area == "factor"
]
NUMERIC_CTES = {
    **{k: DESIGN_CTES[k] for k in ("spec", "responses")},
    "span": "select min(Yr) as y0, max(Yr) as y1 from prepared",
    "standard": "select crop, GEOID, YEAR, col as term, (x - avg(x) over c) / nullif(stddev_samp(x) over c, 0) as v "
    "from cols_long window c as (partition by crop, col)",
    "entries": """
select r.crop || '_' || family || '_numeric' as model_id, r.GEOID, r.YEAR, r.y, r.CNTY, ord, spec.term, v
from responses r join spec using (response) join standard t on t.crop = r.crop and t.GEOID = r.GEOID and t.YEAR = r.YEAR and t.term = spec.term
where area = 'factor' and v is not null
union all select crop || '_' || family || '_numeric', GEOID, YEAR, y, CNTY, 7, 'trend', Yr - (y0 + y1) / 2
from responses join (select distinct family, response from spec where area = 'factor') using (response), span
union all select crop || '_' || family || '_numeric', GEOID, YEAR, y, CNTY, 8, 'trend_squared',
  pow(Yr - (y0 + y1) / 2, 2) - (pow(y1 - y0 + 1, 2) - 1) / 12
from responses join (select distinct family, response from spec where area = 'factor') using (response), span
union all select crop || '_' || family || '_numeric', GEOID, YEAR, y, CNTY, -1, '(Intercept)', 1
from responses join (select distinct family, response from spec where area = 'factor') using (response)
union all select crop || '_' || family || '_numeric', GEOID, YEAR, y, CNTY, -2, '(Response)', y
from responses join (select distinct family, response from spec where area = 'factor') using (response)""",
    "numeric": "select * from entries where y is not null",
}


def numeric_design(spark, d) -> DataFrame:
    rows = prepared_stage(spark, d)
    return a.stage(spark, d, "numeric design", lambda: design.design_rows(rows, bins(spark, d), NUMERIC_SPECS, design.year_range(rows)))


def numeric_names(spark, d) -> tuple[DataFrame, DataFrame]:
    """(design_id, i, term_i) and (design_id, j, term_j) of the numeric designs; `design_id` is the model's name."""
    rows = prepared_stage(spark, d)
    years = design.year_range(rows)
    listed = [
        (m.family, pos, term)
        for m in NUMERIC_SPECS
        for pos, term in [(design.RESPONSE, "(Response)"), (design.INTERCEPT, "(Intercept)"), *((b.start, b.term) for b in design.blocks(m, 20, years))]
    ]
    names = rows.select("crop").distinct().select("crop", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.lit(p).alias("p"), F.lit(t).alias("t")) for f, p, t in listed])).alias("n"))
    names = settle(names.select(F.concat_ws("_", "crop", "n.f").alias("design_id"), F.col("n.p").alias("pos"), F.col("n.t").alias("term")))
    return tuple(names.select("design_id", F.col("pos").alias(k), F.col("term").alias(f"term_{k}")) for k in ("i", "j"))


@query(
    s.statement(
        f"select p.model_id, p.term as term_i, q.term as term_j, {s.r6('sum(p.v * q.v)', 'v')} from numeric p "
        "join numeric q on q.model_id = p.model_id and q.GEOID = p.GEOID and q.YEAR = p.YEAR and p.ord <= q.ord group by all",
        **NUMERIC_CTES,
    )
)
def suff_stats_numeric(spark, d):
    """[y, X]'[y, X] of designs with standardised covariates and a quadratic trend as numbers."""
    i, j = numeric_names(spark, d)
    sums = design.gram(numeric_design(spark, d)).join(i, ["design_id", "i"]).join(j, ["design_id", "j"])
    return tidy(sums.select(F.col("design_id").alias("model_id"), "term_i", "term_j", "v"))


@query(
    s.statement(
        f"select p.model_id, p.term as term_i, q.term as term_j, {s.r6('sum(p.dv * q.dv)', 'v')} from demeaned p "
        "join demeaned q on q.model_id = p.model_id and q.GEOID = p.GEOID and q.YEAR = p.YEAR and p.ord <= q.ord group by all",
        **NUMERIC_CTES,
        demeaned="select model_id, GEOID, YEAR, ord, term, v - avg(v) over (partition by model_id, CNTY, ord) as dv from ("
        "select r.model_id, r.GEOID, r.YEAR, r.CNTY, t.ord, t.term, coalesce(n.v, 0) as v from (select * from numeric where ord = -1) r "
        "join (select distinct model_id, ord, term from numeric where ord >= 0) t on t.model_id = r.model_id "
        "left join numeric n on n.model_id = r.model_id and n.GEOID = r.GEOID and n.YEAR = r.YEAR and n.ord = t.ord)",
    )
)
def demeaned_xtx_numeric(spark, d):
    """X'X of the numeric designs after subtracting area means; a missing covariate is an entry of 0."""
    i, j = numeric_names(spark, d)
    sums = design.demeaned_gram(numeric_design(spark, d)).where("i > 0").join(i, ["design_id", "i"]).join(j, ["design_id", "j"])
    return tidy(sums.select(F.col("design_id").alias("model_id"), "term_i", "term_j", "v"))


@query(
    s.statement(
        "select crop, response, term, count(*) as n, "
        + s.r6("case when sum(x * x) > 1e-12 * sum(raw) then sum(x * y) / sum(x * x) end", "slope")
        + " from (select r.crop, response, col as term, y - avg(y) over (partition by r.crop, CNTY, response, col) as y, "
        "x - avg(x) over (partition by r.crop, CNTY, response, col) as x, x * x as raw "
        "from responses r join cols_long c on c.crop = r.crop and c.GEOID = r.GEOID and c.YEAR = r.YEAR where y is not null) group by all",
        responses=_responses,
    )
)
def fe_within_slope(spark, d):
    """Slope of each response on each model column with one free level per area."""
    rows = prepared_stage(spark, d)
    responses = F.explode(F.array(*[F.struct(F.lit(r).alias("response"), F.col(r).alias("y")) for r in s.OUTCOMES]))
    long = to_long(rows.select("crop", "CNTY", *s.MODEL_COLUMNS, responses.alias("r")).select("*", "r.*"), ["crop", "CNTY", "response", "y"], s.MODEL_COLUMNS)
    names = F.array(*[F.lit(c) for c in s.MODEL_COLUMNS])
    slopes = within.within_slope(long.withColumn("term", F.get(names, F.col("place"))), ["crop", "response", "term"], "CNTY", "y", "x")
    return tidy(slopes)


# ---- diagnostics of closed-form models ------------------------------------
# Three simple models of YIELD per crop with fitted value = mean of a group
# (area, year, all rows) and noise precision 1 / var(YIELD).

SIMPLE = {"area": "CNTY", "year": "YEAR", "all": "crop"}


def _poly(x: str, coefficients: list[float]) -> str:
    out = repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


def phi_sql(z: str) -> str:
    """The normal distribution function by the same rational approximation."""
    t = f"abs({z})"
    tail = f"({t} + 0.65)"
    for k in ("4.0", "3.0", "2.0", "1.0"):
        tail = f"({t} + {k} / {tail})"
    upper = (
        f"(case when {t} > 37 then 0.0 when {t} < {CDF_SPLIT!r} then exp(-{t} * {t} / 2) * "
        f"{_poly(t, CDF_NUMERATOR)} / {_poly(t, CDF_DENOMINATOR)} "
        f"else exp(-{t} * {t} / 2) / {tail} / {ROOT_TWO_PI!r} end)"
    )
    return f"(case when {z} > 0 then 1 - {upper} else {upper} end)"


SIMPLE_CTES = {
    "simple": " union all ".join(
        f"select crop || '_{r}_{name}' as model_id, crop, GEOID, YEAR, CNTY, {r} as y, "
        f"avg({r}) over (partition by crop, {by}) as mean, "
        f"count({r}) over (partition by crop, {by}) as k, "
        f"1 / var_samp({r}) over (partition by crop) as tau from prepared"
        for r in ("YIELD", "dYield", "covYield")
        for name, by in SIMPLE.items()
    ),
    "loo": """
select *, case when k > 0 then 1 / (tau * k) end as s2,
  case when y is not null and k > 1 then 1 / (tau * (k - 1)) end as v,
  case when y is not null and k > 1 then (mean * k - y) / (k - 1) end as m
from simple""",
    "scores0": """
select *, (y - m) / sqrt(v + 1 / tau) as z,
  -(y - m) * (y - m) / (2 * (v + 1 / tau)) - ln(sqrt(2 * pi() * (v + 1 / tau))) as log_cpo,
  case when k > 0 then (y - mean) / sqrt(1 / (tau * k)) end as zp
from loo""",
    "scores": f"select *, exp(log_cpo) as cpo, {phi_sql('z')} as pit0, {phi_sql('zp')} as p0 from scores0",
    "scored": "select * exclude (pit0, p0), case when z is not null then pit0 end as pit, "
    "case when zp is not null then p0 end as p_value from scores",
}


def simple_sql(tail: str) -> str:
    return s.statement(tail, **SIMPLE_CTES)


def simple_scores(spark, d) -> DataFrame:
    """Rows of the three simple models, scored like those of a fit, as a stored table."""
    return a.stage(spark, d, "simple_scores", lambda: score_simple_models(spark, d))


def score_simple_models(spark, d) -> DataFrame:
    responses = F.explode(F.array(*[F.struct(F.lit(r).alias("response"), F.col(r).alias("y")) for r in s.OUTCOMES]))
    rows = prepared_stage(spark, d).select(*KEYS, "CNTY", responses.alias("r")).select(*KEYS, "CNTY", "r.*")
    tau = rows.groupBy("crop", "response").agg((1 / F.var_samp("y")).alias("tau"))
    out = None
    for name, by in SIMPLE.items():
        group = ["response", "crop"] if by == "crop" else ["response", "crop", by]
        means = settle(rows.groupBy(*group).agg(F.avg("y").alias("mean"), F.count("y").alias("k")))
        part = rows.join(means, group).withColumn("model_id", F.concat_ws("_", "crop", "response", F.lit(name)))
        out = part if out is None else out.unionByName(part)
    var = F.try_divide(F.lit(1.0), F.col("tau") * F.col("k"))
    return fit.leave_one_out(out.join(settle(tau), ["crop", "response"]).withColumn("var", var))


@query(
    simple_sql(
        f"select model_id, GEOID, YEAR, {s.r6('p_value')}, {s.r6('pit')}, {s.r6('cpo')} from scored"
    )
)
def ppp_values(spark, d):
    return tidy(simple_scores(spark, d).select("model_id", "GEOID", "YEAR", "p_value", "pit", "cpo"))


@query(
    simple_sql(
        "select model_id, cast(least(floor(round(pit, 9) * 30) + 1, 30) as integer) as bin, count(*) as n "
        "from scored where pit is not null group by 1, 2"
    )
)
def pit_histogram(spark, d):
    # a value that lies on an edge but for its last bits counts alike in every engine
    return diagnostics.histogram(simple_scores(spark, d).withColumn("pit", F.round("pit", 9)), "pit", ["model_id"], 30, 0.0, 1.0)


@query(
    simple_sql(
        "select model_id, cast(least(floor(round(p_value, 9) * 30) + 1, 30) as integer) as bin, count(*) as n "
        "from scored where p_value is not null group by 1, 2"
    )
)
def p_value_histogram(spark, d):
    return diagnostics.histogram(simple_scores(spark, d).withColumn("p_value", F.round("p_value", 9)), "p_value", ["model_id"], 30, 0.0, 1.0)


BINNED = (
    "case when lo = hi then case when x = lo then 1 end "
    "when x between lo and hi then cast(least(floor((x - lo) / (hi - lo) * 30) + 1, 30) as integer) end"
)


def model_columns(spark, d) -> DataFrame:
    """(col, x): the known values of every model column."""
    names = F.array(*[F.lit(c) for c in s.MODEL_COLUMNS])
    long = to_long(prepared_stage(spark, d), [], s.MODEL_COLUMNS).where("x is not null")
    return long.select(F.get(names, F.col("place")).alias("col"), "x")


@query(
    s.statement(
        f"select col, {BINNED} as bin, count(*) as n "
        "from cols_long join (select col, min(x) as lo, max(x) as hi from cols_long group by col) using (col) group by 1, 2"
    )
)
def value_histogram(spark, d):
    """Histogram of every model column between its smallest and largest value."""
    long = model_columns(spark, d)
    ends = settle(long.groupBy("col").agg(F.min("x").alias("lo"), F.max("x").alias("hi")))
    bin_ = diagnostics.equal_bins(F.col("x"), F.col("lo"), F.col("hi"), 30)
    return long.join(ends, "col").groupBy("col", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(
    s.statement(
        f"select col, {BINNED} as bin, count(*) as n from ("
        "select col, x, case col when 'fert' then avg(x) over w else avg(x) over w - stddev_samp(x) over w end as lo, "
        "case col when 'fert' then avg(x) over w else avg(x) over w + stddev_samp(x) over w end as hi "
        "from cols_long window w as (partition by col)) group by 1, 2"
    )
)
def histogram_edges(spark, d):
    """Histogram within one sd of the mean, values beyond in no bin; for fert, between two equal ends."""
    long = model_columns(spark, d)
    half = F.when(F.col("col") == "fert", 0.0).otherwise(F.col("sd"))
    ends = settle(long.groupBy("col").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd")).select(
        "col", (F.col("mean") - half).alias("lo"), (F.col("mean") + half).alias("hi")
    ))
    bin_ = diagnostics.equal_bins(F.col("x"), F.col("lo"), F.col("hi"), 30)
    return long.join(ends, "col").groupBy("col", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


DIAG_SQL = simple_sql(
    "select model_id, count(*) as n_rows, count(y) as n, "
    + ", ".join(
        [
            s.r6("sum(log_cpo)", "cpo"),
            s.r6("sum((y - mean) * (y - mean)) / count(*)", "mse"),
            s.r6("sum((y - mean) * (y - mean)) / count(y)", "mse_obs"),
            s.r6("avg(p_value)", "mean_p_value"),
            s.r6("sum((mean - yb) * (mean - yb)) filter (y is not null) / sum((y - yb) * (y - yb))", "r2"),
        ]
    )
    + " from (select *, avg(y) over (partition by model_id) as yb from scored) group by model_id"
)


@query(DIAG_SQL)
def diag_mse_r2(spark, d):
    return tidy(diagnostics.diagnostics(simple_scores(spark, d)))


@query(
    simple_sql(
        "select model_id, "
        + s.r6(
            "count(*) * ln(2 * pi() / max(tau)) + max(tau) * sum((y - mean) * (y - mean)) "
            "+ 2 * max(tau) * sum(s2)",
            "dic",
        )
        + ", "
        + s.r6("sum(log_cpo)", "cpo")
        + ", "
        + s.r6("sum((y - mean) * (y - mean)) / max(n_all)", "mse")
        + ", "
        + s.r6("avg(p_value)", "mean_p_value")
        + ", "
        + s.r6("sum((mean - yb) * (mean - yb)) / sum((y - yb) * (y - yb))", "r2")
        + " from (select *, count(*) over (partition by model_id) as n_all, avg(y) over (partition by model_id) as yb from scored) "
        "where y is not null group by model_id"
    )
)
def diag_multi_model(spark, d):
    scored = simple_scores(spark, d)
    fits = fit.model_fit(scored, ["model_id"])
    return tidy(diagnostics.compare_models(scored, fits).select("model_id", "dic", "cpo", "mse", "mean_p_value", "r2"))


@query(
    simple_sql(
        f"select model_id, GEOID, YEAR, {s.r6('y', 'observed')}, {s.r6('mean', 'fitted')} "
        "from scored join (select crop, GEOID, YEAR from prepared where YIELD is not null) using (crop, GEOID, YEAR)"
    )
)
def observed_vs_fitted(spark, d):
    pairs = diagnostics.observed_vs_fitted(simple_scores(spark, d), prepared_stage(spark, d))
    return tidy(pairs.select("model_id", "GEOID", "YEAR", "observed", "fitted"))


@query(
    s.statement(
        "select crop as model_id, '(Intercept)' as name, "
        + ", ".join(
            [
                s.r6("avg(YIELD)", "mean"),
                s.r6("stddev_samp(YIELD) / sqrt(count(YIELD))", "sd"),
                s.r6("avg(YIELD) - 1.959964 * stddev_samp(YIELD) / sqrt(count(YIELD))", "q025"),
                s.r6("avg(YIELD)", "q50"),
                s.r6("avg(YIELD) + 1.959964 * stddev_samp(YIELD) / sqrt(count(YIELD))", "q975"),
            ]
        )
        + " from prepared group by crop union all select crop, 'noise precision', "
        + ", ".join(
            s.r6(f"{k} / var_samp(YIELD)", n)
            for k, n in ((1, "mean"), (0, "sd"), (1, "q025"), (1, "q50"), (1, "q975"))
        )
        + " from prepared group by crop"
    )
)
def param_summary(spark, d):
    """Fixed part and hyperparameter of the mean-only model per crop, stacked."""
    y = prepared_stage(spark, d).groupBy(F.col("crop").alias("model_id")).agg(
        F.avg("YIELD").alias("mean"),
        F.stddev_samp("YIELD").alias("s"),
        F.count("YIELD").alias("n"),
    )
    fixed = y.withColumn("sd", F.col("s") / F.sqrt("n")).select(
        "model_id", F.lit("(Intercept)").alias("name"), "mean", "sd",
        *fit.quantile_columns(F.col("mean"), F.col("sd")),
    )
    precision = 1 / (F.col("s") * F.col("s"))
    hyper = y.select(
        "model_id", F.lit("noise precision").alias("name"), precision.alias("mean"),
        F.lit(0.0).alias("sd"), *fit.quantile_columns(precision, F.lit(0.0)),
    )
    return tidy(diagnostics.parameter_summary(fixed, hyper))


# ---- curves and maps -------------------------------------------------------
# Effects that SQL can state: per bin of a covariate, the mean, smallest and
# largest deviation of YIELD from its crop mean.

CURVE_TERMS = ["LSM_SIDI_ALL", "volume", "fert", "herb", "TP", "GDD", "SDD"]
SEGMENTS = {
    "AUTOMOBILE": "Automobile", "BUILDING": "Building", "FURNITURE": "Furniture",
    "MACHINERY": "Machinery", "HOUSEHOLD": "Household",
}
MEANS = {"yield_mean": "yield", "dyield_mean": "dyield", "covyield_mean": "covyield"}
IN_VIEW = "(q50 between -0.5 and 0.5 and x between -3 and 3) as in_view"
EFFECT_CTES = {
    "deviation": " union all ".join(
        f"select crop, GEOID, YEAR, '{f}_mean' as family, {r} - avg({r}) over (partition by crop) as dev from prepared"
        for f, r in (("yield", "YIELD"), ("dyield", "dYield"), ("covyield", "covYield"))
    ),
    "effects": "select family, crop, col as term, z as x, min(dev) as q025, avg(dev) as q50, max(dev) as q975 "
    "from scaled join deviation using (crop, GEOID, YEAR) where dev is not null group by family, crop, col, z",
    "crop_names": "select * from (values ('AUTOMOBILE', 'Automobile'), ('BUILDING', 'Building'), ('FURNITURE', 'Furniture'), "
    "('MACHINERY', 'Machinery'), ('HOUSEHOLD', 'Household')) v(crop, Crop_name)",
    "labels": "select * from (values ('LSM_SIDI_ALL', 'Diversity'), ('volume', 'Irrigation Water Volume'), "
    "('fert', 'Fertilizer Expenses'), ('herb', 'Herbicide & Insecticide Expenses'), ('TP', 'Total Precipitation'), "
    "('GDD', 'Growing Degree Days'), ('SDD', 'Stress Degree Days')) v(term, label)",
}


def simple_effects(spark, d) -> DataFrame:
    found = bins(spark, d)
    rows = prepared_stage(spark, d)
    means = settle(rows.groupBy("crop").agg(*[F.avg(r).alias(f"mean_{r}") for r in s.OUTCOMES]))
    terms = sorted({*CURVE_TERMS, *curves.CONTROLS})
    scaled = found.apply(rows, scaled="z_{}", columns=terms).join(means, "crop")
    devs = F.explode(F.array(*[
        F.struct(F.lit(f).alias("family"), (F.col(r) - F.col(f"mean_{r}")).alias("dev")) for f, r in zip(MEANS, s.OUTCOMES, strict=True)
    ]))
    return (
        scaled.select("crop", devs.alias("d"), F.array(*[F.struct(F.lit(c).alias("term"), F.col(f"z_{c}").alias("x")) for c in terms]).alias("pairs"))
        .where("d.dev is not null")
        .select("crop", "d.family", "d.dev", F.explode("pairs").alias("e"))
        .where("e.x is not null")
        .groupBy("family", "crop", F.col("e.term").alias("term"), F.col("e.x").alias("x"))
        .agg(F.min("dev").alias("q025"), F.avg("dev").alias("q50"), F.max("dev").alias("q975"))
        .withColumn("model_id", F.concat_ws("_", "crop", "family"))
    )


def simple_curves(spark, d) -> DataFrame:
    return curves.curves_across_crops(simple_effects(spark, d), MEANS, CURVE_TERMS, crop_labels=SEGMENTS)


@query(
    s.statement(
        "select family, term, label, 'Effect on ' || replace(family, '_mean', '') as effect_on, Crop_name as Crop, "
        + ", ".join(s.r6(c) for c in curves.CURVE)
        + f", {IN_VIEW} from effects join labels using (term) join crop_names using (crop)",
        **EFFECT_CTES,
    )
)
def effect_curves(spark, d):
    return tidy(simple_curves(spark, d))


@query(
    s.statement(
        "select family, term, Crop_name as Crop, "
        + ", ".join(
            [
                s.r6("avg(x)", "mean"),
                s.r6("stddev_samp(x)", "sd"),
                s.r6("avg(x) - stddev_samp(x)", "low"),
                s.r6("avg(x) + stddev_samp(x)", "high"),
            ]
        )
        + " from effects join labels using (term) join crop_names using (crop) group by 1, 2, 3",
        **EFFECT_CTES,
    )
)
def curve_band(spark, d):
    return tidy(curves.curve_bands(simple_curves(spark, d)))


@query(
    s.statement(
        "select " + ", ".join(s.r6(c) for c in curves.CURVE) + " from effects "
        "where crop = 'BUILDING' and term = 'TP' and family = 'yield_mean'",
        **EFFECT_CTES,
    )
)
def smooth_effect(spark, d):
    return tidy(curves.smooth_effect(simple_effects(spark, d), "BUILDING_yield_mean", "TP"))


@query(
    s.statement(
        "select Crop_name as Crop, term as control, upper(family) as Metric, "
        + ", ".join(s.r6(c) for c in curves.CURVE)
        + f", {IN_VIEW} from effects join crop_names using (crop) "
        "where term in ('TP', 'GDD', 'SDD', 'SOIL', 'fert', 'herb', 'volume')",
        **EFFECT_CTES,
    )
)
def control_curves(spark, d):
    return tidy(curves.control_curves(simple_effects(spark, d), list(MEANS), crop_labels=SEGMENTS))


@query(
    s.statement(
        "select g.crop, 'raw' as type, CNTY, g.GEOID, " + s.r6("Mean") + ", " + s.r6("Standard_Deviation") + ", "
        f"cast(5 as integer) as corners, cast(s_suppkey % {a.GRID} as double) as x0, "
        f"cast(s_suppkey // {a.GRID} as double) as y0 "
        "from (select s_suppkey, cast(s_suppkey as varchar) as GEOID, crop from supplier, (select distinct crop from prepared)) g "
        "left join (select crop, GEOID, any_value(CNTY) as CNTY, avg(YIELD) as Mean, "
        "stddev_samp(YIELD) as Standard_Deviation from prepared group by crop, GEOID) e "
        "on e.GEOID = g.GEOID and e.crop = g.crop"
    )
)
def area_effect_map(spark, d):
    rows = prepared_stage(spark, d)
    effects = rows.groupBy("crop", F.col("CNTY").alias("level")).agg(
        F.avg("YIELD").alias("mean"), F.stddev_samp("YIELD").alias("sd")
    ).select("crop", F.lit("raw").alias("family"), F.lit("CNTY").alias("term"), "level", "mean", "sd")
    return shown(maps.area_effect_maps(a.county(spark, d), rows, effects, {"raw": "raw"}))


@query(
    s.statement(
        "select CNTY, g.GEOID, " + s.r6("Mean") + ", " + s.r6("Standard_Deviation") + ", "
        f"cast(5 as integer) as corners, cast(s_suppkey % {a.GRID} as double) as x0, "
        f"cast(s_suppkey // {a.GRID} as double) as y0 "
        "from (select s_suppkey, cast(s_suppkey as varchar) as GEOID from supplier "
        "join nation on s_nationkey = n_nationkey where n_regionkey = 2) g "
        "left join (select GEOID, any_value(CNTY) as CNTY, avg(YIELD) as Mean, "
        "stddev_samp(YIELD) as Standard_Deviation from prepared where crop = 'BUILDING' group by GEOID) e "
        "on e.GEOID = g.GEOID"
    )
)
def area_effect_map_of_state(spark, d):
    """The map of one crop, cut to one state."""
    rows = prepared_stage(spark, d)
    effects = rows.groupBy("crop", F.col("CNTY").alias("level")).agg(
        F.avg("YIELD").alias("mean"), F.stddev_samp("YIELD").alias("sd")
    ).select(F.col("crop").alias("model_id"), F.lit("CNTY").alias("term"), "level", "mean", "sd")
    return shown(maps.area_effect_map(a.county(spark, d), rows, effects, "BUILDING", "BUILDING", 2))


def shown(map_: DataFrame) -> DataFrame:
    """A map with its outlines reduced to their number of corners and first corner."""
    first = F.col("geometry")[0]
    corners = {"corners": F.size("geometry"), "x0": first["x"], "y0": first["y"]}
    return tidy(map_.withColumns(corners).drop("geometry"))


# ---- fitted models ---------------------------------------------------------
# Stated on the rows: each part's effects are shrunk or smoothed group means of
# what the parts before it leave in the column e.


def _part_sql(k: int, by: str) -> dict[str, str]:
    """Group sums, variances and shrunk effects of one part; `by` is its level column in rows."""
    return {
        f"groups{k}": f"select model_id, {by} as lev, count(y) as n, coalesce(sum(e) filter (y is not null), 0) as r "
        f"from rows{k} where {by} is not null group by all",
        f"within{k}": f"select *, greatest(0, rss - ss) / greatest(1, n_rows - groups) as wit from ("
        f"select model_id, sum(r * r / n) filter (n > 0) as ss, count(*) filter (n > 0) as groups, sum(n) as total from groups{k} group by model_id) "
        f"join (select model_id, sum(e * e) filter (y is not null) as rss, count(y) as n_rows from rows{k} group by model_id) using (model_id)",
        f"moments{k}": f"select model_id, groups, wit, coalesce(greatest(0, (ss - groups * wit) / nullif(total, 0)), 0) as btw from within{k}",
    }


def _walk_sql(k: int) -> dict[str, str]:
    """Effects of one smooth term: the tridiagonal system of its levels as recursions over them."""
    return {
        f"chain{k}": "select *, n + lam * (case when i > 1 then 1 else 0 end + case when i < len then 1 else 0 end) as a from ("
        "select *, wit / nullif(btw, 0) as lam from ("
        "select *, greatest(0, coalesce(avg(step) over (partition by model_id), 0)) as btw from ("
        "select model_id, lev, n, r - n * sum(r) over m / sum(n) over m as c, sum(n) over m as total, groups, wit, "
        "row_number() over w as i, count(*) over m as len, "
        "case when n > 0 and lead(n) over w > 0 then pow(r / n - lead(r) over w / lead(n) over w, 2) - wit * (1 / n + 1 / lead(n) over w) end as step "
        f"from groups{k} join within{k} using (model_id) window w as (partition by model_id order by lev), m as (partition by model_id))))",
        f"down{k}": f"select model_id, i, a as d, c as z from chain{k} where i = 1 union all "
        f"select c.model_id, c.i, a - lam * lam / d, c + lam / d * z from down{k} p join chain{k} c on c.model_id = p.model_id and c.i = p.i + 1",
        f"up{k}": f"select model_id, i, a as e from chain{k} where i = len union all "
        f"select c.model_id, c.i, a - lam * lam / e from up{k} p join chain{k} c on c.model_id = p.model_id and c.i = p.i - 1",
        f"chained{k}": f"select c.model_id, c.i, len, lam, d, z from chain{k} c join down{k} d on d.model_id = c.model_id and d.i = c.i",
        f"back{k}": f"select model_id, i, z / d as m from chained{k} where i = len union all "
        f"select c.model_id, c.i, (z + lam * m) / d from back{k} p join chained{k} c on c.model_id = p.model_id and c.i = p.i - 1",
        f"effects{k}": "select c.model_id, lev, n, case when btw > 0 then coalesce(greatest(0, 1 / (d + e - a) - 1 / total), 0) else 0 end as w, "
        f"case when btw > 0 then coalesce(m, 0) else 0 end as mean from chain{k} c join chained{k} d on d.model_id = c.model_id and d.i = c.i "
        f"join up{k} u on u.model_id = c.model_id and u.i = c.i join back{k} b on b.model_id = c.model_id and b.i = c.i",
        f"moments{k}": f"select distinct model_id, groups, wit, btw from chain{k}",
    }


FIT_CTES = {
    **DESIGN_CTES,
    "model_names": "select distinct crop || '_' || family as model_id, crop, family, area from spec, (select distinct crop from prepared)",
    "wide": "select model_id, crop, GEOID, YEAR, any_value(CNTY) as CNTY, any_value(y) as y, "
    + ", ".join(f"max(x) filter (ord = {k}) as l{k}" for k in range(9))
    + " from design group by model_id, crop, GEOID, YEAR",
    "rows_a": "select *, avg(y) over w as m, avg(y) over w as fitted, 1 / count(y) over w as h, y - avg(y) over w as e "
    "from wide window w as (partition by model_id)",
    **_part_sql("_a", "CNTY"),
    "raw_areas": "select model_id, crop, area, lev, n, r, btw, groups, w, w * r as u from ("
    "select g.*, crop, area, btw, groups, case when area = 'factor' then 1 / nullif(n, 0) else coalesce(btw / nullif(btw * n + wit, 0), 0) end as w "
    "from groups_a g join moments_a using (model_id) join model_names using (model_id)) where w is not null",
    "around": "select x.model_id, x.lev, sum(z.u) as u_sum, count(*) as near from raw_areas x join edges on edges.crop = x.crop and edges.i = x.lev "
    "join raw_areas z on z.model_id = x.model_id and z.lev = edges.j where z.n > 0 and x.area <> 'factor' group by all",
    "phis": "select model_id, greatest(0, least(1, coalesce(sum(u * u_sum) / nullif(sum(u * u * near), 0), 0))) as phi "
    "from raw_areas join around using (model_id, lev) where n > 0 group by model_id",
    "areas": "select a.*, case when area <> 'factor' then coalesce(phi, 0) end as phi, "
    "u + case when area = 'factor' then 0 else (1 - n * w) * coalesce(phi * u_sum / near, 0) end as mean "
    "from raw_areas a left join around using (model_id, lev) left join phis using (model_id)",
    "rows0": "select r.* replace (e - coalesce(mean, 0) as e, fitted + coalesce(mean, 0) as fitted, h + coalesce(w, 0) as h) "
    "from rows_a r left join areas on areas.model_id = r.model_id and areas.lev = r.CNTY",
}
for _k in range(9):
    FIT_CTES |= _part_sql(_k, f"l{_k}")
    if _k < 7:
        del FIT_CTES[f"moments{_k}"]  # comes after the chain it reads
        FIT_CTES |= _walk_sql(_k)
    else:
        FIT_CTES[f"effects{_k}"] = (
            "select model_id, lev, n, w, w * r as mean from (select *, coalesce(btw / nullif(btw * n + wit, 0), 0) as w "
            f"from groups{_k} join moments{_k} using (model_id))"
        )
    FIT_CTES[f"rows{_k + 1}"] = (
        "select r.* replace (e - coalesce(mean, 0) as e, fitted + coalesce(mean, 0) as fitted, h + coalesce(w, 0) as h) "
        f"from rows{_k} r left join effects{_k} f on f.model_id = r.model_id and f.lev = r.l{_k}"
    )
FIT_CTES |= {
    "noise": "select model_id, any_value(m) as m, count(y) as n, sum(h) filter (y is not null) as p_eff, "
    "sum(e * e) filter (y is not null) / greatest(1, count(y) - sum(h) filter (y is not null)) as sigma2 from rows9 group by model_id",
    "loo": "select model_id, crop, GEOID, YEAR, y, fitted as mean, sigma2, h, case when y is not null and 1 / h - 1 > 1e-9 then sigma2 / (1 / h - 1) end as v, "
    "(fitted / h - y) / (1 / h - 1) as mu from rows9 join noise using (model_id)",
    "scores0": "select *, sqrt(sigma2 * h) as sd, (y - mu) / sqrt(v + sigma2) as z, "
    "-(y - mu) * (y - mu) / (2 * (v + sigma2)) - ln(sqrt(2 * pi() * (v + sigma2))) as log_cpo, (y - mean) / sqrt(sigma2 * h) as zp from loo",
    "scores": f"select *, exp(log_cpo) as cpo, {phi_sql('z')} as pit0, {phi_sql('zp')} as p0 from scores0",
    "scored": "select * exclude (pit0, p0), case when z is not null then pit0 end as pit, case when zp is not null then p0 end as p_value from scores",
    "term_effects": " union all ".join(f"select model_id, {k} as ord, lev as x, n, w, mean from effects{k}" for k in range(9)),
    "first_areas": "select model_id, min(lev) as lev, min_by(mean, lev) as mean, min_by(w, lev) as w from areas where area = 'factor' group by model_id",
    "fit_table": "select crop, family, model_id, term, x, mean, sqrt(sigma2 * w) as sd from term_effects join model_names using (model_id) "
    "join spec using (family, ord) join noise using (model_id) where term_effects.n > 0 "
    "union all select a.crop, family, model_id, 'CNTY', lev, mean, sqrt(sigma2 * w) from areas a join model_names using (model_id) join noise using (model_id) "
    "where a.area <> 'factor' "
    "union all select a.crop, family, model_id, 'CNTY', a.lev, a.mean - f.mean, sqrt(sigma2 * (a.w + f.w)) from areas a join first_areas f using (model_id) "
    "join model_names using (model_id) join noise using (model_id) where a.lev > f.lev",
    "quantiled": "select *, mean - 1.959964 * sd as q025, mean as q50, mean + 1.959964 * sd as q975 from fit_table",
    "precisions": "select model_id, 'precision of noise' as name, 1 / sigma2 as mean, greatest(1, n - p_eff) as k from noise where sigma2 > 0 "
    "union all select model_id, 'precision of CNTY', 1 / btw, groups from moments_a join model_names using (model_id) where area <> 'factor' and btw > 0 "
    + " ".join(
        f"union all select model_id, 'precision of ' || term, 1 / btw, groups from moments{k} join model_names using (model_id) "
        f"join spec using (family) where ord = {k} and btw > 0"
        for k in range(9)
    ),
    "hyper": "select model_id, name, mean, mean * sqrt(2 / k) as sd, mean * exp(-1.959964 * sqrt(2 / k)) as q025, mean as q50, "
    "mean * exp(1.959964 * sqrt(2 / k)) as q975 from precisions "
    "union all select model_id, 'phi of CNTY', phi, sd, greatest(0, phi - 1.959964 * sd), phi, least(1, phi + 1.959964 * sd) from ("
    "select model_id, max(phi) as phi, sqrt((1 - max(phi) * max(phi)) / count(*) filter (n > 0)) as sd from areas where area <> 'factor' group by model_id)",
    "intercepts": "select model_id, '(Intercept)' as name, m + coalesce(mean, 0) as mean, sqrt(sigma2 * coalesce(w, 1 / n)) as sd "
    "from noise left join first_areas using (model_id)",
}


def fit_sql(tail: str, **extra: str) -> str:
    return s.statement(tail, **FIT_CTES, **extra)


_fits: dict[tuple[str, str, str], fit.Fits] = {}


def fits(spark, d, name: str = "fits", specs=SPECS) -> fit.Fits:
    key = a.stage_key(spark, d, name)
    if key not in _fits:
        areas = a.stage(spark, d, "edges", lambda: edges(spark, d))
        _fits[key] = fit.fit_models(prepared_stage(spark, d), bins(spark, d), areas, specs)
    return _fits[key]


def scored(spark, d) -> DataFrame:
    return a.stage(spark, d, "scored", lambda: fit.score_rows(fits(spark, d)))


def effects(spark, d) -> DataFrame:
    return a.stage(spark, d, "effects", lambda: fit.effect_table(fits(spark, d)))


@query(fit_sql("select model_id, GEOID, YEAR, " + ", ".join(s.r6(c) for c in ("y", "mean", "sd", "log_cpo", "pit", "p_value")) + " from scored"))
def fit_rows(spark, d):
    return tidy(scored(spark, d).select("model_id", "GEOID", "YEAR", "y", "mean", "sd", "log_cpo", "pit", "p_value"))


@query(fit_sql("select model_id, crop, family, term, " + ", ".join(s.r6(c) for c in ("x", "mean", "sd", "q025", "q50", "q975")) + " from quantiled"))
def fit_effects(spark, d):
    return tidy(effects(spark, d).drop("level"))


SUMMARY = ("mean", "sd", "q025", "q50", "q975")
# Precisions reach any size, so that decimals say little: both engines compare them on the scale of asinh.
ASINH_SQL = ", ".join(s.r6(f"asinh({c})", f"asinh_{c}") for c in SUMMARY)


def asinh_columns(table: DataFrame) -> DataFrame:
    return tidy(table.select("model_id", "name", *[F.asinh(c).alias(f"asinh_{c}") for c in SUMMARY]))


@query(fit_sql(f"select model_id, name, {ASINH_SQL} from hyper"))
def fit_hyper(spark, d):
    return asinh_columns(fit.hyper_table(fits(spark, d)))


FIT_SUMS = (
    "count(y) * ln(2 * pi() * max(sigma2)) + sum((y - mean) * (y - mean)) / max(sigma2) + 2 * sum(h) filter (y is not null)"
)


@query(
    fit_sql(
        f"select model_id, count(y) as n, {s.r6('sum(h) filter (y is not null)', 'p_eff')}, {s.r6(FIT_SUMS, 'dic')} from scored group by model_id"
    )
)
def fit_model(spark, d):
    return tidy(fit.model_fit(scored(spark, d), ["model_id"]))


@query(
    fit_sql(
        "select model_id, count(*) as n_rows, count(y) as n, "
        + ", ".join([
            s.r6(FIT_SUMS, "dic"),
            s.r6("sum(log_cpo)", "cpo"),
            s.r6("sum((y - mean) * (y - mean)) / count(*)", "mse"),
            s.r6("sum((y - mean) * (y - mean)) / count(y)", "mse_obs"),
            s.r6("avg(p_value)", "mean_p_value"),
            s.r6("sum((mean - yb) * (mean - yb)) filter (y is not null) / sum((y - yb) * (y - yb))", "r2"),
        ])
        + " from (select *, avg(y) over (partition by model_id) as yb from scored) group by model_id"
    )
)
def fit_diagnostics(spark, d):
    rows = scored(spark, d)
    return tidy(diagnostics.compare_models(rows, fit.model_fit(rows, ["model_id"])))


@query(
    fit_sql(
        f"select model_id, name, {ASINH_SQL} from ("
        "select model_id, name, mean, sd, mean - 1.959964 * sd as q025, mean as q50, mean + 1.959964 * sd as q975 from intercepts "
        "union all select * from hyper)"
    )
)
def fit_parameter_summary(spark, d):
    found = fits(spark, d)
    return asinh_columns(diagnostics.parameter_summary(fit.intercept_table(found), fit.hyper_table(found)))


# The report's families with an area effect of two parts, in their default form.
BYM_SPECS = [
    spec.model(f"{m.family.removesuffix('_fe')}_bymd", m.response, m.smooths[-1], m.smooths[:-1], "bym", "default") for m in SPECS if m.area == "factor"
]


def _bym_ctes() -> dict[str, str]:
    out = {}
    for name, text in FIT_CTES.items():
        if name == "spec":
            text = text.replace("('fe', 'factor'), ('bym', 'bym2')", "('bymd', 'bym')")
        if name == "areas":
            out["chain_ends"] = (
                "select model_id, crop, lev, n, r, wit, btw, groups, r / nullif(n, 0) as y from groups_a join moments_a using (model_id) join model_names using (model_id)"
            )
            out["chain_links"] = (
                "select x.model_id, x.lev, z.lev as beside, x.y * z.y as product from chain_ends x join edges e on e.crop = x.crop and e.i = x.lev "
                "join chain_ends z on z.model_id = x.model_id and z.lev = e.j"
            )
            out["chain_base"] = (
                "select *, coalesce(1 / nullif(v + wit / nullif(n, 0), 0), 0) as q from (select *, btw - s2 as v from ("
                "select e.*, coalesce(d, 0) as d, greatest(0, least(btw, coalesce(c, 0))) as s2 from chain_ends e "
                "left join (select model_id, avg(product) as c from chain_links group by all) using (model_id) "
                "left join (select model_id, lev, count(*) as d from chain_links group by all) using (model_id, lev)))"
            )
            out["chain_field0"] = "select model_id, lev, 0.0::double as s from chain_base"
            for k in range(12):
                out[f"chain_field{k + 1}"] = (
                    "select b.model_id, b.lev, case when s2 > 0 then (q * coalesce(y, 0) + coalesce(near, 0) / s2) / (q + (d + 1) / s2) else 0 end as s "
                    "from chain_base b left join (select l.model_id, l.lev, sum(s) as near from chain_links l "
                    f"join chain_field{k} f on f.model_id = l.model_id and f.lev = l.beside group by all) using (model_id, lev)"
                )
            text = (
                "select model_id, crop, 'bym' as area, lev, n, r, s + coalesce(v / nullif(v + wit / nullif(n, 0), 0) * (y - s), 0) as mean, "
                "case when n > 0 then least(ww, 1 / n) else ww end as w, coalesce(s2 / nullif(btw, 0), 0) as phi from ("
                "select *, coalesce((case when s2 > 0 then 1 / (q + (d + 1) / s2) else 0 end + coalesce(v * wit / nullif(v * n + wit, 0), 0)) / nullif(wit, 0), 0) as ww "
                "from chain_base join chain_field12 using (model_id, lev))"
            )
        out[name] = text
    return out


@query(
    s.statement(
        "select model_id, term, x, " + ", ".join(s.r6(c) for c in ("mean", "sd", "q025", "q975")) + ", "
        + s.r6("phi") + " from quantiled join (select model_id, max(phi) as phi from areas group by model_id) using (model_id) where term = 'CNTY'",
        **_bym_ctes(),
    )
)
def fit_bym(spark, d):
    """Area effects with an independent and a structured part, and the structured share of their variance."""
    found = fits(spark, d, "bym fits", BYM_SPECS)
    effects_ = fit.effect_table(found).where("term = 'CNTY'").join(found.models.select("model_id", "phi"), "model_id")
    return tidy(effects_.select("model_id", "term", "x", "mean", "sd", "q025", "q975", "phi"))


DEPENDENTS = {m.family: m.family.split("_")[0] for m in SPECS}
FIT_TERMS = sorted({c for m in SPECS for c in m.smooths})


@query(
    fit_sql(
        "select family, term, label, 'Effect on ' || split_part(family, '_', 1) as effect_on, Crop_name as Crop, "
        + ", ".join(s.r6(c) for c in curves.CURVE)
        + f", {IN_VIEW} from quantiled join all_labels using (term) join crop_names using (crop)",
        crop_names=EFFECT_CTES["crop_names"],
        all_labels="select * from (values ('LSM_SIDI_ALL', 'Diversity'), ('volume', 'Irrigation Water Volume'), "
        "('fert', 'Fertilizer Expenses'), ('herb', 'Herbicide & Insecticide Expenses'), ('TP', 'Total Precipitation'), "
        "('GDD', 'Growing Degree Days'), ('SDD', 'Stress Degree Days'), ('dSIDI', 'Change in Diversity'), "
        "('aveSIDI2yr', 'Average Diversity (2 years)'), ('aveSIDI3yr', 'Average Diversity (3 years)'), "
        "('dfert', 'Change in Fertilizer'), ('dherb', 'Change in Herbicide & Insecticide'), "
        "('dVol', 'Change in Irrigation Water Volume'), ('dTP', 'Change in Total Precipitation'), "
        "('dGDD', 'Change in Growing Degree Days'), ('dSDD', 'Change in Stress Degree Days'), "
        "('covSIDI', 'Coefficient of Variation ' || chr(10) || ' for Diversity'), "
        "('covfert', 'Coefficient of Variation ' || chr(10) || ' for Fertlizer'), "
        "('covherb', 'Coefficient of Variation ' || chr(10) || ' for Herbicide & Insecticide'), "
        "('covVol', 'Coefficient of Variation ' || chr(10) || ' for Irrigation Water Volume'), "
        "('covTP', 'Coefficient of Variation ' || chr(10) || ' for Total Precipiation'), "
        "('covGDD', 'Coefficient of Variation ' || chr(10) || ' for Growing Degree Days'), "
        "('covSDD', 'Coefficient of Variation ' || chr(10) || ' for Stress Degree Days')) v(term, label)",
    )
)
def fit_curves(spark, d):
    """Curves of all terms of all ten families."""
    return tidy(curves.curves_across_crops(effects(spark, d), DEPENDENTS, FIT_TERMS, crop_labels=SEGMENTS))


@query(
    fit_sql(
        "select Crop_name as Crop, term as control, upper(family) as Metric, "
        + ", ".join(s.r6(c) for c in curves.CURVE)
        + f", {IN_VIEW} from quantiled join crop_names using (crop) where term in ('TP', 'GDD', 'SDD', 'SOIL', 'fert', 'herb', 'volume')",
        crop_names=EFFECT_CTES["crop_names"],
    )
)
def fit_control_curves(spark, d):
    return tidy(curves.control_curves(effects(spark, d), list(DEPENDENTS), crop_labels=SEGMENTS))


@query(
    fit_sql(
        "select g.crop, g.type, CNTY, g.GEOID, " + s.r6("q.mean", "Mean") + ", " + s.r6("q.sd", "Standard_Deviation") + ", "
        f"cast(5 as integer) as corners, cast(s_suppkey % {a.GRID} as double) as x0, cast(s_suppkey // {a.GRID} as double) as y0 "
        "from (select s_suppkey, cast(s_suppkey as varchar) as GEOID, crop, family as type, family as fam "
        "from supplier, (select distinct crop from prepared), (select distinct family from spec)) g "
        "left join (select distinct crop, GEOID, CNTY from prepared) p on p.crop = g.crop and p.GEOID = g.GEOID "
        "left join quantiled q on q.crop = g.crop and q.family = g.fam and q.term = 'CNTY' and q.x = p.CNTY"
    )
)
def fit_area_map(spark, d):
    """Maps of the area effects of all ten families, spatial and free, for every crop."""
    families = {m.family: m.family for m in SPECS}
    return shown(maps.area_effect_maps(a.county(spark, d), prepared_stage(spark, d), effects(spark, d), families))
