"""Closed-form estimates of all models of a specification, as Spark aggregates.

A model is a sum of parts: the mean, one effect per area, and one effect per level
of each term, in the order of the specification.  The parts are estimated one after
the other from what the earlier ones leave:

* the sum r of what is left over the n rows of a group gives the effect r / (n + l),
  the mean of the group shrunk by l = W / B, the variance within groups over that
  between them.  Both are moment estimates: W is the sum of squares within groups over
  n - (groups), B is (sum of r^2 / n - (groups) W) / n, or 0 if that is negative;
* the levels of a smooth term (``rw1``) are a first-order random walk: the effects m, of
  mean 0 over the rows, minimise the sum of n (m - r / n)^2 plus l times the squared
  differences of neighbouring levels, with l = W / T.  T, the variance of a step, is the
  mean over neighbouring levels of the squared difference of their means less W times
  the sum of their 1 / n, or 0 if that is negative; without it all effects are 0.  The
  tridiagonal system has at most 21 levels and is solved by one pass in each direction;
* free area levels (``factor``) and slopes (``linear``) are not shrunk;
* spatial area effects (``bym2``) are shrunk towards phi times the mean effect of the
  area's neighbours instead of 0, phi being the slope of an area's effect on its
  neighbours', between 0 and 1.  An area without observations gets that;
* ``bym`` areas have two parts with a variance each.  The variance S of the structured
  part is the mean product of the means of neighbouring areas, between 0 and B, and that
  of the independent part is V = B - S.  The structured part is a field that starts at 0
  and is averaged ``SWEEPS`` times: an area's value becomes (q r / n + the sum of its
  d neighbours' values / S) / (q + (d + 1) / S) with q = 1 / (V + W / n), or 0 without
  observations.  One sweep shrinks what is left to do by d / (d + 1) at least.  The
  independent part is what the field leaves, shrunk by V / (V + W / n), and phi is S / B;
* the noise variance is what is left in the end over n - p, p being 1 plus the sum of
  n w of all groups, where w is 1 / (n + l), or the entry of a smooth term's inverse.
  Given the variances, an effect has the variance noise times w, and those of one row
  are added up.

Parts are estimated once and in order, so correlated terms share what they explain in
that order, and the variances of one row leave out the covariances between parts.

This is the engine's own estimate, not that of an integrating solver; the priors of a
specification do not enter it.  Everything after the design rows is stated in grouped
sums: one scan for X'X, X'y and y'y, one for the area sums, and then small joins, so
any number of areas and rows is fitted without gathering a model anywhere.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fallow.functions.scalars import normal_cdf
from fallow.operators.binning import QuantileBins
from fallow.plans import design as dg
from fallow.plans.spec import SD_FACTOR, ModelSpec
from fallow.session import settle, unsent

MODEL = ["model_id", "crop", "family"]
Z975 = 1.959964
SWEEPS = 12
STORED = 4  # sweeps from one stored field to the next
RSS, P_EFF = -1, -2  # beside the positions of levels


@dataclass
class Fits:
    """Results of one run; every member is a stored table."""

    rows: DataFrame  # design rows
    models: DataFrame  # (MODEL, design_id, area, n, m, sigma2, p_eff, phi)
    areas: DataFrame  # (MODEL, CNTY, n, mean, w): area effects, w = 1 / (n + l)
    levels: DataFrame  # (MODEL, ord, term, level, pos, x, n, mean, w): effects of levels and slopes
    parts: DataFrame  # (MODEL, ord, term, groups, within, between), the area at ord -1


def prior_scale(prepared: DataFrame) -> DataFrame:
    """Scale of the smooth terms' priors per crop: sd(YIELD) / 0.31."""
    return prepared.groupBy("crop").agg(
        (F.stddev_samp("YIELD") / SD_FACTOR).alias("scale"),
        F.count(F.lit(1)).alias("n"),
    )


def _variances(groups: DataFrame, left: DataFrame) -> DataFrame:
    """(model_id, groups, within, between) from groups (model_id, n, r) and what is left (model_id, n_rows, rss)."""
    seen = F.col("n") > 0
    sums = groups.groupBy("model_id").agg(
        F.count(F.when(seen, 1)).alias("groups"),
        F.sum("n").alias("n"),
        F.sum(F.when(seen, F.col("r") * F.col("r") / F.col("n"))).alias("ss"),
    )
    within = F.greatest(F.lit(0.0), F.col("rss") - F.col("ss")) / F.greatest(F.lit(1.0), F.col("n_rows") - F.col("groups"))
    between = F.greatest(F.lit(0.0), F.try_divide(F.col("ss") - F.col("groups") * F.col("within"), F.col("n")))
    return (
        sums.join(left, "model_id").withColumn("within", within)
        .select("model_id", "groups", "within", F.coalesce(between, F.lit(0.0)).alias("between"))
    )


def _shrunk() -> Column:
    """1 / (n + within / between), 0 without variance between groups."""
    return F.coalesce(F.try_divide("between", F.col("between") * F.col("n") + F.col("within")), F.lit(0.0))


def _shrunk_levels(own: DataFrame, squares: DataFrame) -> DataFrame:
    """Levels with their effect ``mean`` and ``w``: independent ones shrunk, slopes free."""
    free = F.col("kind") == "linear"
    effects = own.join(_variances(own, squares), "model_id").withColumn("between", F.when(free, 0.0).otherwise(F.col("between")))
    w = F.when(free, F.coalesce(F.try_divide(F.lit(1.0), F.col("n")), F.lit(0.0))).otherwise(_shrunk())
    return effects.withColumn("w", w).withColumn("mean", F.col("w") * F.col("r"))


def _pivots(levels: Column, penalty: Column) -> Column:
    """Pivots of a tridiagonal elimination from the first of ``levels`` on; their diagonal is ``a``."""
    def add(done: Column, e: Column) -> Column:
        before = F.coalesce(F.try_divide(penalty * penalty, F.try_element_at(done, F.lit(-1))), F.lit(0.0))
        return F.concat(done, F.array(e["a"] - before))

    return F.aggregate(levels, F.expr("cast(array() as array<double>)"), add)


def _smooth_levels(own: DataFrame, squares: DataFrame) -> DataFrame:
    """Levels of smooth terms with their effect ``mean`` and ``w``, smoothed along the levels of each model.

    One short list per model, at most one entry per bin; array expressions, no Python.
    """
    empty = F.expr("cast(array() as array<double>)")
    listed = F.array_sort(F.collect_list(F.struct("level", "pos", "x", "n", "r"))).alias("g")
    lists = own.groupBy("model_id", "design_id", "ord", "term").agg(listed, F.sum("n").alias("rows"), F.sum("r").alias("all"))
    lists = lists.join(squares, "model_id").withColumn("seen", F.filter("g", lambda e: e["n"] > 0)).withColumn("groups", F.size("seen").cast("long"))
    explained = F.aggregate("seen", F.lit(0.0), lambda t, e: t + e["r"] * e["r"] / e["n"])
    within = F.greatest(F.lit(0.0), F.col("rss") - explained) / F.greatest(F.lit(1.0), F.col("n_rows") - F.col("groups"))
    lists = lists.withColumn("within", within).drop("seen", "rss", "n_rows")
    pair = lambda e, f: F.when((e["n"] > 0) & (f["n"] > 0), F.pow(e["r"] / e["n"] - f["r"] / f["n"], 2) - F.col("within") * (1 / e["n"] + 1 / f["n"]))
    steps = F.array_compact(F.transform(F.sequence(F.lit(2), F.size("g")), lambda i: pair(F.element_at("g", i - 1), F.element_at("g", i))))
    lists = lists.withColumn("steps", F.when(F.size("g") > 1, steps).otherwise(empty))
    variance = F.try_divide(F.aggregate("steps", F.lit(0.0), lambda t, e: t + e), F.size("steps"))
    lists = lists.withColumn("between", F.greatest(F.lit(0.0), F.coalesce(variance, F.lit(0.0))))
    lists = lists.withColumn("penalty", F.try_divide("within", "between"))

    def equation(e: Column, i: Column) -> Column:
        beside = F.when(i > 0, 1).otherwise(0) + F.when(i < F.size("g") - 1, 1).otherwise(0)
        rest = e["r"] - e["n"] * F.try_divide("all", "rows")
        return F.struct((e["n"] + F.col("penalty") * beside).alias("a"), rest.alias("rest"))

    lists = lists.withColumn("s", F.transform("g", equation))
    lists = lists.withColumn("down", _pivots(F.col("s"), F.col("penalty"))).withColumn("up", F.reverse(_pivots(F.reverse("s"), F.col("penalty"))))

    def forward(done: Column, e: Column) -> Column:
        pivot = F.get("down", F.size(done) - 1)
        carried = F.coalesce(F.try_divide(F.col("penalty"), pivot) * F.try_element_at(done, F.lit(-1)), F.lit(0.0))
        return F.concat(done, F.array(e["rest"] + carried))

    def back(done: Column, e: Column) -> Column:
        carried = F.col("penalty") * F.coalesce(F.get(done, F.lit(0)), F.lit(0.0))
        return F.concat(F.array(F.try_divide(e["z"] + carried, e["down"])), done)

    lists = lists.withColumn("z", F.aggregate("s", empty, forward))
    lists = lists.withColumn("m", F.aggregate(F.reverse(F.arrays_zip("z", "down")), empty, back))
    inverse = F.try_divide(F.lit(1.0), F.col("e.down") + F.col("e.up") - F.col("e.s.a")) - 1 / F.col("rows")
    each = lists.select(
        "model_id", "design_id", "ord", "term", "groups", "within", "between", "rows", F.explode(F.arrays_zip("g", "s", "m", "down", "up")).alias("e")
    )
    return each.select(
        "model_id", "design_id", "ord", "term", "groups", "within", "between", "e.g.level", "e.g.pos", "e.g.x", "e.g.n", "e.g.r",
        F.when(F.col("between") > 0, F.coalesce("e.m", F.lit(0.0))).otherwise(0.0).alias("mean"),
        F.when(F.col("between") > 0, F.greatest(F.lit(0.0), F.coalesce(inverse, F.lit(0.0)))).otherwise(0.0).alias("w"),
    )


def fit_models(prepared: DataFrame, bins: QuantileBins, edges: DataFrame, specs: Sequence[ModelSpec]) -> Fits:
    """Fit every (crop, family); ``prepared`` and ``edges`` (crop, i, j) should be stored tables."""
    years = dg.year_range(prepared)
    rows = settle(dg.design_rows(prepared, bins, specs, years))
    names = settle(dg.level_table(bins, specs, years))
    products = settle(dg.gram(rows))
    keys = settle(dg.model_table(prepared, specs))

    def entry(i: int, j: int) -> Column:
        return F.max(F.when((F.col("i") == i) & (F.col("j") == j), F.col("v")))

    totals = products.where("i <= 0 and j <= 0").groupBy("design_id").agg(
        entry(0, 0).alias("n"), entry(dg.RESPONSE, 0).alias("y"), entry(dg.RESPONSE, dg.RESPONSE).alias("yy")
    )
    mean = F.col("y") / F.col("n")
    start = settle(keys.join(totals, "design_id").select(
        *MODEL, "design_id", "area", F.col("n").alias("n_rows"), mean.alias("m"), (F.col("yy") - F.col("y") * mean).alias("rss")
    ))

    areas, parts, left = _area_effects(rows, start, edges, specs)
    remaining = _after_areas(rows, products, start, areas)
    both = products.where("i >= 0")
    both = settle(both.unionByName(both.where("i < j").select("design_id", F.col("j").alias("i"), F.col("i").alias("j"), "v")))
    at_level = both.where("i = j").select("design_id", F.col("i").alias("pos"), F.col("v").alias("n"))
    names = settle(names.join(at_level, ["design_id", "pos"], "left").fillna(0.0, ["n"]))

    # What a part leaves, in one table: r by position, and by model the squares left (at RSS) and the effective parameters (at P_EFF).
    state = settle(remaining.unionByName(left.select("model_id", F.explode(F.array(
        F.struct(F.lit(RSS).alias("pos"), F.col("rss").alias("r")), F.struct(F.lit(P_EFF).alias("pos"), F.col("p_eff").alias("r")),
    )).alias("s")).select("model_id", "s.*")))
    sizes = settle(start.select("model_id", "design_id", "n_rows"))
    done, found = [], [parts]
    for k in range(max(len(m.terms) for m in specs)):
        own = names.where(F.col("ord") == k).join(sizes, "design_id").join(state, ["model_id", "pos"], "left").fillna(0.0, ["r"])
        kinds = {m.terms[k].kind for m in specs if len(m.terms) > k}
        squares = state.where(F.col("pos") == RSS).select("model_id", F.col("r").alias("rss")).join(sizes.drop("design_id"), "model_id")
        columns = ["model_id", "design_id", "ord", "term", "level", "pos", "x", "n", "r", "mean", "w", "groups", "within", "between"]
        estimated = []
        if "rw1" in kinds:
            estimated.append(_smooth_levels(own.where("kind = 'rw1'"), squares).select(columns))
        if kinds - {"rw1"}:
            estimated.append(_shrunk_levels(own.where("kind <> 'rw1'"), squares).select(columns))
        effects = settle(_stacked(estimated))
        done.append(effects.select("model_id", "ord", "term", "level", "pos", "x", "n", "mean", "w"))
        found.append(effects.select("model_id", "ord", "term", "groups", "within", "between").distinct())
        step = effects.select("model_id", "design_id", F.col("pos").alias("j"), "mean")
        taken = both.join(step, ["design_id", "j"]).groupBy("model_id", F.col("i").alias("pos")).agg(F.sum(F.col("v") * F.col("mean")).alias("taken"))
        used = effects.groupBy("model_id").agg(
            F.sum(2 * F.col("mean") * F.col("r") - F.col("n") * F.col("mean") * F.col("mean")).alias("squares"),
            F.sum(-F.col("n") * F.col("w")).alias("parameters"),
        )
        used = used.select("model_id", F.explode(F.array(
            F.struct(F.lit(RSS).alias("pos"), F.col("squares").alias("taken")), F.struct(F.lit(P_EFF).alias("pos"), F.col("parameters").alias("taken")),
        )).alias("s")).select("model_id", "s.*")
        state = settle(state.join(taken.unionByName(used), ["model_id", "pos"], "left").select(
            "model_id", "pos", (F.col("r") - F.coalesce("taken", F.lit(0.0))).alias("r")
        ))
    left = sizes.drop("design_id")
    for pos, name in ((RSS, "rss"), (P_EFF, "p_eff")):
        left = left.join(state.where(F.col("pos") == pos).select("model_id", F.col("r").alias(name)), "model_id")

    phi = areas.groupBy("model_id").agg(F.max("phi").alias("phi"))
    sigma2 = F.greatest(F.lit(0.0), F.col("rss")) / F.greatest(F.lit(1.0), F.col("n_rows") - F.col("p_eff"))
    models = start.drop("rss", "n_rows").join(left, "model_id").join(phi, "model_id", "left").select(
        *MODEL, "design_id", "area", F.col("n_rows").alias("n"), "m", sigma2.alias("sigma2"), "p_eff", "phi"
    )
    named = keys.select(*MODEL)
    levels = settle(_stacked(done).join(named, "model_id"))
    return Fits(rows, settle(models), areas, levels, settle(_stacked(found).join(named, "model_id")))


def _stacked(tables: Sequence[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _by_area(long: DataFrame, families: Sequence[str], values: Sequence[str]) -> DataFrame:
    """(crop, CNTY, one column ``<value>_<k>`` per value and family): the models of a crop side by side."""
    own = [F.max(F.when(F.col("family") == f, F.col(v))).alias(f"{v}_{k}") for v in values for k, f in enumerate(families)]
    return long.groupBy("crop", "CNTY").agg(*own)


def _by_model(wide: DataFrame, keys: Sequence[str], families: Sequence[str], values: Sequence[str]) -> DataFrame:
    """(model_id, keys, values) of a table with a column per value and family."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("family"), *[F.col(f"{v}_{k}").alias(v) for v in values]) for k, f in enumerate(families)]))
    return wide.select("crop", *keys, each.alias("m")).select(dg.key("m.family").alias("model_id"), *keys, *[f"m.{v}" for v in values])


def _two_part_areas(own: DataFrame, moments: DataFrame, edges: DataFrame, families: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Effects of ``bym`` areas (columns of ``own`` and mean, w, phi), and the variances of their two parts.

    ``own`` (MODEL, design_id, area, CNTY, n, r), ``moments`` and ``edges`` are stored; ``families`` are the
    models of a crop.  The fields of a crop's models lie side by side, so that a sweep is one join of the
    links with the field, for all models at once, reduced by partial aggregation.  ``STORED`` sweeps are one
    plan: links and areas are shuffled once for them, and behind a sweep only the sums around areas are.
    Where a model has no structured part its field is zeros, whose files are small; tables of many areas are
    therefore met by merge joins.
    """
    base = own.where("area = 'bym'").join(moments.select("model_id", "within", "between", "groups"), "model_id")
    base = settle(base.withColumn("y", F.when(F.col("n") > 0, F.col("r") / F.col("n"))).withColumn("here", F.lit(1)))
    links = edges.select("crop", F.col("i").alias("CNTY"), "j")
    each = range(len(families))
    ends = settle(_by_area(base, families, ["y", "here"]))
    areas = ends.count()

    def around(field: DataFrame, sums: Sequence[Column]) -> DataFrame:
        return links.join(unsent(field.withColumnRenamed("CNTY", "j"), areas), ["crop", "j"]).groupBy("crop", "CNTY").agg(*sums)

    beside = settle(unsent(ends, areas).join(around(ends, [
        agg(f"{v}_{k}").alias(f"{name}_{k}") for k in each for name, agg, v in (("sum", F.sum, "y"), ("seen", F.count, "y"), ("d", F.count, "here"))
    ]), ["crop", "CNTY"]))
    pairs = [F.sum(F.when(F.col(f"y_{k}").isNotNull(), F.col(f"seen_{k}"))) for k in each]
    product = beside.groupBy("crop").agg(*[F.try_divide(F.sum(F.col(f"y_{k}") * F.col(f"sum_{k}")), pairs[k]).alias(f"product_{k}") for k in each])
    product = settle(_by_model(product, [], families, ["product"]))
    degree = _by_model(beside, ["CNTY"], families, ["d"])
    shared = F.greatest(F.lit(0.0), F.least(F.col("between"), F.coalesce("product", F.lit(0.0))))
    models = areas * len(families)
    base = base.join(product, "model_id", "left").join(unsent(degree, models), ["model_id", "CNTY"], "left").fillna(0, ["d"])
    base = base.withColumn("structured", shared).withColumn("free", F.col("between") - F.col("structured"))
    spread = F.col("free") + F.try_divide("within", "n")
    base = settle(base.withColumn("q", F.coalesce(F.try_divide(F.lit(1.0), spread), F.lit(0.0))))

    stiff = F.try_divide(F.lit(1.0), "structured")  # missing without a structured part, whose field stays 0
    weight = F.col("q") + (F.col("d") + 1) * stiff
    steps = base.select("crop", "family", "CNTY", (F.col("q") * F.coalesce("y", F.lit(0.0)) / weight).alias("own"), (stiff / weight).alias("pull"))
    steps = settle(_by_area(steps, families, ["own", "pull"]))
    # The first sweep finds zeros around every area.
    field = steps.select("crop", "CNTY", *[F.coalesce(f"own_{k}", F.lit(0.0)).alias(f"s_{k}") for k in each])
    for sweep in range(1, SWEEPS):
        near = around(field, [F.sum(f"s_{k}").alias(f"near_{k}") for k in each])
        value = [F.coalesce(F.col(f"own_{k}") + F.coalesce(f"near_{k}", F.lit(0.0)) * F.col(f"pull_{k}"), F.lit(0.0)).alias(f"s_{k}") for k in each]
        field = steps.join(unsent(near, areas), ["crop", "CNTY"], "left").select("crop", "CNTY", *value)
        if sweep % STORED == 0 or sweep == SWEEPS - 1:
            field = settle(field)
    field = _by_model(field, ["CNTY"], families, ["s"])
    rest = F.coalesce(F.try_divide("free", spread) * (F.col("y") - F.col("s")), F.lit(0.0))
    of_field = F.coalesce(1 / (F.col("q") + (F.col("d") + 1) * stiff), F.lit(0.0))
    of_rest = F.coalesce(F.try_divide(F.col("free") * F.col("within"), F.col("free") * F.col("n") + F.col("within")), F.lit(0.0))
    w = F.coalesce(F.try_divide(of_field + of_rest, "within"), F.lit(0.0))
    effects = base.join(unsent(field, models), ["model_id", "CNTY"]).withColumn("w", F.when(F.col("n") > 0, F.least(w, 1 / F.col("n"))).otherwise(w))
    phi = F.coalesce(F.try_divide("structured", "between"), F.lit(0.0))
    effects = effects.select(*own.columns, (F.col("s") + rest).alias("mean"), "w", phi.alias("phi"))
    both = F.explode(F.array(
        F.struct(F.lit("CNTY").alias("term"), F.col("free").alias("between")), F.struct(F.lit("CNTY structured").alias("term"), F.col("structured").alias("between")),
    ))
    variances = base.select("model_id", "groups", "within", both.alias("v")).distinct().select("model_id", "v.term", "groups", "within", "v.between")
    return effects, variances


def _near_sums(spatial: DataFrame, edges: DataFrame, families: Sequence[str]) -> DataFrame:
    """(model_id, CNTY, u_sum, near): sum and number of the neighbours' ``u``, where an area has any."""
    if not families:
        return spatial.select("model_id", "CNTY", F.col("u").alias("u_sum"), F.lit(0).cast("long").alias("near")).limit(0)
    near = _by_area(spatial, families, ["u"]).withColumnRenamed("CNTY", "j")
    sums = [agg(f"u_{k}").alias(f"{name}_{k}") for k in range(len(families)) for name, agg in (("u_sum", F.sum), ("near", F.count))]
    around = edges.select("crop", F.col("i").alias("CNTY"), "j").join(near, ["crop", "j"]).groupBy("crop", "CNTY").agg(*sums)
    return _by_model(around, ["CNTY"], families, ["u_sum", "near"]).where("near > 0")


def _area_effects(rows: DataFrame, start: DataFrame, edges: DataFrame, specs: Sequence[ModelSpec]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Area effects, their moments, and what they leave of each model."""
    sums = dg.area_table(rows).where(F.col("CNTY").isNotNull())
    own = sums.join(start.drop("rss", "n_rows"), "design_id")
    own = settle(own.select(*MODEL, "design_id", "area", "CNTY", "n", (F.col("sum_y") - F.col("m") * F.col("n")).alias("r")))
    moments = settle(_variances(own, start.select("model_id", "n_rows", "rss")))
    free = F.try_divide(F.lit(1.0), F.col("n"))
    raw = own.where("area <> 'bym'").join(moments, "model_id").withColumn("w", F.when(F.col("area") == "factor", free).otherwise(_shrunk()))
    raw = settle(raw.where(F.col("w").isNotNull()).withColumn("u", F.col("w") * F.col("r")))

    spatial = raw.where("area = 'bym2'")
    families = [m.family for m in specs if m.area == "bym2"]
    around = settle(_near_sums(spatial.where("n > 0"), edges, families))
    slope = F.try_divide(F.sum(F.col("u") * F.col("u_sum")), F.sum(F.col("u") * F.col("u") * F.col("near")))
    phi = spatial.where("n > 0").join(around, ["model_id", "CNTY"]).groupBy("model_id").agg(slope.alias("phi"))
    phi = settle(phi.select("model_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("phi", F.lit(0.0)))).alias("phi")))
    towards = F.coalesce(F.col("phi") * F.col("u_sum") / F.col("near"), F.lit(0.0))
    areas = (
        raw.join(around, ["model_id", "CNTY"], "left").join(phi, "model_id", "left")
        .withColumn("phi", F.when(F.col("area") != "factor", F.coalesce("phi", F.lit(0.0))))
        .withColumn("mean", F.col("u") + F.when(F.col("area") == "factor", 0.0).otherwise((1 - F.col("n") * F.col("w")) * towards))
    )
    columns = [*MODEL, "design_id", "CNTY", "n", "r", "mean", "w", "phi"]
    areas, variances = areas.select(columns), moments.select("model_id", F.lit("CNTY").alias("term"), "groups", "within", "between")
    two_parts = [m.family for m in specs if m.area == "bym"]
    if two_parts:
        own_effects, own_variances = _two_part_areas(own, moments, edges, two_parts)
        areas = areas.unionByName(own_effects.select(columns))
        variances = variances.join(own_variances.select("model_id").distinct(), "model_id", "left_anti").unionByName(own_variances)
    areas = settle(areas)
    used = areas.groupBy("model_id").agg(
        F.sum(F.col("n") * F.col("mean") * F.col("mean") - 2 * F.col("mean") * F.col("r")).alias("rss_step"),
        F.sum(F.col("n") * F.col("w")).alias("p_step"),
    )
    left = start.join(used, "model_id", "left").select(
        "model_id", "n_rows",
        (F.col("rss") + F.coalesce("rss_step", F.lit(0.0))).alias("rss"),
        (1 + F.coalesce("p_step", F.lit(0.0))).alias("p_eff"),
    )
    parts = settle(variances.select(F.lit(-1).alias("ord"), "term", "model_id", "groups", "within", "between"))
    return areas, parts, settle(left)


def _after_areas(rows: DataFrame, products: DataFrame, start: DataFrame, areas: DataFrame) -> DataFrame:
    """(model_id, pos, r): sum over a level's rows of the response minus mean and area effect."""
    response = products.where(f"i = {dg.RESPONSE} and j > 0").select("design_id", F.col("j").alias("pos"), F.col("v").alias("y"))
    counts = products.where("i = 0 and j > 0").select("design_id", F.col("j").alias("pos"), F.col("v").alias("n"))
    given = response.join(counts, ["design_id", "pos"]).join(start.select("model_id", "design_id", "m"), "design_id")
    taken = dg.area_effect_sums(rows, areas).where("pos > 0")
    return settle(given.join(taken, ["model_id", "pos"], "left").select(
        "model_id", "pos", (F.col("y") - F.col("m") * F.col("n") - F.coalesce("taken", F.lit(0.0))).alias("r")
    ))


def score_rows(fits: Fits) -> DataFrame:
    """Fitted mean and sd per row, with leave-one-out and posterior checks.

    For observed rows: ``cpo`` is the density of y given all other rows, ``log_cpo`` its logarithm, ``pit``
    the matching distribution function, ``p_value`` the distribution function of the row's fitted value at
    y.  They are missing where y is.  The level effects of a model are one row with one value per position;
    rows are never shuffled to meet them.
    """
    last = fits.levels.agg(F.max("pos")).first()[0] or 0
    by_pos = F.map_from_entries(F.collect_list(F.struct("pos", F.struct("mean", "w"))))
    dense = F.transform(F.sequence(F.lit(0), F.lit(last)), lambda i: F.try_element_at("by_pos", i))
    effects = settle(
        fits.levels.groupBy("model_id").agg(by_pos.alias("by_pos"))
        .join(fits.models.select(*MODEL, "design_id", "n", "m", "sigma2"), "model_id")
        .select(*MODEL, "design_id", "n", "m", "sigma2", dense.alias("e"))
    )

    def added(field: str) -> Column:
        if "val" not in fits.rows.columns:
            return F.aggregate("idx", F.lit(0.0), lambda t, i: t + F.coalesce(F.get("e", i)[field], F.lit(0.0)))
        weight = (lambda v: v) if field == "mean" else (lambda v: v * v)
        return F.aggregate(
            F.arrays_zip("idx", "val"), F.lit(0.0), lambda t, p: t + weight(p["val"]) * F.coalesce(F.get("e", p["idx"])[field], F.lit(0.0))
        )

    own = fits.rows.drop("crop").join(effects, "design_id").select(
        *MODEL, "GEOID", "YEAR", "CNTY", "y", "sigma2",
        (F.col("m") + added("mean")).alias("mean"), (1 / F.col("n") + added("w")).alias("h"),
    )
    area = fits.areas.select("model_id", "CNTY", F.col("mean").alias("a_mean"), F.col("w").alias("a_w"))
    scored = own.join(area, ["model_id", "CNTY"], "left").select(
        *MODEL, "GEOID", "YEAR", "CNTY", "y",
        F.try_divide(F.lit(1.0), "sigma2").alias("tau"),
        (F.col("mean") + F.coalesce("a_mean", F.lit(0.0))).alias("mean"),
        (F.col("sigma2") * (F.col("h") + F.coalesce("a_w", F.lit(0.0)))).alias("var"),
    )
    return leave_one_out(scored).drop("var")


def leave_one_out(scored: DataFrame) -> DataFrame:
    """Add sd, log_cpo, cpo, pit and p_value to rows with y, mean, var and tau.

    A row that alone determines its fitted value has no leave-one-out value.  The density of an extreme
    outlier may underflow to 0; its logarithm does not.
    """
    mean, var, tau, y = (F.col(c) for c in ("mean", "var", "tau", "y"))
    rest = F.try_divide(F.lit(1.0), var) - tau
    loo_var = F.when((rest > 1e-9 * tau) & y.isNotNull(), 1 / rest)
    loo_mean = F.col("__v") * (F.try_divide(mean, var) - tau * y)
    z = F.col("__z")
    # Step by step: a value that is used many times is a column of its own.
    steps = scored.withColumn("__v", loo_var).withColumns(
        {
            "__s": F.sqrt(F.col("__v") + 1 / tau),
            "__z": (y - loo_mean) / F.sqrt(F.col("__v") + 1 / tau),
            "__p": F.try_divide(y - mean, F.sqrt(var)),
        }
    )
    return steps.withColumns(
        {
            "sd": F.sqrt(var),
            "log_cpo": -z * z / 2 - F.ln(F.sqrt(2 * F.pi()) * F.col("__s")),
            "cpo": F.exp(-z * z / 2) / (F.sqrt(2 * F.pi()) * F.col("__s")),
            "pit": normal_cdf("__z"),
            "p_value": normal_cdf("__p"),
        }
    ).drop("__v", "__s", "__z", "__p")


def model_fit(scored: DataFrame, by: Sequence[str] = MODEL) -> DataFrame:
    """(by, n, p_eff, dic): deviance information criterion per model."""
    off = F.col("y") - F.col("mean")
    sums = scored.where(F.col("y").isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(off * off).alias("sse"),
        F.sum(F.col("sd") * F.col("sd")).alias("ssd"),
        F.max("tau").alias("tau"),
    )
    p_eff = F.col("tau") * F.col("ssd")
    deviance = F.col("n") * F.ln(2 * F.pi() / F.col("tau")) + F.col("tau") * F.col("sse")
    return sums.select(*by, "n", p_eff.alias("p_eff"), (deviance + 2 * p_eff).alias("dic"))


def quantile_columns(mean, sd) -> list:
    return [
        (mean - Z975 * sd).alias("q025"),
        mean.alias("q50"),
        (mean + Z975 * sd).alias("q975"),
    ]


def effect_table(fits: Fits) -> DataFrame:
    """(MODEL, term, level, x, mean, sd, q025, q50, q975) of all observed term levels and of all areas.

    Free area levels are reported against the first area of the model, which itself is the reference and
    has no row.
    """
    noise = fits.models.select("model_id", "sigma2", "area")
    smooth = fits.levels.where("n > 0").join(noise, "model_id").select(
        *MODEL, "term", "level", "x", "mean", F.sqrt(F.col("sigma2") * F.col("w")).alias("sd")
    )
    areas = fits.areas.join(noise, "model_id")
    first = settle(_first_areas(fits))
    against = areas.where("area = 'factor'").join(first, "model_id").where(F.col("CNTY") > F.col("first.CNTY"))
    own = areas.where("area <> 'factor'")

    def row(mean: Column, w: Column) -> list[Column]:
        sd = F.sqrt(F.col("sigma2") * w)
        return [*MODEL, F.lit("CNTY").alias("term"), F.col("CNTY").alias("level"), F.col("CNTY").cast("double").alias("x"), mean.alias("mean"), sd.alias("sd")]

    out = smooth.unionByName(own.select(*row(F.col("mean"), F.col("w"))))
    out = out.unionByName(against.select(*row(F.col("mean") - F.col("first.mean"), F.col("w") + F.col("first.w"))))
    return out.select("*", *quantile_columns(F.col("mean"), F.col("sd")))


def _first_areas(fits: Fits) -> DataFrame:
    """(model_id, first): number, effect and weight of the first area of models with free area levels."""
    free = fits.areas.join(fits.models.where("area = 'factor'").select("model_id"), "model_id")
    return free.groupBy("model_id").agg(F.min_by(F.struct("CNTY", "mean", "w"), "CNTY").alias("first"))


def hyper_table(fits: Fits) -> DataFrame:
    """(MODEL, name, mean, sd, q025, q50, q975): precisions of noise and parts, and the spatial share.

    A precision estimated from k groups (or k degrees of freedom) has the relative sd sqrt(2 / k), and its
    quantiles are those of a normal on the log scale.  Parts without variance between groups have no
    precision and no row.
    """
    noise = fits.models.select(*MODEL, F.lit("noise").alias("name"), F.try_divide(F.lit(1.0), "sigma2").alias("mean"), F.greatest(F.lit(1.0), F.col("n") - F.col("p_eff")).alias("k"))
    shrunk = fits.parts.join(fits.models.where("area = 'factor'").select("model_id", F.lit("CNTY").alias("term")), ["model_id", "term"], "left_anti")
    parts = shrunk.where("between > 0").select(*MODEL, F.col("term").alias("name"), (1 / F.col("between")).alias("mean"), F.col("groups").cast("double").alias("k"))
    spread = F.sqrt(2 / F.col("k"))
    precisions = noise.unionByName(parts).where(F.col("mean").isNotNull()).select(
        *MODEL, F.concat(F.lit("precision of "), "name").alias("name"), "mean", (F.col("mean") * spread).alias("sd"),
        (F.col("mean") * F.exp(-Z975 * spread)).alias("q025"), F.col("mean").alias("q50"), (F.col("mean") * F.exp(Z975 * spread)).alias("q975"),
    )
    size = fits.areas.where("n > 0").groupBy("model_id").agg(F.count(F.lit(1)).alias("k"))
    share = fits.models.where("phi is not null").join(size, "model_id")
    sd = F.sqrt((1 - F.col("phi") * F.col("phi")) / F.col("k"))
    return precisions.unionByName(share.select(
        *MODEL, F.lit("phi of CNTY").alias("name"), F.col("phi").alias("mean"), sd.alias("sd"),
        F.greatest(F.lit(0.0), F.col("phi") - Z975 * sd).alias("q025"), F.col("phi").alias("q50"), F.least(F.lit(1.0), F.col("phi") + Z975 * sd).alias("q975"),
    ))


def intercept_table(fits: Fits) -> DataFrame:
    """(MODEL, name, mean, sd, q025, q50, q975) of the intercept.

    In a model with free area levels the intercept is the first area's level.
    """
    first = _first_areas(fits)
    at = fits.models.join(first, "model_id", "left").select(
        *MODEL,
        (F.col("m") + F.coalesce("first.mean", F.lit(0.0))).alias("mean"),
        F.sqrt(F.col("sigma2") * F.coalesce("first.w", 1 / F.col("n"))).alias("sd"),
    )
    return at.select(
        *MODEL, F.lit("(Intercept)").alias("name"), "mean", "sd", *quantile_columns(F.col("mean"), F.col("sd"))
    )
