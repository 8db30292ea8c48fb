"""Design rows and sufficient statistics of all models at once.

Most covariates of a model are a level of a term, so a row of the design is the
short list ``idx`` of its active positions.  Linear terms have one position each;
designs with such terms carry a list ``val`` beside ``idx``, 1 for levels and the
number itself for linear terms.  Given the hyperparameters, a Gaussian model depends
on the rows only through X'X, X'y, y'y and n; these are grouped sums with map-side
combine, whose result is bounded by the squared number of positions whatever the
number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fallow.operators.binning import QuantileBins, standardise
from fallow.plans.spec import TREND_TERMS, ModelSpec

RESPONSE = -1  # position of the response in the augmented [y, X]
INTERCEPT = 0


@dataclass(frozen=True)
class Block:
    """Positions start .. start + size - 1 hold the levels of one term."""

    term: str
    kind: str
    prior: str
    start: int
    size: int


@dataclass(frozen=True)
class YearRange:
    first: int
    last: int

    @property
    def size(self) -> int:
        return self.last - self.first + 1


def year_range(prepared: DataFrame) -> YearRange:
    low, high = prepared.agg(F.min("Yr"), F.max("Yr")).first()
    return YearRange(low, high)


def blocks(spec: ModelSpec, bins: int, years: YearRange) -> list[Block]:
    """Layout of the positions: the intercept, then term after term."""
    out, at = [], 1
    for t in spec.terms:
        size = {"rw1": bins + 1, "iid": years.size, "linear": 1}[t.kind]
        out.append(Block(t.name, t.kind, t.prior, at, size))
        at += size
    return out


def positions(spec: ModelSpec, bins: int, years: YearRange) -> int:
    last = blocks(spec, bins, years)[-1]
    return last.start + last.size


def design_of(spec: ModelSpec, specs: Sequence[ModelSpec]) -> str:
    """Name of a model's design: the first family with the same response and terms, whatever its area effect."""
    shape = [(t.name, t.kind) for t in spec.terms]
    return next(m.family for m in specs if m.response == spec.response and [(t.name, t.kind) for t in m.terms] == shape)


def designs(specs: Sequence[ModelSpec]) -> list[ModelSpec]:
    """One specification per distinct design."""
    return [m for m in specs if design_of(m, specs) == m.family]


def key(name: str) -> Column:
    return F.concat_ws("_", "crop", name)


def model_table(prepared: DataFrame, specs: Sequence[ModelSpec]) -> DataFrame:
    """(model_id, crop, family, response, area, design, design_id), one row per crop and family."""
    listed = F.explode(F.array(*[
        F.struct(F.lit(m.family).alias("family"), F.lit(m.response).alias("response"), F.lit(m.area).alias("area"), F.lit(design_of(m, specs)).alias("design"))
        for m in specs
    ]))
    own = prepared.select("crop").distinct().select("crop", listed.alias("m")).select("crop", "m.*")
    return own.withColumns({"model_id": key("family"), "design_id": key("design")})


def design_rows(
    prepared: DataFrame, bins: QuantileBins, specs: Sequence[ModelSpec], years: YearRange
) -> DataFrame:
    """One row per panel row and design: (design_id, crop, GEOID, YEAR, CNTY, y, idx).

    One scan serves all models, and models that differ in the area effect alone share their rows.  A
    missing covariate adds no entry for its term; rows with a missing response stay, to be scored later.
    Where any design has linear terms, the rows have the column ``val``, too.
    """
    own = designs(specs)
    smooths = sorted({c for m in own for c in m.smooths})
    numbered = bins.apply(prepared, number="__no_{}", columns=smooths) if smooths else prepared
    slopes = sorted({c for m in own for c in m.linear})
    if slopes:
        numbered = standardise(numbered.withColumns({f"__z_{c}": F.col(c).cast("double") for c in slopes}), ["crop"], [f"__z_{c}" for c in slopes])
    with_val = any(b.kind == "linear" for m in own for b in blocks(m, bins.n, years))

    def entry(b: Block) -> Column:
        if b.kind == "linear":
            value = trend_value(b.term, F.col("Yr"), years) if b.term in TREND_TERMS else F.col(f"__z_{b.term}")
            return F.when(value.isNotNull(), F.struct(F.lit(b.start).alias("pos"), value.alias("val")))
        level = F.col(f"__no_{b.term}") - 1 if b.kind == "rw1" else F.col("Yr") - years.first
        at = (F.lit(b.start) + level).cast("int")
        return F.when(at.isNotNull(), F.struct(at.alias("pos"), F.lit(1.0).alias("val")))

    def active(spec: ModelSpec) -> Column:
        first = F.struct(F.lit(INTERCEPT).alias("pos"), F.lit(1.0).alias("val"))
        return F.array_compact(F.array(first, *[entry(b) for b in blocks(spec, bins.n, years)]))

    each = F.explode(F.array(*[F.struct(F.lit(m.family).alias("design"), F.col(m.response).alias("y"), active(m).alias("x")) for m in own]))
    rows = numbered.select("crop", "GEOID", "YEAR", "CNTY", each.alias("m")).withColumn("design", F.col("m.design"))
    parts = [F.col("m.y").alias("y"), F.col("m.x.pos").alias("idx"), *([F.col("m.x.val").alias("val")] if with_val else [])]
    return rows.select("crop", "GEOID", "YEAR", "CNTY", *parts, key("design").alias("design_id"))


def trend_value(term: str, year: Column, years: YearRange) -> Column:
    """The quadratic trend as two columns, orthogonal over the years: the year about mid-range, and its square about the mean square."""
    t = year - (years.first + years.last) / 2
    return t if term == "trend" else t * t - (years.size * years.size - 1) / 12


def _listed(rows: DataFrame) -> Column:
    """The entries of a row as structs (pos, val)."""
    if "val" not in rows.columns:
        return F.transform("idx", lambda i: F.struct(i.alias("pos"), F.lit(1.0).alias("val")))
    return F.transform(F.arrays_zip("idx", "val"), lambda e: F.struct(e["idx"].alias("pos"), e["val"].alias("val")))


def gram(rows: DataFrame) -> DataFrame:
    """[y, X]'[y, X] of every design as (design_id, i, j, v) rows, i <= j, in one scan.

    v at (0, 0) is the number of observed rows and v at (-1, -1) is y'y.  Products of levels are counts of
    position pairs; those of linear terms are sums of products.
    """
    if "val" in rows.columns:
        response = F.struct(F.lit(RESPONSE).alias("pos"), F.col("y").alias("val"))
        seen = rows.where(F.col("y").isNotNull()).select("design_id", F.concat(F.array(response), _listed(rows)).alias("x"))
        first = seen.select("design_id", "x", F.posexplode("x").alias("at", "p"))
        pairs = first.select("design_id", "p", F.explode(F.slice("x", F.col("at") + 1, F.size("x"))).alias("q"))
        return pairs.groupBy("design_id", F.col("p.pos").alias("i"), F.col("q.pos").alias("j")).agg(F.sum(F.col("p.val") * F.col("q.val")).alias("v"))
    observed = rows.where(F.col("y").isNotNull()).select("design_id", "y", F.concat(F.array(F.lit(RESPONSE)), "idx").alias("idx"))
    first = observed.select("design_id", "y", "idx", F.posexplode("idx").alias("at", "i"))
    pairs = first.select("design_id", "y", "i", F.explode(F.slice("idx", F.col("at") + 1, F.size("idx"))).alias("j"))
    product = F.when(F.col("i") >= 0, 1.0).when(F.col("j") >= 0, F.col("y")).otherwise(F.col("y") * F.col("y"))
    return pairs.groupBy("design_id", "i", "j").agg(F.sum(product).alias("v"))


def xty(rows: DataFrame) -> DataFrame:
    """X'y on its own: (design_id, pos, sum_y)."""
    observed = rows.where(F.col("y").isNotNull()).select("design_id", "y", F.explode(_listed(rows)).alias("x"))
    return observed.groupBy("design_id", F.col("x.pos").alias("pos")).agg(F.sum(F.col("y") * F.col("x.val")).alias("sum_y"))


def area_table(rows: DataFrame) -> DataFrame:
    """(design_id, CNTY, n, sum_y) of every area of a design, those without observed rows included."""
    return rows.groupBy("design_id", "CNTY").agg(
        F.count("y").cast("double").alias("n"), F.coalesce(F.sum("y"), F.lit(0.0)).alias("sum_y")
    )


def area_columns(rows: DataFrame) -> DataFrame:
    """Column sums of X per design and area: (design_id, CNTY, pos, n)."""
    observed = rows.where(F.col("y").isNotNull()).select("design_id", "CNTY", F.explode(_listed(rows)).alias("x"))
    return observed.groupBy("design_id", "CNTY", F.col("x.pos").alias("pos")).agg(F.sum("x.val").alias("n"))


def area_effect_sums(rows: DataFrame, areas: DataFrame) -> DataFrame:
    """X'a of every model, a being the area effect of each observed row: (model_id, pos, taken).

    ``areas``: (model_id, design_id, CNTY, mean).  A row meets the effects of its area as one row of the design and
    is spread over its positions behind that join, where the sums are formed map-side: what is shuffled
    then is bounded by the positions.
    """
    observed = rows.where(F.col("y").isNotNull()).select("design_id", "CNTY", _listed(rows).alias("x"))
    met = observed.join(areas.select("model_id", "design_id", "CNTY", "mean"), ["design_id", "CNTY"])
    each = met.select("model_id", "mean", F.explode("x").alias("x"))
    return each.groupBy("model_id", F.col("x.pos").alias("pos")).agg(F.sum(F.col("x.val") * F.col("mean")).alias("taken"))


def demeaned_xty(rows: DataFrame) -> DataFrame:
    """X'y after subtracting area means: (design_id, pos, sum_y), from grouped sums; no demeaned row is formed."""
    means = area_table(rows).where("n > 0").select("design_id", "CNTY", (F.col("sum_y") / F.col("n")).alias("y"))
    inside = area_columns(rows).withColumn("CNTY", F.coalesce("CNTY", F.lit(-1)))  # rows without an area are one more
    taken = inside.join(means.withColumn("CNTY", F.coalesce("CNTY", F.lit(-1))), ["design_id", "CNTY"])
    taken = taken.groupBy("design_id", "pos").agg(F.sum(F.col("n") * F.col("y")).alias("taken"))
    return xty(rows).join(taken, ["design_id", "pos"]).select("design_id", "pos", (F.col("sum_y") - F.col("taken")).alias("sum_y"))


def demeaned_gram(rows: DataFrame) -> DataFrame:
    """X'X after subtracting area means: (design_id, i, j, v), i <= j; no demeaned row is formed.

    The product of two demeaned columns is that of the columns less, for every area, the product of their
    sums there over its rows.  Rows are reduced to column sums per area by partial aggregation, so an area
    that holds a third of all rows is one short list like any other: it has at most one entry per position.
    Such lists are paired up one leading entry at a time, and the products are added up map-side, too.
    Rows without an area are one more area.
    """
    inside = area_columns(rows).withColumn("CNTY", F.coalesce("CNTY", F.lit(-1)))
    lists = inside.groupBy("design_id", "CNTY").agg(F.array_sort(F.collect_list(F.struct("pos", "n"))).alias("x"))
    size = F.get("x", F.lit(0))["n"]  # the intercept's sum is the number of rows
    first = lists.select("design_id", size.alias("size"), "x", F.posexplode("x").alias("at", "p"))
    pairs = first.select("design_id", "size", "p", F.explode(F.slice("x", F.col("at") + 1, F.size("x"))).alias("q"))
    taken = pairs.groupBy("design_id", F.col("p.pos").alias("i"), F.col("q.pos").alias("j")).agg(
        F.sum(F.col("p.n") * F.col("q.n") / F.col("size")).alias("taken")
    )
    own = gram(rows).where("i >= 0")
    return taken.join(own, ["design_id", "i", "j"], "left").select("design_id", "i", "j", (F.coalesce("v", F.lit(0.0)) - F.col("taken")).alias("v"))


def level_table(bins: QuantileBins, specs: Sequence[ModelSpec], years: YearRange) -> DataFrame:
    """(crop, design_id, ord, term, level, pos, x, kind) of every level that occurs.

    x is the standardised bin value, or the year index (its square for the second set of year levels).  A
    linear term is one level, 0, with x = 1: its effect is that of one unit.
    """
    layout = F.explode(F.array(*[
        F.struct(
            F.lit(m.family).alias("design"), F.lit(k).alias("ord"), F.lit(b.term).alias("term"),
            F.lit(b.kind).alias("kind"), F.lit(b.start).alias("start"),
        )
        for m in designs(specs)
        for k, b in enumerate(blocks(m, bins.n, years))
    ]))
    at = bins.table.select("crop").distinct().select("crop", layout.alias("b")).select("crop", "b.*").withColumn("design_id", key("design"))
    smooth = (
        bins.table.select("crop", F.col("column").alias("term"), "bin", "scaled")
        .join(at.where("kind = 'rw1'"), ["crop", "term"])
        .select("crop", "design_id", "ord", "term", F.col("bin").alias("level"),
                (F.col("start") + F.col("bin") - 1).alias("pos"), F.col("scaled").alias("x"), "kind")
    )
    number = F.explode(F.sequence(F.lit(years.first), F.lit(years.last)))
    yearly = (
        at.where("kind = 'iid'")
        .select("crop", "design_id", "ord", "term", "start", number.alias("level"))
        .select("crop", "design_id", "ord", "term", "level",
                (F.col("start") + F.col("level") - years.first).alias("pos"),
                F.when(F.col("term") == "YEAR_id2", F.col("level") * F.col("level"))
                .otherwise(F.col("level")).cast("double").alias("x"), F.lit("iid").alias("kind"))
    )
    slopes = at.where("kind = 'linear'").select(
        "crop", "design_id", "ord", "term", F.lit(0).alias("level"), F.col("start").alias("pos"), F.lit(1.0).alias("x"), "kind"
    )
    return smooth.unionByName(yearly).unionByName(slopes)
