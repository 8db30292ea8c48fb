"""Model specifications as data.

A model explains one response by smooth terms of binned covariates (first-order
random walks over the bins), linear terms of standardised covariates, a trend (two
sets of year levels, or a quadratic one) and an area effect: ``factor`` (one free
level per area), ``bym2`` (independent and spatially structured parts sharing one
precision) or ``bym`` (the same two parts with a precision each).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fallow.plans.panel import MODEL_COLUMNS

AREAS = ("factor", "bym2", "bym")
TRENDS = ("levels", "quadratic")
TREND_TERMS = ("trend", "trend_squared")
PRIORS = ("pc", "default")

# Scale and probability of the penalised-complexity priors.  A
# smooth term's u is sd(YIELD) / 0.31 per crop, also for the other responses.
SD_FACTOR = 0.31
PC_ALPHA = 0.01
AREA_U = 0.2 / 0.31
PHI_U = 0.5
PHI_ALPHA = 2 / 3

# Controls of the three kinds of model.
YIELD_CONTROLS = ["fert", "herb", "volume", "TP", "GDD", "SDD"]
CHANGE_CONTROLS = ["dVol", "dTP", "dGDD", "dSDD", "dfert", "dherb"]
STABILITY_CONTROLS = ["covVol", "covTP", "covGDD", "covSDD", "covfert", "covherb"]


@dataclass(frozen=True)
class Term:
    name: str
    kind: str  # rw1, iid or linear
    prior: str  # pc, default or flat


@dataclass(frozen=True)
class ModelSpec:
    family: str
    response: str
    terms: tuple[Term, ...]
    area: str
    area_prior: str = "pc"

    @property
    def smooths(self) -> list[str]:
        return [t.name for t in self.terms if t.kind == "rw1"]

    @property
    def linear(self) -> list[str]:
        """Covariates with a slope; the trend is not among them."""
        return [t.name for t in self.terms if t.kind == "linear" and t.name not in TREND_TERMS]


def model(
    family: str,
    response: str,
    diversity: str | Sequence[str],
    controls: Sequence[str],
    area: str,
    priors: str | Mapping[str, str] = "pc",
    linear: Sequence[str] = (),
    trend: str = "levels",
) -> ModelSpec:
    """A model of ``response`` on controls and one or more diversity terms.

    Covariates named in ``linear`` (controls, diversity terms or others) enter with a slope instead of a
    smooth term.  ``priors`` is one kind for all smooth terms and the area, or a mapping with
    the kind of single terms (``"area"`` for the area), the rest being "pc".
    """
    diversity = [diversity] if isinstance(diversity, str) else list(diversity)
    smooths = [c for c in [*controls, *diversity] if c not in linear]
    unknown = [c for c in [*smooths, *linear] if c not in MODEL_COLUMNS]
    if trend not in TRENDS:
        raise ValueError(f"trend must be one of {TRENDS}")
    if unknown or not diversity:
        raise ValueError(f"not a model column: {unknown or 'no diversity term'}")
    if area not in AREAS:
        raise ValueError(f"area must be one of {AREAS}")

    def prior(name: str) -> str:
        kind = priors if isinstance(priors, str) else priors.get(name, "pc")
        if kind not in PRIORS:
            raise ValueError(f"prior must be one of {PRIORS}")
        return kind

    terms = [Term(c, "rw1", prior(c)) for c in smooths]
    terms += [Term(c, "linear", "flat") for c in linear]
    terms += [Term(c, "linear", "flat") for c in TREND_TERMS] if trend == "quadratic" else [Term("YEAR_id", "iid", "default"), Term("YEAR_id2", "iid", "default")]
    return ModelSpec(family, response, tuple(terms), area, prior("area"))


def yield_model(family, diversity="LSM_SIDI_ALL", area="bym2", controls=None, priors="pc") -> ModelSpec:
    return model(family, "YIELD", diversity, controls or YIELD_CONTROLS, area, priors)


def change_model(family, diversity, controls, area="bym2", priors="pc") -> ModelSpec:
    return model(family, "dYield", diversity, controls, area, priors)


def stability_model(family, diversity, controls, area="bym2", priors="pc") -> ModelSpec:
    return model(family, "covYield", diversity, controls, area, priors)


def report_families() -> list[ModelSpec]:
    """The ten families of the report, to be fitted for every crop."""
    out = []
    for tag, area in (("fe", "factor"), ("bym", "bym2")):
        out += [
            yield_model(f"yield_SIDI_{tag}", area=area),
            change_model(f"dyield_aveSIDI_{tag}", "aveSIDI2yr", CHANGE_CONTROLS, area),
            change_model(f"dyield_dSIDI_{tag}", "dSIDI", CHANGE_CONTROLS, area),
            stability_model(f"covyield_aveSIDI_{tag}", "aveSIDI3yr", STABILITY_CONTROLS, area),
            stability_model(f"covyield_covSIDI_{tag}", "covSIDI", STABILITY_CONTROLS, area),
        ]
    return out


def spec_table(spark: SparkSession, specs: Sequence[ModelSpec]) -> DataFrame:
    """One row per model family and term, the area term included."""
    rows = []
    for m in specs:
        rows += [(m.family, m.response, t.name, t.kind, t.prior) for t in m.terms]
        rows.append((m.family, m.response, "CNTY", m.area, "flat" if m.area == "factor" else m.area_prior))
    return spark.createDataFrame(
        rows, "family string, response string, term string, kind string, prior string"
    )


def with_constants(terms: DataFrame) -> DataFrame:
    """Add a prior's constants to rows with (kind, prior, scale): u and alpha of the precision, phi_u and phi_alpha of the mixing weight."""
    pc, spatial = F.col("prior") == "pc", F.col("kind").isin("bym2", "bym")
    return terms.withColumns({
        "u": F.when(pc & spatial, AREA_U).when(pc, F.col("scale")),
        "alpha": F.when(pc, PC_ALPHA),
        "phi_u": F.when(pc & (F.col("kind") == "bym2"), PHI_U),
        "phi_alpha": F.when(pc & (F.col("kind") == "bym2"), PHI_ALPHA),
    })
