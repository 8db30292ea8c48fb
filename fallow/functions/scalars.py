"""Missing-value, arithmetic and key rules of the panel as column expressions.

The panel keeps three kinds of "no number" apart until it is scrubbed: NULL,
NaN and +-Infinity.  ``log`` of zero has to stay -Infinity while the window
columns are taken, because a window that holds it must not skip it.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INF = float("inf")


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def log_keep_inf(c: Column | str) -> Column:
    """Natural log with log(0) = -Infinity; negatives give NULL."""
    x = as_col(c).cast("double")
    return F.when(x == 0, F.lit(-INF)).when(x > 0, F.ln(x))


def to_number(c: Column | str) -> Column:
    """Text to double; text that is no number gives NULL, never an error."""
    return as_col(c).try_cast("double")


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b in doubles; a zero denominator gives NULL."""
    return F.try_divide(as_col(a).cast("double"), as_col(b).cast("double"))


def finite(c: Column | str) -> Column:
    """The value if it is finite, else NULL (NaN sorts above Infinity in Spark)."""
    x = as_col(c)
    return F.when(F.abs(x) < F.lit(INF), x)


def scrub_nonfinite(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """NaN and +-Infinity become NULL in every float column (or in ``columns``)."""
    wanted = set(columns) if columns is not None else None
    floats = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
        and (wanted is None or f.name in wanted)
    ]
    return df.withColumns({c: finite(f"`{c}`") for c in floats})


def over_columns(df: DataFrame, columns: Iterable[str], fn) -> DataFrame:
    """Apply one Column -> Column function to several columns in one projection."""
    return df.withColumns({c: fn(F.col(f"`{c}`")) for c in columns})


def area_normalise(df: DataFrame, columns: Iterable[str], area: str) -> DataFrame:
    return over_columns(df, columns, lambda c: ratio(c, area))


def key_text(c: Column | str, numeric: bool = False) -> Column:
    """Text of a key part: whole numbers without decimals, NULL as ``NA``."""
    x = as_col(c)
    if numeric:
        whole = x.cast("double") == F.floor(x.cast("double"))
        x = F.when(whole, x.cast("bigint").cast("string")).otherwise(x.cast("string"))
    return F.coalesce(x.cast("string"), F.lit("NA"))


def entity_year_key(entity: Column | str, yr: Column | str, numeric_entity: bool = False) -> Column:
    """The ``<entity>_<year index>`` text key."""
    return F.concat(key_text(entity, numeric_entity), F.lit("_"), key_text(yr, True))


def year_of_header(c: Column | str) -> Column:
    """Year in a wide header such as ``X2008`` (characters 2 to 5)."""
    return F.substring(as_col(c), 2, 4).try_cast("int")


def replace_in_order(c: Column | str, pairs: Mapping[str, str]) -> Column:
    """Replace every pattern, one after the other; later ones see earlier results."""
    out = as_col(c)
    for pattern, text in pairs.items():
        out = F.regexp_replace(out, F.lit(pattern), F.lit(text))
    return out


def relabel(c: Column | str, names: Mapping[str, str]) -> Column:
    """Replace whole values that are listed; leave the others."""
    x = as_col(c)
    out = x
    for value, text in names.items():
        out = F.when(x == F.lit(value), F.lit(text)).otherwise(out)
    return out


# Rational approximation of the normal distribution function
# (Hart 1968, in the double-precision form published by West 2005).
CDF_NUMERATOR = [
    0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
]
CDF_DENOMINATOR = [
    0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
]
CDF_SPLIT = 7.07106781186547
ROOT_TWO_PI = 2.506628274631


def _polynomial(x: Column, coefficients: list[float]) -> Column:
    out = F.lit(coefficients[0])
    for a in coefficients[1:]:
        out = out * x + F.lit(a)
    return out


def normal_cdf(c: Column | str) -> Column:
    """P(Z <= z) for a standard normal Z, without a Python round trip.

    Give it a plain column: the expression uses its argument many times.
    """
    z = as_col(c)
    a = F.abs(z)
    bell = F.exp(-a * a / 2)
    middle = bell * _polynomial(a, CDF_NUMERATOR) / _polynomial(a, CDF_DENOMINATOR)
    tail = a + F.lit(0.65)
    for k in (4.0, 3.0, 2.0, 1.0):
        tail = a + F.lit(k) / tail
    upper = (
        F.when(a > 37, F.lit(0.0))
        .when(a < CDF_SPLIT, middle)
        .otherwise(bell / tail / F.lit(ROOT_TWO_PI))
    )
    return F.when(z > 0, 1 - upper).when(z <= 0, upper)
