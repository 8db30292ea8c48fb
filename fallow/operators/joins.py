"""Panel joins.

None carries a broadcast hint: dimensions read from files are broadcast by
Spark when their size is under its threshold, and skewed keys of the larger
sides are split by adaptive execution.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def common_columns(left: DataFrame, right: DataFrame) -> list[str]:
    return [c for c in left.columns if c in right.columns]


def null_safe_left_join(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Left join in which a missing key matches a missing key; one copy of the keys."""
    mine = {c: f"__right_{c}" for c in by}
    r = right.withColumnsRenamed(mine)
    on = reduce(lambda a, b: a & b, [left[c].eqNullSafe(r[k]) for c, k in mine.items()])
    return left.join(r, on, "left").drop(*mine.values())


def natural_left_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on every column name the two tables share."""
    by = common_columns(left, right)
    if not by:
        raise ValueError("natural join: the tables share no column")
    return null_safe_left_join(left, right, by)


def suffixed_left_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    suffixes: tuple[str, str] = ("_x", "_y"),
) -> DataFrame:
    """Left join that keeps clashing columns of both sides under suffixes."""
    clash = [c for c in common_columns(left, right) if c not in by]
    lft = left.withColumnsRenamed({c: c + suffixes[0] for c in clash})
    rgt = right.withColumnsRenamed({c: c + suffixes[1] for c in clash})
    return null_safe_left_join(lft, rgt, by)


def left_join_keys(left: DataFrame, right: DataFrame, keys: Mapping[str, str]) -> DataFrame:
    """Left join with differently named keys, ``{left name: right name}``."""
    renamed = right.withColumnsRenamed({r: f"__right_{r}" for r in keys.values()})
    on = reduce(
        lambda a, b: a & b, [left[a] == renamed[f"__right_{b}"] for a, b in keys.items()]
    )
    return left.join(renamed, on, "left").drop(*[f"__right_{b}" for b in keys.values()])


def keep_members(df: DataFrame, members: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows whose key is present in ``members`` (left semi join)."""
    return df.join(members, list(by), "left_semi")


def bind_columns(df: DataFrame, other: DataFrame, by: Sequence[str]) -> DataFrame:
    """Put the columns of two tables side by side, matched by their row key.

    Stands for a bind by row position, which a distributed table does not have.
    """
    return df.join(other, list(by), "left")


def drop_missing(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double")))


def select_at(df: DataFrame, positions: Sequence[int]) -> DataFrame:
    """Columns by position, counted from zero."""
    names = df.columns
    return df.select(*[F.col(f"`{names[i]}`") for i in positions])
