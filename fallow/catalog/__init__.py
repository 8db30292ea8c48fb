"""The query catalogue: every operator as a query on the given tables."""

from fallow.catalog import files, models  # noqa: F401  (register their queries)
from fallow.catalog.basics import CATALOG

__all__ = ["CATALOG"]
