"""fallow: panel analytics on Spark (entity x time x group tables)."""

__version__ = "0.1.0"
