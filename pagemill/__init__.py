"""Document-corpus preparation and retrieval on PySpark DataFrames."""

from pagemill.settings import Settings

__all__ = ["Settings"]
