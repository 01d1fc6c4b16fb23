"""Dataset profiling, relationship discovery and metadata as Spark plans."""

__all__ = ["catalog", "operators", "plans", "sources"]
