"""Parquet tables as a context; NaN is left in the files and counted as missing by the operators."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..catalog import Context, ContextType
from .delimited import named_by_stem


class ParquetContext(Context):
    """One resource per Parquet file or folder; paths may be in any store that Spark reads."""

    def __init__(self, spark: SparkSession, source: str | list[str] | dict[str, str], name: str = "context", description: str | None = None):
        paths = source if isinstance(source, dict) else named_by_stem([source] if isinstance(source, str) else list(source))
        super().__init__(spark, name, {k: spark.read.parquet(p) for k, p in paths.items()}, ContextType.PARQUET, description, paths)
