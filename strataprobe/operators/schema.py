"""Catalog operators: counts, names, types, samples, schema comparison by name."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ColumnNotFound
from ..functions.names import possible_date, possible_id
from ..functions.scalars import as_text, col, missing, pandas_like

#: Columns that one aggregate holds at most; wider tables take several, each reading only its columns.
WIDTH = 100


def require(df: DataFrame, *names: str) -> None:
    for name in names:
        if name not in df.columns:
            raise ColumnNotFound(f"column {name!r} is not one of {df.columns}")


def slices(names: list[str], width: int = WIDTH) -> list[list[str]]:
    return [names[i : i + width] for i in range(0, len(names), width)] or [[]]


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("item_count"))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """resource, item_count: one aggregate a table, which needs no column of it."""
    return union_all([df.agg(F.count("*").alias("item_count")).select(F.lit(name).alias("resource"), "item_count") for name, df in tables.items()])


def table_overview(tables: dict[str, DataFrame]) -> DataFrame:
    """resource, item_count, field_count, columns."""
    return union_all([df.agg(F.count("*").alias("item_count")).select(F.lit(name).alias("resource"), "item_count", F.lit(len(df.columns)).alias("field_count"), F.array(*[F.lit(c) for c in df.columns]).alias("columns")) for name, df in tables.items()])


def schema_rows(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """resource, ordinal, field, dtype, pandas_like_dtype, nullable: from the plans alone, without reading data."""
    rows = [(name, i, f.name, f.dataType.simpleString(), pandas_like(f.dataType), f.nullable) for name, df in tables.items() for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "resource string, ordinal int, field string, dtype string, pandas_like_dtype string, nullable boolean")


@dataclass
class Profile:
    rows: int
    nulls: dict[str, int]
    samples: dict[str, list[str]]


def sample_values(df: DataFrame, n: int = 5, rows: int = 100) -> dict[str, list[str]]:
    """Up to n values of each column, from the first rows that Spark reads, as text; a bounded look for display, on which nothing is decided."""
    if not df.columns:
        return {}
    found = df.select(*[as_text(f.name, f.dataType).alias(f"c{i}") for i, f in enumerate(df.schema.fields)]).limit(rows).collect()
    return {c: [r[i] for r in found if r[i] is not None][:n] for i, c in enumerate(df.columns)}


def profile_fields(df: DataFrame, samples: int = 5) -> Profile:
    """Rows, nulls by column over all rows, and a few sample values."""
    nulls, rows = {}, 0
    for names in slices(df.columns):
        got = df.agg(F.count("*").alias("rows"), *[F.count_if(missing(c, df.schema[c].dataType)).alias(f"n{i}") for i, c in enumerate(names)]).first()
        rows = got["rows"]
        nulls |= {c: got[f"n{i}"] for i, c in enumerate(names)}
    return Profile(rows, nulls, sample_values(df, samples))


def sample_items(df: DataFrame, n: int = 5, order_by: list[str] | None = None) -> DataFrame:
    """The first n rows in the order of the given columns, else of all that have one."""
    keys = order_by or [f.name for f in df.schema.fields if f.dataType.typeName() != "map"]
    require(df, *keys)
    return df.orderBy(*[col(c) for c in keys]).limit(n)


def common_columns(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """column_name, n_tables, locations: names (trimmed, lower case) that more than one table has."""
    rows = schema_rows(spark, tables).select("resource", "field", F.lower(F.trim("field")).alias("column_name"))
    grouped = rows.groupBy("column_name").agg(F.count_distinct("resource").alias("n_tables"), F.sort_array(F.collect_list(F.concat_ws(".", "resource", "field"))).alias("locations"))
    return grouped.where("n_tables > 1")


def compare_schemas(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """schema_rows with whether a column may be a key or a date, and in how many tables its name is."""
    rows = schema_rows(spark, tables)
    names = {f.name for df in tables.values() for f in df.schema.fields}
    marks = spark.createDataFrame([(n, possible_id(n), possible_date(n)) for n in sorted(names)], "field string, possible_id boolean, possible_date boolean")
    return rows.join(F.broadcast(marks), "field").join(F.broadcast(rows.groupBy("field").agg(F.count("*").alias("n_tables"))), "field").select(*rows.columns, "possible_id", "possible_date", "n_tables")


def schema_profile(spark: SparkSession, tables: dict[str, DataFrame], samples: int = 3) -> DataFrame:
    """compare_schemas with null_count and sample_values of every column: one pass over each table."""
    rows = []
    for name, df in tables.items():
        found = profile_fields(df, samples)
        rows += [(name, c, found.nulls[c], found.samples[c]) for c in df.columns]
    looked = spark.createDataFrame(rows, "resource string, field string, null_count bigint, sample_values array<string>")
    return compare_schemas(spark, tables).join(F.broadcast(looked), ["resource", "field"])


def file_info(df: DataFrame, size_in_bytes: int | None, large: int = 50 * 1024 * 1024) -> dict:
    """Bytes, megabytes, columns, whether it is large, and about how many rows, from the mean width of 100 rows as text."""
    width = F.lit(0)
    for f in df.schema.fields:
        width = width + F.coalesce(F.octet_length(as_text(f.name, f.dataType)), F.lit(0)) + 1
    mean = df.limit(100).select(width.alias("w")).agg(F.avg("w")).first()[0]
    size = size_in_bytes or 0
    return {"size_in_bytes": size, "size_mb": round(size / 1024**2, 2), "columns": df.columns, "is_large": size > large, "estimated_rows": int(size / mean) if mean else 0}
