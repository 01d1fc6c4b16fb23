"""Operators by name, with the kinds of contexts that they take, over registered contexts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..catalog import Context, ContextType, get_context
from . import profile, relate, schema, spatial, temporal

ANY = frozenset(ContextType) - {ContextType.UNKNOWN}
SEVERAL = frozenset({ContextType.MULTI_CSV, ContextType.SQLITE, ContextType.PARQUET})


@dataclass(frozen=True)
class Operator:
    name: str
    run: Callable
    kinds: frozenset
    summary: str

    def __call__(self, context: Context | str, **params):
        return self.run(get_context(context) if isinstance(context, str) else context, **params)


REGISTRY: dict[str, Operator] = {}


def operator(name: str, kinds: frozenset = ANY) -> Callable:
    """Register a function(context, **params) under a name."""

    def add(run: Callable) -> Callable:
        REGISTRY[name] = Operator(name, run, kinds, (run.__doc__ or "").strip().split("\n")[0])
        return run

    return add


def run(name: str, context: Context | str, **params):
    if name not in REGISTRY:
        raise KeyError(f"no operator {name!r}; there are {sorted(REGISTRY)}")
    return REGISTRY[name](context, **params)


def operators_for(kind: ContextType, names: list[str] | None = None) -> list[str]:
    """Those of the names (all by default) that take contexts of the kind; names that are not registered pass."""
    return [n for n in (names if names is not None else list(REGISTRY)) if n not in REGISTRY or kind in REGISTRY[n].kinds]


@operator("context_overview")
def context_overview(context: Context) -> dict:
    """Per resource its counts, columns and key; and the relationships."""
    infos = context.get_all_resource_info()
    edges = [r.to_dict() for r in context.get_relationships()]
    resources = {k: {"item_count": v.item_count, "field_count": v.field_count, "fields": [f.name for f in v.fields], "primary_key": v.primary_key} for k, v in infos.items()}
    return {"name": context.name, "type": context.context_type.value, "is_multi_csv": context.is_multi_csv, "resource_count": len(infos), "resources": resources, "relationships": edges, "relationship_count": len(edges)}


@operator("multi_file_overview")
def multi_file_overview(context: Context) -> dict:
    """Per resource its place, rows, columns and megabytes, or the error that it gave."""
    out: dict = {}
    for resource in context.resources:
        try:
            df, size = context.table(resource), context.size_in_bytes(resource)
            out[resource] = {"file_path": context.get_file_path(resource), "row_count": df.count(), "column_count": len(df.columns), "columns": df.columns, "file_size_mb": round((size or 0) / 1024**2, 2)}
        except Exception as e:  # noqa: BLE001  a table that cannot be read is part of the answer
            out[resource] = {"error": f"{type(e).__name__}: {e}"}
    return out


@operator("list_resources")
def list_resources(context: Context) -> list[str]:
    """Names of the resources."""
    return context.resources


@operator("context_schema")
def context_schema(context: Context) -> dict:
    """The whole schema with relationships."""
    return context.get_schema()


@operator("resource_info")
def resource_info(context: Context, resource: str | None = None) -> dict:
    """What is known of one resource."""
    return context.get_resource_info(resource or context.primary_resource).to_dict()


@operator("item_count")
def item_count(context: Context, resource: str | None = None) -> DataFrame:
    """Number of rows."""
    return schema.row_count(context.table(resource))


@operator("field_names")
def field_names(context: Context, resource: str | None = None) -> list[str]:
    """Names of the columns."""
    return context.table(resource).columns


@operator("field_types")
def field_types(context: Context, resource: str | None = None) -> DataFrame:
    """Columns with their types."""
    name = resource or context.primary_resource
    return schema.schema_rows(context.spark, {name: context.table(name)})


@operator("sample_items")
def sample_items(context: Context, resource: str | None = None, n: int = 5) -> DataFrame:
    """The first rows."""
    return schema.sample_items(context.table(resource), n)


@operator("field_statistics")
def field_statistics(context: Context, resource: str | None = None, approx: bool = False) -> DataFrame:
    """Statistics of every column."""
    return profile.field_statistics(context.table(resource), approx)


@operator("missing_values")
def missing_values(context: Context, resource: str | None = None) -> DataFrame:
    """Missing values by column."""
    return profile.missing_values(context.table(resource))


@operator("unique_values")
def unique_values(context: Context, field: str, resource: str | None = None, limit: int | None = 100) -> DataFrame:
    """Distinct values of a column."""
    return profile.unique_values(context.table(resource), field, limit)


@operator("relationships", SEVERAL)
def relationships(context: Context) -> list[dict]:
    """Edges between resources."""
    return [r.to_dict() for r in context.get_relationships()]


@operator("detect_temporal_columns")
def detect_temporal_columns(context: Context, resource: str | None = None) -> DataFrame:
    """Columns that may hold times."""
    return temporal.detect_temporal_columns(context.table(resource))


@operator("analyze_temporal_column")
def analyze_temporal_column(context: Context, column: str, resource: str | None = None) -> DataFrame:
    """Span and granularity of a column of times."""
    return temporal.analyze_temporal_column(context.table(resource), column)


@operator("detect_spatial_columns")
def detect_spatial_columns(context: Context, resource: str | None = None) -> DataFrame:
    """Columns that may hold places."""
    return spatial.detect_spatial_columns(context.table(resource))


@operator("analyze_spatial_column")
def analyze_spatial_column(context: Context, column: str, resource: str | None = None) -> DataFrame:
    """Range or geometry kinds of a column."""
    return spatial.analyze_spatial_column(context.table(resource), column)


@operator("spatial_extent")
def spatial_extent(context: Context, lat_column: str, lon_column: str, resource: str | None = None) -> DataFrame:
    """Bounding box of two columns of coordinates."""
    return spatial.spatial_extent(context.table(resource), lat_column, lon_column)


@operator("temporal_extent")
def temporal_extent(context: Context, time_column: str, resource: str | None = None) -> DataFrame:
    """First and last time of a column."""
    return temporal.temporal_extent(context.table(resource), time_column)


@operator("column_relationship", SEVERAL)
def column_relationship(context: Context, resource_a: str, column_a: str, resource_b: str, column_b: str) -> DataFrame:
    """Overlap of two columns and the key relation that it suggests."""
    return relate.column_relationship(context.table(resource_a), column_a, context.table(resource_b), column_b)


@operator("join_preview", SEVERAL)
def join_preview(context: Context, resource_a: str, column_a: str, resource_b: str, column_b: str, join_type: str = "inner", preview_rows: int = 5) -> DataFrame:
    """The first rows of a join."""
    return relate.join_preview(context.table(resource_a), column_a, context.table(resource_b), column_b, join_type, preview_rows)


@operator("common_columns", SEVERAL)
def common_columns(context: Context) -> DataFrame:
    """Column names that several resources have."""
    return schema.common_columns(context.spark, {r: context.table(r) for r in context.resources})


@operator("compare_schemas", SEVERAL)
def compare_schemas(context: Context) -> DataFrame:
    """All columns of all resources, with possible keys and dates."""
    return schema.compare_schemas(context.spark, {r: context.table(r) for r in context.resources})


@operator("query")
def query(context: Context, sql: str, params: list | dict | None = None) -> DataFrame:
    """SQL over the resources."""
    return context.execute_query(sql, params)


def as_dict(result) -> dict | list:
    """Any operator's result as plain Python values, for display at the edge."""
    if isinstance(result, DataFrame):
        return [r.asDict(recursive=True) for r in result.collect()]
    return result
