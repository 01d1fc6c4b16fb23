"""Contexts: named sets of lazily read tables, and what is known of them."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from enum import Enum

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .errors import ContextNotFound, ResourceNotFound
from .functions.scalars import col, pandas_like


class ContextType(Enum):
    SINGLE_CSV = "single_csv"
    MULTI_CSV = "multi_csv"
    TEXT = "text"
    SQLITE = "sqlite"
    PARQUET = "parquet"
    UNKNOWN = "unknown"


@dataclass
class FieldInfo:
    name: str
    dtype: str
    nullable: bool = True
    is_primary_key: bool = False
    is_foreign_key: bool = False
    foreign_key_reference: str | None = None
    description: str | None = None
    pandas_like_dtype: str | None = None
    sample_values: list[str] = field(default_factory=list)

    def to_dict(self) -> dict:
        return asdict(self) | {"sample_values": self.sample_values[:5]}


@dataclass
class ResourceInfo:
    name: str
    item_count: int
    field_count: int
    fields: list[FieldInfo]
    primary_key: list[str] | None = None
    location: str | None = None
    size_in_bytes: int | None = None
    description: str | None = None

    def to_dict(self) -> dict:
        return asdict(self) | {"fields": [f.to_dict() for f in self.fields]}


@dataclass
class Relationship:
    from_resource: str
    from_field: str
    to_resource: str
    to_field: str | None
    relationship_type: str
    confidence: float
    is_verified: bool = False
    description: str | None = None

    def to_dict(self) -> dict:
        return asdict(self)


class Context:
    """A dataset: an ordered set of resources, each a lazy DataFrame or a function that makes it on first use.

    Infos and relationships are worked out on first use and kept until refresh().
    """

    def __init__(self, spark: SparkSession, name: str, tables: dict[str, DataFrame | Callable[[], DataFrame]], kind: ContextType = ContextType.UNKNOWN, description: str | None = None, locations: dict[str, str] | None = None):
        self.spark, self.name, self.description, self._kind = spark, name, description, kind
        self._tables, self.locations = dict(tables), dict(locations or {})
        self.refresh()

    @property
    def context_type(self) -> ContextType:
        return self._kind

    @property
    def resources(self) -> list[str]:
        return list(self._tables)

    @property
    def primary_resource(self) -> str | None:
        return next(iter(self._tables), None)

    @property
    def is_multi_csv(self) -> bool:
        return self.context_type is ContextType.MULTI_CSV

    def validate(self) -> None:
        if not self._tables:
            raise ResourceNotFound(f"context {self.name!r} has no resources")

    def refresh(self) -> None:
        """Forget what was worked out."""
        self._infos: dict[str, ResourceInfo] = {}
        self._relationships: list[Relationship] | None = None

    def table(self, resource: str | None = None) -> DataFrame:
        """The whole of a resource; the first one by default."""
        chosen = resource or self.primary_resource
        if chosen not in self._tables:
            raise ResourceNotFound(f"resource {chosen!r} is not one of {self.resources}")
        found = self._tables[chosen]
        if not isinstance(found, DataFrame):
            found = self._tables[chosen] = found()
        return found

    def tables(self) -> dict[str, DataFrame]:
        return {r: self.table(r) for r in self.resources}

    def read_resource(self, resource: str, fields: list[str] | None = None, limit: int | None = None) -> DataFrame:
        """Some columns (in the table's order) and at most limit rows; empty and 0 mean all."""
        df = self.table(resource)
        if fields:
            df = df.select(*[col(c) for c in df.columns if c in fields])
        return df.limit(limit) if limit else df

    def iter_resource(self, resource: str, chunksize: int = 10_000) -> Iterator[pd.DataFrame]:
        """The rows as pandas frames of chunksize rows; one partition at a time is on the driver."""
        df = self.table(resource)
        rows = df.toLocalIterator()
        while chunk := list(itertools.islice(rows, chunksize)):
            yield pd.DataFrame([tuple(r) for r in chunk], columns=df.columns)

    def keys(self, resource: str) -> tuple[list[str], dict[str, str]]:
        """Declared primary key, and foreign keys by column as 'resource.column'."""
        self.table(resource)
        return [], {}

    def size_in_bytes(self, resource: str) -> int | None:
        """Bytes of the files of a resource, where it has files."""
        files = self.table(resource).inputFiles()
        if not files:
            return None
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        paths = [jvm.org.apache.hadoop.fs.Path(f) for f in files]
        return sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths)

    def declared_type(self, resource: str, name: str) -> str | None:
        return None

    def get_resource_info(self, resource: str, samples: int = 5) -> ResourceInfo:
        if resource not in self._infos:
            from .operators.schema import profile_fields

            df = self.table(resource)
            profile = profile_fields(df, samples)
            primary, foreign = self.keys(resource)
            fields = [
                FieldInfo(
                    name=f.name,
                    dtype=self.declared_type(resource, f.name) or f.dataType.simpleString(),
                    nullable=profile.nulls[f.name] > 0,
                    is_primary_key=f.name in primary,
                    is_foreign_key=f.name in foreign,
                    foreign_key_reference=foreign.get(f.name),
                    pandas_like_dtype=pandas_like(f.dataType, profile.nulls[f.name] > 0),
                    sample_values=profile.samples[f.name],
                )
                for f in df.schema.fields
            ]
            self._infos[resource] = ResourceInfo(resource, profile.rows, len(fields), fields, primary or None, self.locations.get(resource), self.size_in_bytes(resource))
        return self._infos[resource]

    def get_all_resource_info(self) -> dict[str, ResourceInfo]:
        return {r: self.get_resource_info(r) for r in self.resources}

    def _discover(self) -> list[Relationship]:
        if len(self._tables) < 2:
            return []
        from .operators.relate import discover_relationships

        rows = discover_relationships(self.tables()).collect()
        return [Relationship(r.from_resource, r.from_field, r.to_resource, r.to_field, r.relationship_type, r.confidence, r.is_verified) for r in rows]

    def get_relationships(self) -> list[Relationship]:
        if self._relationships is None:
            self._relationships = self._discover()
        return self._relationships

    def get_field_values(self, resource: str, name: str, limit: int | None = 100) -> list:
        from .operators.profile import unique_values

        return [r.value for r in unique_values(self.table(resource), name, limit).collect()]

    def get_schema(self) -> dict:
        return {"name": self.name, "type": self.context_type.value, "resources": {k: v.to_dict() for k, v in self.get_all_resource_info().items()}, "relationships": [r.to_dict() for r in self.get_relationships()]}

    def get_file_path(self, resource: str) -> str | None:
        self.table(resource)
        return self.locations.get(resource)

    def get_all_file_paths(self) -> dict[str, str]:
        return dict(self.locations)

    def create_views(self, prefix: str = "") -> None:
        """Each resource as a temporary view."""
        for name, df in self.tables().items():
            df.createOrReplaceTempView(prefix + name)

    def execute_query(self, sql: str, params: list | dict | None = None) -> DataFrame:
        """SQL over the resources by name; params fill its markers."""
        self.create_views()
        return self.spark.sql(sql, args=params) if params else self.spark.sql(sql)

    def get_resource_ddl(self, resource: str) -> str:
        df = self.table(resource)
        return f"CREATE TABLE {resource} ({df.schema.toDDL()})"

    def to_dict(self) -> dict:
        return {"name": self.name, "type": self.context_type.value, "description": self.description, "resources": self.resources, "file_paths": dict(self.locations)}

    def __repr__(self) -> str:
        return f"{type(self).__name__}(name={self.name!r}, type={self.context_type.value}, resources={self.resources})"

    def __str__(self) -> str:
        return f"{self.name} ({self.context_type.value}): {', '.join(self.resources)}"


_CONTEXTS: dict[str, Context] = {}


def register_context(key: str, context: Context) -> str:
    _CONTEXTS[key] = context
    return key


def register_new(context: Context) -> str:
    """Register under a key of its own."""
    return register_context(f"ctx_{uuid.uuid4().hex[:8]}", context)


def get_context(key: str) -> Context:
    if key not in _CONTEXTS:
        raise ContextNotFound(f"no context {key!r}; registered: {sorted(_CONTEXTS)}")
    return _CONTEXTS[key]


def forget_context(key: str) -> None:
    _CONTEXTS.pop(key, None)


def clear_registry() -> None:
    _CONTEXTS.clear()
