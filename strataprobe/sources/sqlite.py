"""SQLite as a Spark data source, read in ranges of rowid, and as a context.

The database file must be readable where the tasks run: a folder that all
executors share, or the driver's own in local mode.  Rows come through Python
one by one and every column that the schema names is read, so this is for files
of the size that SQLite is used for, not for the bulk of a corpus.
"""

from __future__ import annotations

import os
import re
import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from ..catalog import Context, ContextType, Relationship
from ..functions.scalars import col

#: Tables that SQLite keeps for itself.
INTERNAL = ("sqlite_sequence", "sqlite_stat1")
#: Rows of a partition, and partitions at most.
_ROWS, _PARTITIONS = 100_000, 1024
_NUMBER = re.compile(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*")
_LONG = range(-(1 << 63), 1 << 63)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def connect(path: str) -> sqlite3.Connection:
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def spark_type(declared: str) -> T.DataType:
    """By SQLite's rules of affinity."""
    name = declared.upper()
    if "INT" in name:
        return T.LongType()
    if any(x in name for x in ("CHAR", "CLOB", "TEXT")):
        return T.StringType()
    if "BLOB" in name:
        return T.BinaryType()
    if not name:
        return T.StringType()
    return T.DoubleType()


def columns_of(path: str, table: str) -> list[tuple]:
    """cid, name, type, notnull, default, place in the primary key."""
    with connect(path) as db:
        return db.execute(f"PRAGMA table_info({_quoted(table)})").fetchall()


class _Rows(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.table, self.schema = options["path"], options["dbtable"], schema
        self.rows = int(options.get("rowsperpartition", _ROWS))
        self.declared = {c[1]: c[2].upper() for c in columns_of(self.path, self.table)}
        self.conditions: list[tuple[str, tuple]] = []

    def pushFilters(self, filters):  # noqa: N802
        """Conditions that SQLite can test without losing a row go there as well; Spark checks all of them again.

        Values are of any type there, whatever the column's.  A number of a column
        of numbers compares in SQLite as it does here, and what reads as null here
        matches no comparison.  Texts are only tested for equality, byte by byte,
        and stored bytes, which read as text, always pass.  Columns without a type,
        and tests for null (a value that does not fit reads as null), are left to Spark.
        """
        signs = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            declared = self.declared.get(name, "")
            if declared and type(f) in signs and not isinstance(f.value, bool):
                kind, column = spark_type(declared), _quoted(name)
                if isinstance(kind, T.LongType | T.DoubleType) and isinstance(f.value, int | float):
                    self.conditions.append((f"{column} {signs[type(f)]} ?", (f.value,)))
                elif isinstance(kind, T.StringType) and isinstance(f, EqualTo) and isinstance(f.value, str):
                    self.conditions.append((f"({column} = ? COLLATE BINARY OR typeof({column}) = 'blob')", (f.value,)))
            elif declared and isinstance(f, IsNotNull):
                self.conditions.append((f"{_quoted(name)} IS NOT NULL", ()))
            yield f

    def partitions(self) -> list[InputPartition]:
        with connect(self.path) as db:
            try:
                total = db.execute(f"SELECT count(rowid) FROM {_quoted(self.table)}").fetchone()[0]
                step = max(self.rows, -(-total // _PARTITIONS), 1)
                # by counted rows, so that gaps between row numbers make no empty partitions
                found = db.execute(f"SELECT min(id) FROM (SELECT rowid AS id, (row_number() OVER (ORDER BY rowid) - 1) / ? AS part FROM {_quoted(self.table)}) GROUP BY part ORDER BY part", (step,)).fetchall()
            except sqlite3.OperationalError:  # a table without rowid, or a view
                return [_Rows(None, None)]
        lows = [r[0] for r in found]
        return [_Rows(low, high) for low, high in zip(lows, [*lows[1:], None], strict=True)] if lows else [_Rows(0, 0)]

    def read(self, partition: _Rows) -> Iterator[tuple]:
        names = ", ".join(_quoted(f.name) for f in self.schema.fields) or "1"
        where, args = [c for c, _ in self.conditions], [a for _, x in self.conditions for a in x]
        if partition.low is not None:
            where.append("rowid >= ?")
            args.append(partition.low)
        if partition.high is not None:
            where.append("rowid < ?")
            args.append(partition.high)
        with connect(self.path) as db:
            for row in db.execute(f"SELECT {names} FROM {_quoted(self.table)}" + " WHERE ".join(["", " AND ".join(where)] if where else [""]), args):
                yield tuple(_value(v, f.dataType) for v, f in zip(row, self.schema.fields, strict=True))


def _value(v: object, kind: T.DataType) -> object:
    """A stored value as the column's type; what does not fit is null, as columns hold values of any type."""
    if v is None:
        return None
    if isinstance(kind, T.LongType | T.DoubleType):
        if isinstance(v, str):
            v = float(v) if _NUMBER.fullmatch(v) else None
        if not isinstance(v, int | float):
            return None
        if isinstance(kind, T.DoubleType):
            return float(v)
        return int(v) if (isinstance(v, int) or v.is_integer()) and int(v) in _LONG else None
    if isinstance(kind, T.BinaryType):
        return bytes(v) if isinstance(v, bytes) else str(v).encode()
    return v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v)


class SQLiteDataSource(DataSource):
    """spark.read.format("sqlite").option("dbtable", ...).load(path)"""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> T.StructType:
        found = columns_of(self.options["path"], self.options["dbtable"])
        if not found:
            raise ValueError(f"no table {self.options['dbtable']!r}")
        return T.StructType([T.StructField(c[1], spark_type(c[2])) for c in found])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options, schema)


def read_sqlite(spark: SparkSession, path: str, table: str, rows_per_partition: int = _ROWS) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SQLiteDataSource)
    return spark.read.format("sqlite").option("dbtable", table).option("rowsperpartition", rows_per_partition).load(path)


class SQLiteContext(Context):
    """The tables of a SQLite file, with its declared keys."""

    def __init__(self, spark: SparkSession, db_path: str, name: str = "context", description: str | None = None, exclude_resources: list[str] | None = None):
        self.db_path = os.path.abspath(os.path.expanduser(re.sub("^file:(//(?=/))?", "", db_path)))
        hidden = {*INTERNAL, *(exclude_resources or [])}
        with connect(self.db_path) as db:
            names = [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name")]
        shown = [n for n in names if n not in hidden]
        super().__init__(spark, name, {n: read_sqlite(spark, self.db_path, n) for n in shown}, ContextType.SQLITE, description, dict.fromkeys(shown, self.db_path))

    def get_db_path(self) -> str:
        return self.db_path

    def read_resource(self, resource: str, fields: list[str] | None = None, limit: int | None = None) -> DataFrame:
        """Some columns in the order asked for, and at most limit rows; empty and 0 mean all."""
        df = self.table(resource)
        df = df.select(*[col(c) for c in fields]) if fields else df
        return df.limit(limit) if limit else df

    def declared_type(self, resource: str, name: str) -> str | None:
        return next((c[2] for c in columns_of(self.db_path, resource) if c[1] == name), None)

    def keys(self, resource: str) -> tuple[list[str], dict[str, str]]:
        primary = [c[1] for c in sorted(columns_of(self.db_path, resource), key=lambda c: c[5]) if c[5]]
        return primary, {f: f"{t}.{c}" if c else t for f, t, c in self._foreign(resource)}

    def _foreign(self, resource: str) -> list[tuple[str, str, str | None]]:
        """Column, parent and parent's column; a parent named alone stands for its primary key."""
        self.table(resource)
        with connect(self.db_path) as db:
            found = db.execute(f"PRAGMA foreign_key_list({_quoted(resource)})").fetchall()
        out = []
        for _, place, parent, own, theirs, *_ in sorted(found):
            if theirs is None:
                key = [c[1] for c in sorted(columns_of(self.db_path, parent), key=lambda c: c[5]) if c[5]]
                theirs = key[place] if place < len(key) else None
            out.append((own, parent, theirs))
        return out

    def _discover(self) -> list[Relationship]:
        return [Relationship(r, own, parent, theirs, "many-to-one", 1.0, True) for r in self.resources for own, parent, theirs in self._foreign(r)]

    def size_in_bytes(self, resource: str) -> int | None:
        return os.path.getsize(self.db_path)

    def get_resource_ddl(self, resource: str) -> str:
        with connect(self.db_path) as db:
            row = db.execute("SELECT sql FROM sqlite_master WHERE type = 'table' AND name = ?", (resource,)).fetchone()
        return row[0] if row and row[0] else ""

    def execute_native(self, sql: str, params: list | tuple = ()) -> DataFrame:
        """SQL in SQLite's own dialect, run by SQLite on the driver."""
        with connect(self.db_path) as db:
            cursor = db.execute(sql, tuple(params))
            names, rows = [d[0] for d in cursor.description], cursor.fetchall()
        kinds = [next((type(r[i]) for r in rows if r[i] is not None), str) for i in range(len(names))]
        types = {int: T.LongType(), float: T.DoubleType(), bytes: T.BinaryType()}
        schema = T.StructType([T.StructField(n, types.get(k, T.StringType())) for n, k in zip(names, kinds, strict=True)])
        return self.spark.createDataFrame([tuple(_value(v, f.dataType) for v, f in zip(r, schema.fields, strict=True)) for r in rows], schema)

    def to_dict(self) -> dict:
        return super().to_dict() | {"db_path": self.db_path, "size_in_bytes": os.path.getsize(self.db_path)}
