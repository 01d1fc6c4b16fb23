"""From paths to contexts."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from ..catalog import Context, ContextType
from .delimited import DelimitedContext, files_of, is_uri
from .parquet import ParquetContext
from .sqlite import SQLiteContext

#: Kinds of files by extension.
EXTENSIONS = {
    ".csv": ContextType.SINGLE_CSV,
    ".tsv": ContextType.SINGLE_CSV,
    ".txt": ContextType.TEXT,
    ".sqlite": ContextType.SQLITE,
    ".sqlite3": ContextType.SQLITE,
    ".db": ContextType.SQLITE,
    ".parquet": ContextType.PARQUET,
}


def detect_type_from_extension(path: str) -> ContextType:
    return EXTENSIONS.get(os.path.splitext(path.rstrip("/"))[1].lower(), ContextType.UNKNOWN)


def is_csv_type(path: str) -> bool:
    return detect_type_from_extension(path) is ContextType.SINGLE_CSV


def classify_context_type(paths: list[str]) -> ContextType:
    """What a set of paths will be read as."""
    if not paths:
        return ContextType.UNKNOWN
    if len(paths) > 1:
        return ContextType.MULTI_CSV if all(map(is_csv_type, paths)) else ContextType.UNKNOWN
    path = os.path.expanduser(paths[0])
    if os.path.isdir(path) and detect_type_from_extension(path) is not ContextType.PARQUET:
        files = [f for f in os.listdir(path) if is_csv_type(f)]
        return ContextType.MULTI_CSV if len(files) > 1 else ContextType.SINGLE_CSV if files else ContextType.UNKNOWN
    return detect_type_from_extension(path)


def _existing(path: str) -> str:
    """A path of this machine that is there; URIs are looked up when they are read."""
    if is_uri(path):
        return path
    path = os.path.expanduser(path)
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    return path


def create_context(spark: SparkSession, source, name: str = "context", pattern: str = "*.csv", **options) -> Context:
    """A context from a context, a path, a list of paths, or a dict of names and paths."""
    if isinstance(source, Context):
        return source
    if isinstance(source, str | os.PathLike):
        return _from_path(spark, os.fspath(source), name, pattern, **options)
    if isinstance(source, list | tuple):
        if not source:
            raise ValueError("an empty list of paths")
        paths = [_existing(os.fspath(p)) for p in source]
        return _typed(spark, detect_type_from_extension(paths[0]), paths, name, **options)
    if isinstance(source, dict):
        if not source:
            raise ValueError("an empty dict of paths")
        named = {k: _existing(os.fspath(v)) for k, v in source.items()}
        return _typed(spark, detect_type_from_extension(next(iter(named.values()))), named, name, **options)
    raise ValueError(f"no context can be made from {type(source).__name__}")


def _from_path(spark: SparkSession, path: str, name: str, pattern: str, **options) -> Context:
    kind = detect_type_from_extension(path)
    path = _existing(path)
    if kind is ContextType.UNKNOWN and (is_uri(path) or os.path.isdir(path)):
        files = [f if is_uri(path) else f.removeprefix("file:") for f in files_of(spark, path, pattern)]
        if not files:
            raise FileNotFoundError(f"no {pattern} in {path}")
        return _typed(spark, detect_type_from_extension(files[0]), files, name, **options)
    return _typed(spark, kind, path, name, **options)


def _typed(spark: SparkSession, kind: ContextType, source, name: str, **options) -> Context:
    """Text and unknown files are read as delimited ones."""
    if kind is ContextType.PARQUET:
        return ParquetContext(spark, source, name, **options)
    if kind is ContextType.SQLITE:
        if not isinstance(source, str):
            raise ValueError("several SQLite files cannot be one context")
        return SQLiteContext(spark, source, name, **options)
    return DelimitedContext(spark, source, name, **options)
