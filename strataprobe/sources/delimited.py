"""Delimited text: delimiter detection, missing-value tokens, inferred types."""

from __future__ import annotations

import codecs
import functools
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import Context, ContextType
from ..errors import ResourceNotFound
from ..functions.scalars import NA_TOKENS, col, without_na_tokens
from ..operators.schema import slices

# Candidates for the delimiter, and how much of a file is looked at.
DELIMITERS = (",", "\t", ";", "|")
_HEAD = 8192


def is_uri(path: str) -> bool:
    return re.match(r"[A-Za-z][A-Za-z0-9+.-]+:", path) is not None


def absolute(path: str) -> str:
    """A path of this machine in full; URIs as they are."""
    return path if is_uri(path) else os.path.abspath(os.path.expanduser(path))


def files_of(spark: SparkSession, path: str, pattern: str = "*") -> list[str]:
    """The files that a path in any store means, in order: itself, or those of a folder that fit the pattern and are not hidden."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(conf)
    if not fs.exists(where):
        raise FileNotFoundError(path)
    if not fs.getFileStatus(where).isDirectory():
        return [path]
    found = [s.getPath() for s in fs.globStatus(jvm.org.apache.hadoop.fs.Path(where, pattern)) or []]
    return sorted(p.toString() for p in found if not p.getName().startswith(("_", ".")))


def _head(spark: SparkSession, path: str, size: int) -> bytes:
    """The first bytes of the first file that is not empty, read through Hadoop's file systems as Spark reads."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for file in files_of(spark, path):
        where = jvm.org.apache.hadoop.fs.Path(file)
        fs = where.getFileSystem(conf)
        length = min(size, fs.getFileStatus(where).getLen())
        if length:
            stream = fs.open(where)
            try:
                return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, length))
            finally:
                stream.close()
    return b""


def detect_delimiter(path: str, encoding: str = "utf-8", spark: SparkSession | None = None) -> str:
    """The most frequent candidate of the file's head, if it parts its first lines alike; else the comma.

    A URI or a folder needs the session; what cannot be read there is an error.
    """
    if spark is not None:
        head = _head(spark, path, 4 * _HEAD).decode(encoding, "replace")[:_HEAD]
    else:
        try:
            with open(path, encoding=encoding) as f:
                head = f.read(_HEAD)
        except (OSError, UnicodeError):
            return ","
    best = max(DELIMITERS, key=head.count)
    widths = {len(line.split(best)) for line in [x for x in head.splitlines() if x.strip()][:5]}
    return best if len(widths) == 1 and widths.pop() > 1 else ","


def _typed(df: DataFrame) -> DataFrame:
    """Text columns as boolean, integer or floating, where every value that is not missing reads as that."""
    tests = {"long": r"^\s*[+-]?\d{1,18}\s*$", "double": r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$|^\s*[+-]?(?i:inf|infinity)\s*$", "boolean": r"^(?:True|TRUE|true|False|FALSE|false)$"}
    kinds = {}
    for names in slices(df.columns):
        if names:
            row = df.agg(*[F.bool_and(col(c).rlike(p)).alias(f"{i}_{kind}") for i, c in enumerate(names) for kind, p in tests.items()]).first()
            kinds |= {c: next((k for k in ("long", "double", "boolean") if row[f"{i}_{k}"]), "string") for i, c in enumerate(names)}
    if not kinds:
        return df
    return df.select(*[(F.trim(col(c)).cast(k) if k != "string" else col(c)).alias(c) for c, k in kinds.items()])


def has_quoted_newlines(spark: SparkSession, path: str) -> bool:
    """Whether some line holds an odd number of quotes, as a record that goes on in the next line does."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def read_delimited(
    spark: SparkSession, path: str, delimiter: str | None = None, encoding: str = "utf-8", infer: bool = True, schema: T.StructType | None = None, na_tokens: tuple[str, ...] = NA_TOKENS, multiline: bool | None = None, **options: str
) -> DataFrame:
    """A file with a header, or a folder of them, as a DataFrame; types are inferred over all rows unless a schema is given.

    Files are read in splits, by many tasks, unless records go on over lines:
    multiline says so; None looks for quoted newlines first, in one splittable scan.
    """
    path = absolute(path)
    if multiline is None:
        multiline = codecs.lookup(encoding).name.startswith(("utf-16", "utf-32")) or has_quoted_newlines(spark, path)
    reader = spark.read.options(header="true", sep=delimiter or detect_delimiter(path, encoding, spark), encoding=encoding, multiLine=str(multiline).lower(), quote='"', escape='"', mode="PERMISSIVE").options(**options)
    if schema is not None:
        return reader.schema(schema).csv(path)
    df = without_na_tokens(reader.option("inferSchema", "false").csv(path), na_tokens)
    return _typed(df) if infer else df


class DelimitedContext(Context):
    """One or more delimited files, one resource each, named by file stem or by the caller."""

    def __init__(self, spark: SparkSession, source: str | list[str] | dict[str, str], name: str = "context", description: str | None = None, delimiter: str | None = None, encoding: str = "utf-8", **read_options):
        self.encoding, self.read_options = encoding, read_options
        self._delimiters: dict[str, str] = {}
        paths = source if isinstance(source, dict) else named_by_stem([source] if isinstance(source, str) else list(source))
        paths = {k: absolute(v) for k, v in paths.items()}
        for k, p in paths.items():
            self._delimiters[k] = delimiter or detect_delimiter(p, encoding, spark)
        # types are inferred by a scan, so a table is read when it is first asked for
        tables = {k: functools.partial(read_delimited, spark, p, self._delimiters[k], encoding, **read_options) for k, p in paths.items()}
        super().__init__(spark, name, tables, ContextType.MULTI_CSV if len(paths) > 1 else ContextType.SINGLE_CSV, description, paths)

    def get_delimiter(self, resource: str) -> str:
        if resource not in self._delimiters:
            raise ResourceNotFound(f"resource {resource!r} is not one of {self.resources}")
        return self._delimiters[resource]

    def to_dict(self) -> dict:
        return super().to_dict() | {"delimiters": dict(self._delimiters)}


def stem(path: str) -> str:
    return os.path.splitext(os.path.basename(path.rstrip("/")))[0]


def named_by_stem(paths: list[str]) -> dict[str, str]:
    """Paths by file stem; two of one stem are an error rather than one lost."""
    out: dict[str, str] = {}
    for path in paths:
        if stem(path) in out:
            raise ValueError(f"two files are named {stem(path)!r}; give them names")
        out[stem(path)] = path
    return out


def load_preview(spark: SparkSession, path: str, rows: int = 25) -> DataFrame:
    """The first rows of an uploaded file: tabs for .tsv, else commas."""
    return read_delimited(spark, path, "\t" if path.lower().endswith(".tsv") else ",", infer=False).limit(rows)
