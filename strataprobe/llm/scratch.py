"""Intermediate tables in the folder that the cluster shares.

A written table cuts lineage and survives lost executors.  The folder is the
session's ``spark.checkpoint.dir``.  Where that is unset, a session with a local
master sets a folder of its machine once and uses that; any other master is an
error, as its executors would each write to a disk of their own.

Operators drop the tables that nothing reads any more.  Those that a result
still reads go when the driver ends, or at the end of ``temporary_tables``.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_PREFIX = "strataprobe-"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the session."""
    found = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"{_KEY} is not set: the executors of {master} need a folder that they all share")
        found = tempfile.mkdtemp(prefix=_PREFIX)
        spark.conf.set(_KEY, found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


_OPEN: list[list[Scratch]] = []


@contextlib.contextmanager
def temporary_tables() -> Iterator[None]:
    """Tables that operators make inside go at the end of the block; a result must be written or fetched by then."""
    own: list[Scratch] = []
    _OPEN.append(own)
    try:
        yield
    finally:
        _OPEN.remove(own)
        for scratch in own:
            scratch.close()


class Scratch:
    """Tables of one operator run; all that are left go when the driver ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{_PREFIX}{uuid.uuid4().hex}"
        self._count = 0
        atexit.register(self._end)
        if _OPEN:
            _OPEN[-1].append(self)

    def path(self, name: str = "table") -> str:
        self._count += 1
        return f"{self.root}/{self._count:04d}-{name}"

    def keep(self, df: DataFrame, name: str = "table") -> DataFrame:
        """Write df, return a reader of what was written."""
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that nothing reads any more."""
        _delete(self.spark, df._scratch_path)

    def close(self) -> None:
        """Delete all tables."""
        atexit.unregister(self._end)
        _delete(self.spark, self.root)

    def _end(self) -> None:
        try:
            _delete(self.spark, self.root)
        except Exception:  # noqa: BLE001  the session or its gateway has gone already
            return
