"""What Python workers need: this package, and batches of bounded size."""

from __future__ import annotations

import contextlib
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

ROWS = 512
BYTES = 32 << 20
_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package's modules to the executors, once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent.parent
    if root.is_dir():  # else the package itself comes from a shipped archive
        archive = Path(tempfile.mkdtemp(prefix="strataprobe-")) / f"{root.name}.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for module in sorted(root.rglob("*.py")):
                out.write(module, module.relative_to(root.parent))
        context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def bound_batches(spark: SparkSession, rows: int = ROWS, size: int = BYTES) -> None:
    """Ship the package; cap the rows and bytes of a batch for this session, so that long texts fit in a worker's memory.

    The caps stay set: results are read lazily, after the operator has returned,
    and must be read under them.  Lower caps that the session has are left.
    """
    ship_package(spark)
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key, None)
        digits = "".join(c for c in now or "" if c.isdigit() or c == "-")
        if not digits or int(digits) <= 0 or int(digits) > most:
            spark.conf.set(key, str(most))


@contextlib.contextmanager
def rows_per_batch(spark: SparkSession, rows: int) -> Iterator[None]:
    """So many rows a batch in what is run inside; for rows that are megabytes each."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def fetched(df: DataFrame) -> pd.DataFrame:
    """A result of bounded size on the driver, column by column rather than row by row."""
    return df.toArrow().to_pandas()


def most_frequent(counted: DataFrame, key: str, limit: int | Callable[[Row], int], by: tuple[str, ...] = (), n: str = "n") -> DataFrame:
    """Rows of the highest counts, at most about limit of them (of each group), without sorting: by a threshold on the count.

    counted should be a written table, as it is read twice.  Only a histogram of
    counts (eight steps to a doubling) reaches the driver; of the step at a
    group's edge a share chosen by the hash of the key is taken.
    """
    step = F.floor(F.log2(F.col(n).cast("double")) * 8).cast("int")
    left: dict[tuple, int] = {}
    edges: dict[tuple, tuple[int, int]] = {}
    for row in sorted(counted.groupBy(*by, step.alias("_step")).agg(F.count("*").alias("_rows")).collect(), key=lambda r: -r["_step"]):
        group = tuple(row[c] for c in by)
        rest = left.setdefault(group, limit(row) if callable(limit) else limit)
        if group in edges:
            continue
        if row["_rows"] > rest:
            edges[group] = (row["_step"], int(rest / row["_rows"] * 1_000_000))
        left[group] = rest - row["_rows"]
    if not edges:
        return counted
    share = F.pmod(F.xxhash64(key), F.lit(1_000_000))
    schema = ", ".join([*(f"_{c} {counted.schema[c].dataType.simpleString()}" for c in by), "_edge int, _share int"])
    cut = F.broadcast(counted.sparkSession.createDataFrame([(*g, *e) for g, e in edges.items()], schema))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    inside = F.col("_edge").isNull() | (step > F.col("_edge")) | ((step == F.col("_edge")) & (share < F.col("_share")))
    return counted.join(cut, same, "left").where(inside).select(*counted.columns)
