"""Times: which columns hold them, how fine they are, what span they cover."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import NoValidValues
from ..functions.names import suggests_time
from ..functions.scalars import as_text, col, is_temporal, missing
from ..functions.temporal import as_time, best_format, text_sample
from .schema import require, sample_values

# Share of a sample that must read as a time, and the sample's size.
PARSE_SHARE = 0.8
SAMPLE_ROWS = 100
_TEMPORAL = "field string, name_suggests_temporal boolean, detected_type string, sample_values array<string>"
#: Cells, of about as many distinct times each, in which a column of times is sorted.
_CELLS = 1024


def detected_type(df: DataFrame, name: str) -> str | None:
    """datetime64, timedelta64, datetime_string or None."""
    kind = df.schema[name].dataType
    if is_temporal(kind):
        return "datetime64"
    if isinstance(kind, T.DayTimeIntervalType):
        return "timedelta64"
    if not isinstance(kind, T.StringType):
        return None
    _, read = best_format(df.sparkSession, text_sample(df, name, SAMPLE_ROWS))
    return "datetime_string" if read > PARSE_SHARE else None


def detect_temporal_columns(df: DataFrame, samples: int = 5) -> DataFrame:
    """field, name_suggests_temporal, detected_type, sample_values of the columns that are times by name or by type."""
    looks = {c: (suggests_time(c), detected_type(df, c)) for c in df.columns}
    held = sample_values(df, samples)
    return df.sparkSession.createDataFrame([(c, named, kind, held[c]) for c, (named, kind) in looks.items() if named or kind], _TEMPORAL)


def granularity(seconds: Column) -> Column:
    """The name of a typical gap."""
    day = 86_400
    return (
        F.when(seconds < 1, "sub-second").when(seconds < 60, "second").when(seconds < 3600, "minute").when(seconds < day, "hourly").when(seconds < 7 * day, "daily").when(seconds < 32 * day, "weekly/monthly").when(seconds.isNotNull(), "monthly+")
    )


def median_gap(times: DataFrame) -> DataFrame:
    """median_gap_us of a frame of one column ts: the median difference of successive sorted times, in microseconds.

    Equal times are counted map-side (each repeat is a gap of 0).  The time axis
    is cut into cells at approximate quantiles of the distinct times, so that
    outliers make no cell larger; differences within a cell come from a window
    over the cell, those between cells from the cells' first and last times, so
    no task sorts the whole column.  The quantiles are worked out at once.
    """
    micros = times.where("ts IS NOT NULL").select(F.unix_micros("ts").alias("us")).groupBy("us").agg(F.count("*").alias("n"))
    cuts = micros.agg(F.percentile_approx("us", [i / _CELLS for i in range(1, _CELLS)], 4 * _CELLS)).first()[0] or []
    splits = [-float("inf"), *sorted({float(c) for c in cuts}), float("inf")]
    placed = micros.withColumn("x", F.col("us").cast("double"))
    placed = Bucketizer(splits=splits, inputCol="x", outputCol="cell").transform(placed) if len(splits) > 2 else placed.withColumn("cell", F.lit(0.0))
    placed = placed.select("us", "n", "cell")
    before = F.lag("us").over(Window.partitionBy("cell").orderBy("us"))
    inner = placed.select((F.col("us") - before).alias("gap"), F.lit(1).cast("long").alias("n")).where("gap IS NOT NULL")
    edges = placed.groupBy("cell").agg(F.min("us").alias("first"), F.max("us").alias("last"))
    across = edges.select((F.col("first") - F.lag("last").over(Window.orderBy("cell"))).alias("gap"), F.lit(1).cast("long").alias("n")).where("gap IS NOT NULL")
    repeats = micros.where("n > 1").agg(F.sum(F.col("n") - 1).alias("n")).select(F.lit(0).cast("long").alias("gap"), "n").where("n IS NOT NULL")
    gaps = inner.unionByName(across).unionByName(repeats).groupBy("gap").agg(F.sum("n").alias("n"))
    return gaps.agg(F.percentile("gap", F.lit(0.5), F.col("n")).alias("median_gap_us"))


def _span(low: Column, high: Column) -> Column:
    return F.floor((F.unix_micros(high) - F.unix_micros(low)) / F.lit(86_400_000_000)).cast("long")


def analyze_temporal_column(df: DataFrame, name: str, numeric_epoch_ns: bool = False) -> DataFrame:
    """One row: field, total, null_count, parse_success_rate (of all rows), min_ts, max_ts, span_days, median_gap_us, apparent_granularity, timezone."""
    require(df, name)
    kind = df.schema[name].dataType
    ts = as_time(df, name, numeric_epoch_ns)
    counted = df.agg(F.count("*").alias("total"), F.count_if(missing(name, kind)).alias("null_count"), F.count(ts).alias("valid"), F.min(ts).alias("min_ts"), F.max(ts).alias("max_ts"))
    gap = median_gap(df.select(ts.alias("ts")))
    rate = F.when(F.col("total") > 0, F.bround(F.col("valid") / F.col("total"), 4)).otherwise(0.0)
    zone = "UTC" if isinstance(kind, T.TimestampType) else "none/naive"
    return counted.join(F.broadcast(gap)).select(
        F.lit(name).alias("field"), "total", "null_count", rate.alias("parse_success_rate"), "min_ts", "max_ts", _span(F.col("min_ts"), F.col("max_ts")).alias("span_days"), F.col("median_gap_us").cast("double").alias("median_gap_us"),
        F.when(F.col("valid") > 1, granularity(F.col("median_gap_us") / 1e6)).alias("apparent_granularity"), F.lit(zone).alias("timezone"),
    )


def temporal_extent(df: DataFrame, name: str, numeric_epoch_ns: bool = False) -> DataFrame:
    """One row: total_records, valid_timestamps, null_timestamps, start_ts, end_ts, duration_days."""
    require(df, name)
    ts = as_time(df, name, numeric_epoch_ns)
    out = df.agg(F.count("*").alias("total_records"), F.count(ts).alias("valid_timestamps"), F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"))
    return out.select("total_records", "valid_timestamps", (F.col("total_records") - F.col("valid_timestamps")).alias("null_timestamps"), "start_ts", "end_ts", _span(F.col("start_ts"), F.col("end_ts")).alias("duration_days"))


def checked_temporal_extent(df: DataFrame, name: str) -> dict:
    """temporal_extent as a dict; a column without any time is an error."""
    row = temporal_extent(df, name).first()
    if not row["valid_timestamps"]:
        raise NoValidValues(f"column {name!r} has no valid times")
    return row.asDict()


def records_by(df: DataFrame, name: str, part: str = "year") -> DataFrame:
    """year (or month of the year) and n, in order; empty unless there is more than one valid time."""
    require(df, name)
    ts = as_time(df, name)
    unit = {"year": F.year, "month": F.month}[part](ts)
    counted = df.where(ts.isNotNull()).groupBy(unit.alias(part)).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.join(F.broadcast(total)).where("total > 1").select(part, "n").orderBy(part)


def text_time_share(df: DataFrame, name: str) -> DataFrame:
    """Rows of a text column by whether they read as a time."""
    require(df, name)
    ts = as_time(df, name)
    return df.groupBy(ts.isNotNull().alias("is_time")).agg(F.count("*").alias("n"), F.min(as_text(name, df.schema[name].dataType)).alias("least"))
