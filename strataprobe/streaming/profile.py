"""Running profiles of a stream: missing values, and records by period."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalars import col, missing


def running_missing_values(stream: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """row_count and one <field>_nulls column each: one row, to be written in complete mode."""
    names = fields or stream.columns
    return stream.groupBy().agg(F.count("*").alias("row_count"), *[F.count_if(missing(c, stream.schema[c].dataType)).alias(f"{c}_nulls") for c in names])


def running_records_by(stream: DataFrame, name: str, part: str = "year") -> DataFrame:
    """year or month, and n; to be written in complete mode."""
    ts = col(name).cast("timestamp")
    return stream.where(ts.isNotNull()).groupBy({"year": F.year, "month": F.month}[part](ts).alias(part)).agg(F.count("*").alias("n"))


def windowed_counts(stream: DataFrame, name: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts by window of event time, with a watermark for what comes late."""
    timed = stream.withColumn("_ts", col(name).cast("timestamp")).withWatermark("_ts", late)
    return timed.groupBy(F.window("_ts", width)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")


def read_growing(spark: SparkSession, path: str, schema, max_files: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def start(profile: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Run over what is there into a table in memory, and end."""
    return profile.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_path(spark: SparkSession, path: str) -> str:
    """A stream reads folders and patterns; a table of a single file becomes a pattern that matches it alone."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return f"{path[:-1]}[{path[-1]}]" if fs.getFileStatus(where).isFile() else path
