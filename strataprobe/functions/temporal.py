"""Reading times from columns of any type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scalars import col, is_numeric, is_temporal

#: Rows of the sample by which a column's format is chosen.
SAMPLE_ROWS = 1000
#: Formats tried on a sample; month first where both readings are possible.
FORMATS = (
    "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss.SSS",
    "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm", "yyyy/MM/dd", "yyyy/MM/dd HH:mm:ss", "yyyyMMdd",
    "MM/dd/yyyy", "MM/dd/yyyy HH:mm:ss", "dd/MM/yyyy", "dd/MM/yyyy HH:mm:ss", "MM-dd-yyyy", "dd-MM-yyyy", "dd.MM.yyyy", "dd.MM.yyyy HH:mm:ss", "d MMM yyyy", "MMM d, yyyy", "yyyy-MM", "yyyy",
)


def format_of(text: str | None) -> str | None:
    """The first format that reads a value."""
    return best_format(SparkSession.getActiveSession(), [text.strip()])[0] if text and text.strip() else None


def text_sample(df: DataFrame, name: str, rows: int = SAMPLE_ROWS) -> list[str]:
    """Trimmed texts that are not empty, of at most so many rows, chosen by the hash of value and place in the input: the same for the same files."""
    texts = df.select(F.trim(col(name)).alias("v"), F.monotonically_increasing_id().alias("at")).where("v != ''")
    return [r.v for r in texts.withColumn("h", F.xxhash64("v", "at")).orderBy("h", "at").limit(rows).select("v").collect()]


def best_format(spark: SparkSession, texts: list[str]) -> tuple[str | None, float]:
    """The format that reads most of the texts, the first of those that tie, and the share of them that it reads."""
    if not texts:
        return None, 0.0
    sample = spark.createDataFrame([(t,) for t in texts], "v string")
    reads = sample.agg(*[F.count(F.try_to_timestamp("v", F.lit(f))).alias(str(i)) for i, f in enumerate(FORMATS)]).first()
    best = max(range(len(FORMATS)), key=lambda i: (reads[i], -i))
    return (FORMATS[best], reads[best] / len(texts)) if reads[best] else (None, 0.0)


def as_time(df: DataFrame, name: str, numeric_epoch_ns: bool = False) -> Column:
    """The column as timestamps in the session's zone; what cannot be read is null.

    Texts are read strictly in one format, that which reads most of a sample, so
    values that are no times cost only themselves.  Numbers are times only with
    numeric_epoch_ns, as nanoseconds since 1970.
    """
    kind = df.schema[name].dataType
    c = col(name)
    if is_temporal(kind):
        return c.cast("timestamp")
    if isinstance(kind, T.StringType):
        found, _ = best_format(df.sparkSession, text_sample(df, name))
        return F.try_to_timestamp(F.trim(c), F.lit(found)) if found else F.lit(None).cast("timestamp")
    if is_numeric(kind) and numeric_epoch_ns:
        return F.timestamp_micros(F.floor(c.cast("double") / 1000).cast("long"))
    return F.lit(None).cast("timestamp")
