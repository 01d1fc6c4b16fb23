"""Exact deduplication as a stateful stream with disk-backed keyed state.

The table's files are read as a stream.  State is keyed by the SHA-256 of the
text and never expires; it keeps, per digest, the stable identifier and the
content locator (file and row index) of the row that stays, and the number of
rows seen.  It lives in RocksDB on the executors' disks and is checkpointed to
the shared folder.  With ``state_dir`` a later run goes on from that state and
folds in new files only; without it the state goes when the tables of the run do.

A digest hit is a claim, not proof: the bytes of every copy are compared with
those of the row that stays.  Rows whose bytes differ from it are grouped again
by digest and whole text.  Groups are counted map-side in the stream.  Where the
states meet the rows again, digests of very many rows (few enough to broadcast,
see ``rows.spread_join``) have their rows spread over tasks, and for the
comparison of bytes the row that stays is replicated once for every
``salt_rows`` copies, so no task holds a whole group.

Defined results: null text counts as the empty text; the row with the largest
id stays, null ids lose, and equal ids are settled by locator, so exactly one
row of a group stays; an empty table gives an empty table.  Only the id and
text columns of the input are read, whatever the others are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import col
from .rows import HOT_ROWS, spread_join
from .scratch import Scratch

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


class _Settings:
    """Session settings that hold while a stream runs."""

    def __init__(self, spark: SparkSession, values: dict[str, str]):
        self.spark, self.values = spark, values

    def __enter__(self) -> None:
        self.before = {k: self.spark.conf.get(k, None) for k in self.values}
        for k, v in self.values.items():
            self.spark.conf.set(k, v)

    def __exit__(self, *_: object) -> None:
        for k, v in self.before.items():
            if v is None:
                self.spark.conf.unset(k)
            else:
                self.spark.conf.set(k, v)


#: While bytes are compared: a filter on the keys of hits, of 2 MB however many there are, is made first and applied in the scan,
#: so that other texts are (mostly, beyond some million hits) not shuffled.
_FILTERED = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1g",
    "spark.sql.optimizer.runtime.bloomFilter.numBits": "16777216",
}


def _table(spark: SparkSession, path: str, id_col: str, text_col: str) -> DataFrame:
    """The two columns, read under their own schema, so that no other column can hide the rows' file and place."""
    whole = spark.read.parquet(path)
    return spark.read.schema(whole.select(col(id_col), col(text_col)).schema).parquet(path)


def _digested(table: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return table.select(col(id_col).alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).withColumn(
        "digest", F.sha2(F.col("text"), 256)
    )


def _latest(states: DataFrame) -> DataFrame:
    """The last state of each digest: its count only grows."""
    last = F.max(F.struct("n", "keep")).alias("last")
    return states.groupBy("digest").agg(last).select("digest", F.col("last.n").alias("n"), F.col("last.keep").alias("keep"))


def _locator(prefix: str = "") -> Column:
    return F.struct(F.col(f"{prefix}id"), F.col(f"{prefix}file"), F.col(f"{prefix}row"))


def fold_stream(spark: SparkSession, path: str, into: str, checkpoint: str, id_col: str = "doc_id", text_col: str = "text", max_files: int = 10_000) -> None:
    """Run the stream over all files not yet seen; each batch writes the states it changed under ``into``."""
    schema = _table(spark, path, id_col, text_col).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(_streamable(spark, path))
    states = _digested(stream, id_col, text_col).groupBy("digest").agg(F.count("*").alias("n"), F.max(_locator()).alias("keep"))

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{into}/epoch={epoch}")

    with _Settings(spark, _STATE):
        query = states.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
        try:
            query.awaitTermination()
        finally:
            query.stop()


def deduplicate_exact(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", max_files: int = 10_000, salt_rows: int = 64, hot_rows: int = HOT_ROWS, state_dir: str | None = None) -> DataFrame:
    """One row per row of the table at path: id, keep_id, group_size, kept, digest, file, row.

    state_dir: a folder that the executors share, for the stream's checkpoint and
    the states that it writes; a run over a table that has grown goes on there.
    """
    scratch = Scratch(spark)
    into, checkpoint = (f"{state_dir}/states", f"{state_dir}/checkpoint") if state_dir else (scratch.path("states"), scratch.path("checkpoint"))
    fold_stream(spark, path, into, checkpoint, id_col, text_col, max_files)
    table = _table(spark, path, id_col, text_col)
    kind = table.select(col(id_col).alias("id")).schema["id"].dataType.simpleString()
    state_schema = f"digest string, n bigint, keep struct<id:{kind},file:string,row:bigint>"
    states = scratch.keep(_latest(spark.read.schema(f"{state_schema}, epoch int").parquet(into).drop("epoch")) if _exists(spark, into) else spark.createDataFrame([], state_schema), "latest")
    rows = _digested(table, id_col, text_col)
    joined = spread_join(rows.drop("text"), states, "digest", states.select("digest", "n"), F.xxhash64("file", "row"), hot_rows)
    joined = scratch.keep(joined.withColumn("kept", (F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))), "rows")
    scratch.drop(states)

    with _Settings(spark, _FILTERED):
        different = scratch.keep(_unequal(rows, joined, salt_rows), "unequal")
    if not different.isEmpty():
        joined = scratch.keep(_regroup(rows, joined, different), "regrouped")
    return joined.select("id", F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"), "kept", "digest", "file", "row")


def _streamable(spark: SparkSession, path: str) -> str:
    """A stream reads folders and patterns; a table of a single file becomes a pattern that matches it alone."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return f"{path[:-1]}[{path[-1]}]" if fs.getFileStatus(where).isFile() else path


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _unequal(rows: DataFrame, joined: DataFrame, salt_rows: int) -> DataFrame:
    """Digests of which some copy's bytes differ from those of the row that stays.

    Rows find their mark by the hash of their place, the one key by which the
    scan can be filtered; should two places collide, their digests only come up here.
    """
    at = F.xxhash64("file", "row").alias("at")
    hits = joined.where(F.col("n") > 1)
    salts = F.ceil(F.col("n") / F.lit(salt_rows)).cast("int")
    stays = F.when(F.col("kept"), F.sequence(F.lit(0), salts - 1)).otherwise(F.array(F.pmod(F.xxhash64("file", "row"), salts).cast("int")))
    marks = hits.select(at, "digest", "kept", stays.alias("salts"))
    texts = rows.select(at, "text").join(marks, "at")
    left = texts.where(~F.col("kept")).select("digest", F.col("salts")[0].alias("salt"), "text")
    right = texts.where("kept").select("digest", F.explode("salts").alias("salt"), F.col("text").alias("kept_text"))
    return left.join(right, ["digest", "salt"]).where(F.col("text") != F.col("kept_text")).select("digest").distinct()


def _regroup(rows: DataFrame, joined: DataFrame, different: DataFrame) -> DataFrame:
    """joined, with the rows of the given digests grouped by whole text."""
    again = rows.join(different, "digest", "left_semi")
    groups = again.groupBy("digest", "text").agg(F.count("*").alias("n"), F.max(_locator()).alias("keep"))
    fixed = again.join(groups, ["digest", "text"]).withColumn("kept", (F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row")))
    return joined.join(different, "digest", "left_anti").unionByName(fixed.select(*joined.columns))
