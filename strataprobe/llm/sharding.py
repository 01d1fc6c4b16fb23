"""Sharding by weighted rendezvous hashing of stable record keys.

Each (key, shard) pair gets a uniform hash ``u`` and the score ``-ln(u)/weight``;
the shard of the least score takes the record.  A new shard can only win
records for itself, so growing from n to n+1 shards moves about 1/(n+1) of the
rows and never shuffles rows between old shards.

Defined results: a null key falls back to the text's digest (so that null keys
spread and equal texts stay together); a null text has size 1 and the CRC of no
bytes; repeated rows each get a slot; an empty table gives an empty table.
Columns of the input named size, text_crc32, law, shard, slot or grown_shard are
replaced, all others are kept whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import col
from .rows import packed, unpacked
from .scratch import Scratch

_SPAN = float(1 << 52)
ADDED = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def record_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    return F.coalesce(col(id_col).cast("string"), F.concat(F.lit("text:"), F.sha2(F.coalesce(col(text_col), F.lit("")), 256)))


def rendezvous(key: Column, shards: Sequence[tuple[int, float]], seed: str = "shard") -> Column:
    """The id of the shard that wins the key; shards are (id, weight) with weight above 0."""
    if not shards or any(w <= 0 for _, w in shards):
        raise ValueError("rendezvous needs shards of positive weight")

    def score(shard: int, weight: float) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(f"{seed}/{shard}")), 12)
        return F.struct((-F.log((bits + F.lit(0.5)) / F.lit(_SPAN)) / F.lit(float(weight))).alias("score"), F.lit(int(shard)).alias("shard"))

    return F.array_min(F.array(*[score(s, w) for s, w in shards]))["shard"]


def shard_documents(
    docs: DataFrame,
    shards: Sequence[tuple[int, float]] = tuple((i, 1.0) for i in range(8)),
    grown: tuple[int, float] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_columns: bool = True,
) -> DataFrame:
    """docs with size, text_crc32, law, shard, slot and grown_shard.

    slot numbers the rows of a shard from 0 without gaps.  Rows are numbered
    within (shard, input split) and offset by the counts of the splits before,
    so no task ever holds a whole shard, however hot a key may be.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(col(text_col), F.lit(""))
    key = F.col("key")
    row = packed(docs) if keep_columns else F.struct(col(id_col).alias(id_col))
    rows = (
        docs.select(row.alias("row"), record_key(id_col, text_col).alias("key"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"), F.lit("key").alias("law"))
        .withColumn("shard", rendezvous(key, shards).cast("int"))
        .withColumn("grown_shard", rendezvous(key, [*shards, grown]).cast("int") if grown else F.lit(None).cast("int"))
        .withColumn("split", F.spark_partition_id())
    )
    rows = scratch.keep(rows, "sharded")
    counts = rows.groupBy("shard", "split").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = scratch.keep(counts.select("shard", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")), "offsets")
    within = Window.partitionBy("shard", "split").orderBy("key", "text_crc32", "size")
    numbered = rows.withColumn("place", F.row_number().over(within).cast("long") - 1)
    out = numbered.join(offsets, ["shard", "split"]).withColumn("slot", F.col("offset") + F.col("place"))
    kept = unpacked(docs, but=ADDED) if keep_columns else [F.col("row").getField(id_col).alias(id_col)]
    return out.select(*kept, *ADDED)
