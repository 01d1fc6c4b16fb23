"""The corpus pipeline: toxicity, near duplicates, benchmark passages, mixing, shards.

Each stage takes (spark, docs, sf_dir) and returns what goes on; between stages
the rows are written and read again, and the tables that a stage made go.  All
stages but the last return the columns of documents, whatever they are called
and however many there are; the last adds those of the shards and replaces
columns of the same names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strataprobe.llm import toxicity
from strataprobe.llm.decontamination import decontaminate
from strataprobe.llm.jaccard_join import keep_one_per_class
from strataprobe.llm.mixing import mixed_rows
from strataprobe.llm.scratch import Scratch, temporary_tables
from strataprobe.llm.sharding import shard_documents


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learnt from the labelled rows among them, does not call toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out("doc_id", 5, 0)))
    return toxicity.reject_toxic(docs, model)


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates (five-word shingles, similarity 0.8) the document of the least id."""
    return keep_one_per_class(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed_rows(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row in one of 8 shards, with its place there."""
    return shard_documents(docs, [(i, 1.0) for i in range(8)], grown=(8, 1.0))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("jaccard_join", keep_one_copy),
    ("decontamination", remove_benchmark),
    ("mixing", mix),
    ("sharding", shard),
]

#: No SQL: the first stage scores with a trained model.  The tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written and read again."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with temporary_tables():
            out = scratch.keep(stage(spark, docs, sf_dir), name)
        if hasattr(docs, "_scratch_path"):
            scratch.drop(docs)
        docs = out
    return docs
