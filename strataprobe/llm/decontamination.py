"""Benchmark decontamination: which test items a document holds.

The search is that of ``containment``: items partitioned by size, MinHash over
windows, exact containment of five-word shingles.  The items are the stated
query set.  Items of equal text are searched for once.  They are sent to the
workers in blocks, by the hash of their text, of about ``block_items`` texts and
``block_bytes`` bytes; one block at a time is searched for in every document,
its results are written, and its index is given back before the next is made,
so what the driver and the workers hold is bounded however many items there are.
A single block, as benchmarks usually are, needs one scan and no written table.

Defined results: null or wordless texts and items match nothing; null item ids
are reported as null; repeated items and documents each give their own rows; an
empty table of items or documents gives no rows; columns of the documents are
never changed, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import col
from .batches import bound_batches
from .containment import ContainmentIndex
from .rows import packed, unpacked
from .scratch import Scratch

BLOCK_ITEMS = 20_000
BLOCK_BYTES = 64 << 20
#: Documents found in blocks of items up to which their keys are broadcast to leave them out.
BROADCAST_ROWS = 1_000_000


def match_column(shared, text: Column) -> Column:
    """The items of a broadcast index that a text holds: an array of (item, n_item, n_shared, first_word)."""

    @F.pandas_udf("array<struct<item:string,n_item:bigint,n_shared:bigint,first_word:bigint>>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([[{"item": i, "n_item": q, "n_shared": s, "first_word": w} for i, q, s, w in m] for m in shared.value.matches(batch)], dtype=object)

    # as non-deterministic, so that a filter on the result does not run the search a second time
    return find.asNondeterministic()(text)


def _key(text: Column) -> Column:
    return F.sha2(text, 256)


class _Items:
    """Item texts in blocks of bounded size; equal texts are one, which is searched for under its digest."""

    def __init__(self, items: DataFrame, text_col: str, k: int, threshold: Fraction, block_items: int, block_bytes: int):
        self.texts = items.select(col(text_col).alias("text")).where("text IS NOT NULL").groupBy(_key(F.col("text")).alias("key")).agg(F.first("text").alias("text"))
        row = self.texts.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")).first()
        self.blocks = max(1, -(-row["n"] // block_items), -(-row["size"] // block_bytes))
        self.k, self.threshold = k, threshold

    def index(self, block: int):
        """The broadcast index of a block."""
        own = self.texts if self.blocks == 1 else self.texts.where(F.pmod(F.xxhash64("key"), F.lit(self.blocks)) == block)
        rows = own.collect()
        return own.sparkSession.sparkContext.broadcast(ContainmentIndex([r.key for r in rows], [r.text for r in rows], self.k, self.threshold))

    def search(self, text: Column, make: Callable[[Column], DataFrame], scratch: Scratch) -> DataFrame:
        """make(matches) for the matches of each block, put together; several blocks run one after another, each written."""
        if self.blocks == 1:
            return make(match_column(self.index(0), text))
        found = []
        for block in range(self.blocks):
            shared = self.index(block)
            found.append(scratch.keep(make(match_column(shared, text)), "block"))
            shared.destroy()
        return reduce(DataFrame.unionByName, found)


def contaminations(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    k: int = 5,
    threshold: Fraction = Fraction(4, 5),
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_items: int = BLOCK_ITEMS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document and item that it holds: id, item_id, n_item_shingles, n_shared, containment."""

    def rows(matches: Column) -> DataFrame:
        made = docs.select(col(id_col).alias("id"), matches.alias("matches")).where(F.size("matches") > 0)
        return made.select("id", F.explode("matches").alias("m")).select("id", "m.*")

    bound_batches(docs.sparkSession)
    found = _Items(items, item_text_col, k, threshold, block_items, block_bytes).search(col(text_col), rows, Scratch(docs.sparkSession))
    named = items.where(col(item_text_col).isNotNull()).select(_key(col(item_text_col)).alias("item"), col(item_col).alias("item_id"))
    return found.join(named, "item").select(F.col("id").alias(id_col), "item_id", F.col("n_item").alias("n_item_shingles"), "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    k: int = 5,
    threshold: Fraction = Fraction(4, 5),
    text_col: str = "text",
    item_text_col: str = "text",
    block_items: int = BLOCK_ITEMS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The documents that hold no item, with their own columns."""
    bound_batches(docs.sparkSession)
    known, text = _Items(items, item_text_col, k, threshold, block_items, block_bytes), col(text_col)
    if known.blocks == 1:
        marked = docs.select(packed(docs).alias("row"), match_column(known.index(0), text).alias("matches"))
        return marked.where(F.size("matches") == 0).select(*unpacked(docs))
    # of several blocks only the keys of what they find are written; rows equal in id and text hold the same items
    scratch = Scratch(docs.sparkSession)
    key = F.sha2(F.concat(F.coalesce(col(id_col).cast("string"), F.lit("~")), F.lit("/"), F.coalesce(text, F.lit(""))), 256)
    found = known.search(text, lambda matches: docs.select(key.alias("key"), matches.alias("matches")).where(F.size("matches") > 0).select("key").distinct(), scratch)
    found = scratch.keep(found.distinct(), "found")
    few = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    return docs.select(packed(docs).alias("row"), key.alias("key")).join(few, "key", "left_anti").select(*unpacked(docs))
