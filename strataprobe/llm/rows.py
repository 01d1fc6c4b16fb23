"""The rows of an input beside an operator's own columns, and bounded samples of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.scalars import col

_POSITIVE = 1 << 63


def packed(docs: DataFrame, leave: tuple[str, ...] = ()) -> Column:
    """All columns of docs as one struct, so that none clashes with a helper column, whatever they are called."""
    return F.struct(*[col(c).alias(c) for c in docs.columns if c not in leave])


def unpacked(docs: DataFrame, row: str = "row", but: tuple[str, ...] = ()) -> list[Column]:
    """The columns of docs out of the struct named row, but for those that results replace (names in any case)."""
    replaced = {c.lower() for c in but}
    return [F.col(row).getField(c).alias(c) for c in docs.columns if c.lower() not in replaced]


def row_hash(*keys: Column, seed: str) -> Column:
    """A number from 0 to 2^63 - 1 by the given columns; nulls take part as values, so rows of null ids differ by text."""
    parts = []
    for key in keys:
        parts += [key.isNull(), key]
    return F.shiftrightunsigned(F.xxhash64(*parts, F.lit(seed)), 1)


def shares(counted: list[Row], rows: int, size: int) -> list[float]:
    """Of each group (rows, size) the share to draw, so that about rows rows and size bytes come of all together.

    Small groups are drawn whole; the rest is shared out evenly, in rows and in bytes.
    """

    def level(amounts: list[int], most: int) -> list[float]:
        rest, out = float(most), {}
        order = sorted(range(len(amounts)), key=lambda i: amounts[i])
        for place, i in enumerate(order):
            own = min(float(amounts[i]), rest / (len(order) - place))
            out[i] = own / amounts[i] if amounts[i] else 1.0
            rest -= own
        return [out[i] for i in range(len(amounts))]

    return [min(a, b) for a, b in zip(level([r["rows"] for r in counted], rows), level([r["size"] for r in counted], size), strict=True)]


def bounded_sample(docs: DataFrame, id_col: str, text_col: str, rows: int, size: int, longest: int, by: str | None = None, seed: str = "sample") -> DataFrame:
    """(text[, by]) of about rows rows and size bytes at most, by the hash of id and text.

    The sample is the same however docs is partitioned.  Rows equal in id and text
    (and by) are drawn once, so that no group of copies can break the bound; texts
    that are null or longer than ``longest`` bytes are not drawn.  by: a column
    whose values each get their part of the bound.
    """
    own = docs.select(col(id_col).alias("id"), col(text_col).alias("text"), *([col(by).alias("by")] if by else []))
    own = own.where(F.col("text").isNotNull() & (F.octet_length("text") <= longest))
    group = ["by"] if by else []
    counted = own.groupBy(*group).agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")).collect()
    limits = [(*[r[c] for c in group], min(_POSITIVE - 1, int(share * _POSITIVE))) for r, share in zip(counted, shares(counted, rows, size), strict=True)]
    own = own.withColumn("h", row_hash(F.col("id"), F.col("text"), seed=seed))
    if by:
        known = docs.sparkSession.createDataFrame(limits, f"own {own.schema['by'].dataType.simpleString()}, least bigint")
        own = own.join(F.broadcast(known), F.col("by").eqNullSafe(F.col("own"))).where(F.col("h") <= F.col("least"))
    else:
        own = own.where(F.col("h") <= (limits[0][0] if limits else 0))
    own = own.dropDuplicates([*group, "h"])  # map-side first: of a group of copies a task sends one
    own = own.repartition(docs.sparkSession.sparkContext.defaultParallelism, "h")  # else the small shuffle is one task, and so is the work on the sample
    return own.select("text", *([F.col("by").alias(by)] if by else []))


#: Rows of one key above which a join spreads them over several tasks, and keys at most that this can be.
HOT_ROWS, HOT_KEYS = 100_000, 100_000


def spread_join(left: DataFrame, right: DataFrame, key: str, counts: DataFrame, salt: Column | None = None, hot_rows: int = HOT_ROWS, how: str = "inner") -> DataFrame:
    """left joined with right (one row a key) on key, the rows of a frequent key spread over tasks; how: inner or left.

    counts(key, n): how many rows of left have each key, at least for the frequent keys.  Keys of more than
    hot_rows rows and of more than a HOT_KEYS-th of all rows are frequent; those
    are few enough to broadcast, however many rows there are.  salt: a number by
    which rows of a key are told apart, by default their place in the input split.
    """
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = max(hot_rows, -(-total // HOT_KEYS))
    hot = counts.where(F.col("n") > least).select(F.col(key).alias("hot_key"), F.ceil(F.col("n") / F.lit(least)).cast("int").alias("salts"))
    if hot.isEmpty():
        return left.join(right, key, how)
    own = F.monotonically_increasing_id() if salt is None else salt
    left = left.withColumn("own_salt", own).join(F.broadcast(hot), F.col(key) == F.col("hot_key"), "left")
    left = left.withColumn("salt", F.when(F.col("salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("own_salt"), F.col("salts")).cast("int"))).drop("hot_key", "salts", "own_salt")
    right = right.join(F.broadcast(hot), F.col(key) == F.col("hot_key"), "left")
    right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts"), F.lit(1)) - 1))).drop("hot_key", "salts")
    return left.join(right, [key, "salt"], how).drop("salt")
