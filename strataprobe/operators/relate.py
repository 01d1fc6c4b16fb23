"""How tables relate: overlap of columns, discovered keys, join previews."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import names_match
from ..functions.scalars import canonical, col, family, is_nested, present
from .schema import require

# Thresholds and weights of relationship discovery.
LEAST_OVERLAP = 0.1
DISCOVERY_UNIQUE = 0.9
COLUMN_UNIQUE = 0.99
OVERLAP_WEIGHT = 0.8
NAME_WEIGHT = 0.2
FOREIGN_KEY_CONFIDENCE = 0.5


#: Characters of a value that are shuffled; of longer ones, a digest besides.
_HEAD = 64


def _key(df: DataFrame, name: str) -> Column:
    """A text that is equal for equal values and never long: of long ones the first characters and a digest."""
    kind = df.schema[name].dataType
    value = canonical(name, kind)
    return F.when(F.length(value) > _HEAD, F.concat(F.substring(value, 1, _HEAD), F.lit("\u2026"), F.md5(value))).otherwise(value) if family(kind) == "text" else value


def _values(df: DataFrame, name: str) -> DataFrame:
    return df.select(_key(df, name).alias("value"))


def column_relationship(a: DataFrame, column_a: str, b: DataFrame, column_b: str) -> DataFrame:
    """One row: how the distinct values of two columns overlap, and what key relation that suggests.

    Distinct values are counted map-side and only they are shuffled; columns of
    different type families have no common value.
    """
    require(a, column_a)
    require(b, column_b)
    tag = lambda df, name, side: _values(df, name).groupBy("value").agg(F.count("*").alias("n")).select(
        F.lit(family(df.schema[name].dataType)).alias("family"), "value", *[F.col("n").alias(f"n_{s}") if s == side else F.lit(0).cast("long").alias(f"n_{s}") for s in "ab"]
    )
    both = tag(a, column_a, "a").unionByName(tag(b, column_b, "b")).groupBy("family", "value").agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"))
    some = F.col("value").isNotNull()
    counts = both.agg(
        F.count_if(some & (F.col("n_a") > 0)).alias("values_in_a"),
        F.count_if(some & (F.col("n_b") > 0)).alias("values_in_b"),
        F.count_if(some & (F.col("n_a") > 0) & (F.col("n_b") > 0)).alias("common_values"),
        F.coalesce(F.sum("n_a"), F.lit(0)).alias("rows_a"),
        F.coalesce(F.sum("n_b"), F.lit(0)).alias("rows_b"),
    )
    rate = lambda n: F.when(F.col(n) > 0, F.bround(F.col("common_values") / F.col(n), 4)).otherwise(0.0)
    unique = lambda n, rows: (F.col(rows) > 0) & (F.col(n) >= COLUMN_UNIQUE * F.col(rows))
    out = counts.select("values_in_a", "values_in_b", "common_values", rate("values_in_a").alias("match_rate_a_to_b"), rate("values_in_b").alias("match_rate_b_to_a"), unique("values_in_a", "rows_a").alias("is_unique_in_a"), unique("values_in_b", "rows_b").alias("is_unique_in_b"))
    exact = lambda n: F.when(F.col(n) > 0, F.col("common_values") / F.col(n)).otherwise(0.0)
    ua, ub = F.col("is_unique_in_a"), F.col("is_unique_in_b")
    kind = F.when(ua & ub, "one-to-one").when(ua, "one-to-many (A -> B)").when(ub, "one-to-many (B -> A)").otherwise("many-to-many")
    confidence = F.bround((exact("values_in_a") + exact("values_in_b")) / 2, 4)
    return out.withColumn("suggested_relationship_type", kind).withColumn("confidence_score", confidence).withColumn("likely_foreign_key", (confidence > FOREIGN_KEY_CONFIDENCE) & (ua | ub))


def common_values(a: DataFrame, column_a: str, b: DataFrame, column_b: str, limit: int = 10) -> DataFrame:
    """value: the least distinct values, as text, that both columns have.

    Values of more than 64 characters meet by a digest, and are put in order by
    their first 64 characters; only those that are shown are fetched whole.
    """
    require(a, column_a)
    require(b, column_b)
    if family(a.schema[column_a].dataType) != family(b.schema[column_b].dataType):
        return _values(a, column_a).limit(0)
    left, right = (_values(df, c).where("value IS NOT NULL").distinct() for df, c in ((a, column_a), (b, column_b)))
    least = left.join(right, "value", "left_semi").orderBy("value").limit(limit)
    if family(a.schema[column_a].dataType) != "text":
        return least
    whole = a.select(_key(a, column_a).alias("key"), canonical(column_a, a.schema[column_a].dataType).alias("value"))
    return whole.join(F.broadcast(least.withColumnRenamed("value", "key")), "key", "left_semi").select("value").distinct().orderBy("value")


def _long(tables: dict[str, DataFrame], columns: dict[str, list[str]], sample_rows: int | None) -> DataFrame:
    """(t, c, family, value, n) of the candidate columns: one scan a table, counted map-side."""
    frames = []
    for t, (name, df) in enumerate(tables.items()):
        wanted = columns[name]
        if not wanted:
            continue
        rows = df.select(*[col(c) for c in wanted])
        if sample_rows:
            rows = rows.orderBy(*[col(c) for c in wanted]).limit(sample_rows)
        cells = F.array(*[F.struct(F.lit(df.columns.index(c)).alias("c"), F.lit(family(df.schema[c].dataType)).alias("family"), _key(df, c).alias("value")) for c in wanted])
        frames.append(rows.select(F.explode(cells).alias("x")).select(F.lit(t).alias("t"), "x.c", "x.family", "x.value").groupBy("t", "c", "family", "value").agg(F.count("*").alias("n")))
    return reduce(DataFrame.unionByName, frames)


EDGES = "from_resource string, from_field string, to_resource string, to_field string, relationship_type string, match_rate double, common_value_count bigint, confidence double, is_verified boolean"


def candidate_pairs(tables: dict[str, DataFrame]) -> list[tuple[str, str, str, str]]:
    """Pairs of columns of different tables whose names match and whose types can be equal; from the schemas alone."""
    names = list(tables)
    usable = {t: [f for f in df.schema.fields if not is_nested(f.dataType)] for t, df in tables.items()}
    return [(a, x.name, b, y.name) for i, a in enumerate(names) for b in names[i + 1 :] for x in usable[a] for y in usable[b] if names_match(x.name, y.name) and family(x.dataType) == family(y.dataType)]


def discover_relationships(tables: dict[str, DataFrame], sample_rows: int | None = None, samples: int = 5) -> DataFrame:
    """Edges between columns whose names match and whose values overlap, the most confident first.

    One plan finds all pairs: every candidate column becomes (column, value)
    rows, distinct map-side, and equal values meet in one shuffle, where each
    value yields the candidate pairs of columns that hold it.
    Samples show long values by their first 64 characters and a digest.
    sample_rows: look only at so many first rows (in the order of the columns).
    """
    spark = next(iter(tables.values())).sparkSession
    pairs = candidate_pairs(tables)
    if not pairs:
        return spark.createDataFrame([], EDGES + ", sample_common_values array<string>")
    names = list(tables)
    columns = {t: [c for c in df.columns if any((t, c) in ((p[0], p[1]), (p[2], p[3])) for p in pairs)] for t, df in tables.items()}
    held = _long(tables, columns, sample_rows)
    sizes = held.groupBy("t", "c").agg(F.count_if(F.col("value").isNotNull()).alias("distinct"), F.sum("n").alias("rows"))
    place = {t: {c: i for i, c in enumerate(df.columns)} for t, df in tables.items()}
    known = spark.createDataFrame([(names.index(a), place[a][x], names.index(b), place[b][y], a, x, b, y) for a, x, b, y in pairs], "t int, c int, t_b int, c_b int, from_resource string, from_field string, to_resource string, to_field string")
    left = held.where("value IS NOT NULL").join(F.broadcast(known), ["t", "c"]).select("t", "c", "t_b", "c_b", "family", "value")
    right = held.where("value IS NOT NULL").select(F.col("t").alias("t_b"), F.col("c").alias("c_b"), "family", "value")
    shared = left.join(right, ["t_b", "c_b", "family", "value"])
    # of each of 64 parts of the values the least one, so that samples stay few however many values are common
    parts = shared.groupBy("t", "c", "t_b", "c_b", F.pmod(F.xxhash64("value"), F.lit(64)).alias("part")).agg(F.count("*").alias("n"), F.min("value").alias("low"))
    common = parts.groupBy("t", "c", "t_b", "c_b").agg(F.sum("n").alias("common_value_count"), F.slice(F.sort_array(F.collect_list("low")), 1, samples).alias("sample_common_values"))
    by = lambda s: F.broadcast(sizes.select(F.col("t").alias("t" + s), F.col("c").alias("c" + s), F.col("distinct").alias("distinct" + s), F.col("rows").alias("rows" + s)))
    joined = common.join(F.broadcast(known), ["t", "c", "t_b", "c_b"]).join(by(""), ["t", "c"]).join(by("_b"), ["t_b", "c_b"])
    raw = F.col("common_value_count") / F.least("distinct", "distinct_b")
    unique = lambda s: F.col("distinct" + s) / F.col("rows" + s) > DISCOVERY_UNIQUE
    kind = F.when(unique("") & unique("_b"), "one-to-one").when(unique(""), "one-to-many").when(unique("_b"), "many-to-one").otherwise("many-to-many")
    edges = joined.where(raw > LEAST_OVERLAP).select(
        "t", "c", "t_b", "c_b", "from_resource", "from_field", "to_resource", "to_field", kind.alias("relationship_type"), F.bround(raw, 4).alias("match_rate"), "common_value_count",
        F.bround(OVERLAP_WEIGHT * raw + NAME_WEIGHT, 3).alias("confidence"), F.lit(False).alias("is_verified"), "sample_common_values",
    )
    return edges.orderBy(F.col("confidence").desc(), "t", "t_b", "c", "c_b").drop("t", "c", "t_b", "c_b")


JOIN_TYPES = {"inner": "inner", "left": "left", "right": "right", "outer": "full"}


def join_tables(a: DataFrame, column_a: str, b: DataFrame, column_b: str, join_type: str = "inner", null_safe: bool = False) -> DataFrame:
    """Equi-join of two tables; unknown types are inner.

    Clashing columns end in _table_a and _table_b; a key of one name is one
    column.  null_safe: null keys join null keys, all with all in one task, so
    this is for sides of few null keys; ``join_count`` counts such joins of any
    size.  Keys of different type families join nothing.
    """
    require(a, column_a)
    require(b, column_b)
    how = JOIN_TYPES.get(join_type, "inner")
    clash = {c for c in a.columns if c in b.columns} - ({column_a} if column_a == column_b else set())
    own = "_key"
    while any(c.lower().startswith(own) for c in [*a.columns, *b.columns]):
        own = "_" + own
    key_a, key_b = f"{own}_a", f"{own}_b"
    left = a.select(*[col(c).alias(c + "_table_a" if c in clash else c) for c in a.columns if not (column_a == column_b and c == column_a)], col(column_a).alias(key_a))
    right = b.select(*[col(c).alias(c + "_table_b" if c in clash else c) for c in b.columns if not (column_a == column_b and c == column_b)], col(column_b).alias(key_b))
    same = family(a.schema[column_a].dataType) == family(b.schema[column_b].dataType)
    condition: Column = F.lit(False)
    if same:
        condition = F.col(key_a).eqNullSafe(F.col(key_b)) if null_safe else F.col(key_a) == F.col(key_b)
    joined = left.join(right, condition, how)
    if column_a == column_b:
        key = F.coalesce(F.col(key_a), F.col(key_b)) if same else F.coalesce(F.col(key_a).cast("string"), F.col(key_b).cast("string"))
        joined = joined.withColumn(column_a, key)
        return joined.select(*[F.col("`" + (c + "_table_a" if c in clash else c).replace("`", "``") + "`") for c in a.columns], *[F.col("`" + (c + "_table_b" if c in clash else c).replace("`", "``") + "`") for c in b.columns if c != column_b])
    return joined.drop(key_a, key_b)


def join_preview(a: DataFrame, column_a: str, b: DataFrame, column_b: str, join_type: str = "inner", preview_rows: int = 5, sample_rows: int | None = 1000, null_safe: bool = True) -> DataFrame:
    """The first rows of a join of the first sample_rows of each side (None: of all), in the order of the key."""
    cut = lambda df, c: df.orderBy(col(c), *[col(x) for x in df.columns if x != c]).limit(sample_rows) if sample_rows else df
    joined = join_tables(cut(a, column_a), column_a, cut(b, column_b), column_b, join_type, null_safe)
    return joined.orderBy(*[col(c) for c in joined.columns]).limit(preview_rows)


def join_count(a: DataFrame, column_a: str, b: DataFrame, column_b: str, join_type: str = "inner", null_safe: bool = True) -> DataFrame:
    """row_count of the join, from counts of the keys: the joined rows are never made."""
    require(a, column_a)
    require(b, column_b)
    same = family(a.schema[column_a].dataType) == family(b.schema[column_b].dataType)
    count = lambda df, c, side: df.groupBy(present(c, df.schema[c].dataType).cast("string").alias("k") if not same else canonical(c, df.schema[c].dataType).alias("k")).agg(F.count("*").alias(f"n_{side}"))
    left, right = count(a, column_a, "a"), count(b, column_b, "b")
    condition = F.lit(False) if not same else left["k"].eqNullSafe(right["k"]) if null_safe else left["k"] == right["k"]
    both = left.join(right, condition, "full")
    na, nb = F.col("n_a"), F.col("n_b")
    how = JOIN_TYPES.get(join_type, "inner")
    rows = F.when(na.isNotNull() & nb.isNotNull(), na * nb)
    if how in ("left", "full"):
        rows = rows.when(nb.isNull(), na)
    if how in ("right", "full"):
        rows = rows.when(na.isNull(), nb)
    return both.agg(F.coalesce(F.sum(rows), F.lit(0)).alias("row_count"))


__all__ = ["candidate_pairs", "column_relationship", "common_values", "discover_relationships", "join_count", "join_preview", "join_tables"]
