"""Profiles of columns: missing values, statistics, distinct values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import as_text, col, is_numeric, missing, present
from .schema import require, slices, union_all

_NUMBERS = ("count", "mean", "std", "min", "p25", "p50", "p75", "max")
_QUARTILES = (0.25, 0.5, 0.75)
#: Distinct values of a column, about, up to which one task counts them for exact quartiles.
EXACT_DISTINCT = 1_000_000
#: Characters of a value that are shuffled; of longer ones, a digest besides.
_HEAD = 64


def _unpivoted(df: DataFrame, rows: list[list[Column]], names: list[str]) -> DataFrame:
    """One row of aggregates as one row per described column."""
    structs = [F.struct(*[c.alias(n) for c, n in zip(r, names, strict=True)]) for r in rows]
    return df.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def missing_values(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """field, null_count; NaN counts as missing.  One pass over the table."""
    names = fields or df.columns
    require(df, *names)
    out = []
    for part in slices(names):
        counted = df.agg(*[F.count_if(missing(c, df.schema[c].dataType)).alias(f"n{i}") for i, c in enumerate(part)])
        out.append(_unpivoted(counted, [[F.lit(c), F.col(f"n{i}")] for i, c in enumerate(part)], ["field", "null_count"]))
    return union_all(out)


def numeric_fields(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def _portions(names: list[str], sizes: dict[str, int], most: int, width: int = 25) -> list[list[str]]:
    """Names in runs of at most width, and of at most most in size together (one name at least)."""
    out: list[list[str]] = []
    total = 0
    for c in names:
        if not out or len(out[-1]) == width or total + sizes[c] > most:
            out.append([])
            total = 0
        out[-1].append(c)
        total += sizes[c]
    return out


def numeric_statistics(df: DataFrame, fields: list[str] | None = None, approx: bool = False, accuracy: int = 10_000, exact_distinct: int = EXACT_DISTINCT) -> DataFrame:
    """field, count, mean, std (of a sample), min, p25, p50, p75, max of numeric columns, in one aggregate if they have few values.

    Quartiles are exact with linear interpolation.  One task counts the distinct
    values of a column, and of several together, where there are at most
    exact_distinct of one (by an estimate, which tables of no more rows do not
    need); for the other columns ``distributed_quantiles`` gives the same values.
    approx=True takes sketches of bounded size instead.
    """
    names = fields or numeric_fields(df)
    require(df, *names)
    x = {c: present(c, df.schema[c].dataType).cast("double") for c in names}
    sizes = dict.fromkeys(names, 0)
    if not approx and names:
        total = df.count()
        sizes = dict.fromkeys(names, total)
        if total > exact_distinct:
            for part in slices(names):
                row = df.agg(*[F.approx_count_distinct(x[c]).alias(f"d{i}") for i, c in enumerate(part)]).first()
                sizes |= {c: row[f"d{i}"] for i, c in enumerate(part)}
    wide = [c for c in names if not approx and sizes[c] > exact_distinct]
    out = []
    for part in _portions(names, {c: 0 if c in wide else n for c, n in sizes.items()}, 8 * exact_distinct):
        aggs, rows = [], []
        for i, c in enumerate(part):
            aggs += [F.count(x[c]).alias(f"n{i}"), F.avg(x[c]).alias(f"m{i}"), F.stddev_samp(x[c]).alias(f"s{i}"), F.min(x[c]).alias(f"a{i}"), F.max(x[c]).alias(f"z{i}")]
            if c in wide:
                q = [F.lit(None).cast("double")] * 3
            else:
                quartiles = F.percentile_approx(x[c], list(_QUARTILES), accuracy) if approx else F.percentile(x[c], F.array(*map(F.lit, _QUARTILES)))
                aggs.append(quartiles.alias(f"q{i}"))
                q = [F.col(f"q{i}")[j] for j in range(3)]
            rows.append([F.lit(c), F.col(f"n{i}"), F.col(f"m{i}"), F.col(f"s{i}"), F.col(f"a{i}") + F.lit(0.0), *q, F.col(f"z{i}") + F.lit(0.0)])
        out.append(_unpivoted(df.agg(*aggs), rows, ["field", *_NUMBERS]))
    if not out:
        return df.sparkSession.createDataFrame([], "field string, count bigint, mean double, std double, min double, p25 double, p50 double, p75 double, max double")
    whole = union_all(out)
    if not wide:
        return whole
    found = distributed_quantiles(df, wide, _QUARTILES)
    found = found.groupBy(F.col("field").alias("wide")).agg(*[F.max(F.when(F.col("p") == p, F.col("value"))).alias(f"w{j}") for j, p in enumerate(_QUARTILES)])
    joined = whole.join(F.broadcast(found), F.col("field") == F.col("wide"), "left")
    return joined.select(*[F.coalesce(F.col(n), F.col(f"w{('p25', 'p50', 'p75').index(n)}")).alias(n) if n in ("p25", "p50", "p75") else F.col(n) for n in ("field", *_NUMBERS)])


def distributed_quantiles(df: DataFrame, fields: list[str] | None = None, probabilities: tuple[float, ...] = (0.25, 0.5, 0.75), accuracy: int = 50_000) -> DataFrame:
    """field, p, value: exact quantiles with linear interpolation for columns of any number of distinct values.

    A sketch brackets every quantile between two values; the next scan counts
    what lies below each bracket, and only the values inside it (about
    4 / accuracy of the rows) are counted by value and ranked.  No task holds a
    column's distinct values, as one exact aggregate would.
    """
    names = fields or numeric_fields(df)
    require(df, *names)
    spark, out = df.sparkSession, []
    margin = 2.0 / accuracy
    for part in slices(names, 25):
        x = {c: present(c, df.schema[c].dataType).cast("double") for c in part}
        ends = [min(1.0, max(0.0, p + m)) for p in probabilities for m in (-margin, margin)]
        sketch = df.agg(*[a.alias(f"{k}{i}") for i, c in enumerate(part) for k, a in (("n", F.count(x[c])), ("a", F.min(x[c])), ("z", F.max(x[c])), ("q", F.percentile_approx(x[c], ends, accuracy)))]).first()
        brackets = []
        for i, c in enumerate(part):
            if sketch[f"n{i}"]:
                for j, p in enumerate(probabilities):
                    low = sketch[f"a{i}"] if p - margin <= 0 else sketch[f"q{i}"][2 * j]
                    high = sketch[f"z{i}"] if p + margin >= 1 else sketch[f"q{i}"][2 * j + 1]
                    brackets.append((c, p, low, high, p * (sketch[f"n{i}"] - 1)))
        if not brackets:
            continue
        below = df.agg(*[F.count_if(x[c] < low).alias(f"b{i}") for i, (c, _, low, _, _) in enumerate(brackets)]).first()
        known = spark.createDataFrame([(i, c, p, rank, below[f"b{i}"]) for i, (c, p, _, _, rank) in enumerate(brackets)], "i int, field string, p double, rank double, below long")
        inside = F.explode(F.array(*[F.when(x[c].between(low, high), F.struct(F.lit(i).alias("i"), x[c].alias("v"))) for i, (c, _, low, high, _) in enumerate(brackets)]))
        counted = df.select(inside.alias("r")).where("r IS NOT NULL").select("r.i", "r.v").groupBy("i", "v").agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("i").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
        ranked = counted.withColumn("upto", upto).join(F.broadcast(known), "i").withColumn("upto", F.col("upto") + F.col("below"))
        value = lambda r: F.min(F.when(F.col("upto") > r, F.col("v")))
        both = ranked.groupBy("i", "field", "p", "rank").agg(value(F.floor("rank")).alias("low"), value(F.ceil("rank")).alias("high"))
        out.append(both.select("field", "p", (F.col("low") + (F.col("rank") - F.floor("rank")) * (F.col("high") - F.col("low"))).alias("value")))
    return union_all(out) if out else spark.createDataFrame([], "field string, p double, value double")


def population_statistics(df: DataFrame, fields: list[str] | None = None, places: int = 4) -> DataFrame:
    """field, count, mean, std (of the whole population), min, max; mean and std rounded.  Columns without values are left out."""
    names = fields or numeric_fields(df)
    require(df, *names)
    out = []
    for part in slices(names):
        aggs, rows = [], []
        for i, c in enumerate(part):
            x = present(c, df.schema[c].dataType).cast("double")
            aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}"), F.min(x).alias(f"a{i}"), F.max(x).alias(f"z{i}")]
            rows.append([F.lit(c), F.col(f"n{i}"), F.bround(F.col(f"m{i}"), places), F.bround(F.col(f"s{i}"), places), F.col(f"a{i}") + F.lit(0.0), F.col(f"z{i}") + F.lit(0.0)])
        out.append(_unpivoted(df.agg(*aggs), rows, ["field", "count", "mean", "std", "min", "max"]))
    return union_all(out).where("count > 0")


def categorical_statistics(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """field, count, unique, top, freq of columns that are not numeric; of tied values the least is the top.

    All columns are counted together: values are spread into (field, value) rows
    and counted map-side first, so a value that fills a column is one row a task.
    Of long values only the first characters and a digest are shuffled; where one
    of those is the top, it is fetched by a scan of its own.  Worked out at once,
    into one row a column.
    """
    names = fields or [f.name for f in df.schema.fields if not is_numeric(f.dataType)]
    require(df, *names)
    schema = "field string, count bigint, unique bigint, top string, freq bigint"
    if not names:
        return df.sparkSession.createDataFrame([], schema)
    text = {c: as_text(c, df.schema[c].dataType) for c in names}
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), text[c].alias("value")) for c in names]))
    cells = df.select(pairs.alias("p")).select("p.field", F.substring("p.value", 1, _HEAD).alias("head"), F.when(F.length("p.value") > _HEAD, F.md5("p.value")).alias("digest"))
    counted = cells.groupBy("field", "head", "digest").agg(F.count("*").alias("n"))
    some = F.col("head").isNotNull()
    rank = F.when(some, F.struct(-F.col("n"), F.col("head").alias("head"), F.col("digest").alias("digest")))
    stats = counted.groupBy("field").agg(F.sum(F.when(some, F.col("n")).otherwise(0)).alias("count"), F.count_if(some).alias("unique"), F.min(rank).alias("r"), F.max(F.when(some, F.col("n"))).alias("freq"))
    found = {r["field"]: r for r in stats.collect()}

    def top(c: str) -> str | None:
        r = found[c]["r"]
        if r is None or r["digest"] is None:
            return r and r["head"]
        rows = df.select(text[c].alias("value")).where(F.col("value").startswith(F.lit(r["head"])))
        if found[c]["freq"] > 1:  # else every value is as frequent
            tied = counted.where((F.col("field") == c) & (F.col("head") == r["head"]) & (F.col("n") == found[c]["freq"])).select("digest")
            rows = rows.withColumn("digest", F.md5("value")).join(tied, "digest", "left_semi")
        return rows.agg(F.min("value")).first()[0]

    return df.sparkSession.createDataFrame([(c, found[c]["count"], found[c]["unique"], top(c), found[c]["freq"]) if c in found else (c, 0, 0, None, None) for c in names], schema)


def field_statistics(df: DataFrame, approx: bool = False) -> DataFrame:
    """Both kinds in one frame; what does not apply is null.  Tables of numbers alone have only the numbers' columns."""
    numbers = numeric_statistics(df, approx=approx)
    others = [f.name for f in df.schema.fields if not is_numeric(f.dataType)]
    if not others:
        return numbers
    return numbers.unionByName(categorical_statistics(df, others), allowMissingColumns=True)


def unique_values(df: DataFrame, name: str, limit: int | None = 100) -> DataFrame:
    """value: the distinct values that are not missing, in order, at most limit (empty or 0: all)."""
    require(df, name)
    values = df.select(present(name, df.schema[name].dataType).alias("value")).where("value IS NOT NULL").distinct()
    if isinstance(df.schema[name].dataType, T.MapType):
        return values.limit(limit) if limit else values
    return values.orderBy("value").limit(limit) if limit else values.orderBy("value")


def unique_values_overflow(df: DataFrame, name: str, limit: int = 100, keep_null: bool = True) -> DataFrame:
    """value, overflow_count: at most limit distinct values (missing among them), and how many more there are."""
    require(df, name)
    values = df.select(present(name, df.schema[name].dataType).alias("value"))
    values = (values if keep_null else values.where("value IS NOT NULL")).distinct()
    more = values.agg(F.greatest(F.count("*") - F.lit(limit), F.lit(0)).alias("overflow_count"))
    return values.orderBy(F.col("value").asc_nulls_last()).limit(limit).join(F.broadcast(more))


def value_counts(df: DataFrame, name: str) -> DataFrame:
    require(df, name)
    return df.groupBy(col(name).alias("value")).agg(F.count("*").alias("n"))
