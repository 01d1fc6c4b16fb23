"""Places: which columns hold coordinates or geometries, and what area they cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import NoValidValues
from ..functions.names import suggests_place
from ..functions.scalars import col, is_numeric, missing, present, to_number
from ..functions.temporal import text_sample
from .schema import require, sample_values, slices

# Kinds of well-known text, in the order in which prefixes are tried, and the share of a sample that must be such text.
WKT_KINDS = ("POINT", "LINESTRING", "POLYGON", "MULTIPOINT", "MULTILINESTRING", "MULTIPOLYGON", "GEOMETRYCOLLECTION")
WKT_SHARE = 0.5
WKT_SAMPLE = 50
_WKT = rf"^({'|'.join(WKT_KINDS)})\s*\("
_SPATIAL = "field string, name_suggests_spatial boolean, detected_type string, sample_values array<string>"


def _range_type(low: Column, high: Column) -> Column:
    return F.when((low >= -90) & (high <= 90), "possible_latitude").when((low >= -180) & (high <= 180), "possible_longitude")


def coordinate_types(df: DataFrame) -> DataFrame:
    """field, detected_type of every numeric or boolean column, from its least and largest value in one pass."""
    names = [f.name for f in df.schema.fields if is_numeric(f.dataType) or isinstance(f.dataType, T.BooleanType)]
    out = None
    for part in slices(names):
        if not part:
            break
        values = {c: present(c, df.schema[c].dataType).cast("double") for c in part}
        ends = df.agg(*[f(values[c]).alias(f"{k}{i}") for i, c in enumerate(part) for k, f in (("a", F.min), ("z", F.max))])
        rows = ends.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), _range_type(F.col(f"a{i}"), F.col(f"z{i}")).alias("detected_type")) for i, c in enumerate(part)])).alias("r")).select("r.*")
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else df.sparkSession.createDataFrame([], "field string, detected_type string")


def is_wkt(c: Column) -> Column:
    return F.upper(F.trim(c)).rlike(_WKT)


def wkt_share(df: DataFrame, name: str, sample: int = WKT_SAMPLE) -> float:
    """Share of some values of a text column (the same for the same files) that are well-known text."""
    texts = text_sample(df, name, sample)
    got = df.sparkSession.createDataFrame([(t,) for t in texts], "v string").agg(F.avg(is_wkt(F.col("v")).cast("double"))).first()[0]
    return got or 0.0


def detect_spatial_columns(df: DataFrame, samples: int = 5) -> DataFrame:
    """field, name_suggests_spatial, detected_type, sample_values of the columns that are places by name or by values."""
    ranges = {r.field: r.detected_type for r in coordinate_types(df).collect()}
    looks = []
    for f in df.schema.fields:
        kind = ranges.get(f.name)
        if kind is None and isinstance(f.dataType, T.StringType) and wkt_share(df, f.name) > WKT_SHARE:
            kind = "wkt_geometry"
        looks.append((f.name, suggests_place(f.name), kind))
    held = sample_values(df, samples)
    return df.sparkSession.createDataFrame([(c, named, kind, held[c]) for c, named, kind in looks if named or kind], _SPATIAL)


def coordinate_pairs(spatial: DataFrame, order: list[str]) -> DataFrame:
    """latitude, longitude: the first column that may be each, by name or range, in the table's order; at most one pair."""
    place = F.array_position(F.array(*[F.lit(c) for c in order]), F.col("field"))
    name = F.lower("field")
    lat = (F.col("detected_type") == "possible_latitude") | name.contains("lat")
    lon = (F.col("detected_type") == "possible_longitude") | name.contains("lon")
    both = spatial.agg(F.min_by("field", F.when(F.coalesce(lat, F.lit(False)), place)).alias("latitude"), F.min_by("field", F.when(F.coalesce(lon, F.lit(False)), place)).alias("longitude"))
    return both.where("latitude IS NOT NULL AND longitude IS NOT NULL")


def named_pair(df: DataFrame) -> tuple[str, str] | None:
    """Latitude and longitude of a table, of the columns in range whose names speak of them: any small number is in range."""
    named = detect_spatial_columns(df, 0).where("lower(field) RLIKE 'lat|lon' AND detected_type LIKE 'possible%'")
    pair = coordinate_pairs(named, df.columns).first()
    return (pair.latitude, pair.longitude) if pair and pair.latitude != pair.longitude else None


def wkt_types(df: DataFrame, name: str, sample: int | None = None) -> DataFrame:
    """wkt_type, n: values by the kind with which they begin; collections of geometries are not counted."""
    require(df, name)
    rows = df.select(F.upper(F.trim(col(name))).alias("v")).where("v IS NOT NULL")
    rows = rows.limit(sample) if sample else rows
    kind = F.regexp_extract("v", f"^({'|'.join(WKT_KINDS[:-1])})", 1)
    return rows.select(kind.alias("wkt_type")).where("wkt_type != ''").groupBy("wkt_type").agg(F.count("*").alias("n"))


def analyze_spatial_column(df: DataFrame, name: str) -> DataFrame:
    """One row: field, total, null_count, dtype, min, max, mean, coordinate_hint, format, wkt_types."""
    require(df, name)
    kind = df.schema[name].dataType
    counts = [F.count("*").alias("total"), F.count_if(missing(name, kind)).alias("null_count")]
    text = isinstance(kind, T.StringType)
    wkt = text and wkt_share(df, name) > WKT_SHARE
    value = F.lit(None).cast("double") if text else to_number(col(name), kind)
    out = df.agg(*counts, F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"))
    hint = F.when(F.col("min").isNull(), F.lit(None)).otherwise(F.when((F.col("min") >= -90) & (F.col("max") <= 90), "latitude").when((F.col("min") >= -180) & (F.col("max") <= 180), "longitude").otherwise("projected_or_other"))
    if wkt:
        kinds = wkt_types(df, name).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("wkt_type", "n")))).alias("wkt_types"))
        out = out.join(F.broadcast(kinds))
    else:
        out = out.withColumn("wkt_types", F.lit(None).cast("map<string,bigint>"))
    return out.select(F.lit(name).alias("field"), "total", "null_count", F.lit(kind.simpleString()).alias("dtype"), "min", "max", "mean", hint.alias("coordinate_hint"), F.lit("WKT" if wkt else None).cast("string").alias("format"), "wkt_types")


def spatial_extent(df: DataFrame, lat_column: str, lon_column: str) -> DataFrame:
    """One row: valid_point_count, min_lat, max_lat, min_lon, max_lon, center_lat, center_lon, warnings.

    Each column drops its own missing and unreadable values; the count is the
    lesser of the two columns' counts.
    """
    require(df, lat_column, lon_column)
    lat, lon = (to_number(col(c), df.schema[c].dataType) for c in (lat_column, lon_column))
    out = df.agg(
        F.least(F.count(lat), F.count(lon)).alias("valid_point_count"),
        F.min(lat).alias("min_lat"), F.max(lat).alias("max_lat"), F.min(lon).alias("min_lon"), F.max(lon).alias("max_lon"), F.avg(lat).alias("center_lat"), F.avg(lon).alias("center_lon"),
    )
    bad_lat = F.when((F.col("min_lat") < -90) | (F.col("max_lat") > 90), F.lit("latitude values outside [-90, 90]"))
    bad_lon = F.when((F.col("min_lon") < -180) | (F.col("max_lon") > 180), F.lit("longitude values outside [-180, 180]"))
    return out.withColumn("warnings", F.array_compact(F.array(bad_lat, bad_lon)))


def checked_spatial_extent(df: DataFrame, lat_column: str, lon_column: str) -> dict:
    """spatial_extent as a dict; without any valid point it is an error."""
    row = spatial_extent(df, lat_column, lon_column).first()
    if not row["valid_point_count"]:
        raise NoValidValues(f"no valid points in {lat_column!r}, {lon_column!r}")
    return row.asDict()
