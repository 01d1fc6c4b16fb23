"""The registered profiling queries and the SQL that gives the same rows.

Each query takes (spark, sf_dir) and runs an operator over whole tables.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Context
from .functions.names import SPATIAL, TEMPORAL
from .operators import profile, relate, schema, spatial, temporal
from .operators.registry import run as run_operator
from .plans.executor import execute_plan
from .plans.standards import record_frame
from .plans.synthesis import synthesise
from .session import shared_dir
from .sources import create_context
from .sources.parquet import ParquetContext
from .streaming import profile as streaming

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
STAR = TABLES[:7]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tables(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> dict[str, DataFrame]:
    return {n: table(spark, sf_dir, n) for n in names}


def context(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = STAR) -> ParquetContext:
    return ParquetContext(spark, {n: f"{sf_dir}/{n}.parquet" for n in names}, "star schema")


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def rounded(df: DataFrame, *names: str, places: int = 4) -> DataFrame:
    """Floating results to a few places, so that the order of summation does not show."""
    return df.withColumns({c: F.round(F.col(c), places) + F.lit(0.0) for c in names})


# Flagship: statistics of numeric columns in one fused aggregate.
NUMERIC = {
    "orders": ("o_orderkey", "o_custkey", "o_totalprice"),
    "lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"),
    "events": ("event_id", "user_id", "value"),
    "part": ("p_partkey", "p_size", "p_retailprice"),
}


def _numeric_sql(t: str) -> str:
    return union([
        f"SELECT '{c}' AS field, count({c}) AS count, round(avg({c}::DOUBLE), 4) + 0.0 AS mean, round(stddev_samp({c}::DOUBLE), 4) + 0.0 AS std, round(min({c}::DOUBLE), 4) + 0.0 AS min, "
        f"round(quantile_cont({c}::DOUBLE, 0.25), 4) + 0.0 AS p25, round(quantile_cont({c}::DOUBLE, 0.5), 4) + 0.0 AS p50, round(quantile_cont({c}::DOUBLE, 0.75), 4) + 0.0 AS p75, round(max({c}::DOUBLE), 4) + 0.0 AS max FROM {t}"
        for c in NUMERIC[t]
    ])


for _t in NUMERIC:
    query(f"numeric_statistics_{_t}", _numeric_sql(_t))(lambda spark, d, t=_t: rounded(profile.numeric_statistics(table(spark, d, t)), "mean", "std", "min", "p25", "p50", "p75", "max"))

query(
    "population_statistics_lineitem",
    union([f"SELECT '{c}' AS field, count({c}) AS count, round_even(avg({c}::DOUBLE), 4) + 0.0 AS mean, round_even(stddev_pop({c}::DOUBLE), 4) + 0.0 AS std, min({c}::DOUBLE) + 0.0 AS min, max({c}::DOUBLE) + 0.0 AS max FROM lineitem" for c in NUMERIC["lineitem"]]),
)(lambda spark, d: rounded(profile.population_statistics(table(spark, d, "lineitem")), "mean", "std"))

query(
    "distributed_quantiles_lineitem",
    union([f"SELECT '{c}' AS field, {p}::DOUBLE AS p, round(quantile_cont({c}::DOUBLE, {p}), 4) + 0.0 AS value FROM lineitem" for c in ("l_extendedprice", "l_tax") for p in (0.25, 0.5, 0.75)]),
)(lambda spark, d: rounded(profile.distributed_quantiles(table(spark, d, "lineitem"), ["l_extendedprice", "l_tax"]), "value"))

CATEGORICAL = {"customer": ("c_name", "c_mktsegment"), "orders": ("o_orderstatus", "o_orderdate", "o_orderpriority"), "events": ("ts", "event_type", "props"), "documents": ("text", "lang", "source"), "conversations": ("role", "text")}
_TIMES = {"o_orderdate", "l_shipdate", "ts"}


def _categorical_sql(t: str) -> str:
    parts = []
    for c in CATEGORICAL[t]:
        v = c if c not in _TIMES else f"regexp_replace(strftime({c}, '%Y-%m-%d %H:%M:%S.%f'), '\\.?0*$', '')" if c == "ts" else f"strftime({c}, '%Y-%m-%d %H:%M:%S')"
        parts.append(
            f"SELECT '{c}' AS field, CAST(sum(n) AS BIGINT) AS count, count(*) AS \"unique\", first(v ORDER BY n DESC, v) AS top, max(n) AS freq "
            f"FROM (SELECT {v} AS v, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY 1)"
        )
    return union(parts)


for _t in CATEGORICAL:
    query(f"categorical_statistics_{_t}", _categorical_sql(_t))(lambda spark, d, t=_t: profile.categorical_statistics(table(spark, d, t)))


@query(
    "field_statistics_customer",
    "SELECT field, count, mean, std, min, p25, p50, p75, max, NULL::VARCHAR AS \"unique\", NULL::VARCHAR AS top, NULL::VARCHAR AS freq FROM ("
    + union([
        f"SELECT '{c}' AS field, count({c}) AS count, round(avg({c}::DOUBLE), 4) + 0.0 AS mean, round(stddev_samp({c}::DOUBLE), 4) + 0.0 AS std, round(min({c}::DOUBLE), 4) + 0.0 AS min, round(quantile_cont({c}::DOUBLE, 0.25), 4) + 0.0 AS p25, "
        f"round(quantile_cont({c}::DOUBLE, 0.5), 4) + 0.0 AS p50, round(quantile_cont({c}::DOUBLE, 0.75), 4) + 0.0 AS p75, round(max({c}::DOUBLE), 4) + 0.0 AS max FROM customer"
        for c in ("c_custkey", "c_nationkey", "c_acctbal")
    ])
    + ") UNION ALL SELECT field, count, NULL, NULL, NULL, NULL, NULL, NULL, NULL, CAST(\"unique\" AS VARCHAR), top, CAST(freq AS VARCHAR) FROM (" + _categorical_sql("customer") + ")",
)
def field_statistics_customer(spark: SparkSession, d: str) -> DataFrame:
    out = rounded(run_operator("field_statistics", context(spark, d, ("customer",))), "mean", "std", "min", "p25", "p50", "p75", "max")
    return out.withColumns({c: F.col(c).cast("string") for c in ("unique", "freq")})


query("row_counts", union([f"SELECT '{t}' AS resource, count(*) AS item_count FROM {t}" for t in TABLES]))(lambda spark, d: schema.row_counts(tables(spark, d)))

COLUMNS = {
    "region": ("r_regionkey", "r_name"),
    "nation": ("n_nationkey", "n_name", "n_regionkey"),
    "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
    "supplier": ("s_suppkey", "s_name", "s_nationkey", "s_acctbal"),
    "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"),
    "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"),
    "lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"),
    "events": ("event_id", "ts", "user_id", "event_type", "value", "props"),
    "documents": ("doc_id", "text", "lang", "source", "n_chars"),
    "embeddings": ("vec_id", "embedding", "label"),
    "pages": ("page_id", "url", "html"),
    "benchmark": ("item_id", "text"),
    "labels": ("doc_id", "quality", "toxic"),
    "conversations": ("conv_id", "turn", "role", "text"),
}
# The SQL takes names and types from DuckDB's own description of the tables, and has copies of its own of the rules by name.
_CATALOG = "(" + " UNION ALL ".join(f"SELECT '{t}' AS resource, row_number() OVER () - 1 AS ordinal, column_name AS field, column_type AS kind FROM (DESCRIBE {t})" for t in TABLES) + ") AS cat"
_TIME_NAMES = "date|time|timestamp|datetime|created|updated|modified|start|end|begin|expire|valid|year|month|day|hour|minute|second|period|duration|_at$|_on$|_dt$"
_PLACE_NAMES = (
    "lat(itude)?|lon(g(itude)?)?|coord|geo|location|position|point|polygon|geometry|geom|wkt|wkb|x_?coord|y_?coord|easting|northing|spatial|place|address|city|state|country|zip|postal|region|bbox|bounds|extent"
)

query(
    "table_overview",
    union([f"SELECT '{t}' AS resource, (SELECT count(*) FROM {t}) AS item_count, CAST(count(*) AS INTEGER) AS field_count, string_agg(field, ', ' ORDER BY ordinal) AS columns FROM {_CATALOG} WHERE resource = '{t}'" for t in TABLES]),
)(
    lambda spark, d: schema.table_overview(tables(spark, d)).withColumn("columns", F.concat_ws(", ", "columns"))
)
query("schema_catalog", f"SELECT resource, CAST(ordinal AS INTEGER) AS ordinal, field FROM {_CATALOG}")(lambda spark, d: schema.schema_rows(spark, tables(spark, d)).select("resource", "ordinal", "field"))
query("common_columns", f"SELECT lower(trim(field)) AS column_name, count(DISTINCT resource) AS n_tables, string_agg(resource || '.' || field, ', ' ORDER BY resource || '.' || field) AS locations FROM {_CATALOG} GROUP BY 1 HAVING count(DISTINCT resource) > 1")(
    lambda spark, d: schema.common_columns(spark, tables(spark, d)).withColumn("locations", F.concat_ws(", ", "locations"))
)
query(
    "compare_schemas",
    f"SELECT resource, CAST(ordinal AS INTEGER) AS ordinal, field, lower(field) LIKE '%id' AS possible_id, regexp_matches(lower(field), 'date|time|created|updated|timestamp') AS possible_date, count(*) OVER (PARTITION BY field) AS n_tables FROM {_CATALOG}",
)(lambda spark, d: schema.compare_schemas(spark, tables(spark, d)).select("resource", "ordinal", "field", "possible_id", "possible_date", "n_tables"))
query(
    "name_suggestions",
    f"SELECT resource, field, regexp_matches(lower(field), '{_TIME_NAMES}') AS name_suggests_temporal, regexp_matches(lower(field), '{_PLACE_NAMES}') AS name_suggests_spatial FROM {_CATALOG}",
)(lambda spark, d: schema.schema_rows(spark, tables(spark, d)).select("resource", "field", F.lower("field").rlike(TEMPORAL).alias("name_suggests_temporal"), F.lower("field").rlike(SPATIAL).alias("name_suggests_spatial")))

query(
    "field_types",
    f"SELECT resource, CAST(ordinal AS INTEGER) AS ordinal, field, CASE kind WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'SMALLINT' THEN 'smallint' WHEN 'TINYINT' THEN 'tinyint' WHEN 'DOUBLE' THEN 'double' WHEN 'FLOAT' THEN 'float' WHEN 'VARCHAR' THEN 'string' "
    f"WHEN 'BOOLEAN' THEN 'boolean' WHEN 'DATE' THEN 'date' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'TIMESTAMP_NS' THEN 'timestamp_ntz' WHEN 'TIMESTAMP WITH TIME ZONE' THEN 'timestamp' WHEN 'FLOAT[]' THEN 'array<float>' WHEN 'DOUBLE[]' THEN 'array<double>' ELSE kind END AS dtype, "
    f"CASE WHEN kind IN ('BIGINT', 'INTEGER', 'SMALLINT', 'TINYINT') THEN 'int64' WHEN kind IN ('DOUBLE', 'FLOAT') THEN 'float64' WHEN kind = 'BOOLEAN' THEN 'bool' WHEN kind = 'DATE' OR kind LIKE 'TIMESTAMP%' THEN 'datetime64[ns]' ELSE 'object' END AS pandas_like_dtype FROM {_CATALOG}",
)(lambda spark, d: schema.schema_rows(spark, tables(spark, d)).drop("nullable"))
_PROFILED = ("nation", "orders", "documents")
query(
    "schema_profile",
    "WITH nulls AS (" + union([f"SELECT '{t}' AS resource, '{c}' AS field, count(*) - count({c}) AS null_count FROM {t}" for t in _PROFILED for c in COLUMNS[t]]) + f") SELECT n.resource, n.field, ordinal, null_count, lower(n.field) LIKE '%id' AS possible_id FROM nulls n JOIN {_CATALOG} USING (resource, field)",
)(lambda spark, d: schema.schema_profile(spark, tables(spark, d, _PROFILED)).select("resource", "field", F.col("ordinal").cast("long").alias("ordinal"), "null_count", "possible_id"))

for _t in ("orders", "events", "documents", "lineitem", "embeddings"):
    query(f"missing_values_{_t}", union([f"SELECT '{c}' AS field, count(*) - count({c}) AS null_count FROM {_t}" for c in COLUMNS[_t]]))(lambda spark, d, t=_t: profile.missing_values(table(spark, d, t)))

query("unique_values_mktsegment", "SELECT DISTINCT c_mktsegment AS value FROM customer WHERE c_mktsegment IS NOT NULL ORDER BY 1 LIMIT 100")(lambda spark, d: profile.unique_values(table(spark, d, "customer"), "c_mktsegment"))
query("unique_values_user_id", "SELECT DISTINCT user_id AS value FROM events WHERE user_id IS NOT NULL")(lambda spark, d: profile.unique_values(table(spark, d, "events"), "user_id", None))
query(
    "unique_values_overflow_part_type",
    "SELECT value, (SELECT greatest(count(DISTINCT p_type) - 10, 0) FROM part) AS overflow_count FROM (SELECT DISTINCT p_type AS value FROM part ORDER BY 1 LIMIT 10)",
)(lambda spark, d: profile.unique_values_overflow(table(spark, d, "part"), "p_type", 10))
query("value_counts_event_type", "SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1")(lambda spark, d: profile.value_counts(table(spark, d, "events"), "event_type"))
query("sample_items_orders", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5")(lambda spark, d: schema.sample_items(table(spark, d, "orders"), 5, ["o_orderkey"]).select("o_orderkey", "o_custkey", "o_totalprice"))

PAIRS = {
    "orders_customer": ("orders", "o_custkey", "customer", "c_custkey"),
    "lineitem_orders": ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    "lineitem_part": ("lineitem", "l_partkey", "part", "p_partkey"),
    "nation_region": ("nation", "n_regionkey", "region", "r_regionkey"),
    "documents_labels": ("documents", "doc_id", "labels", "doc_id"),
    "customer_supplier": ("customer", "c_nationkey", "supplier", "s_nationkey"),
}


def _relationship_sql(a: str, x: str, b: str, y: str) -> str:
    return f"""
        WITH va AS (SELECT DISTINCT {x} AS v FROM {a} WHERE {x} IS NOT NULL), vb AS (SELECT DISTINCT {y} AS v FROM {b} WHERE {y} IS NOT NULL),
        n AS (SELECT (SELECT count(*) FROM va) AS na, (SELECT count(*) FROM vb) AS nb, (SELECT count(*) FROM va JOIN vb USING (v)) AS nc, (SELECT count(*) FROM {a}) AS ra, (SELECT count(*) FROM {b}) AS rb),
        r AS (SELECT *, CASE WHEN na > 0 THEN nc::DOUBLE / na ELSE 0.0 END AS ab, CASE WHEN nb > 0 THEN nc::DOUBLE / nb ELSE 0.0 END AS ba, na >= 0.99 * ra AS ua, nb >= 0.99 * rb AS ub FROM n)
        SELECT na AS values_in_a, nb AS values_in_b, nc AS common_values, round(ab, 4) AS match_rate_a_to_b, round(ba, 4) AS match_rate_b_to_a, ua AS is_unique_in_a, ub AS is_unique_in_b,
               CASE WHEN ua AND ub THEN 'one-to-one' WHEN ua THEN 'one-to-many (A -> B)' WHEN ub THEN 'one-to-many (B -> A)' ELSE 'many-to-many' END AS suggested_relationship_type,
               round((ab + ba) / 2, 4) AS confidence_score, round((ab + ba) / 2, 4) > 0.5 AND (ua OR ub) AS likely_foreign_key
        FROM r
    """


for _n, (_a, _x, _b, _y) in PAIRS.items():
    query(f"column_relationship_{_n}", _relationship_sql(_a, _x, _b, _y))(lambda spark, d, p=(_a, _x, _b, _y): relate.column_relationship(table(spark, d, p[0]), p[1], table(spark, d, p[2]), p[3]))

query("common_values_orders_customer", "SELECT v AS value FROM (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS v FROM orders JOIN customer ON o_custkey = c_custkey) ORDER BY 1 LIMIT 10")(lambda spark, d: relate.common_values(table(spark, d, "orders"), "o_custkey", table(spark, d, "customer"), "c_custkey"))

_JOINS = {"inner": "JOIN", "left": "LEFT JOIN", "right": "RIGHT JOIN", "outer": "FULL JOIN"}
for _how, _sql in _JOINS.items():
    query(f"join_count_{_how}_orders_customer", f"SELECT count(*) AS row_count FROM orders {_sql} customer ON o_custkey IS NOT DISTINCT FROM c_custkey")(
        lambda spark, d, how=_how: relate.join_count(table(spark, d, "orders"), "o_custkey", table(spark, d, "customer"), "c_custkey", how).select(F.col("row_count").cast("long").alias("row_count"))
    )
    query(f"join_tables_{_how}_documents_labels", f"SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, md5(text) AS text_md5, lang, source, n_chars, CAST(quality AS VARCHAR) AS quality, CAST(toxic AS VARCHAR) AS toxic FROM documents d {_sql} labels l ON d.doc_id = l.doc_id")(
        lambda spark, d, how=_how: relate.join_tables(table(spark, d, "documents"), "doc_id", table(spark, d, "labels"), "doc_id", how).withColumns({"text_md5": F.md5("text"), **{c: F.col(c).cast("string") for c in ("quality", "toxic")}}).drop("text")
    )
    query(f"join_preview_{_how}_supplier_customer", f"SELECT s_suppkey, s_name, s_nationkey, s_acctbal, c_custkey, c_name FROM (SELECT * FROM supplier WHERE s_suppkey < 20) s {_sql} (SELECT * FROM customer WHERE c_custkey < 12) c ON s_suppkey = c_custkey ORDER BY s_suppkey NULLS FIRST, c_custkey NULLS FIRST LIMIT 30")(
        lambda spark, d, how=_how: relate.join_preview(table(spark, d, "supplier").where("s_suppkey < 20"), "s_suppkey", table(spark, d, "customer").where("c_custkey < 12"), "c_custkey", how, 30, None).select("s_suppkey", "s_name", "s_nationkey", "s_acctbal", "c_custkey", "c_name")
    )
query("join_preview_orders_customer", "SELECT o_orderkey, o_custkey, c_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_orderkey LIMIT 5")(
    lambda spark, d: relate.join_preview(table(spark, d, "orders"), "o_custkey", table(spark, d, "customer"), "c_custkey", "inner", 5, None).select("o_orderkey", "o_custkey", "c_custkey", "c_name")
)


def _discovery_sql() -> str:
    """Every pair that the name rule admits, by a copy of the rule; values compared as the operator does."""

    def names_match(x: str, y: str) -> bool:
        x, y = (c.lower().replace("_", "").replace("-", "") for c in (x, y))
        return x in y or y in x or (x[-2:] == y[-2:] == "id" and x[:-2] == y[:-2])

    numbers = {"r_regionkey", "n_nationkey", "n_regionkey", "c_custkey", "c_nationkey", "c_acctbal", "s_suppkey", "s_nationkey", "s_acctbal", "p_partkey", "p_size", "p_retailprice", "o_orderkey", "o_custkey", "o_totalprice", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "event_id", "user_id", "value", "doc_id", "n_chars", "vec_id", "label", "page_id", "item_id", "quality", "toxic", "conv_id", "turn"}
    kind = lambda c: "number" if c in numbers else "time" if c in _TIMES else "nested" if c == "embedding" else "text"
    names, parts = list(COLUMNS), []
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            for x in COLUMNS[a]:
                for y in COLUMNS[b]:
                    if kind(x) == kind(y) != "nested" and names_match(x, y):
                        parts.append(
                            f"SELECT '{a}' AS from_resource, '{x}' AS from_field, '{b}' AS to_resource, '{y}' AS to_field, (SELECT count(DISTINCT {x}) FROM {a}) AS na, (SELECT count(DISTINCT {y}) FROM {b}) AS nb, "
                            f"(SELECT count(*) FROM (SELECT DISTINCT {x} AS v FROM {a}) JOIN (SELECT DISTINCT {y} AS v FROM {b}) USING (v)) AS nc, (SELECT count(*) FROM {a}) AS ra, (SELECT count(*) FROM {b}) AS rb"
                        )
    return (
        "SELECT from_resource, from_field, to_resource, to_field, CASE WHEN na / ra::DOUBLE > 0.9 AND nb / rb::DOUBLE > 0.9 THEN 'one-to-one' WHEN na / ra::DOUBLE > 0.9 THEN 'one-to-many' WHEN nb / rb::DOUBLE > 0.9 THEN 'many-to-one' ELSE 'many-to-many' END AS relationship_type, "
        "round(nc::DOUBLE / least(na, nb), 4) AS match_rate, nc AS common_value_count, round(0.8 * nc::DOUBLE / least(na, nb) + 0.2, 3) AS confidence, false AS is_verified FROM (" + union(parts) + ") WHERE nc::DOUBLE / least(na, nb) > 0.1"
    )


query("discover_relationships", _discovery_sql())(lambda spark, d: relate.discover_relationships(tables(spark, d)).drop("sample_common_values"))

_STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _stamped(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.date_format(c, _STAMP) for c in names})


for _n, _t, _c in (("events", "events", "ts"), ("orders", "orders", "o_orderdate"), ("lineitem", "lineitem", "l_shipdate")):
    query(
        f"temporal_extent_{_n}",
        f"SELECT count(*) AS total_records, count({_c}) AS valid_timestamps, count(*) - count({_c}) AS null_timestamps, strftime(min({_c}), '%Y-%m-%d %H:%M:%S.%f') AS start_ts, strftime(max({_c}), '%Y-%m-%d %H:%M:%S.%f') AS end_ts, "
        f"CAST(floor((epoch_us(max({_c})) - epoch_us(min({_c}))) / 86400000000.0) AS BIGINT) AS duration_days FROM {_t}",
    )(lambda spark, d, t=_t, c=_c: _stamped(temporal.temporal_extent(table(spark, d, t), c), "start_ts", "end_ts"))
    query(
        f"temporal_granularity_{_n}",
        f"WITH g AS (SELECT epoch_us({_c}) - lag(epoch_us({_c})) OVER (ORDER BY {_c}) AS gap FROM {_t} WHERE {_c} IS NOT NULL), m AS (SELECT median(gap)::DOUBLE AS us FROM g) "
        f"SELECT '{_c}' AS field, us AS median_gap_us, CASE WHEN us < 1e6 THEN 'sub-second' WHEN us < 60e6 THEN 'second' WHEN us < 3600e6 THEN 'minute' WHEN us < 86400e6 THEN 'hourly' WHEN us < 604800e6 THEN 'daily' WHEN us < 2764800e6 THEN 'weekly/monthly' ELSE 'monthly+' END AS apparent_granularity FROM m",
    )(lambda spark, d, t=_t, c=_c: temporal.analyze_temporal_column(table(spark, d, t), c).select("field", "median_gap_us", "apparent_granularity"))
for _part in ("year", "month"):
    query(f"records_by_{_part}_orders", f"SELECT CAST({_part}(o_orderdate) AS BIGINT) AS {_part}, count(*) AS n FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1")(
        lambda spark, d, part=_part: temporal.records_by(table(spark, d, "orders"), "o_orderdate", part).withColumn(part, F.col(part).cast("long"))
    )


def _time_columns_sql(t: str) -> str:
    return (
        f"SELECT field, name_suggests_temporal, detected_type FROM (SELECT field, regexp_matches(lower(field), '{_TIME_NAMES}') AS name_suggests_temporal, CASE WHEN kind = 'DATE' OR kind LIKE 'TIMESTAMP%' THEN 'datetime64' END AS detected_type "
        f"FROM {_CATALOG} WHERE resource = '{t}') WHERE name_suggests_temporal OR detected_type IS NOT NULL"
    )


query("temporal_columns_orders", _time_columns_sql("orders"))(lambda spark, d: temporal.detect_temporal_columns(table(spark, d, "orders")).drop("sample_values"))
query("temporal_columns_events", _time_columns_sql("events"))(lambda spark, d: temporal.detect_temporal_columns(table(spark, d, "events")).drop("sample_values"))


# Dates as text, day first, with junk in every seventh and eleventh row.
_DATED = "(SELECT CASE WHEN o_orderkey % 7 = 0 THEN '-' WHEN o_orderkey % 11 = 0 THEN ' n/a' ELSE strftime(o_orderdate, '%d/%m/%Y') END AS written, CASE WHEN o_orderkey % 7 > 0 AND o_orderkey % 11 > 0 THEN CAST(strftime(o_orderdate, '%Y-%m-%d') AS TIMESTAMP) END AS ts, o_orderkey FROM orders)"


def _dated(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, d, "orders").select(F.when(key % 7 == 0, "-").when(key % 11 == 0, " n/a").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("written"), key)


query(
    "temporal_extent_text",
    f"SELECT count(*) AS total_records, count(ts) AS valid_timestamps, count(*) - count(ts) AS null_timestamps, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS end_ts, CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000.0) AS BIGINT) AS duration_days FROM {_DATED}",
)(lambda spark, d: _stamped(temporal.temporal_extent(_dated(spark, d), "written"), "start_ts", "end_ts"))
query(
    "temporal_column_text",
    f"WITH g AS (SELECT epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts) AS gap FROM {_DATED} WHERE ts IS NOT NULL) SELECT 'written' AS field, count(*) AS total, count(*) - count(written) AS null_count, round_even(count(ts)::DOUBLE / count(*), 4) AS parse_success_rate, (SELECT median(gap)::DOUBLE FROM g) AS median_gap_us, 'none/naive' AS timezone FROM {_DATED}",
)(lambda spark, d: temporal.analyze_temporal_column(_dated(spark, d), "written").select("field", "total", "null_count", "parse_success_rate", "median_gap_us", "timezone"))
for _part in ("year", "month"):
    query(f"records_by_{_part}_text", f"SELECT CAST({_part}(ts) AS BIGINT) AS {_part}, count(*) AS n FROM {_DATED} WHERE ts IS NOT NULL GROUP BY 1")(
        lambda spark, d, part=_part: temporal.records_by(_dated(spark, d), "written", part).withColumn(part, F.col(part).cast("long"))
    )
# nine tenths of the rows read as dates, and nothing of the other columns does
query("temporal_columns_text", f"SELECT 'written' AS field, false AS name_suggests_temporal, CASE WHEN count(ts) / count(*) > 0.8 THEN 'datetime_string' END AS detected_type FROM {_DATED} WHERE o_orderkey % 7 > 0")(
    lambda spark, d: temporal.detect_temporal_columns(_dated(spark, d).where("o_orderkey % 7 > 0").select("written", F.lit("no date").alias("remark"))).drop("sample_values")
)


def _range_sql(t: str, c: str) -> str:
    return f"SELECT '{c}' AS field, CASE WHEN min({c}) >= -90 AND max({c}) <= 90 THEN 'possible_latitude' WHEN min({c}) >= -180 AND max({c}) <= 180 THEN 'possible_longitude' END AS detected_type FROM {t}"


for _t in ("lineitem", "part", "events"):
    query(f"coordinate_types_{_t}", union([_range_sql(_t, c) for c in NUMERIC[_t]]))(lambda spark, d, t=_t: spatial.coordinate_types(table(spark, d, t)))

_EXTENT = (
    "SELECT least(count({a}), count({b})) AS valid_point_count, round(min({a}::DOUBLE), 4) AS min_lat, round(max({a}::DOUBLE), 4) AS max_lat, round(min({b}::DOUBLE), 4) AS min_lon, round(max({b}::DOUBLE), 4) AS max_lon, round(avg({a}::DOUBLE), 4) AS center_lat, round(avg({b}::DOUBLE), 4) AS center_lon, "
    "CASE WHEN min({a}) < -90 OR max({a}) > 90 THEN 1 ELSE 0 END + CASE WHEN min({b}) < -180 OR max({b}) > 180 THEN 1 ELSE 0 END AS n_warnings FROM {t}"
)
for _n, _t, _a, _b in (("lineitem", "lineitem", "l_quantity", "l_linenumber"), ("events", "events", "value", "user_id")):
    query(f"spatial_extent_{_n}", _EXTENT.format(a=_a, b=_b, t=_t))(
        lambda spark, d, t=_t, a=_a, b=_b: rounded(spatial.spatial_extent(table(spark, d, t), a, b), "min_lat", "max_lat", "min_lon", "max_lon", "center_lat", "center_lon").withColumn("n_warnings", F.size("warnings")).drop("warnings")
    )
query(
    "spatial_column_events",
    "SELECT 'value' AS field, count(*) AS total, count(*) - count(value) AS null_count, round(min(value), 4) + 0.0 AS min, round(max(value), 4) + 0.0 AS max, round(avg(value), 4) + 0.0 AS mean, CASE WHEN min(value) >= -90 AND max(value) <= 90 THEN 'latitude' WHEN min(value) >= -180 AND max(value) <= 180 THEN 'longitude' ELSE 'projected_or_other' END AS coordinate_hint FROM events",
)(lambda spark, d: rounded(spatial.analyze_spatial_column(table(spark, d, "events"), "value"), "min", "max", "mean").select("field", "total", "null_count", "min", "max", "mean", "coordinate_hint"))
_SPATIAL_SQL = (
    "SELECT field, regexp_matches(lower(field), '" + _PLACE_NAMES + "') AS name_suggests_spatial, detected_type FROM ({ranges}) UNION ALL SELECT field, true, NULL FROM " + _CATALOG + " WHERE resource = '{t}' AND kind = 'VARCHAR' AND regexp_matches(lower(field), '" + _PLACE_NAMES + "')"
)
for _t in ("part", "lineitem"):
    query(f"spatial_columns_{_t}", "SELECT * FROM (" + _SPATIAL_SQL.format(t=_t, ranges=union([_range_sql(_t, c) for c in NUMERIC[_t]])) + ") WHERE name_suggests_spatial OR detected_type IS NOT NULL")(
        lambda spark, d, t=_t: spatial.detect_spatial_columns(table(spark, d, t)).drop("sample_values")
    )


def _placed(spark: SparkSession, d: str) -> DataFrame:
    """Customers with a point on the globe, in numbers and as text."""
    key = F.col("c_custkey")
    lat, lon = (key % 180 - 90).cast("double"), (key % 360 - 180).cast("double")
    return table(spark, d, "customer").select((key + 1000).alias("c_key"), lon.alias("x_coord"), lat.alias("y_coord"), F.format_string("POINT(%s %s)", lon, lat).alias("shape"))


query("coordinate_pairs_customer", "SELECT CASE WHEN min(c_custkey % 180 - 90) >= -90 AND max(c_custkey % 180 - 90) <= 90 THEN 'y_coord' END AS latitude, CASE WHEN min(c_custkey % 360 - 180) < -90 THEN 'x_coord' END AS longitude FROM customer")(
    lambda spark, d: spatial.coordinate_pairs(spatial.detect_spatial_columns(_placed(spark, d)), ["c_key", "x_coord", "y_coord", "shape"])
)
query(
    "wkt_columns_customer",
    "SELECT 'shape' AS field, count(*) AS total, 0::BIGINT AS null_count, 'WKT' AS format, count(*) FILTER (WHERE 'POINT(' || (c_custkey % 360 - 180) || ' ' || (c_custkey % 180 - 90) || ')' LIKE 'POINT(%') AS points FROM customer",
)(lambda spark, d: spatial.analyze_spatial_column(_placed(spark, d), "shape").select("field", "total", "null_count", "format", F.col("wkt_types")["POINT"].alias("points")))
query("wkt_types_events", "SELECT CASE WHEN user_id % 3 = 0 THEN 'POINT' WHEN user_id % 3 = 1 THEN 'LINESTRING' ELSE 'MULTIPOLYGON' END AS wkt_type, count(*) AS n FROM events GROUP BY 1")(
    lambda spark, d: spatial.wkt_types(
        table(spark, d, "events").select(F.when(F.col("user_id") % 3 == 0, F.format_string("Point (%s 1)", F.col("value").cast("string"))).when(F.col("user_id") % 3 == 1, F.lit(" LINESTRING(0 0, 1 1)")).otherwise(F.lit("multipolygon(((0 0, 1 1, 1 0, 0 0)))")).alias("g")), "g"
    )
)
_SQL = "SELECT c_mktsegment, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment"
query("sql_passthrough", _SQL)(lambda spark, d: context(spark, d, ("orders", "customer")).execute_query(_SQL))




def _written(spark: SparkSession, name: str) -> str:
    """A new place in the folder that the session shares."""
    import uuid

    return f"{shared_dir(spark)}/strataprobe-{uuid.uuid4().hex}/{name}"


def _delimited(spark: SparkSession, d: str, name: str, mark: str, extension: str = "csv") -> Context:
    """A table written as delimited text in several files, and read back as a context by its URI."""
    path = _written(spark, f"{name}.{extension}")
    table(spark, d, name).repartition(3).write.csv(path, sep=mark, header=True, quote='"', escape='"')
    return create_context(spark, path if "://" in path or path.startswith("file:") else f"file:{path}", pattern="*.csv")


query("csv_customer", "SELECT * FROM customer")(lambda spark, d: _delimited_union(spark, d, "customer", ";"))
query("tsv_supplier", "SELECT * FROM supplier")(lambda spark, d: _delimited_union(spark, d, "supplier", "\t"))
# texts with quotes, delimiters and line ends in them
query("csv_benchmark", "SELECT item_id, md5(text) AS text_md5 FROM benchmark")(lambda spark, d: _delimited_union(spark, d, "benchmark", ",").select("item_id", F.md5("text").alias("text_md5")))
query("csv_field_types_orders", "SELECT CAST(ordinal AS INTEGER) AS ordinal, field, CASE WHEN kind IN ('BIGINT', 'INTEGER') THEN 'bigint' WHEN kind = 'DOUBLE' THEN 'double' ELSE 'string' END AS dtype FROM " + _CATALOG + " WHERE resource = 'orders'")(
    lambda spark, d: schema.schema_rows(spark, {"orders": _delimited_union(spark, d, "orders", "|")}).select("ordinal", "field", "dtype")
)


def _delimited_union(spark: SparkSession, d: str, name: str, mark: str) -> DataFrame:
    """All files of the context: each is a resource of its own."""
    context = _delimited(spark, d, name, mark)
    return schema.union_all(list(context.tables().values()))


def _sqlite(spark: SparkSession, d: str) -> Context:
    """Nations, regions and suppliers in a SQLite file, with declared keys; a mark without a type holds numbers and texts."""
    import os
    import sqlite3

    path = _written(spark, "geo.db").removeprefix("file:")
    os.makedirs(os.path.dirname(path))
    with contextlib.closing(sqlite3.connect(path)) as db, db:
        db.execute("CREATE TABLE region(r_regionkey INTEGER PRIMARY KEY, r_name TEXT)")
        db.execute("CREATE TABLE nation(n_nationkey INTEGER PRIMARY KEY, n_name TEXT, n_regionkey INTEGER REFERENCES region(r_regionkey), mark)")
        db.execute("CREATE TABLE supplier(s_suppkey INTEGER PRIMARY KEY, s_name TEXT, s_nationkey INTEGER REFERENCES nation, s_acctbal REAL)")
        for name, wide in (("region", 2), ("nation", 3), ("supplier", 4)):
            rows = (tuple(r) if name != "nation" else (*r, r[0] % 5 if r[0] % 2 else str(r[0] % 5)) for r in table(spark, d, name).toLocalIterator())
            db.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * (wide + (name == 'nation')))})", rows)
    return create_context(spark, path)


query("sqlite_supplier", "SELECT * FROM supplier WHERE s_acctbal > 1000 AND s_nationkey <= 12")(lambda spark, d: _sqlite(spark, d).table("supplier").where("s_acctbal > 1000 AND s_nationkey <= 12"))
# numbers and texts of a column without a type are equal once they are read
query("sqlite_untyped", "SELECT n_nationkey, n_name, CAST(n_nationkey % 5 AS VARCHAR) AS mark FROM nation WHERE n_nationkey % 5 = 3")(lambda spark, d: _sqlite(spark, d).read_resource("nation", ["n_nationkey", "n_name", "mark"]).where("mark = '3'"))
query("sqlite_native_sql", "SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")(lambda spark, d: _sqlite(spark, d).execute_native("SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1"))
query(
    "sqlite_foreign_keys",
    "SELECT 'nation' AS from_resource, f.field AS from_field, t.resource AS to_resource, t.field AS to_field FROM " + _CATALOG.replace("AS cat", "AS f") + " JOIN " + _CATALOG.replace("AS cat", "AS t") + " ON f.resource = 'nation' AND t.resource = 'region' AND f.field = 'n_' || substr(t.field, 3) AND t.field LIKE '%key' "
    "UNION ALL SELECT 'supplier', f.field, t.resource, t.field FROM " + _CATALOG.replace("AS cat", "AS f") + " JOIN " + _CATALOG.replace("AS cat", "AS t") + " ON f.resource = 'supplier' AND t.resource = 'nation' AND f.field = 's_' || substr(t.field, 3) AND t.field LIKE '%nationkey'",
)(lambda spark, d: spark.createDataFrame([(e.from_resource, e.from_field, e.to_resource, e.to_field) for e in _sqlite(spark, d).get_relationships()], "from_resource string, from_field string, to_resource string, to_field string"))


@query("streaming_missing_values_events", "SELECT count(*) AS row_count, count(*) - count(event_id) AS event_id_nulls, count(*) - count(value) AS value_nulls FROM events")
def streaming_missing_values_events(spark: SparkSession, d: str) -> DataFrame:
    return _streamed(spark, d, "events", lambda s: streaming.running_missing_values(s, ["event_id", "value"]))


@query("streaming_records_by_month_orders", "SELECT CAST(month(o_orderdate) AS BIGINT) AS month, count(*) AS n FROM orders GROUP BY 1")
def streaming_records_by_month_orders(spark: SparkSession, d: str) -> DataFrame:
    return _streamed(spark, d, "orders", lambda s: streaming.running_records_by(s, "o_orderdate", "month")).withColumn("month", F.col("month").cast("long"))


def _streamed(spark: SparkSession, d: str, name: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    import uuid

    path, view = f"{d}/{name}.parquet", f"strataprobe_{uuid.uuid4().hex}"
    stream = streaming.read_growing(spark, streaming.stream_path(spark, path), spark.read.parquet(path).schema)
    running = streaming.start(make(stream), view, f"{shared_dir(spark)}/{view}")
    try:
        running.awaitTermination()
    finally:
        running.stop()
    return spark.table(view)


@query(
    "metadata_record",
    "WITH g AS (SELECT epoch_us(o_orderdate) - lag(epoch_us(o_orderdate)) OVER (ORDER BY o_orderdate) AS gap FROM orders WHERE o_orderdate IS NOT NULL), m AS (SELECT median(gap)::DOUBLE AS us FROM g) "
    "SELECT 'Star Schema' AS title, '3 resources: ' || " + " || ', ' || ".join(f"'{t} (' || (SELECT count(*) FROM {t}) || ' rows, ' || (SELECT count(*) FROM (DESCRIBE {t})) || ' fields)'" for t in ("orders", "customer", "nation"))
    + " || '.' AS description, NULL::VARCHAR AS subject, NULL::MAP(VARCHAR, DOUBLE) AS spatial_coverage, NULL::VARCHAR AS spatial_resolution, "
    "(SELECT strftime(min(o_orderdate), '%Y-%m-%d') || ' to ' || strftime(max(o_orderdate), '%Y-%m-%d') FROM orders) AS temporal_coverage, "
    "CASE WHEN us < 1e6 THEN 'sub-second' WHEN us < 60e6 THEN 'second' WHEN us < 3600e6 THEN 'minute' WHEN us < 86400e6 THEN 'hourly' WHEN us < 604800e6 THEN 'daily' WHEN us < 2764800e6 THEN 'weekly/monthly' ELSE 'monthly+' END AS temporal_resolution, "
    "NULL::VARCHAR AS methods, 'Parquet' AS format FROM m",
)
def metadata_record(spark: SparkSession, d: str) -> DataFrame:
    return record_frame(spark, synthesise(context(spark, d, ("orders", "customer", "nation"))))


@query(
    "plan_log",
    "SELECT CAST(s AS INTEGER) AS step, t AS task, p AS player, true AS success, NULL::VARCHAR AS error FROM (VALUES (1, 'Survey the resources', 'data_analyst'), (2, 'Describe the schema', 'schema_expert'), (3, 'Profile the columns', 'data_analyst'), "
    "(4, 'Find relations', 'relationship_analyst'), (5, 'Find time and place', 'spatial_temporal_specialist'), (6, 'Write the record', 'metadata_generator')) AS plan(s, t, p)",
)
def plan_log(spark: SparkSession, d: str) -> DataFrame:
    return execute_plan(context(spark, d, ("nation", "region"))).log(spark).select("step", "task", "player", "success", "error")
