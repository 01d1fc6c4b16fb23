import math

import pytest
from pyspark.sql import functions as F

from strataprobe.errors import ColumnNotFound
from strataprobe.operators import profile, schema


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(1, 1.0, "b", True), (2, float("nan"), "a", None), (3, None, "b", False), (4, 4.0, "a", True)], "id long, x double, s string, f boolean")


def by(df, key="field"):
    return {r[key]: r for r in df.collect()}


def test_missing_values_count_nan(odd):
    assert {k: r.null_count for k, r in by(profile.missing_values(odd)).items()} == {"id": 0, "x": 2, "s": 0, "f": 1}
    with pytest.raises(ColumnNotFound):
        profile.missing_values(odd, ["nope"])


def test_numeric_statistics(odd):
    rows = by(profile.numeric_statistics(odd))
    assert set(rows) == {"id", "x"}
    r = rows["id"]
    assert (r["count"], r["mean"], r["p25"], r["p50"], r["p75"], r["max"]) == (4, 2.5, 1.75, 2.5, 3.25, 4.0)
    assert math.isclose(r["std"], math.sqrt(5 / 3))
    assert rows["x"]["count"] == 2 and rows["x"]["mean"] == 2.5


def test_population_statistics(odd):
    r = by(profile.population_statistics(odd))["id"]
    assert r["std"] == 1.118 and r["mean"] == 2.5


def test_approximate_quartiles_stay_close(spark):
    df = spark.range(10_001).select(F.col("id").alias("v"))
    r = profile.numeric_statistics(df, approx=True).first()
    assert abs(r["p50"] - 5000) <= 10 and abs(r["p25"] - 2500) <= 10


def test_categorical_ties_take_the_least(odd):
    rows = by(profile.categorical_statistics(odd))
    assert (rows["s"]["count"], rows["s"]["unique"], rows["s"]["top"], rows["s"]["freq"]) == (4, 2, "a", 2)
    assert (rows["f"]["count"], rows["f"]["unique"], rows["f"]["top"], rows["f"]["freq"]) == (3, 2, "true", 2)


def test_field_statistics(odd):
    rows = by(profile.field_statistics(odd))
    assert rows["s"]["mean"] is None and rows["id"]["top"] is None and set(rows) == {"id", "x", "s", "f"}
    assert "top" not in profile.field_statistics(odd.select("id", "x")).columns


def test_empty_and_all_null(spark):
    empty = spark.createDataFrame([], "a long, s string")
    assert by(profile.numeric_statistics(empty))["a"]["count"] == 0
    r = by(profile.categorical_statistics(empty))["s"]
    assert (r["count"], r["unique"], r["top"], r["freq"]) == (0, 0, None, None)
    nulls = spark.createDataFrame([(None, None)], "a long, s string")
    assert by(profile.missing_values(nulls))["s"].null_count == 1
    assert by(profile.categorical_statistics(nulls))["s"]["unique"] == 0
    assert profile.unique_values(nulls, "s").count() == 0


def test_unique_values(odd):
    assert [r.value for r in profile.unique_values(odd, "s").collect()] == ["a", "b"]
    assert [r.value for r in profile.unique_values(odd, "x", 0).collect()] == [1.0, 4.0]
    rows = profile.unique_values_overflow(odd, "x", 2).collect()
    assert [(r.value, r.overflow_count) for r in rows] == [(1.0, 1), (4.0, 1)]
    assert profile.unique_values_overflow(odd, "x", 5, keep_null=False).count() == 2


def test_wide_tables_take_several_aggregates(spark):
    df = spark.range(3).select(*[(F.col("id") * i).alias(f"c{i}") for i in range(130)])
    assert {r["field"]: r["max"] for r in profile.numeric_statistics(df).collect()}["c129"] == 258.0
    assert profile.missing_values(df).count() == 130


def test_names_with_dots_and_nested_types(spark):
    df = spark.createDataFrame([(1, [1, 2], {"k": 1})], "`a.b` long, arr array<int>, m map<string,int>")
    assert by(profile.missing_values(df))["a.b"].null_count == 0
    assert by(profile.categorical_statistics(df))["arr"]["top"] == "[1,2]"
    assert schema.profile_fields(df).samples["m"] == ['{"k":1}']


def test_schema_operators(spark, odd):
    other = spark.createDataFrame([(1, "z")], "ID long, created string")
    tables = {"a": odd, "b": other}
    assert {r.resource: r.item_count for r in schema.row_counts(tables).collect()} == {"a": 4, "b": 1}
    assert [(r.column_name, r.n_tables, r.locations) for r in schema.common_columns(spark, tables).collect()] == [("id", 2, ["a.id", "b.ID"])]
    marks = {(r.resource, r.field): (r.possible_id, r.possible_date, r.n_tables) for r in schema.compare_schemas(spark, tables).collect()}
    assert marks["b", "created"] == (False, True, 1) and marks["b", "ID"] == (True, False, 1)
    assert [r.id for r in schema.sample_items(odd, 2, ["id"]).collect()] == [1, 2]
    info = schema.file_info(odd, 60 * 1024 * 1024)
    assert info["is_large"] and info["size_mb"] == 60.0 and info["estimated_rows"] > 0


def test_counts_add_up(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    n = df.count()
    nulls = {r.field: r.null_count for r in profile.missing_values(df).collect()}
    for r in profile.numeric_statistics(df).collect():
        assert r["count"] + nulls[r["field"]] == n
        assert r["min"] <= r["p25"] <= r["p50"] <= r["p75"] <= r["max"]


def test_scans_read_only_the_columns_they_need(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    plan = profile.numeric_statistics(df, ["l_tax"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_tax:double>" in plan


def test_distributed_quantiles_are_exact(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    want = {r["field"]: (r["p25"], r["p50"], r["p75"]) for r in profile.numeric_statistics(df).collect()}
    for accuracy in (20, 50_000):
        got = {}
        for r in profile.distributed_quantiles(df, accuracy=accuracy).collect():
            got[r.field, r.p] = r.value
        assert got == pytest.approx({(f, p): v for f, own in want.items() for p, v in zip((0.25, 0.5, 0.75), own, strict=True)})
    assert profile.distributed_quantiles(df.limit(0)).count() == 0


def test_wide_columns_get_the_same_quartiles(spark):
    """Beyond the bound of distinct values the quartiles come from brackets, and are the same."""
    import random

    r = random.Random(1)
    df = spark.createDataFrame([(r.random(), i % 5) for i in range(800)], "x double, y long")
    want = [tuple(x) for x in profile.numeric_statistics(df).orderBy("field").collect()]
    got = [tuple(x) for x in profile.numeric_statistics(df, exact_distinct=50).orderBy("field").collect()]
    assert [w[0] for w in got] == [w[0] for w in want]
    for a, b in zip(got, want, strict=True):
        assert a[1:] == pytest.approx(b[1:])


def test_top_of_long_values(spark):
    """Long values that share their first characters: the most frequent, and of tied ones the least, is fetched whole."""
    head = "h" * 70
    rows = [(head + "b", head + "z"), (head + "a", head + "y"), (head + "b", head + "x"), ("short", None), (head + "a", head + "w")]
    got = {r.field: (r["count"], r.unique, r.top, r.freq) for r in profile.categorical_statistics(spark.createDataFrame(rows, "s string, t string")).collect()}
    assert got == {"s": (5, 3, head + "a", 2), "t": (4, 4, head + "w", 1)}
