import pytest

from strataprobe.functions.names import names_match
from strataprobe.operators import relate


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


@pytest.mark.parametrize(("a", "b", "same"), [("cust_id", "CustID", True), ("doc_id", "document_id", False), ("parentid", "parent-ID", True), ("id", "user_id", True), ("name", "short_name", True), ("o_custkey", "c_custkey", False)])
def test_names_match(a, b, same):
    assert names_match(a, b) is same and names_match(b, a) is same


def test_column_relationship(spark):
    parent = spark.createDataFrame([(i,) for i in range(100)], "id long")
    child = spark.createDataFrame([(i % 50,) for i in range(200)] + [(None,)], "parent_id int")
    r = one(relate.column_relationship(child, "parent_id", parent, "id"))
    assert (r.values_in_a, r.values_in_b, r.common_values) == (50, 100, 50)
    assert (r.match_rate_a_to_b, r.match_rate_b_to_a, r.confidence_score) == (1.0, 0.5, 0.75)
    assert r.suggested_relationship_type == "one-to-many (B -> A)" and r.likely_foreign_key
    back = one(relate.column_relationship(parent, "id", child, "parent_id"))
    assert back.common_values == 50 and back.suggested_relationship_type == "one-to-many (A -> B)"


def test_uniqueness_threshold(spark):
    frame = lambda distinct, rows: spark.createDataFrame([(min(i, distinct - 1),) for i in range(rows)], "k long")
    assert one(relate.column_relationship(frame(99, 100), "k", frame(98, 100), "k")).suggested_relationship_type == "one-to-many (A -> B)"


def test_families_do_not_mix(spark):
    numbers, texts = spark.createDataFrame([(1,), (2,)], "key long"), spark.createDataFrame([("1",), ("2",)], "key string")
    floats = spark.createDataFrame([(1.0,), (2.5,)], "key double")
    assert one(relate.column_relationship(numbers, "key", texts, "key")).common_values == 0
    assert one(relate.column_relationship(numbers, "key", floats, "key")).common_values == 1
    assert relate.discover_relationships({"a": numbers, "b": texts}).count() == 0
    assert relate.common_values(numbers, "key", texts, "key").count() == 0
    assert one(relate.join_count(numbers, "key", texts, "key", "outer")).row_count == 4


def test_empty(spark):
    none = spark.createDataFrame([], "id long")
    r = one(relate.column_relationship(none, "id", none, "id"))
    assert (r.common_values, r.match_rate_a_to_b, r.likely_foreign_key) == (0, 0.0, False)


@pytest.mark.parametrize(("common", "found"), [(1, 0), (2, 1)])
def test_least_overlap(spark, common, found):
    a = spark.createDataFrame([(i,) for i in range(10)], "id long")
    b = spark.createDataFrame([(i,) for i in range(10 - common, 20 - common)], "id long")
    assert relate.discover_relationships({"a": a, "b": b}).count() == found


def test_discovery(spark):
    a = spark.createDataFrame([(i, f"n{i}") for i in range(20)], "id long, name string")
    b = spark.createDataFrame([(i, i % 20) for i in range(60)], "code long, a_id int")
    c = spark.createDataFrame([(f"n{i}",) for i in range(10)], "name string")
    edges = relate.discover_relationships({"a": a, "b": b, "c": c}).collect()
    got = {(e.from_resource, e.from_field, e.to_resource, e.to_field): e for e in edges}
    assert set(got) == {("a", "id", "b", "a_id"), ("a", "name", "c", "name")}
    e = got["a", "id", "b", "a_id"]
    assert (e.relationship_type, e.match_rate, e.confidence, e.is_verified) == ("one-to-many", 1.0, 1.0, False)
    assert len(e.sample_common_values) == 5 and e.common_value_count == 20
    assert relate.discover_relationships({"a": a, "b": b}, sample_rows=10).count() == 1


@pytest.fixture(scope="module")
def sides(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "k long, v string")
    b = spark.createDataFrame([(1, "p"), (1, "q"), (None, "r"), (9, "s")], "k long, v string")
    return a, b


@pytest.mark.parametrize(("how", "n"), [("inner", 3), ("left", 4), ("right", 4), ("outer", 5), ("sideways", 3)])
def test_joins(sides, how, n):
    a, b = sides
    df = relate.join_tables(a, "k", b, "k", how)
    assert df.columns == ["k", "v_table_a", "v_table_b"] and df.count() == n
    assert one(relate.join_count(a, "k", b, "k", how)).row_count == n
    assert relate.join_preview(a, "k", b, "k", how, 2).count() == 2


def test_null_keys_can_be_left_out(sides):
    a, b = sides
    assert relate.join_tables(a, "k", b, "k", null_safe=False).count() == 2
    assert one(relate.join_count(a, "k", b, "k", null_safe=False)).row_count == 2


def test_keys_of_two_names_both_stay(spark, sides):
    a, b = sides
    df = relate.join_tables(a, "k", b.withColumnRenamed("k", "j"), "j")
    assert df.columns == ["k", "v_table_a", "j", "v_table_b"] and df.count() == 3
