import sqlite3

import pytest

from strataprobe.sources import create_context


@pytest.fixture()
def path(tmp_path):
    path = str(tmp_path / "d.db")
    with sqlite3.connect(path) as db:
        db.executescript("""
            CREATE TABLE parent(id INTEGER PRIMARY KEY AUTOINCREMENT, name TEXT NOT NULL, x REAL);
            CREATE TABLE pair(a INT, b INT, note TEXT, PRIMARY KEY (b, a));
            CREATE TABLE child(id INTEGER PRIMARY KEY, parent_id INTEGER REFERENCES parent, p2 INTEGER REFERENCES parent(id), raw BLOB);
            CREATE TABLE keyed(k TEXT PRIMARY KEY, v NUMERIC) WITHOUT ROWID;
            CREATE VIEW seen AS SELECT * FROM parent;
            INSERT INTO parent(name, x) VALUES ('a', 1.5), ('b', NULL);
            INSERT INTO child VALUES (1, 1, 2, x'00ff'), (5, 2, NULL, NULL);
            INSERT INTO keyed VALUES ('q', 3);
        """)
    return path


def test_resources_and_rows(spark, path):
    ctx = create_context(spark, path)
    assert ctx.resources == ["child", "keyed", "pair", "parent"]
    assert ctx.table("child").dtypes == [("id", "bigint"), ("parent_id", "bigint"), ("p2", "bigint"), ("raw", "binary")]
    assert [(r.id, r.p2, r.raw) for r in ctx.table("child").orderBy("id").collect()] == [(1, 2, bytearray(b"\x00\xff")), (5, None, None)]
    assert ctx.table("pair").count() == 0 and ctx.table("keyed").first().v == 3.0
    assert ctx.read_resource("parent", ["x", "id"]).columns == ["x", "id"]
    assert create_context(spark, path, exclude_resources=["pair"]).resources == ["child", "keyed", "parent"]


def test_keys_and_relationships(spark, path):
    ctx = create_context(spark, path)
    assert ctx.get_resource_info("pair").primary_key == ["b", "a"]
    child = {f.name: f for f in ctx.get_resource_info("child").fields}
    assert child["id"].is_primary_key and child["parent_id"].foreign_key_reference == "parent.id"
    edges = {(e.from_field, e.to_resource, e.to_field, e.relationship_type, e.confidence, e.is_verified) for e in ctx.get_relationships()}
    assert edges == {("parent_id", "parent", "id", "many-to-one", 1.0, True), ("p2", "parent", "id", "many-to-one", 1.0, True)}
    assert ctx.get_resource_ddl("parent").startswith("CREATE TABLE parent") and ctx.get_db_path() == path


def test_queries_and_pushdown(spark, path):
    ctx = create_context(spark, path)
    assert [r.name for r in ctx.execute_native("SELECT name FROM parent WHERE id = ?", [2]).collect()] == ["b"]
    assert ctx.execute_query("SELECT count(*) AS n FROM child JOIN parent ON parent_id = parent.id").first().n == 2
    assert [r.id for r in ctx.table("parent").where("id > 1").collect()] == [2]


def test_partitions_cover_all_rows(spark, tmp_path):
    from strataprobe.sources.sqlite import read_sqlite

    path = str(tmp_path / "big.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE t(id INTEGER PRIMARY KEY, v INT)")
        db.executemany("INSERT INTO t VALUES (?, ?)", [(i * 3, i) for i in range(1000)])
    df = read_sqlite(spark, path, "t", rows_per_partition=500)
    assert df.rdd.getNumPartitions() == 2 and df.agg({"v": "sum"}).first()[0] == sum(range(1000))


def test_missing_file(spark):
    with pytest.raises(FileNotFoundError):
        create_context(spark, "/nowhere/x.db")


def test_pushed_conditions_lose_no_row(spark, tmp_path):
    """Values of other types than their column's: what SQLite is asked agrees with what Spark sees."""
    from strataprobe.sources.sqlite import read_sqlite

    path = str(tmp_path / "loose.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE t(a, n INTEGER, x NUMERIC, s TEXT)")
        db.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", [(5, 5, "-inf", "b"), ("5", "five", 3, b"b"), (None, None, None, None), (5.0, 2**62, "1_0", "B"), (b"5", 7, -1e300, "5")])
    df = read_sqlite(spark, path, "t")
    whole = spark.createDataFrame(df.collect(), df.schema)
    for test in ("a = '5'", "n >= 5", "n < 6", "n IS NULL", "n IS NOT NULL", "x < 0", "x > 2", "x IS NULL", "s = 'b'", "s > 'A'", "s = '5'", "a IS NULL"):
        assert df.where(test).count() == whole.where(test).count(), test
    assert df.where("a = '5'").count() == 3 and df.where("n IS NULL").count() == 2
