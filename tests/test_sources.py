import os

import pytest

from strataprobe.catalog import ContextType, clear_registry, get_context, register_context
from strataprobe.errors import ContextNotFound, ResourceNotFound
from strataprobe.sources import classify_context_type, create_context, detect_type_from_extension, is_csv_type
from strataprobe.sources.delimited import detect_delimiter, load_preview, named_by_stem, read_delimited


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


@pytest.mark.parametrize("mark", [",", "\t", ";", "|"])
def test_delimiters(tmp_path, spark, mark):
    path = write(tmp_path / "a.csv", "\n".join(mark.join(r) for r in (["x", "y"], ["1", "b"], ["2", "c"])) + "\n")
    assert detect_delimiter(path) == mark
    df = read_delimited(spark, path)
    assert df.dtypes == [("x", "bigint"), ("y", "string")] and df.count() == 2


def test_ragged_and_single_column_fall_back_to_the_comma(tmp_path):
    assert detect_delimiter(write(tmp_path / "r.csv", "a;b\n1;2;3\n")) == ","
    assert detect_delimiter(write(tmp_path / "s.csv", "a\n1\n2\n")) == ","
    assert detect_delimiter(str(tmp_path / "none.csv")) == ","


def test_na_tokens_and_types(tmp_path, spark):
    path = write(tmp_path / "n.csv", "s,i,f,b\nNA,1,1.5,True\nnull,,nan,False\n-,3,2,\n?,4,1e3,true\n")
    df = read_delimited(spark, path)
    assert [r.s for r in df.collect()] == [None, None, "-", "?"]
    assert [t for _, t in df.dtypes] == ["string", "bigint", "double", "boolean"]
    assert [r.f for r in df.collect()] == [1.5, None, 2.0, 1000.0]


def test_read_resource(tmp_path, spark):
    ctx = create_context(spark, write(tmp_path / "a.csv", "x,y,z\n1,2,3\n4,5,6\n"))
    assert ctx.context_type is ContextType.SINGLE_CSV and ctx.resources == ["a"]
    assert ctx.read_resource("a", ["z", "x"]).columns == ["x", "z"]
    assert ctx.read_resource("a", limit=1).count() == 1
    assert ctx.read_resource("a", [], 0).count() == 2
    assert [len(c) for c in ctx.iter_resource("a", 1)] == [1, 1]
    with pytest.raises(ResourceNotFound):
        ctx.read_resource("b")
    assert ctx.get_delimiter("a") == "," and ctx.get_file_path("a").endswith("a.csv")


def test_factory(tmp_path, spark):
    a, b = write(tmp_path / "a.csv", "id\n1\n"), write(tmp_path / "b.csv", "id\n1\n")
    ctx = create_context(spark, [b, a])
    assert ctx.context_type is ContextType.MULTI_CSV and ctx.resources == ["b", "a"]
    assert create_context(spark, ctx) is ctx
    assert create_context(spark, str(tmp_path)).resources == ["a", "b"]
    assert create_context(spark, {"one": a, "two": b}).resources == ["one", "two"]
    assert create_context(spark, write(tmp_path / "t.txt", "q,r\n1,2\n")).context_type is ContextType.SINGLE_CSV
    for bad in ([], {}, 3):
        with pytest.raises(ValueError):
            create_context(spark, bad)
    os.mkdir(tmp_path / "empty")
    for gone in (str(tmp_path / "no.csv"), [str(tmp_path / "no.csv")], str(tmp_path / "empty")):
        with pytest.raises(FileNotFoundError):
            create_context(spark, gone)
    with pytest.raises(ValueError):
        named_by_stem(["x/a.csv", "y/a.csv"])


def test_classify(tmp_path):
    assert classify_context_type([]) is ContextType.UNKNOWN
    assert classify_context_type(["a.CSV"]) is ContextType.SINGLE_CSV
    assert classify_context_type(["a.csv", "b.tsv"]) is ContextType.MULTI_CSV
    assert classify_context_type(["a.csv", "b.db"]) is ContextType.UNKNOWN
    assert classify_context_type([str(tmp_path)]) is ContextType.UNKNOWN
    write(tmp_path / "a.csv", "")
    assert classify_context_type([str(tmp_path)]) is ContextType.SINGLE_CSV
    write(tmp_path / "b.tsv", "")
    assert classify_context_type([str(tmp_path)]) is ContextType.MULTI_CSV
    assert detect_type_from_extension("x.sqlite3") is ContextType.SQLITE and is_csv_type("x.TSV")


def test_preview(tmp_path, spark):
    path = write(tmp_path / "p.tsv", "a\tb\n" + "1\t2\n" * 40)
    assert load_preview(spark, path).count() == 25 and load_preview(spark, path).columns == ["a", "b"]


def test_registry(tmp_path, spark):
    ctx = create_context(spark, write(tmp_path / "a.csv", "x\n1\n"))
    register_context("k", ctx)
    assert get_context("k") is ctx
    clear_registry()
    with pytest.raises(ContextNotFound):
        get_context("k")


def test_resource_info_looks_at_all_rows(tmp_path, spark):
    path = write(tmp_path / "late.csv", "id,v\n" + "".join(f"{i},{'' if i == 150 else 'a'}\n" for i in range(200)))
    info = create_context(spark, path).get_resource_info("late")
    assert info.item_count == 200 and [f.nullable for f in info.fields] == [False, True]
    assert info.fields[0].sample_values == ["0", "1", "2", "3", "4"] and info.size_in_bytes == os.path.getsize(path)
    assert info.fields[0].pandas_like_dtype == "int64" and info.to_dict()["fields"][1]["name"] == "v"


def test_sql(tmp_path, spark):
    ctx = create_context(spark, write(tmp_path / "a.csv", "x,y\n1,a\n2,b\n"))
    assert [r.y for r in ctx.execute_query("SELECT y FROM a WHERE x = ?", [2]).collect()] == ["b"]
    assert "x BIGINT" in ctx.get_resource_ddl("a")


def test_uris_folders_and_quoted_newlines(tmp_path, spark):
    quoted = write(tmp_path / "q.txt", 'x;t\n1;"one\nline"\n2;"two ""q"""\n')
    df = read_delimited(spark, f"file://{quoted}", ";")
    assert [(r.x, r.t) for r in df.orderBy("x").collect()] == [(1, "one\nline"), (2, 'two "q"')]
    write(tmp_path / "a.csv", "x;y\n1;b\n2;c\n")
    ctx = create_context(spark, f"file://{tmp_path}")
    assert ctx.resources == ["a"] and ctx.get_delimiter("a") == ";" and ctx.table().count() == 2
    with pytest.raises(FileNotFoundError):
        create_context(spark, f"file://{tmp_path}/gone")


def test_files_are_read_in_splits(tmp_path, spark):
    path = write(tmp_path / "big.csv", "x,y\n" + "".join(f"{i},b\n" for i in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        df = read_delimited(spark, path)
        assert df.rdd.getNumPartitions() > 2 and df.agg({"x": "sum"}).first()[0] == sum(range(20_000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_overview_shows_errors_in_place(tmp_path, spark):
    from strataprobe.operators.registry import run

    ctx = create_context(spark, {"a": write(tmp_path / "a.csv", "x\n1\n"), "b": write(tmp_path / "b.csv", "y\n1\n2\n")})
    os.remove(tmp_path / "b.csv")
    found = run("multi_file_overview", ctx)
    assert (found["a"]["row_count"], found["a"]["columns"]) == (1, ["x"]) and set(found["b"]) == {"error"}
