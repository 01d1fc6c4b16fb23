import hashlib

import pytest
from oracle import assert_same, connect

from strataprobe.llm import exact_dedup
from strataprobe.llm.exact_dedup import deduplicate_exact, fold_stream
from strataprobe.llm.queries import ORACLES, QUERIES
from strataprobe.llm.scratch import Scratch


def run(spark, df, tmp_path, **options):
    path = str(tmp_path / "docs")
    df.write.parquet(path)
    return deduplicate_exact(spark, path, **options).collect()


def check(rows, texts):
    """texts: (id, text) of every row."""
    groups = {}
    for i, t in texts:
        groups.setdefault(t or "", []).append(i)
    by_digest = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    assert len(rows) == len(texts) and sorted(str(r.id) for r in rows) == sorted(str(i) for i, _ in texts)
    for digest, ids in by_digest.items():
        own = [r for r in rows if r.digest == digest]
        best = max((i for i in ids if i is not None), default=None)
        assert len(own) == len(ids) and all(r.keep_id == best and r.group_size == len(ids) for r in own)
        assert sum(r.kept for r in own) == 1 and next(r.id for r in own if r.kept) == best


def test_groups(spark, documents, tmp_path):
    texts = [(i, f"t{i % 9}") for i in range(60)] + [(100, None), (101, ""), (102, "z" * 200_000), (103, "z" * 200_000), (None, "t1"), (None, "lone"), (7, "t7"), (7, "t7")]
    check(run(spark, documents(*texts).repartition(4), tmp_path, max_files=1, salt_rows=3), texts)


def test_empty_table(spark, documents, tmp_path):
    assert run(spark, documents(), tmp_path) == []


def test_only_new_files_are_read_again(spark, documents, tmp_path):
    scratch, path = Scratch(spark), str(tmp_path / "grow")
    into, at = scratch.path(), scratch.path()
    documents((1, "a"), (2, "b")).coalesce(1).write.parquet(path)
    fold_stream(spark, path, into, at)
    documents((3, "a")).coalesce(1).write.mode("append").parquet(path)
    fold_stream(spark, path, into, at)
    states = spark.read.parquet(into).orderBy("epoch", "digest").collect()
    assert [(r.epoch, r.n, r.keep.id) for r in states if r.n == 2] == [(1, 2, 3)] and len(states) == 3


def test_bytes_are_checked_on_hits(spark, documents, tmp_path, monkeypatch):
    """With a digest that collides, rows are still grouped by their whole text."""
    from pyspark.sql import functions as F

    real = exact_dedup._digested

    def weak(table, id_col, text_col):
        return real(table, id_col, text_col).withColumn("digest", F.substring("digest", 1, 1))

    monkeypatch.setattr(exact_dedup, "_digested", weak)
    rows = run(spark, documents(*[(i, f"t{i % 40}") for i in range(80)]), tmp_path)
    assert len(rows) == 80 and all(r.group_size == 2 and r.keep_id == r.id % 40 + 40 and r.kept == (r.id >= 40) for r in rows)


def test_query(spark, sf_dir):
    assert_same(QUERIES["op8_exact_dedup"](spark, sf_dir), connect(sf_dir), ORACLES["op8_exact_dedup"])


@pytest.mark.parametrize("name", [n for n in ORACLES if n != "op8_exact_dedup"])
def test_other_sql(name, spark, sf_dir):
    assert_same(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLES[name])
