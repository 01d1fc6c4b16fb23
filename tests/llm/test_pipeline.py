"""run() against each stage done plainly on the driver."""

import random

import pytest
from test_containment import brute as contained
from test_jaccard_join import brute as near
from test_sharding import winner

import corpus_pipeline

EIGHT = [(i, 1.0) for i in range(8)]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """A small corpus with toxic rows, copies, benchmark passages and several sources."""
    r = random.Random(11)
    vocabulary = ["".join(r.choices(["ba", "do", "ki", "lu", "ne"], k=3)) for _ in range(500)]
    items = [(j, " ".join(r.choices(vocabulary, k=14))) for j in range(6)]
    rows, labels = [], []
    for i in range(360):
        words = r.choices(vocabulary, k=r.choice([30, 80, 120]))
        toxic = i % 6 == 0
        for _ in range(len(words) // 8 if toxic else 0):
            words[r.randrange(len(words))] = r.choice(["scumbag", "wretchling"])
        if i % 10 == 1:
            words[5:5] = items[i % 6][1].split()
        if i % 9 == 2 and rows:
            words = r.choice(rows)[1].split()
            words[r.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words), "xx", f"s{i % 4}", 0))
        labels.append((i, 1, int("scumbag" in words or "wretchling" in words)))
    d = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows, labels, items


def test_stages_are_the_ones_asked_for():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "jaccard_join", "decontamination", "mixing", "sharding"] and corpus_pipeline.ORACLE_SQL is None


def test_each_stage_against_brute_force(spark, made):
    d, rows, labels, items = made
    stage = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns

    clean = stage["toxicity"](spark, docs, d)
    assert clean.columns == columns
    clean_ids = {r.doc_id for r in clean.collect()}
    toxic = {i for i, _, y in labels if y}
    assert len(clean_ids & toxic) <= 3 and len({i for i, *_ in rows} - toxic - clean_ids) <= 3

    left = [(i, t) for i, t, *_ in rows if i in clean_ids]
    from fractions import Fraction

    want = sorted({int(c) for _, _, c, _ in near(left, 5, Fraction(4, 5))})
    single = stage["jaccard_join"](spark, clean, d)
    assert single.columns == columns and sorted(r.doc_id for r in single.collect()) == want and len(want) < len(left)

    bad = {int(i) for i, *_ in contained([x for x in left if x[0] in set(want)], items)}
    pure = stage["decontamination"](spark, single, d)
    assert pure.columns == columns and sorted(r.doc_id for r in pure.collect()) == [i for i in want if i not in bad] and bad

    mixed = stage["mixing"](spark, pure, d)
    assert mixed.columns == columns
    sizes, taken = {}, {}
    for r in pure.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
    for r in mixed.collect():
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
    total = sum(sizes.values())
    weights = dict(zip(sorted(sizes), (1, 2, 3, 1), strict=True))
    for s in sizes:
        assert abs(taken[s] - total * weights[s] / 7) <= 140

    out = stage["sharding"](spark, mixed, d).collect()
    assert len(out) == mixed.count() and all(r.shard == winner(str(r.doc_id), EIGHT) for r in out)
    for s in range(8):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))


def test_run_chains_the_stages(spark, made):
    d, rows, *_ = made
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, d)
    key = lambda r: (r.doc_id, r.shard, r.text_crc32)
    assert sorted(map(key, corpus_pipeline.run(spark, d).collect())) == sorted(map(key, docs.collect()))


def test_odd_documents(spark, documents, tmp_path):
    d = str(tmp_path)
    documents((1, None), (None, "a b c"), (2, ""), (3, "x y z " * 50_000), (4, "a b c", None, None), (4, "a b c", None, None)).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(None, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert {r.text for r in corpus_pipeline.run(spark, d).collect()} <= {None, "", "a b c", "x y z " * 50_000}


def test_empty_tables(spark, documents, tmp_path):
    d = str(tmp_path)
    documents().write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert corpus_pipeline.run(spark, d).collect() == []
