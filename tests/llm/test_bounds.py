"""What bounds memory: samples, blocks of items, caches, spread keys, scratch folders."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_containment import brute, corpus, got
from test_exact_dedup import check

from strataprobe.llm import language_id, quality, rows, scratch, token_counts
from strataprobe.llm.components import connected_components
from strataprobe.llm.decontamination import contaminations, decontaminate
from strataprobe.llm.exact_dedup import deduplicate_exact
from strataprobe.llm.scratch import Scratch, temporary_tables


def sampled(docs, **options):
    settings = {"rows": 50, "size": 10**9, "longest": 10**6} | options
    return [tuple(r) for r in rows.bounded_sample(docs, "doc_id", "text", **settings).collect()]


def test_sample_of_null_ids(documents):
    """Null ids are told apart by text; copies are drawn once."""
    docs = documents(*[(None, f"text {i}", "x") for i in range(1000)])
    drawn = sampled(docs)
    assert 25 <= len(drawn) <= 85 and sampled(docs.repartition(5)).sort() is None
    assert sorted(drawn) == sorted(sampled(docs.repartition(5)))
    assert len(sampled(documents(*[(None, "same", "x") for _ in range(1000)]), rows=2000)) == 1


def test_sample_of_one_hot_id(documents):
    docs = documents(*[(7, f"text {i}", "x") for i in range(1000)])
    assert 25 <= len(sampled(docs)) <= 85


def test_sample_is_bounded_in_bytes(documents):
    docs = documents(*[(i, "x" * 1000 + str(i), "x") for i in range(500)], (1000, "y" * 10**5, "x"), (1001, None, "x"))
    drawn = sampled(docs, rows=10**6, size=50_000, longest=5000)
    assert 25 <= len(drawn) <= 85 and max(len(t) for t, in drawn) < 5000


def test_sample_by_language_leaves_no_language_out(documents):
    docs = documents(*[(i, f"text {i}", "common") for i in range(2000)], *[(9000 + i, f"rare {i}", "rare") for i in range(3)])
    found = Counter(lang for _, lang in sampled(docs, by="lang"))
    assert found["rare"] == 3 and 20 <= found["common"] <= 80
    model = language_id.fit(docs, train_docs=60)
    assert model.langs == ["common", "rare"]


def test_shares():
    assert rows.shares([{"rows": 10, "size": 100}, {"rows": 1000, "size": 100}], 110, 10**9) == [1.0, 0.1]
    assert rows.shares([{"rows": 0, "size": 0}], 5, 5) == [1.0]
    tiny = rows.shares([{"rows": 10**13, "size": 10**16}], 50_000, 10**9)[0]
    assert int(tiny * 2**63) > 0  # fine enough for any corpus


def test_quality_learns_from_null_ids(documents):
    """The scorer has weights for words although no id tells rows apart and the bound is hit."""
    r = random.Random(5)
    good = [" ".join(r.choice(["ba", "do", "ki", "lu"]) + r.choice(["ne", "sa"]) for _ in range(60)).capitalize() + "." for _ in range(300)]
    bad = [" ".join(r.choice(["###", "$$$", "%%%"]) for _ in range(60)) + str(i) for i in range(60)]
    _, scorer = quality.fit(documents(*[(None, t, "x") for t in good + bad]), train_docs=100)
    assert (scorer.word != 0).sum() > 5


def test_items_in_blocks_are_put_together(spark, documents):
    """Blocks by number and by bytes, with repeated items, give what one block gives."""
    docs, items = corpus(6)
    items = items + [(1000 + i, items[i % 5][1]) for i in range(40)]
    frame, table = documents(*docs[:50]), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs[:50], items)
    assert got(contaminations(frame, table)) == want
    assert got(contaminations(frame, table, block_items=9)) == want and got(contaminations(frame, table, block_bytes=2000)) == want
    bad = {i for i, *_ in want}
    assert sorted(str(r.doc_id) for r in decontaminate(frame, table, block_items=20).collect()) == sorted(str(i) for i, _ in docs[:50] if str(i) not in bad)


def test_many_items_go_to_the_driver_block_by_block(spark, documents, monkeypatch):
    """60,000 items in three blocks: one index at a time, and a copied item is one text."""
    from strataprobe.llm import decontamination

    sizes, real = [], decontamination.ContainmentIndex

    def watched(ids, *args):
        sizes.append(len(ids))
        return real(ids, *args)

    monkeypatch.setattr(decontamination, "ContainmentIndex", watched)
    items = spark.range(60_000).selectExpr("id AS item_id", "CASE WHEN id % 3 = 0 THEN 'the very same item of a test' ELSE concat('item number ', id, ' of a long test') END AS text")
    found = contaminations(documents((1, "it holds item number 4 of a long test"), (2, "nothing")), items, block_items=15_000)
    assert [(r.doc_id, r.item_id) for r in found.collect()] == [(1, 4)]
    assert len(sizes) == 3 and sum(sizes) == 40_001 and max(sizes) < 15_000


def test_long_pieces_are_not_cached():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    counter = token_counts.Counter50k(lambda: public_tokenizers.path("byte_bpe_50k.json"))
    text = "abcdefghij" * 5000 + " word " + "z" * 64 + " " + "q" * 63
    assert counter.count(text) == len(counter.tokenizer.encode(text, add_special_tokens=False))
    assert counter.cache and max(map(len, counter.cache)) <= token_counts.LONGEST


def test_hot_digest_is_spread(spark, documents, tmp_path):
    texts = [(i, "the hot text" if i % 3 else f"t{i}") for i in range(400)]
    path = str(tmp_path / "hot")
    documents(*texts).repartition(4).write.parquet(path)
    check(deduplicate_exact(spark, path, hot_rows=20, salt_rows=8).collect(), texts)


def test_spread_join(spark):
    left = spark.createDataFrame([("hot" if i % 2 else f"k{i % 7}", i) for i in range(500)], "key string, v int")
    right = left.select("key").distinct().withColumn("w", F.length("key"))
    counts = left.groupBy("key").agg(F.count("*").alias("n"))
    want = sorted(map(tuple, left.join(right, "key").collect()))
    assert sorted(map(tuple, rows.spread_join(left, right, "key", counts, hot_rows=10).collect())) == want == sorted(map(tuple, rows.spread_join(left, right, "key", counts).collect()))


def test_state_is_taken_up_again(spark, documents, tmp_path):
    """A second run over a table that has grown reads the new files only, and gives the whole table's rows."""
    path, state = str(tmp_path / "grow"), str(tmp_path / "state")
    first = [(i, f"t{i % 4}") for i in range(20)]
    documents(*first).coalesce(1).write.parquet(path)
    check(deduplicate_exact(spark, path, state_dir=state).collect(), first)
    more = [(100 + i, f"t{i}") for i in range(6)]
    documents(*more).coalesce(1).write.mode("append").parquet(path)
    check(deduplicate_exact(spark, path, state_dir=state).collect(), first + more)
    states = spark.read.parquet(f"{state}/states")
    assert states.where("epoch = 1").count() == 6 and states.select("epoch").distinct().count() == 2


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    class Cluster:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            @staticmethod
            def getConf():  # noqa: N802
                return {}

        class conf:  # noqa: N801
            @staticmethod
            def get(*_):
                return None

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Cluster)


def test_temporary_tables_go(spark):
    import os

    with temporary_tables():
        own = Scratch(spark)
        assert own.keep(spark.range(3)).count() == 3 and os.path.exists(own.root)
    assert not os.path.exists(own.root)


@pytest.mark.parametrize("shape", ["path", "star", "tree"])
def test_components_of_a_hundred_thousand_nodes(spark, monkeypatch, shape):
    """By distributed rounds alone; their number grows with the logarithm of the size."""
    from strataprobe.llm import components

    class Counted(Scratch):
        def keep(self, df, name="table"):
            kept.append(name)
            return super().keep(df, name)

    kept, n, r = [], 100_000, random.Random(8)
    monkeypatch.setattr(components, "ONE_TASK", 0)
    ids = r.sample(range(10**12), n)
    parent = {"path": lambda i: i - 1, "star": lambda i: 0, "tree": lambda i: r.randrange(i)}[shape]
    edges = spark.createDataFrame([(ids[i], ids[parent(i)]) for i in range(1, n)], "a long, b long")
    found = connected_components(edges, Counted(spark))
    assert found.count() == n and [x.label for x in found.select("label").distinct().collect()] == [min(ids)]
    assert kept.count("jumped") <= 24
