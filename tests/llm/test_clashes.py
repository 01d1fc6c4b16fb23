"""Every operator and stage over documents whose extra columns have the names of results and helpers."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strataprobe.llm import language_id, quality, toxicity
from strataprobe.llm.decontamination import contaminations, decontaminate
from strataprobe.llm.exact_dedup import deduplicate_exact
from strataprobe.llm.jaccard_join import jaccard_classes, keep_one_per_class
from strataprobe.llm.license_scan import scan_licenses
from strataprobe.llm.mixing import mix_sources, mixed_rows
from strataprobe.llm.sharding import shard_documents
from strataprobe.llm.token_counts import count_tokens

EXTRA = (
    "score", "predicted", "matches", "size", "target", "taken", "copies", "source_size", "_key", "_split", "_u", "_row", "_predicted", "_judged", "_evidence", "_metadata", "row", "rank", "key", "id", "n", "at", "h", "item",
    "evidence", "votes", "posterior", "keep", "lang_pred", "n_bytes", "n_tokens", "over_limit", "shard", "slot", "law", "text_crc32", "grown_shard", "digest", "file", "salt", "class", "linked", "odd.name", "a`b", "odds", "draw", "extra", "split",
)


@pytest.fixture(scope="module")
def rows():
    texts = [f"{'vile' if i % 5 == 0 else 'fine'} words number {i % 11} in a text of some length {i}" for i in range(60)]
    texts[7] = texts[8] = "one text that is there twice, word for word, in this table"
    texts[9] = "before it the benchmark passage of several words after it"
    return [(i, t, "xx", f"s{i % 3}") for i, t in enumerate(texts)] + [(None, None, None, None), (100, "", "xx", "s0"), (100, "", "xx", "s0")]


@pytest.fixture(scope="module")
def docs(documents, rows):
    return documents(*rows).select("*", *[F.concat(F.lit(f"{c}/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias(c) for c in EXTRA])


@pytest.fixture(scope="module")
def labels(spark, rows):
    return spark.createDataFrame([(r[0], 1, int(r[1].startswith("vile"))) for r in rows if r[1]], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "the benchmark passage of several words")], "item_id long, text string")


def unchanged(df, docs, replaced=(), added=(), count=None):
    """All columns of docs but the replaced ones are there with their values, in their order, then what is added."""
    kept = [c for c in docs.columns if c not in replaced]
    assert df.columns == [*kept, *(a for a in added)], df.columns
    found = df.collect()
    assert count is None or len(found) == count
    for r in found:
        for c in EXTRA:
            if c not in replaced:
                assert r[c] == f"{c}/{'null' if r['doc_id'] is None else r['doc_id']}", c
    return found


def test_operators_that_add_columns(spark, docs, labels):
    n = docs.count()
    model = toxicity.fit(docs, labels)
    unchanged(toxicity.score_toxicity(docs, model), docs, ("score", "predicted"), ("score", "predicted"), n)
    added = ("votes", "posterior", "score", "keep")
    unchanged(quality.classify_quality(docs, *quality.fit(docs)), docs, added, added, n)
    added = ("lang_pred", "score")
    unchanged(language_id.identify(docs, language_id.fit(docs)), docs, added, added, n)
    unchanged(language_id.identify(docs, language_id.fit(docs.limit(0))), docs, added, added, n)
    added = ("size", "source_size", "target", "copies", "taken")
    unchanged(mix_sources(docs), docs, added, added, n)
    added = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    unchanged(shard_documents(docs), docs, added, added, n)


def test_token_counts(docs):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    added = ("n_bytes", "n_tokens", "over_limit")
    unchanged(count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")), docs, added, added, docs.count())


def test_operators_that_keep_rows(docs, labels, items):
    clean = unchanged(toxicity.reject_toxic(docs, toxicity.fit(docs, labels)), docs)
    assert 0 < len(clean) < docs.count()
    assert sorted(str(r.doc_id) for r in unchanged(decontaminate(docs, items), docs)) == sorted(str(r.doc_id) for r in docs.collect() if r.doc_id != 9)
    more = items.unionByName(items.selectExpr("item_id + 1 AS item_id", "concat(text, ' and more words again') AS text"))
    assert len(unchanged(decontaminate(docs, more, block_items=1), docs)) == docs.count() - 1
    ids = [r.doc_id for r in unchanged(keep_one_per_class(docs), docs)]
    assert 7 in ids and 8 not in ids
    unchanged(mixed_rows(docs), docs)


def test_operators_that_give_rows_of_their_own(spark, docs, items, tmp_path):
    assert [(r.doc_id, r.item_id) for r in contaminations(docs, items).collect()] == [(9, 1)]
    assert scan_licenses(docs).collect() == []
    assert {r.component_id for r in jaccard_classes(docs).collect() if r.id in (7, 8)} == {7}
    path = str(tmp_path / "docs")
    docs.drop("a`b").write.parquet(path)
    assert {r.keep_id for r in deduplicate_exact(spark, path).collect() if r.id in (7, 8)} == {8}


def test_stages(spark, docs, labels, items, tmp_path):
    d = str(tmp_path)
    labels.write.parquet(f"{d}/labels.parquet")
    items.write.parquet(f"{d}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert unchanged(stage(spark, docs, d), docs), name
    added = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    unchanged(corpus_pipeline.STAGES[-1][1](spark, docs, d), docs, added, added, docs.count())


def test_empty_tables_of_operators_without_a_test_of_their_own(spark, docs, items, tmp_path):
    none = docs.limit(0)
    assert scan_licenses(none).collect() == [] and decontaminate(none, items).collect() == [] and mixed_rows(none).collect() == []
    assert keep_one_per_class(none).collect() == []
