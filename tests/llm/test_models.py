"""Operators with trained models: held-out accuracy, and defined results for odd rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataprobe.llm import language_id, quality, toxicity
from strataprobe.llm import textcore as T
from strataprobe.llm.queries import QUERIES

ALPHABETS = {"aa": ["ba", "do", "ki", "lu"], "bb": ["sch", "ei", "ung", "er"], "cc": ["ão", "çe", "nho", "ve"]}
VILE = ["scum", "grotter", "vermling"]


def words(r, lang, n):
    return ["".join(r.choices(ALPHABETS[lang], k=r.choice([1, 2, 2, 3]))) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(3)
    rows = []
    for i in range(1200):
        lang = r.choice(list(ALPHABETS))
        text = words(r, lang, r.choice([12, 40, 150]))
        toxic = r.random() < 0.2
        for _ in range(max(1, len(text) // 25) if toxic else 0):
            text[r.randrange(len(text))] = r.choice(VILE)
        rows.append((i, " ".join(text).capitalize() + ".", lang, "s", int(toxic)))
    return rows


ODD = [(None, "ba do ki", "aa"), (9001, None, "aa"), (9002, "", None), (9003, "123 !!", "bb"), (9004, "dokilu " * 60_000, None), (9005, "dokilu", "aa"), (9005, "dokilu", "aa")]


def crc(i, parts):
    return zlib.crc32(str(i).encode()) % parts


def test_language(documents, corpus):
    docs = documents(*[(i, t, lang) for i, t, lang, *_ in corpus], *ODD).withColumn("score", F.lit("old"))
    out = language_id.held_out("doc_id", 4, 2)
    rows = language_id.identify(docs.withColumn("held_out", out), language_id.fit(docs.where(~out))).collect()
    assert len(rows) == len(corpus) + len(ODD)
    held = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 9000]
    assert len(held) > 200 and all(crc(r.doc_id, 4) == 2 for r in held)
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.99
    assert all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in rows if r.doc_id in (9001, 9002, 9003)} == {"und"} and {r.lang_pred for r in rows if r.doc_id in (9004, 9005)} == {"aa"}


def test_unseen_words_back_off_to_characters(documents):
    docs = documents((1, "abab baba", "xx"), (2, "zqzq qzqz", "yy"))
    model = language_id.fit(docs)
    assert model.predict(["bababab", "qzqzqzq", "ab zq zq"])[0].tolist() == ["xx", "yy", "yy"]


def test_language_without_training(documents):
    docs = documents((1, "a b", None))
    row = language_id.identify(docs, language_id.fit(docs)).first()
    assert (row.lang_pred, row.score) == ("und", 0.0)
    assert language_id.identify(documents(), language_id.fit(documents((1, "ab", "x")))).collect() == []


def test_language_sample_is_bounded(documents, corpus):
    docs = documents(*[(i, t, lang) for i, t, lang, *_ in corpus])
    model, whole = language_id.fit(docs, train_docs=150), language_id.fit(docs)
    assert sum(t.values.sum() for t in model.tables) != sum(t.values.sum() for t in whole.tables)
    assert np.mean([a == b for a, b in zip(model.predict([r[1] for r in corpus])[0], [r[2] for r in corpus], strict=True)]) > 0.95


@pytest.fixture(scope="module")
def scored(spark, documents, corpus):
    docs = documents(*[(i, t, lang) for i, t, lang, *_ in corpus], *ODD)
    labels = spark.createDataFrame([(i, None, y) for i, _, _, _, y in corpus] + [(None, 1, 1), (5000, 1, 1), (0, 1, corpus[0][4]), (9001, 0, 0), (9002, 0, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out("doc_id", 5, 0)))
    return toxicity.score_toxicity(docs.withColumn("held_out", toxicity.held_out("doc_id", 5, 0)).withColumn("predicted", F.lit("x")), model).collect(), corpus


def test_toxicity(scored):
    rows, corpus = scored
    labels = {i: y for i, _, _, _, y in corpus}
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert len(rows) == len(corpus) + len(ODD) and len(held) > 150
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    empty = {r.score for r in rows if not r.text or r.text == "123 !!"}
    assert len(empty) == 1 and empty.pop() < 0.5


def test_toxicity_without_training(spark, documents):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = toxicity.score_toxicity(documents((1, "a b"), (2, None)), toxicity.fit(documents((1, "a b")), labels)).collect()
    assert all(r.predicted == 0 for r in rows)
    assert toxicity.score_toxicity(documents(), toxicity.Model.of(__import__("pandas").DataFrame({"gram": [], "toxic": [], "ordinary": []}))).collect() == []


def test_kneser_ney_by_hand():
    """The shared lower order by the textbook's formula, for bigrams over three trigrams."""
    grams = np.array(["abc", "xbc", "abd"], dtype=object)
    d = 0.75
    unigram = lambda c: ({"c": 1, "d": 1}[c] + 0.5) / (2 + 0.5 * 3)  # noqa: E731  two distinct bigrams end in c, d
    below = {"c": unigram("c"), "d": unigram("d")}
    want = {"bc": (2 - d) / 3 + d * 2 / 3 * below["c"], "bd": (1 - d) / 3 + d * 2 / 3 * below["d"]}
    assert toxicity._shared(grams, d).tolist() == pytest.approx([want["bc"], want["bc"], want["bd"]])


def test_toxicity_table_grows(spark, documents, corpus):
    """A broadcast of few n-grams changes no score: the others are looked up."""
    docs = documents(*[(i, t, lang) for i, t, lang, *_ in corpus], *ODD)
    labels = spark.createDataFrame([(i, 1, y) for i, _, _, _, y in corpus], "doc_id long, quality int, toxic int")
    whole, cached = [toxicity.fit(docs, labels.where(~toxicity.held_out("doc_id", 5, 0)), max_grams=n) for n in (10**6, 40)]
    assert whole.tables is None and len(cached.grams) < 60 < cached.tables[0].count()
    assert cached.curve == pytest.approx(whole.curve, rel=1e-3, abs=1e-3)
    cached.curve = whole.curve
    want, got = [sorted((str(r.doc_id), str(r.text)[:50], r.predicted, round(r.score, 4)) for r in toxicity.score_toxicity(docs, m).collect()) for m in (whole, cached)]
    assert got == want and len(got) == len(corpus) + len(ODD)


def test_counts_leave_out_only_the_curves_rows(spark, documents):
    """Each text has its own word; few are held back when the curve takes few rows."""
    own = ["".join(chr(97 + i // 26**p % 26) for p in range(3)) for i in range(400)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(400)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(documents(*[(i, f"zz{w}") for i, w in enumerate(own)]), labels, calibration_rows=10)
    assert 370 < T.find(model.grams, T.string_gram_hash([f"zz{w}" for w in own]))[1].sum() < 400


def test_toxic_stems_in_long_words(spark):
    """A toxic stem at the head of a long word of ordinary letters is seen, though its difference per character is small."""
    counts = [("achlichbadokiluba", 30, 1), ("achten", 1, 30), ("badokiluba", 20, 20)]
    grams = toxicity.gram_counts(spark.createDataFrame(counts, "word string, toxic long, ordinary long")).toPandas()
    model = toxicity.Model.of(grams.sort_values("gram"))
    stem, plain = model.evidence(["badokiluba achlichbadokiluba", "badokiluba achten"])
    assert 0 < stem[0] < 1 and stem[1] > 2 and plain[1] < 1
    assert stem[2:8].max() == 0.5 and plain[2:].max() == 0


def test_word_and_gram_counts(spark):
    rows = spark.createDataFrame([("Ab ab! c", 1), ("ab", 0)], "text string, toxic int")
    counted = {r.word: (r.toxic, r.ordinary) for r in toxicity.word_counts(rows).collect()}
    assert counted == {"ab": (2, 1), "c": (1, 0)}
    grams = {r.gram: (r.toxic, r.ordinary) for r in toxicity.gram_counts(toxicity.word_counts(rows), 2).collect()}
    assert grams == {"\x02a": (2, 1), "ab": (2, 1), "b\x03": (2, 1), "\x02c": (1, 0), "c\x03": (1, 0)}


def test_words_of_a_batch():
    batch = T.Words(["Öl öl x1y", None, "", "a" * 9000 + " b"])
    assert batch.counts.tolist() == [4, 0, 0, 2] and batch.hashes[0] == batch.hashes[1]
    codes, begin, size = batch.padded(np.array([0, 3]), 2)
    assert "".join(map(chr, codes)) == "\x02\x02öl\x03\x02\x02y\x03" and begin.tolist() == [0, 5] and size.tolist() == [5, 4]
    assert T.gram_hashes(codes, 2)[0] == T.string_gram_hash(["\x02\x02"])[0] and T.gram_hashes(codes, 3)[1] == T.string_gram_hash(["\x02öl"])[0]


@pytest.fixture(scope="module")
def judged(documents):
    r = random.Random(5)
    good = [(i, "\n".join(" ".join(words(r, "aa", 9)).capitalize() + "." for _ in range(8))) for i in range(300)]
    bad = [(1000 + i, " ".join(w + r.choice(["###", "$$$", "%%%", "&&&"]) for w in words(r, "aa", 60))) for i in range(40)]
    bad += [(2000 + i, "\n".join(["buy " * 6] * 30)) for i in range(30)]
    docs = documents(*good, *bad, *ODD).withColumn("keep", F.lit("old"))
    return quality.classify_quality(docs, *quality.fit(docs)).collect(), len(good) + len(bad)


def test_quality(judged):
    rows, n = judged
    assert len(rows) == n + len(ODD)
    real = [r for r in rows if r.doc_id is not None and r.doc_id < 9000]
    assert np.mean([r.keep == (r.doc_id < 1000) for r in real]) > 0.97
    assert all(r.keep for r in real if r.doc_id < 1000)
    assert all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 and len(r.votes) == len(quality.LABELLERS) for r in rows)


def test_label_model_finds_the_accuracies():
    """Votes drawn with known accuracies; the estimates come close."""
    r = np.random.default_rng(1)
    truth = r.random(20_000) < 0.7
    accuracy = np.array([0.95, 0.8, 0.7, 0.9])
    right = r.random((len(truth), 4)) < accuracy
    votes = np.where(right, truth[:, None], ~truth[:, None]).astype(np.int8)
    votes[r.random(votes.shape) < 0.2] = quality.NONE
    patterns, weights = np.unique(votes, axis=0, return_counts=True)
    model = quality.LabelModel(patterns, weights.astype(float))
    assert np.abs(model.right_good - accuracy).max() < 0.03 and np.abs(model.right_bad - accuracy).max() < 0.03 and abs(model.share - 0.7) < 0.03
    assert np.mean((model.posterior(votes) > 0.5) == truth) > 0.93


def test_quality_of_an_empty_table(documents):
    assert quality.classify_quality(documents(), *quality.fit(documents())).collect() == []


def test_quality_query_agrees_with_labels(spark, sf_dir):
    """Labels are no input; clean documents are kept."""
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")  # enough junk for its patterns to be seen
    rows = {r.doc_id: r for r in QUERIES["op5_quality"](spark, sf_dir).collect()}
    labels = [r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r.doc_id in rows]
    assert np.mean([rows[r.doc_id].keep for r in labels if r.quality == 1]) > 0.97
    assert np.mean([rows[r.doc_id].keep == (r.quality == 1) for r in labels]) > 0.9


def test_language_query(spark, sf_dir):
    rows = QUERIES["op10_language_id"](spark, sf_dir).collect()
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert np.mean([langs[r.doc_id] == r.lang_pred for r in rows if r.held_out]) > 0.95


def test_toxicity_query(spark, sf_dir):
    rows = QUERIES["op4_toxicity"](spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r.held_out == (crc(r.doc_id, 5) == 0) for r in rows)
