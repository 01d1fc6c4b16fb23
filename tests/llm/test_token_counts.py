import random

import pytest

from strataprobe.llm import token_counts
from strataprobe.llm.queries import QUERIES
from strataprobe.llm.token_counts import Counter50k, count_tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def want(library, text):
    return len(library.encode(text or "", add_special_tokens=False))


def test_any_text(library):
    r = random.Random(1)
    odd = [chr(c) for c in range(0x300)] + list(" 　一\U0001f600١\xb2Ⅳ‍้ि")
    counter = Counter50k(PATH)
    for i in range(1500):
        text = "".join(r.choice(odd if r.random() < 0.5 else list("ab 1'st!\n\t_  ")) for _ in range(r.randint(0, 40)))
        text += "<|endoftext|>" * (i % 40 == 0)
        assert counter.count(text) == want(library, text), repr(text)


def test_either_tier_alone_gives_the_same(library, monkeypatch):
    texts = [f"Some words, {i} of them's {'very ' * (i % 5)}rare{i * 7919}" for i in range(200)]
    monkeypatch.setattr(token_counts, "CACHED", 12)
    counter = Counter50k(PATH, {" of": 1, "Some": 1})
    assert [counter.count(t) for t in texts] == [want(library, t) for t in texts] and len(counter.cache) <= 12


def test_frame(documents, library):
    from pyspark.sql import functions as F

    rows = [(1, None), (2, ""), (3, "Hello world"), (None, "Hello world"), (3, "Hello world"), (4, "word " * 100_000), (5, "é" * 5000), (6, " " * 3000), (7, "<|endoftext|> x")]
    docs = documents(*rows).withColumn("n_tokens", F.lit("old")).repartition(3)
    out = count_tokens(docs, PATH, limit=512, size=2).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.n_tokens == want(library, r.text) and r.n_bytes == len((r.text or "").encode()) and r.over_limit == (r.n_tokens > 512)
    assert count_tokens(documents(), PATH).collect() == []


def test_query(spark, sf_dir, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op7_token_counts"](spark, sf_dir).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {i: want(library, t) for i, t in texts.items()}
