import math
import zlib
from collections import Counter

import pytest
import xxhash

from strataprobe.llm.sharding import shard_documents

EIGHT = [(i, 1.0) for i in range(8)]


def winner(key, shards):
    def score(shard):
        n, weight = shard
        h = xxhash.xxh64_intdigest(key.encode(), seed=42)
        h = xxhash.xxh64_intdigest(f"shard/{n}".encode(), seed=h)
        return (-math.log(((h >> 12) + 0.5) / 2**52) / weight, n)

    return min(map(score, shards))[1]


def checked(df, rows):
    out = df.collect()
    assert len(out) == rows
    for shard in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == shard) == list(range(sum(r.shard == shard for r in out)))
    return out


def test_brute_force_and_growth(documents):
    docs = documents(*[(i, f"text {i % 7} é") for i in range(500)])
    for r in checked(shard_documents(docs, EIGHT, grown=(8, 1.0)), 500):
        assert r.shard == winner(str(r.doc_id), EIGHT)
        assert r.grown_shard == winner(str(r.doc_id), [*EIGHT, (8, 1.0)]) and r.grown_shard in (r.shard, 8)
        assert r.size == len(r.text.encode()) + 1 and r.text_crc32 == zlib.crc32(r.text.encode()) and r.law == "key"


def test_weights(documents):
    docs = documents(*[(i, "x") for i in range(4000)])
    n = Counter(r.shard for r in shard_documents(docs, [(0, 1.0), (1, 3.0)]).collect())
    assert 0.7 < n[1] / 4000 < 0.8
    with pytest.raises(ValueError):
        shard_documents(docs, [(0, 0.0)])


def test_odd_rows(documents, spark):
    rows = [(None, None), (None, "a"), (None, "a"), (1, ""), (1, ""), (-5, "y" * 300_000)]
    out = checked(shard_documents(documents(*rows), EIGHT), 6)
    assert next(r.size for r in out if r.text is None) == 1
    assert len({r.shard for r in out if r.text == "a"}) == 1
    assert checked(shard_documents(documents(), EIGHT), 0) == []


def test_hot_key_and_clashing_columns(documents):
    from pyspark.sql import functions as F

    docs = documents(*[(7 if i % 3 == 0 else i, f"t{i}") for i in range(300)]).withColumn("shard", F.lit("old")).withColumn("slot", F.lit(-1)).repartition(5)
    out = checked(shard_documents(docs, EIGHT, keep_columns=True), 300)
    assert len({r.shard for r in out if r.doc_id == 7}) == 1
    assert len(shard_documents(docs, EIGHT, keep_columns=False).columns) == 7
