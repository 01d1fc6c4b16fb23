import pytest
from pyspark.sql import functions as F

from strataprobe.llm.mixing import mix_sources, mixed_rows, source_targets


def water_fill(sizes, weights=(1, 2, 3), cap=3):
    """By the rule's words: share by weight, cut, reshare the excess, again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, open_ = sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    while open_:
        rest = total - sum(target[s] for s in names if s not in open_)
        level = rest / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] >= cap * sizes[s]}
        for s in open_:
            target[s] = cap * sizes[s] if s in over else level * w[s]
        if not over:
            break
        open_ -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1000, "b": 10, "c": 1}, {"z": 5, None: 50, "é": 500, "a": 0}, {"a": 0}])
def test_targets(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in source_targets(frame).collect()}
    assert got == pytest.approx(water_fill(sizes))


def check(df, n):
    rows = df.collect()
    assert len(rows) == n
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        assert all(r.source_size == sum(x.size for x in own) for r in own)
        assert abs(sum(r.taken for r in own) - own[0].target) <= max([r.size for r in own] or [0])
    assert all(r.taken <= 3 * r.size and r.taken == r.copies * r.size for r in rows)
    return rows


def test_taken_words_come_near_targets_and_reruns_agree(documents):
    docs = documents(*[(i, "w " * (1 + i * 37 % 90), "en", f"s{i % 5}" if i % 3 else "s0") for i in range(600)])
    first = check(mix_sources(docs), 600)
    again = check(mix_sources(docs.repartition(7)), 600)
    assert {r.doc_id: r.taken for r in first} == {r.doc_id: r.taken for r in again}
    assert len({r.copies for r in first}) > 1


def test_brute_force_order(documents):
    """The documents that a source takes are those of the least rank by length odds, but for the one that closes the gap."""
    import hashlib

    docs = documents(*[(i, "w " * (5 + i % 11), "en", "only" if i % 2 else "other") for i in range(200)])
    rows = check(mix_sources(docs), 200)

    def rank(r):
        inner = hashlib.md5(r.text.encode()).hexdigest()
        u = (int(hashlib.md5(f"{r.doc_id}/{inner}/mix".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        return u / (1 - u) / (len(r.text) / (len(r.text) + 512))

    for source in ("only", "other"):
        own = sorted((r for r in rows if r.source == source), key=rank)
        whole = min(r.copies for r in own)
        extra = [r.copies > whole for r in own]
        changes = sum(a != b for a, b in zip(extra, extra[1:], strict=False))
        assert changes <= 3


def test_odd_rows(documents):
    rows = [(None, None, None, None), (1, "", "en", None), (2, "a b c", None, None), (3, "x " * 50_000, "en", "long"), (4, "q", "en", "tiny"), (4, "q", "en", "tiny")]
    check(mix_sources(documents(*rows)), 6)
    assert mix_sources(documents()).collect() == []
    assert {r.taken for r in mix_sources(documents((1, None), (2, ""))).collect()} == {0}


def test_clashing_columns_and_appeal(documents):
    docs = documents(*[(i, "w w w", "en", "ab"[i % 2]) for i in range(400)]).withColumn("target", F.lit("old")).withColumn("appeal", F.when(F.col("doc_id") % 4 < 2, 8.0).otherwise(1.0))
    rows = check(mix_sources(docs, appeal_col="appeal"), 400)
    share = lambda p: [r.copies for r in rows if r.source == "a" and (r.doc_id % 4 < 2) is p]
    assert sum(share(True)) > sum(share(False))


def shares_of(rows, key):
    """Copies a document by key, beyond the whole ones."""
    least = min(r.copies for r in rows)
    out = {}
    for r in rows:
        n, k = out.get(key(r), (0, 0))
        out[key(r)] = n + 1, k + r.copies - least
    return {k: v / n for k, (n, v) in out.items()}


def test_longer_texts_are_drawn_more_often(documents):
    """Inclusion probabilities rise with length as the odds say, under one factor that meets the target."""
    docs = documents(*[(i, "word " * (10 if i % 2 else 200), "en", "ab"[i % 4 // 2]) for i in range(4000)])
    rows = [r for r in check(mix_sources(docs), 4000) if r.source == "a"]
    found = shares_of(rows, lambda r: r.size)
    odds = {n: found[n] / (1 - found[n]) for n in found}
    want = (1000 / 1512) / (50 / 562)
    assert 0.7 * want < odds[200] / odds[10] < 1.4 * want


@pytest.mark.parametrize("ident", [5, None])
def test_equal_rows_are_taken_one_by_one(documents, ident):
    """300 equal rows of 10 words, target 2000 words: 200 of them, within one document."""
    docs = documents(*[(ident, "w " * 10, "en", "a") for _ in range(300)], *[(1000 + i, "w " * 10, "en", "b") for i in range(300)]).repartition(6)
    rows = mix_sources(docs).collect()
    for source in "ab":
        own = [r for r in rows if r.source == source]
        assert len(own) == 300 and abs(sum(r.taken for r in own) - own[0].target) <= 10
    kept = mixed_rows(docs).collect()
    assert sum(r.source == "a" for r in kept) == sum(r.copies for r in rows if r.source == "a")


def test_equal_rows_among_others(documents):
    docs = documents(*[(i, "w " * (3 + i % 17), "en", "s") for i in range(200)], *[(7000, "hot " * 9, "en", "s") for _ in range(150)], *[(8000 + i, "x " * 11, "en", "t") for i in range(400)]).repartition(5)
    check(mix_sources(docs), 750)


def test_extreme_odds(documents):
    """Odds near the ends of a double, zero, negative, not a number and null: no division fails, targets are met."""
    values = [1e9, 1e300, float("inf"), 0.0, -3.0, float("nan"), None, 1e-300, 1.0, 2.0]
    docs = documents(*[(i, "w " * (1 + i % 7), "en", "ab"[i % 2]) for i in range(800)])
    appeal = F.element_at(F.array(*[F.lit(v).cast("double") for v in values]), (F.col("doc_id") % len(values) + 1).cast("int"))
    check(mix_sources(docs.withColumn("appeal", appeal), appeal_col="appeal"), 800)
