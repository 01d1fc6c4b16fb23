import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from strataprobe.llm import jaccard_join
from strataprobe.llm.jaccard_join import jaccard_classes, keep_one_per_class

WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"


def shingles(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)])


def brute(rows, k, t):
    """Component and links of every row by comparing all pairs."""
    sets = [shingles(x, k) for _, x in rows]
    n = len(rows)
    root, links = list(range(n)), [0] * n

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and both * t.denominator >= len(sets[i] | sets[j]) * t.numerator:
                links[i] += 1
                links[j] += 1
                root[top(i)] = top(j)
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[top(i)] = min(least.get(top(i), rows[i][0]), rows[i][0])
    return sorted((str(rows[i][0]), len(sets[i]), str(least.get(top(i))), links[i]) for i in range(n))


def got(df):
    return sorted((str(r.id), r.n_shingles, str(r.component_id), r.n_links) for r in df.collect())


def corpus(seed, n=150):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = r.choices(vocabulary, k=25)
    texts = []
    for _ in range(n):
        if texts and r.random() < 0.6:
            words = r.choice(texts).split()
            for _ in range(r.choice([0, 1, 1, 2, 4])):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            texts.append(" ".join(words))
        else:
            words = r.choices(vocabulary, k=r.choice([1, 2, 3, 9, 10, 40, 120]))
            texts.append(" ".join(words + passage if r.random() < 0.5 else words))
    ids = r.sample(range(1000), n)
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize(("seed", "k", "t"), [(1, 3, "9/10"), (2, 5, "4/5"), (3, 1, "1/2"), (4, 3, "1")])
def test_brute_force(documents, seed, k, t):
    rows = corpus(seed)
    assert got(jaccard_classes(documents(*rows), k, t)) == brute(rows, k, Fraction(t))


def test_small_chunks_lose_nothing(documents, monkeypatch):
    monkeypatch.setattr(jaccard_join, "MEMBERS", 2)
    monkeypatch.setattr(jaccard_join, "COMMON", 4)
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", -1)
    rows = corpus(9)
    assert got(jaccard_classes(documents(*rows), 3, "3/4")) == brute(rows, 3, Fraction(3, 4))


@pytest.mark.parametrize("hot", [2, 30])
def test_frequent_tokens_are_spread_and_lose_nothing(documents, monkeypatch, hot):
    monkeypatch.setattr(jaccard_join, "HOT", hot)
    monkeypatch.setattr(jaccard_join, "MEET", 2)
    monkeypatch.setattr(jaccard_join, "MEMBERS", 2)
    r = random.Random(hot)
    rows = corpus(10, 80) + [(2000 + i, " ".join(["same"] * 3 + [f"v{r.randrange(9)}" for _ in range(4)])) for i in range(60)]
    assert got(jaccard_classes(documents(*rows), 3, "3/4")) == brute(rows, 3, Fraction(3, 4))


def test_odd_rows(documents):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [(5, None), (6, ""), (7, " \t\n"), (8, "one"), (9, "ONE"), (10, "one two"), (None, "one two"), (None, None), (None, "alone here now"), (11, long), (12, long + " end"), (13, "É a b"), (14, "é a b"), (8, "one"), (20, "a b c d"), (21, "a b c d")]
    assert got(jaccard_classes(documents(*rows), 3, "9/10")) == brute(rows, 3, Fraction(9, 10))


def test_empty_table(documents):
    assert jaccard_classes(documents(), 3, "9/10").collect() == []
    with pytest.raises(ValueError):
        jaccard_classes(documents(), 3, "3/2")


def test_one_of_each_class_stays(documents):
    from pyspark.sql import functions as F

    rows = [*corpus(5, 80), (None, "q r s t u v"), (2000, "q r s t u v"), (2000, "q r s t u v"), (3000, ""), (3001, None), (None, "lone pair of words"), (None, "lone pair of words")]
    kept = keep_one_per_class(documents(*rows).withColumn("id", F.lit("clash"))).collect()
    ids = [r.doc_id for r in kept]
    classes = Counter((c, n > 0) for _, n, c, _ in brute([r for r in rows if r[0] is not None], 5, Fraction(4, 5)))
    assert sorted(i for i in ids if i is not None) == sorted({int(c) for c, some in classes if some} | {3000, 3001})
    assert ids.count(None) == 1 and kept[0].id == "clash"


def test_hash_of_words_depends_on_each_byte_and_place():
    from strataprobe.llm import textcore as T

    words = [b"ab", b"ba", b"a", b"b", b"aa", b"aaa", b"\xc3\xa9", b"x" * 5000, b"x" * 5001, b"x" * 4999 + b"y"]
    hashes, counts = T.word_hashes([b" ".join(words), b"", b"ab"])
    assert len(set(hashes[:-1].tolist())) == len(words) and hashes[-1] == hashes[0] and counts.tolist() == [10, 0, 1]
    assert np.array_equal(T.word_hashes([b"ab"])[0], hashes[:1])


@pytest.mark.parametrize("most", [10**6, 0])
@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, monkeypatch, most, seed):
    """In one task and by distributed rounds: chains, stars, loops and random edges."""
    from strataprobe.llm import components
    from strataprobe.llm.scratch import Scratch

    monkeypatch.setattr(components, "ONE_TASK", most)
    r = random.Random(seed)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(300, 300), (9, 8)] + [(r.randrange(400, 500), r.randrange(400, 500)) for _ in range(60)]
    root = {x: x for e in edges for x in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    found = {x.node: x.label for x in components.connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert {x: found[x] for x in linked} == {x: top(x) for x in linked}
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).count() == 0


def test_long_chain_by_distributed_rounds(spark, monkeypatch):
    """A chain of thousands of nodes of random ids settles in few rounds."""
    from strataprobe.llm import components
    from strataprobe.llm.scratch import Scratch

    class Counted(Scratch):
        def keep(self, df, name="table"):
            kept.append(name)
            return super().keep(df, name)

    kept = []
    monkeypatch.setattr(components, "ONE_TASK", 0)
    ids = random.Random(4).sample(range(10**12), 3000)
    edges = spark.createDataFrame(list(zip(ids, ids[1:], strict=False)), "a long, b long")
    found = components.connected_components(edges, Counted(spark)).collect()
    assert {r.node for r in found} == set(ids) and {r.label for r in found} == {min(ids)}
    assert kept.count("jumped") <= 20
