import random
import re
from fractions import Fraction

import pytest

from strataprobe.llm import decontamination
from strataprobe.llm.containment import ContainmentIndex, bands_for, least_similarity
from strataprobe.llm.decontamination import contaminations, decontaminate
from strataprobe.llm.license_scan import scan_licenses
from strataprobe.llm.license_templates import TEMPLATES
from strataprobe.llm.queries import QUERIES


def shingles(text, k, whole):
    words = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (text or "").lower())
    if whole and 0 < len(words) < k:
        return {tuple(words)}, len(words)
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}, k


def brute(docs, items, k=5, t=Fraction(4, 5)):
    out = []
    for i, text in docs:
        for j, item in items:
            own, n = shingles(item, k, True)
            if own:
                shared = len(own & shingles(text, n, False)[0])
                if shared >= t * len(own):
                    out.append((str(i), str(j), len(own), shared))
    return sorted(out)


def got(df):
    return sorted((str(r.doc_id), str(r.item_id), r.n_item_shingles, r.n_shared) for r in df.collect())


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(3000)]
    items = [(j, " ".join(r.choices(vocabulary, k=r.choice([1, 3, 5, 6, 15, 40, 60, 200])))) for j in range(60)]
    docs = []
    for i in range(150):
        words = r.choices(vocabulary, k=r.choice([0, 20, 300, 4000]))
        for _ in range(r.choice([0, 1, 2])):
            own = r.choice(items)[1].split()
            for _ in range(r.choice([0, 0, 1, 2])):
                own[r.randrange(len(own))] = r.choice(vocabulary)
            at = r.randrange(len(words) + 1)
            words[at:at] = own
        docs.append((i, r.choice([" ", ", ", "\n"]).join(words).title()))
    return docs, items


@pytest.fixture(scope="module")
def table(spark):
    return lambda items: spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(documents, table, seed):
    docs, items = corpus(seed)
    want = brute(docs, items)
    assert len(want) > 60 and got(contaminations(documents(*docs), table(items))) == want


def test_blocks_of_items(documents, table, monkeypatch):
    docs, items = corpus(3)
    assert got(contaminations(documents(*docs[:60]), table(items), block_items=13)) == brute(docs[:60], items)


def test_decontaminate(documents, table):
    docs, items = corpus(4)
    bad = {i for i, _, _, _ in brute(docs, items)}
    frame = documents(*docs, (900, None), (901, ""), (None, "clean text of some words"))
    kept = decontaminate(frame, table(items))
    assert kept.columns == frame.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted([str(i) for i, _ in docs if str(i) not in bad] + ["900", "901", "None"])


def test_odd_rows(documents, table):
    items = [(1, None), (2, ""), (3, "..."), (4, "hello"), (None, "the same words again and again here"), (5, "the same words again and again here")]
    docs = [(1, "Say HELLO!"), (2, None), (3, ""), (4, "x " * 100_000 + "the same words again and again here"), (4, "hello hello")]
    assert got(contaminations(documents(*docs), table(items))) == brute(docs, items)
    assert contaminations(documents(), table(items)).collect() == [] and contaminations(documents(*docs), table([])).collect() == []


def test_band_setting():
    t = Fraction(4, 5)
    assert (1 - least_similarity(t)) ** bands_for(t, 1e-6) <= 1e-6
    assert bands_for(t, 1e-6) < bands_for(t, 1e-9)


def test_licenses(documents):
    docs = [(i, f"some words before it. {text} and words after it") for i, text in enumerate(TEMPLATES.values())]
    docs += [(100, "no licence in here at all, only common words"), (101, None), (102, "\n".join(TEMPLATES.values())), (103, "RELEASED under the mit license")]
    want = brute(docs, list(TEMPLATES.items()))
    rows = scan_licenses(documents(*docs)).collect()
    assert sorted((str(r.doc_id), f"{r.license}/{r.wording}", r.n_template_shingles, r.n_shared) for r in rows) == want
    assert {r.license for r in rows if r.doc_id == 103} == {"MIT"} and all(r.containment >= 0.8 for r in rows)


def test_queries_over_tables(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert got(QUERIES["op6_decontamination"](spark, sf_dir)) == brute(docs, items)
    found = QUERIES["op1_license_scan"](spark, sf_dir).collect()
    assert sorted((str(r.doc_id), f"{r.license}/{r.wording}") for r in found) == [(a, b) for a, b, _, _ in brute(docs, list(TEMPLATES.items()))]


def test_index_of_nothing():
    assert ContainmentIndex([], []).matches(["a b c", None]) == [[], []]
    assert decontamination.BLOCK_ITEMS > 0
