"""Quality classifier from weak labels.

Heuristic labellers vote on every document: good, bad, or nothing.  Votes are
counted by pattern over all documents (at most 3^labellers rows), and
expectation-maximisation on those counts estimates how often each labeller is
right about good and about bad documents, and with that every pattern's
posterior of being good.  The posteriors of a bounded sample of documents then
train a linear scorer over hashed words and shape features, which scores whole
texts and can disagree with the labellers.

No human label is used.  The sample has about ``train_docs`` documents and
``train_bytes`` bytes of text at most, chosen by the hash of id and text (rows
equal in both once, none longer than ``longest`` bytes); counts of votes cover
all documents.

Defined results: null and empty texts get the bad votes of an empty text, and a
score as any other; repeated rows vote once each; an empty table gives an empty
table; without two different posteriors the scorer is the mean posterior;
columns of the input named votes, posterior, score or keep are replaced, all
others are kept whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import col
from . import textcore as T
from .batches import bound_batches, fetched
from .rows import bounded_sample, packed, unpacked

#: What the scorer is trained on at most: documents, bytes of text, bytes of one text.
TRAIN_DOCS, TRAIN_BYTES, LONGEST = 10_000, 32 << 20, 1 << 20
BINS = 1 << 16
GOOD, BAD, NONE = 1, 0, 2


def _class_table(test) -> np.ndarray:
    return np.array([test(chr(i)) if i < 128 else False for i in range(256)])


_SYMBOL = _class_table(lambda c: c in "#$%&*@^~|<>{}[]\\_=+")
_DIGIT = _class_table(str.isdigit)
_UPPER = _class_table(str.isupper)
_STOP = _class_table(lambda c: c in ".!?")
_LETTER = np.array([i >= 128 or chr(i).isalpha() for i in range(256)])

#: Column of ``shape_features`` by name.
FEATURES = ("words", "word_length", "letters", "symbols", "digits", "uppers", "stops", "distinct", "line_repeats", "top_word", "echoes", "marks")


def _per_text(buffer: np.ndarray, table: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(table[buffer], dtype=np.int64)))
    ends = np.cumsum(sizes)
    return (total[ends] - total[ends - sizes]).astype(np.float64)


def shape_features(raw: list[bytes], words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """By text, the numbers that labellers look at."""
    sizes = np.array([len(t) for t in raw], dtype=np.int64)
    buffer = np.frombuffer(b"".join(raw), dtype=np.uint8)
    share = lambda table: _per_text(buffer, table, sizes) / np.maximum(sizes, 1)
    ends = np.cumsum(counts)
    distinct, top, lines = np.zeros(len(raw)), np.zeros(len(raw)), np.zeros(len(raw))
    for i, (t, c, e) in enumerate(zip(raw, counts.tolist(), ends.tolist(), strict=True)):
        if c:
            n = np.unique(words[e - c : e], return_counts=True)[1]
            distinct[i], top[i] = len(n) / c, (n.max() - 1) / c
        own = [x for x in t.split(b"\n") if x.strip()]
        lines[i] = 1 - len(set(own)) / len(own) if own else 0.0
    blanks = _per_text(buffer, T.WHITE, sizes)
    same = np.zeros(len(words))
    same[1:] = words[1:] == words[:-1]
    if len(words):
        same[(ends - counts)[counts > 0]] = 0  # a text's first word has none before it
    return np.column_stack((counts, (sizes - blanks) / np.maximum(counts, 1), share(_LETTER), share(_SYMBOL), share(_DIGIT), share(_UPPER), _per_text(buffer, _STOP, sizes) / np.maximum(counts, 1), distinct, lines, top, T.sums_by_text(same, counts) / np.maximum(counts, 1), _per_text(buffer, _SYMBOL, sizes) / np.maximum(counts, 1)))


#: Labellers: feature, whether high or low values are bad, bad beyond, good within (else no vote).
LABELLERS: tuple[tuple[str, str, float, float], ...] = (
    ("words", "low", 1, 20),
    ("word_length", "high", 12, 9),
    ("word_length", "low", 2.5, 3.5),
    ("letters", "low", 0.55, 0.7),
    ("symbols", "high", 0.06, 0.01),
    ("marks", "high", 0.3, 0.05),
    ("digits", "high", 0.25, 0.06),
    ("uppers", "high", 0.3, 0.08),
    ("stops", "low", 0.005, 0.03),
    ("distinct", "low", 0.2, 0.35),
    ("line_repeats", "high", 0.3, 0.1),
    ("top_word", "high", 0.2, 0.12),
    ("echoes", "high", 0.1, 0.03),
)


def votes(features: np.ndarray) -> np.ndarray:
    """By text and labeller: GOOD, BAD or NONE."""
    out = np.full((len(features), len(LABELLERS)), NONE, dtype=np.int8)
    for j, (name, side, bad, good) in enumerate(LABELLERS):
        x = features[:, FEATURES.index(name)]
        sign = 1 if side == "high" else -1
        out[sign * x <= sign * good, j] = GOOD
        out[sign * x > sign * bad, j] = BAD
    return out


class LabelModel:
    """Accuracies of labellers and the share of good documents, by expectation-maximisation."""

    def __init__(self, patterns: np.ndarray, weights: np.ndarray, rounds: int = 200, prior: float = 1.0):
        good, bad = (patterns == GOOD), (patterns == BAD)
        p = (good.sum(axis=1) + 1.0) / (good.sum(axis=1) + 2.0 * bad.sum(axis=1) + 1.5)
        self.share, self.right_good, self.right_bad = 0.8, None, None
        for _ in range(rounds):
            wg, wb = weights * p, weights * (1 - p)
            self.right_good = (good.T @ wg + 4 * prior) / ((good | bad).T @ wg + 5 * prior)
            self.right_bad = (bad.T @ wb + 4 * prior) / ((good | bad).T @ wb + 5 * prior)
            self.share = (wg.sum() + prior) / (weights.sum() + 2 * prior)
            new = self.posterior(patterns)
            if np.abs(new - p).max(initial=0.0) < 1e-9:
                break
            p = new

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of being good, by pattern of votes."""
        good, bad = (patterns == GOOD).astype(float), (patterns == BAD).astype(float)
        log_good = good @ np.log(self.right_good) + bad @ np.log(1 - self.right_good) + np.log(self.share)
        log_bad = bad @ np.log(self.right_bad) + good @ np.log(1 - self.right_bad) + np.log(1 - self.share)
        return 1 / (1 + np.exp(np.clip(log_bad - log_good, -40, 40)))


class _Read:
    """A batch of texts as word bins and scaled shape features."""

    def __init__(self, texts):
        raw = T.as_bytes(texts, "")
        words, self.counts = T.word_hashes([t.lower() for t in raw])
        self.features = shape_features(raw, words, self.counts)
        self.bins = (words >> T.U64(48)).astype(np.uint16)

    def scaled(self) -> np.ndarray:
        x = self.features.copy()
        x[:, 0] = np.log1p(x[:, 0])
        x[:, 1] = np.minimum(x[:, 1], 50) / 5
        x[:, 6] = np.minimum(x[:, 6], 1)
        return np.column_stack((np.ones(len(x)), x, x**2))


def _reads(texts) -> Iterator[_Read]:
    for part in T.portions(texts):
        yield _Read(texts[part])


class Scorer:
    """A linear model: the mean weight of a text's hashed words, and weights of its shape."""

    def __init__(self, word: np.ndarray, shape: np.ndarray):
        self.word, self.shape = word, shape

    def margin(self, bins: np.ndarray, counts: np.ndarray, scaled: np.ndarray) -> np.ndarray:
        return T.sums_by_text(self.word[bins].astype(np.float64), counts) / np.maximum(counts, 1) + scaled @ self.shape

    def score(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Scores, and patterns of votes."""
        scores, patterns = [np.empty(0)], [np.empty((0, len(LABELLERS)), dtype=np.int8)]
        for read in _reads(texts):
            scores.append(1 / (1 + np.exp(-np.clip(self.margin(read.bins, read.counts, read.scaled()), -40, 40))))
            patterns.append(votes(read.features))
        return np.concatenate(scores), np.concatenate(patterns)

    @classmethod
    def train(cls, bins: list[np.ndarray], scaled: np.ndarray, target: np.ndarray, rounds: int = 12, batch: int = 256, rate: float = 0.3) -> Scorer:
        """Logistic regression on soft labels by adaptive gradient steps, in a fixed order."""
        scale = np.maximum(np.abs(scaled).max(axis=0, initial=1e-9), 1e-9)
        model = cls(np.zeros(BINS), np.zeros(scaled.shape[1]))
        seen_word, seen_shape = np.full(BINS, 1e-6), np.full(scaled.shape[1], 1e-6)
        order, sizes = np.random.default_rng(7).permutation(len(bins)), np.array([len(b) for b in bins], dtype=np.int64)
        for _ in range(rounds):
            for low in range(0, len(order), batch):
                rows = order[low : low + batch]
                own, counts, x = np.concatenate([bins[i] for i in rows]), sizes[rows], scaled[rows] / scale
                error = 1 / (1 + np.exp(-np.clip(model.margin(own, counts, x), -40, 40))) - target[rows]
                step = np.bincount(own, weights=np.repeat(error / np.maximum(counts, 1), counts), minlength=BINS) / len(rows) + 1e-7 * model.word
                seen_word += step**2
                model.word -= rate * step / np.sqrt(seen_word)
                step = x.T @ error / len(rows)
                seen_shape += step**2
                model.shape -= rate * step / np.sqrt(seen_shape)
        model.shape = model.shape / scale
        return model


def _vote_text(patterns: np.ndarray) -> list[str]:
    return ["".join("01-"[v] for v in row) for row in patterns]


def _vote_array(texts) -> np.ndarray:
    return np.array([["01-".index(c) for c in t] for t in texts], dtype=np.int8).reshape(-1, len(LABELLERS))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES, longest: int = LONGEST) -> tuple[LabelModel, Scorer]:
    """The label model from the votes on all documents, and the scorer from a bounded sample."""
    bound_batches(docs.sparkSession)

    def pattern_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counted: dict[str, int] = {}
        for batch in batches:
            for read in _reads(batch["text"]):
                for v in _vote_text(votes(read.features)):
                    counted[v] = counted.get(v, 0) + 1
        yield pd.DataFrame({"votes": list(counted), "n": list(counted.values())}).astype({"votes": object, "n": "int64"})

    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for read in _reads(batch["text"]):
                ends = np.cumsum(read.counts)
                bins = [read.bins[e - c : e].tobytes() for c, e in zip(read.counts.tolist(), ends.tolist(), strict=True)]
                yield pd.DataFrame({"bins": bins, "scaled": [x.tobytes() for x in read.scaled()], "votes": _vote_text(votes(read.features))})

    texts = docs.select(col(text_col).alias("text"))
    counted = fetched(texts.mapInPandas(pattern_counts, "votes string, n bigint").groupBy("votes").agg(F.sum("n").alias("n"))).sort_values("votes")
    labels = LabelModel(_vote_array(counted["votes"]), counted["n"].to_numpy(dtype=np.float64))
    chosen = bounded_sample(docs, id_col, text_col, train_docs, train_bytes, longest, seed="quality")
    rows = fetched(chosen.mapInPandas(sample, "bins binary, scaled binary, votes string")).sort_values(["scaled", "bins"])
    bins = [np.frombuffer(b, dtype=np.uint16) for b in rows["bins"]]
    scaled = np.array([np.frombuffer(x, dtype=np.float64) for x in rows["scaled"]]).reshape(len(rows), 1 + 2 * len(FEATURES))
    target = labels.posterior(_vote_array(rows["votes"]))
    if len(target) and np.ptp(target) > 1e-9:
        return labels, Scorer.train(bins, scaled, target)
    mean = float(target.mean()) if len(target) else 0.5
    shape = np.zeros(1 + 2 * len(FEATURES))
    shape[0] = np.log(max(mean, 1e-9) / max(1 - mean, 1e-9))
    return labels, Scorer(np.zeros(BINS), shape)


def classify_quality(docs: DataFrame, labels: LabelModel, scorer: Scorer, text_col: str = "text") -> DataFrame:
    """docs with votes (one of 1, 0 and - a labeller), posterior, score and keep (score at least 0.5)."""
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast((labels, scorer))

    @F.pandas_udf("votes string, posterior double, score double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        label_model, model = shared.value
        for batch in batches:
            score, patterns = model.score(batch)
            yield pd.DataFrame({"votes": _vote_text(patterns), "posterior": label_model.posterior(patterns), "score": score})

    out = docs.select(packed(docs).alias("row"), judge.asNondeterministic()(col(text_col)).alias("judged"))
    return out.select(*unpacked(docs, but=("votes", "posterior", "score", "keep")), "judged.*", (F.col("judged.score") >= 0.5).alias("keep"))
