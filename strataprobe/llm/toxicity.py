"""Toxicity from class-conditional Kneser-Ney models of characters within words.

Two models, toxic and ordinary, share one vocabulary of character n-grams.  At
the highest order each class has its own counts; what an order lacks is filled
from the order below, whose continuation counts both classes share.  So an
expression that neither class has seen often costs both the same, and only what
a class really prefers moves the balance.

For every word the log-likelihoods of the two models are compared.  A text's
evidence is that difference per character of the whole text, the largest
difference of any one word, the shares of words whose whole difference lies
above each of several steps, so that a toxic stem counts however long its word
is, and for some steps the number of such words over the root of all words, as
one in a short text may be chance.  A logistic curve fitted on labelled rows that the counts have not seen
weighs the steps and turns the evidence into a score.  Word counts are gathered
from all labelled training rows but those the curve is fitted on (a fifth, at
most about ``calibration_rows``, by the hash of id and text), so they grow with
the input, and so does the table of n-grams: all of them enter the model.
Up to ``max_grams`` n-grams are broadcast.  Beyond that the model is a written
table; the ``max_grams`` most frequent n-grams are broadcast as a cache, and the
words that hold any other n-gram are looked up in the table by a join.  Both ways
give the same evidence.

Defined results: null and empty texts have no evidence and get the score of that
evidence; rows without a label are not learnt from; repeated labels count once a
row; without training rows of both classes every score is the share of toxic
rows (0 without any); an empty table gives an empty table; columns of the input
named score or predicted are replaced by score_toxicity, all others are kept
whatever their names; reject_toxic changes no column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import col
from . import textcore as T
from .batches import bound_batches, fetched, most_frequent
from .language_id import held_out
from .rows import packed, row_hash, spread_join, unpacked
from .scratch import Scratch

ORDER = 5
MAX_GRAMS = 400_000
DISCOUNT = 0.75
CALIBRATION_ROWS = 20_000
BROADCAST_LABELS = 1_000_000
_PAD, _END = "\x02", "\x03"
#: Differences of a word, in nats, above which words are counted: for shares of all words, and against the root of all words; the curve sets the weights.
_STEPS = np.array([1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 8.0])
_SHARES, _ROOTS = [0, 1, 2, 3, 4, 5], [3, 5, 6]
_EVIDENCE = 2 + len(_SHARES) + len(_ROOTS)


def gram_counts(words: DataFrame, order: int = ORDER) -> DataFrame:
    """words(word, toxic, ordinary) as n-grams(gram, toxic, ordinary)."""
    padded = F.concat(F.lit(_PAD * (order - 1)), F.col("word"), F.lit(_END))
    spread = words.select(padded.alias("p"), "toxic", "ordinary").select("p", "toxic", "ordinary", F.explode(F.sequence(F.lit(1), F.length("p") - (order - 1))).alias("at"))
    gram = F.col("p").substr(F.col("at"), F.lit(order))
    return spread.groupBy(gram.alias("gram")).agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def word_counts(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """rows(text, toxic) as words(word, toxic, ordinary); words are runs of letters, lower-cased."""
    words = rows.select(F.explode(F.split(F.lower(F.col(text_col)), r"[^\p{L}]+")).alias("word"), F.col("toxic").cast("long").alias("toxic")).where("word != ''")
    return words.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum(F.lit(1) - F.col("toxic")).alias("ordinary"))


def _continuations(keys: DataFrame, size: int, discount: float, scratch: Scratch) -> DataFrame:
    """``_shared`` as a plan: distinct keys(key) of so many characters with p of their last."""
    lower = scratch.keep(keys.groupBy(F.col("key").substr(2, size - 1).alias("low")).agg(F.count("*").cast("double").alias("n")), "lower")
    if size == 2:
        whole = lower.agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        found = lower.crossJoin(whole).select("low", ((F.col("n") + 0.5) / (F.col("total") + 0.5 * (F.col("kinds") + 1))).alias("p"))
    else:
        lower = lower.withColumn("context", F.col("low").substr(1, size - 2))
        totals = lower.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        below = _continuations(lower.select(F.col("low").alias("key")), size - 1, discount, scratch).withColumnRenamed("key", "low")
        p = F.greatest(F.col("n") - discount, F.lit(0.0)) / F.col("total") + discount * F.col("kinds") / F.col("total") * F.col("p")
        found = lower.join(totals, "context").join(below, "low").select("low", p.alias("p"))
    return keys.withColumn("low", F.col("key").substr(2, size - 1)).join(found, "low").select("key", "p")


def difference_tables(grams: DataFrame, scratch: Scratch, order: int = ORDER, discount: float = DISCOUNT) -> tuple[DataFrame, DataFrame]:
    """What ``Model.of`` computes, as written tables of any size: n-grams(gram, n, value) and contexts(context, value)."""
    classes = ("toxic", "ordinary")
    own = grams.withColumn("context", F.col("gram").substr(1, order - 1))
    sums = own.groupBy("context").agg(*[F.sum(c).cast("double").alias(f"{c}_total") for c in classes], *[F.count(F.when(F.col(c) > 0, 1)).alias(f"{c}_kinds") for c in classes])
    left = {c: F.when(F.col(f"{c}_total") > 0, discount * F.col(f"{c}_kinds") / F.col(f"{c}_total")).otherwise(1.0) for c in classes}
    sums = scratch.keep(sums.withColumns({f"{c}_left": left[c] for c in classes}), "contexts")
    shared = _continuations(grams.select(F.col("gram").alias("key")), order, discount, scratch).withColumnRenamed("key", "gram")
    logs = [F.log(F.greatest(F.col(c) - discount, F.lit(0.0)) / F.greatest(f"{c}_total", F.lit(1.0)) + F.col(f"{c}_left") * F.col("p")) for c in classes]
    values = own.join(sums, "context").join(shared, "gram").select("gram", (F.col("toxic") + F.col("ordinary")).alias("n"), (logs[0] - logs[1]).alias("value"))
    return scratch.keep(values, "values"), sums.select("context", (F.log("toxic_left") - F.log("ordinary_left")).alias("value"))


class Model:
    """Log-likelihood difference by n-gram, and by context for n-grams unseen after it.

    tables: n-grams and contexts as DataFrames if those held here are only a
    cache of them; then a word with an n-gram not held here is open.
    """

    tables: tuple[DataFrame, DataFrame] | None = None

    def __init__(self, grams: np.ndarray, ratio: np.ndarray, contexts: np.ndarray, context_ratio: np.ndarray, order: int):
        by, at = np.argsort(grams), np.argsort(contexts)
        self.grams, self.ratio = grams[by], ratio[by].astype(np.float32)
        self.contexts, self.context_ratio = contexts[at], context_ratio[at].astype(np.float32)
        self.order, self.curve = order, np.array([-20.0] + [0.0] * _EVIDENCE)
        self.cache = False

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "tables"}

    @classmethod
    def written(cls, tables: tuple[DataFrame, DataFrame], max_grams: int, order: int = ORDER) -> Model:
        """With the most frequent n-grams at hand and all of them in tables."""
        top = fetched(most_frequent(tables[0], "gram", max_grams).select("gram", "value")).sort_values("gram")
        none = np.empty(0)
        model = cls(T.string_gram_hash(top["gram"].tolist()), top["value"].to_numpy(), none.astype(T.U64), none, order)
        model.tables, model.cache = tables, True
        return model

    @classmethod
    def of(cls, rows: pd.DataFrame, order: int = ORDER, discount: float = DISCOUNT) -> Model:
        """From n-grams with their counts by class."""
        grams = rows["gram"].to_numpy(dtype=object)
        shared = _shared(grams, discount)
        context = np.array([g[:-1] for g in grams], dtype=object)
        keys, which = np.unique(context, return_inverse=True) if len(grams) else (context, np.empty(0, dtype=np.int64))
        logs, spare = [], []
        for name in ("toxic", "ordinary"):
            n = rows[name].to_numpy(dtype=np.float64)
            total = np.bincount(which, weights=n, minlength=len(keys))
            kinds = np.bincount(which, weights=n > 0, minlength=len(keys))
            left = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            logs.append(np.log(np.maximum(n - discount, 0) / np.maximum(total[which], 1) + left[which] * shared))
            spare.append(np.log(left))
        return cls(T.string_gram_hash(list(grams)), logs[0] - logs[1], T.string_gram_hash(list(keys)), spare[0] - spare[1], order)

    def word_ratios(self, words: T.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log-likelihood difference of each distinct word, its length with the end, and whether it is open."""
        n = self.order
        if not len(words.distinct):
            return np.empty(0), np.empty(0), np.empty(0, dtype=bool)
        codes, begin, size = words.padded(words.first, n - 1)
        at, known = T.find(self.grams, T.gram_hashes(codes, n))
        by, seen = T.find(self.contexts, T.gram_hashes(codes, n - 1))
        value = np.where(known, self.ratio[at] if len(self.ratio) else 0.0, np.where(seen, self.context_ratio[by] if len(self.contexts) else 0.0, 0.0))
        valid = np.arange(len(codes)) - np.repeat(begin, size) <= np.repeat(size - n, size)
        missing = np.logical_or.reduceat(valid & ~known, begin) if self.cache else np.zeros(len(begin), dtype=bool)
        return np.add.reduceat(np.where(valid, value, 0.0), begin), (size - n + 1).astype(np.float64), missing

    def evidence(self, texts) -> np.ndarray:
        """By text: the difference per character, the largest of a word, and the shares and roots of words above steps."""
        return _ratios(self.sums(texts)[0])

    def sums(self, texts) -> tuple[np.ndarray, list[list[tuple[str, int]]]]:
        """By text: what its words that are not open add up to (see ``_ratios``), and the open words with their numbers."""
        parts = [self._sums(texts[p]) for p in T.portions(texts)]
        return np.concatenate([np.empty((0, len(_SUMS))), *[p for p, _ in parts]]), [w for _, o in parts for w in o]

    def _sums(self, texts) -> tuple[np.ndarray, list[list[tuple[str, int]]]]:
        words = T.Words(texts)
        total, length, missing = self.word_ratios(words)
        counts, rest = words.counts, [[] for _ in range(len(words.counts))]
        total, length, off = total[words.which], length[words.which], missing[words.which]
        if off.any():
            at = np.flatnonzero(off)
            holder = np.searchsorted(np.cumsum(counts), at, side="right")
            pairs, times = np.unique(np.column_stack((holder, words.which[at])), axis=0, return_counts=True)
            names = {}
            for text, word, n in zip(*pairs.T.tolist(), times.tolist(), strict=True):
                if word not in names:
                    start = int(words.start[words.first[word]])
                    names[word] = words.codes[start : start + int(words.length[words.first[word]])].tobytes().decode("utf-32-le", "surrogatepass")
                rest[text].append((names[word], n))
            total, length = np.where(off, 0.0, total), np.where(off, 0.0, length)
        above = T.sums_by_text((total[:, None] > _STEPS).astype(np.float64), counts)
        largest = T.maxima_by_text(np.where(off, -np.inf, total), counts)
        return np.column_stack((counts, T.sums_by_text(total, counts), T.sums_by_text(length, counts), largest, above)), rest

    def score(self, texts) -> np.ndarray:
        z = self.curve[0] + self.evidence(texts) @ self.curve[1:]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _ratios(sums: np.ndarray) -> np.ndarray:
    """Evidence from a text's number of words, sum of differences, sum of lengths, largest difference, and words above each step."""
    words, above = np.maximum(sums[:, :1], 1), sums[:, 4:]
    return np.column_stack((sums[:, 1] / np.maximum(sums[:, 2], 1), sums[:, 3], above[:, _SHARES] / words, above[:, _ROOTS] / np.sqrt(words)))


_SUMS = [f"s{i}" for i in range(4 + len(_STEPS))]


def _evidence_by_text(texts: DataFrame, model: Model, shared, scratch: Scratch) -> DataFrame:
    """texts(key, text) as (key, evidence), once for each key; open words are looked up in the model's tables."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own, rest = shared.value.sums(batch["text"])
            yield pd.DataFrame({"key": batch["key"], **dict(zip(_SUMS, own.T, strict=True)), "rest": [[{"word": w, "n": n} for w, n in words] for words in rest]})

    schema = "key string, " + ", ".join(f"{c} double" for c in _SUMS) + ", rest array<struct<word: string, n: bigint>>"
    firsts = [F.first(c).alias(c) for c in (*_SUMS, "rest")]
    made = scratch.keep(texts.mapInPandas(sums, schema).groupBy("key").agg(F.count("*").alias("rows"), *firsts), "sums")
    rest = made.select("key", F.explode("rest").alias("r")).select("key", "r.word", "r.n")
    values, contexts = model.tables
    padded = F.concat(F.lit(_PAD * (model.order - 1)), F.col("word"), F.lit(_END))
    spread = rest.select("word").distinct().select("word", padded.alias("p")).select("word", "p", F.explode(F.sequence(F.lit(1), F.length("p") - (model.order - 1))).alias("at"))
    spread = spread.select("word", F.col("p").substr(F.col("at"), F.lit(model.order)).alias("gram")).withColumn("context", F.col("gram").substr(1, model.order - 1))
    looked = spread.join(values.select("gram", "value"), "gram", "left").join(contexts.withColumnRenamed("value", "spare"), "context", "left")
    looked = looked.groupBy("word").agg(F.sum(F.coalesce("value", "spare", F.lit(0.0))).alias("total"), F.count("*").alias("length"))
    n, total = F.col("n"), F.col("total")
    adds = [F.sum(n * total).alias("a1"), F.sum(n * F.col("length")).alias("a2"), F.max("total").alias("a3")]
    adds += [F.sum(F.when(total > float(step), n).otherwise(0)).alias(f"a{4 + i}") for i, step in enumerate(_STEPS)]
    added = rest.join(looked, "word").groupBy("key").agg(*adds)
    both = made.drop("rest").join(added, "key", "left")  # a row a distinct text
    s = [F.col("s0")] + [F.greatest("s3", "a3") if i == 3 else F.col(f"s{i}") + F.coalesce(f"a{i}", F.lit(0)) for i in range(1, len(_SUMS))]
    words = F.greatest(s[0], F.lit(1.0))
    evidence = [s[1] / F.greatest(s[2], F.lit(1.0)), s[3], *[s[4 + i] / words for i in _SHARES], *[s[4 + i] / F.sqrt(words) for i in _ROOTS]]
    found = scratch.keep(both.select("key", "rows", F.array(*evidence).alias("evidence")), "evidence")
    scratch.drop(made)
    return found


def with_evidence(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """(row, evidence): the rows of docs as a struct, each with its evidence."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    row, text = packed(docs).alias("row"), col(text_col)
    if model.tables is not None:
        key = F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256).alias("key")
        found = _evidence_by_text(docs.select(key, text.alias("text")), model, shared, Scratch(spark))
        counts = found.select("key", F.col("rows").alias("n"))
        return spread_join(docs.select(row, key), found.drop("rows"), "key", counts).drop("key")

    @F.pandas_udf("array<double>")
    def evidence(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(shared.value.evidence(batch)))

    # as non-deterministic, so that a filter on the score does not gather the evidence a second time
    return docs.select(row, evidence.asNondeterministic()(text).alias("evidence"))


def _shared(grams: np.ndarray, discount: float) -> np.ndarray:
    """Interpolated probability of each n-gram's last character from the shared lower orders."""
    if not len(grams):
        return np.empty(0)
    lower = np.array([g[1:] for g in grams], dtype=object)
    keys, which = np.unique(lower, return_inverse=True)
    n = np.bincount(which).astype(np.float64)
    if len(keys[0]) == 1:
        return ((n + 0.5) / (n.sum() + 0.5 * (len(keys) + 1)))[which]
    context, by = np.unique(np.array([k[:-1] for k in keys], dtype=object), return_inverse=True)
    total, kinds = np.bincount(by, weights=n), np.bincount(by).astype(np.float64)
    below = _shared(keys, discount)
    value = np.maximum(n - discount, 0) / total[by] + discount * kinds[by] / total[by] * below
    return value[which]


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.5, rounds: int = 50) -> np.ndarray:
    """Newton's method with a small penalty on the slopes."""
    x = np.column_stack((np.ones(len(x)), x))
    scale = np.maximum(x.std(axis=0), 1e-9)
    scale[0] = 1.0
    x = x / scale
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w / scale


def labelled_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(id, text, toxic) of the documents that have a label; the labels are broadcast only if few."""
    known = labels.where(col(label_col).isNotNull() & col(id_col).isNotNull()).groupBy(col(id_col).alias("id")).agg(F.max(col(label_col)).alias("toxic"))
    if labels.count() <= BROADCAST_LABELS:
        known = F.broadcast(known)
    return docs.select(col(id_col).alias("id"), col(text_col).alias("text")).where("text IS NOT NULL").join(known, "id")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_grams: int = MAX_GRAMS, calibration_rows: int = CALIBRATION_ROWS) -> Model:
    """The curve from a fifth of the labelled rows given, at most about calibration_rows; counts from all others.

    max_grams bounds what is broadcast, not the model: beyond it the rest is looked up in written tables.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = labelled_rows(docs, labels, id_col, text_col, label_col)
    total = rows.count()
    below = int(min(total // 5, calibration_rows) / max(total, 1) * 2**63)
    rows = rows.withColumn("h", row_hash(F.col("id"), F.col("text"), seed="curve"))
    grams = gram_counts(word_counts(rows.where(F.col("h") >= below))).withColumn("n", F.col("toxic") + F.col("ordinary"))
    scratch = Scratch(spark)
    grams = scratch.keep(grams, "grams")
    known = grams.count()
    if known <= max_grams:
        model = Model.of(fetched(grams.drop("n")).sort_values("gram"))
    else:
        model = Model.written(difference_tables(grams, scratch), max_grams)
    chosen = rows.where(F.col("h") < below).dropDuplicates(["h"])  # copies once, so that no group of them breaks the bound
    seen = fetched(with_evidence(chosen, model).select(F.col("row.toxic").cast("double").alias("y"), "evidence"))
    if known and seen["y"].nunique() > 1:
        model.curve = _logistic(np.array(seen["evidence"].tolist()), seen["y"].to_numpy())
    else:
        share = float(seen["y"].mean()) if len(seen) else 0.0
        model.curve = np.array([np.log(max(share, 1e-9) / max(1 - share, 1e-9))] + [0.0] * _EVIDENCE)
    return model


def _scored(docs: DataFrame, model: Model, text_col: str) -> DataFrame:
    """(row, score)"""
    bound_batches(docs.sparkSession)
    z = F.lit(float(model.curve[0]))
    for i, slope in enumerate(model.curve[1:]):
        z = z + F.col("evidence")[i] * float(slope)
    return with_evidence(docs, model, text_col).select("row", (1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(40.0)), F.lit(-40.0))))).alias("score"))


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with score and predicted."""
    return _scored(docs, model, text_col).select(*unpacked(docs, but=("score", "predicted")), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs that the model does not call toxic, with docs' own columns."""
    return _scored(docs, model, text_col).where("score < 0.5").select(*unpacked(docs))


__all__ = ["Model", "fit", "held_out", "reject_toxic", "score_toxicity"]
