"""Language identification by word-first backoff.

A word that the model knows in any language is scored by its log frequency in
each; a word it does not know is scored by its character n-grams, at the longest
length at which any of them is known, down to single characters.  A text's
score per language is the mean over its words.

The model is fitted on a bounded sample of labelled rows, chosen by the hash of
id and text: about ``train_docs`` rows and ``train_bytes`` bytes of text at most,
shared out by language, so that languages of few rows are taken whole and none
drops out (rows equal in id, text and language once, none longer than
``longest`` bytes).  All words and n-grams of the sample are in the model; what
is broadcast grows with the sample, so it is bounded as that is, and holds an
entry for each language that a word occurs in, not for each language.  Whole
texts are scored.

Defined results: null texts and texts without a letter get ``und`` and score 0;
without any training row all texts get ``und`` and score 0; ties go to the first
language in code point order; null ids are trained on as any other; an empty
table gives an empty table; columns of the input named lang_pred or score are
replaced, all others are kept whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import col
from . import textcore as T
from .batches import bound_batches, fetched
from .rows import bounded_sample, packed, unpacked

#: Characters of the longest n-gram.
LONGEST = 5
#: What the model is fitted on at most: rows, bytes of text, bytes of one text.
TRAIN_DOCS, TRAIN_BYTES, LONGEST_TEXT = 50_000, 64 << 20, 1 << 20
#: Count of a word in a language that has not got it.
ABSENT = 0.1
#: Scores of words by language that are held at a time.
_CELLS = 1 << 18
UNKNOWN = "und"


class Table:
    """Log frequencies by language of sorted keys, kept for the languages that have each; others have the language's least."""

    def __init__(self, keys: np.ndarray, langs: np.ndarray, counts: np.ndarray, n_langs: int):
        """One entry for each key and language that has it."""
        by = np.lexsort((langs, keys))
        keys, langs, counts = keys[by], langs[by], counts[by].astype(np.float64)
        total = np.maximum(np.bincount(langs, weights=counts, minlength=n_langs), 1.0) if len(keys) else np.ones(n_langs)
        self.absent = np.log(ABSENT / total)
        self.keys, first = np.unique(keys, return_index=True)
        self.ends = np.append(first[1:], len(keys)).astype(np.int64) if len(keys) else np.empty(0, dtype=np.int64)
        self.langs = langs.astype(np.int32)
        self.values = (np.log(counts / total[langs]) if len(keys) else np.empty(0)).astype(np.float32)

    def rows(self, at: np.ndarray) -> np.ndarray:
        """Log frequencies by language of the keys at the given places."""
        out = np.tile(self.absent, (len(at), 1))
        if len(at):
            end = self.ends[at]
            size = end - np.where(at > 0, self.ends[at - 1], 0)
            row = np.repeat(np.arange(len(at)), size)
            entry = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(end - size, size)
            out[row, self.langs[entry]] = self.values[entry]
        return out


class Model:
    """tables[0]: words; tables[n]: n-grams."""

    def __init__(self, langs: list[str], tables: list[Table]):
        self.langs, self.tables = langs, tables

    @classmethod
    def of(cls, rows: pd.DataFrame) -> Model:
        """From rows of lang, kind (0: word, else n), hash and n, one for each lang, kind and hash."""
        langs = sorted(rows["lang"].unique())
        place = pd.Series(range(len(langs)), index=langs, dtype=np.int64)
        tables = []
        for kind in range(LONGEST + 1):
            own = rows[rows["kind"] == kind]
            tables.append(Table(own["hash"].to_numpy(dtype=np.int64).view(T.U64), own["lang"].map(place).to_numpy(dtype=np.int64), own["n"].to_numpy(dtype=np.float64), max(len(langs), 1)))
        return cls(langs, tables)

    def word_scores(self, words: T.Words, some: np.ndarray) -> np.ndarray:
        """Log frequencies by language of some of the distinct words; 0 for those of which nothing is known."""
        out = np.zeros((len(some), len(self.langs)))
        at, known = T.find(self.tables[0].keys, words.distinct[some])
        out[known] = self.tables[0].rows(at[known])
        rest = np.flatnonzero(~known)
        for n in range(LONGEST, 0, -1):
            if not len(rest):
                break
            codes, begin, size = words.padded(words.first[some[rest]], 1)
            at, known = T.find(self.tables[n].keys, T.gram_hashes(codes, n))
            known &= np.arange(len(codes)) - np.repeat(begin, size) <= np.repeat(size - n, size)
            scores, owner = self.tables[n].rows(at[known]), np.repeat(np.arange(len(rest)), size)[known]
            found = np.bincount(owner, minlength=len(rest))
            has = found > 0
            for j in range(len(self.langs)):
                out[rest[has], j] = np.bincount(owner, weights=scores[:, j], minlength=len(rest))[has] / found[has]
            rest = rest[~has]
        return out

    def predict(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Languages and scores."""
        parts = [self._predict(texts[p]) for p in T.portions(texts)] or [(np.empty(0, dtype=object), np.empty(0))]
        return np.concatenate([n for n, _ in parts]), np.concatenate([s for _, s in parts])

    def _predict(self, texts) -> tuple[np.ndarray, np.ndarray]:
        words = T.Words(texts)
        holder = np.repeat(np.arange(len(words.counts)), words.counts)
        pairs, times = np.unique(words.which * max(len(words.counts), 1) + holder, return_counts=True)
        word, holder = np.divmod(pairs, max(len(words.counts), 1))
        sums = np.zeros((len(words.counts), len(self.langs)))
        step = max(256, _CELLS // len(self.langs))
        for low in range(0, len(words.distinct), step):
            scores = self.word_scores(words, np.arange(low, min(low + step, len(words.distinct))))
            own = slice(*np.searchsorted(word, (low, low + step)))
            for j in range(len(self.langs)):
                sums[:, j] += np.bincount(holder[own], weights=scores[word[own] - low, j] * times[own], minlength=len(sums))
        means = sums / np.maximum(words.counts, 1)[:, None]
        power = np.exp((means - means.max(axis=1, keepdims=True)) * np.minimum(words.counts, 20)[:, None])
        best = means.argmax(axis=1)
        score = power[np.arange(len(best)), best] / power.sum(axis=1)
        none = words.counts == 0
        names = np.array(self.langs, dtype=object)[best]
        names[none], score[none] = UNKNOWN, 0.0
        return names, score


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of words and n-grams by language, one set of rows per batch."""
    for batch in batches:
        for lang, words in ((lang, T.Words(rows["text"].iloc[p])) for lang, rows in batch.groupby("lang") for p in T.portions(rows["text"])):
            if not len(words.hashes):
                continue
            times = np.bincount(words.which, minlength=len(words.distinct))
            made = [(0, words.distinct, times)]
            codes, begin, size = words.padded(words.first, 1)
            weight = np.repeat(times, size)
            left = np.repeat(size, size) - (np.arange(len(codes)) - np.repeat(begin, size))
            for n in range(1, LONGEST + 1):
                valid = left >= n
                keys, which = np.unique(T.gram_hashes(codes, n)[valid], return_inverse=True)
                made.append((n, keys, np.bincount(which, weights=weight[valid], minlength=len(keys)).astype(np.int64)))
            for kind, keys, n in made:
                yield pd.DataFrame({"lang": lang, "kind": np.int32(kind), "hash": keys.view(np.int64), "n": n.astype(np.int64)})


def fit(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES, longest: int = LONGEST_TEXT) -> Model:
    """A model of the labelled rows (null languages and texts are left out)."""
    bound_batches(rows.sparkSession)
    labelled = rows.where(col(lang_col).isNotNull()).select(col(id_col).alias("id"), col(text_col).alias("text"), col(lang_col).cast("string").alias("lang"))
    sample = bounded_sample(labelled, "id", "text", train_docs, train_bytes, longest, "lang", "language")
    counts = sample.mapInPandas(_counts, "lang string, kind int, hash bigint, n bigint").groupBy("lang", "kind", "hash").agg(F.sum("n").alias("n"))
    return Model.of(fetched(counts))


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score."""
    spark = docs.sparkSession
    bound_batches(spark)
    if not model.langs:
        return docs.select(packed(docs).alias("row")).select(*unpacked(docs, but=("lang_pred", "score")), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names, score = shared.value.predict(batch)
            yield pd.DataFrame({"lang_pred": names, "score": score})

    out = docs.select(packed(docs).alias("row"), predict.asNondeterministic()(col(text_col)).alias("predicted"))
    return out.select(*unpacked(docs, but=("lang_pred", "score")), "predicted.*")


def held_out(id_col: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    """Whether a row's id falls into the part that no model learns from."""
    return F.pmod(F.crc32(F.coalesce(col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(parts)) == part
