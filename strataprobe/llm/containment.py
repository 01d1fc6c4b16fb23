"""Finding short items inside long texts: MinHash over windows, verified by exact shingle containment.

Items are partitioned by their number of distinct shingles q into classes
[U/2, U).  For each class a text is read in windows of 2U shingles that overlap
by U, so an item's passage always lies whole in some window, and a window that
holds the threshold share of an item has a Jaccard similarity of at least
``threshold * U/2 / (2U + (1 - threshold) * U/2)`` with it, whatever the text's
length.  The number of one-row bands follows from that similarity and the
probability with which a match may be missed (``miss``).  Every candidate is
verified against the whole text: shared distinct shingles / item's shingles,
exactly but for the 64-bit hashes by which shingles are compared.

A window's minimum can equal an item's only if the text holds the item's very
shingle, so texts and windows that hold no such shingle are passed over first;
that leaves the search's result as it is.

Defined results: words are runs of letters, digits and non-ASCII characters of
the lower-cased text; items of fewer words than a shingle have their whole
sequence as one shingle, which a text must hold as consecutive words; items and
texts that are null or have no word match nothing; repeated items and texts each
give their own matches.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np

from . import textcore as T

_FILTER = 1 << 22


def least_similarity(threshold: Fraction) -> float:
    """Least Jaccard similarity of an item and a window that holds it."""
    t = float(threshold)
    return t * 0.5 / (2 + (1 - t) * 0.5)


def bands_for(threshold: Fraction, miss: float) -> int:
    """One-row bands needed so that a match collides in none with at most the given probability."""
    return math.ceil(math.log(miss) / math.log(1 - least_similarity(threshold)))


def _bands(n: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.arange(1, n + 1, dtype=T.U64)
    return T.mix64(i * T.U64(0xD1B54A32D192ED03)) | T.U64(1), T.mix64(i * T.U64(0x8CB92BA72F3D8DD7))


def minima(tokens: np.ndarray, factor: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """MinHash of a set for every band, and the place of the token that gives it."""
    values = (tokens[None, :] ^ term[:, None]) * factor[:, None]
    at = values.argmin(axis=1)
    return values[np.arange(len(at)), at], at


class _Class:
    """The items of one shingle length and size class."""

    def __init__(self, upper: int, items: list[int], sets: list[np.ndarray], bands: int):
        self.upper = upper
        self.factor, self.term = _bands(bands)
        keys, owners, marks = [], [], []
        for item in items:
            values, at = minima(sets[item], self.factor, self.term)
            keys.append(self._keys(values))
            owners.append(np.full(bands, item))
            marks.append(sets[item][at])
        keys, owners = np.concatenate(keys), np.concatenate(owners)
        by = np.argsort(keys, kind="stable")
        self.keys, self.owners = keys[by], owners[by]
        self.marks = np.unique(np.concatenate(marks))

    def _keys(self, values: np.ndarray) -> np.ndarray:
        return T.mix64(values ^ (np.arange(len(values), dtype=T.U64) * T.U64(0x9E3779B97F4A7C15)))

    def candidates(self, tokens: np.ndarray, hits: np.ndarray) -> dict[int, int]:
        """Items that collide with a window of the text, with that window's first shingle. hits: places of marked shingles."""
        blocks = np.unique(hits // self.upper)
        found: dict[int, int] = {}
        for window in np.unique(np.concatenate((blocks, np.maximum(blocks - 1, 0)))).tolist():
            begin = window * self.upper
            own = tokens[begin : begin + 2 * self.upper]
            keys = self._keys(minima(own, self.factor, self.term)[0])
            low, high = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
            for a, b in zip(low[low < high].tolist(), high[low < high].tolist(), strict=True):
                for item in np.unique(self.owners[a:b]).tolist():
                    found.setdefault(item, begin)
        return found


class ContainmentIndex:
    """Items (ids and texts) to be found in texts."""

    def __init__(self, ids: list, texts: list[str | None], k: int = 5, threshold: Fraction = Fraction(4, 5), miss: float = 1e-6):
        self.k, self.threshold = k, Fraction(threshold)
        self.ids, self.sets, self.lengths = [], [], []
        words, counts = T.word_hashes(T.as_bytes(texts, "unicode"), T.NON_WORD)
        sets = T.distinct_sets(*T.shingle_hashes(words, counts, k))
        for item, own, n in zip(ids, sets, counts.tolist(), strict=True):
            if len(own):
                self.ids.append(item)
                self.sets.append(own)
                self.lengths.append(min(n, k))
        bands = bands_for(self.threshold, miss)
        groups: dict[tuple[int, int], list[int]] = {}
        for i, (own, length) in enumerate(zip(self.sets, self.lengths, strict=True)):
            groups.setdefault((length, len(own).bit_length()), []).append(i)
        self.classes: dict[int, list[_Class]] = {}
        for (length, size), items in sorted(groups.items()):
            self.classes.setdefault(length, []).append(_Class(1 << size, items, self.sets, bands))
        self.filters = {length: self._filter(own) for length, own in self.classes.items()}

    @staticmethod
    def _filter(classes: list[_Class]) -> np.ndarray:
        out = np.zeros(_FILTER, dtype=bool)
        for c in classes:
            out[(c.marks & T.U64(_FILTER - 1)).astype(np.int64)] = True
        return out

    def matches(self, texts) -> list[list[tuple]]:
        """Of each text, (item id, item's shingles, shared shingles, first word of a window that found it)."""
        out: list[list[tuple]] = []
        for part in T.portions(texts):
            out += self._matches(texts[part])
        return out

    def _matches(self, texts) -> list[list[tuple]]:
        out: list[list[tuple]] = [[] for _ in range(len(texts))]
        words, counts = T.word_hashes(T.as_bytes(texts, "unicode"), T.NON_WORD)
        for length, classes in self.classes.items():
            tokens, made = T.shingle_hashes(words, counts, length, whole=False)
            maybe = np.flatnonzero(self.filters[length][(tokens & T.U64(_FILTER - 1)).astype(np.int64)])
            ends = np.cumsum(made)
            holder = np.searchsorted(ends, maybe, side="right")
            for text in np.unique(holder).tolist():
                begin = int(ends[text] - made[text])
                own = tokens[begin : int(ends[text])]
                places = maybe[holder == text] - begin
                found: dict[int, int] = {}
                for c in classes:
                    hits = places[T.find(c.marks, own[places])[1]]
                    if len(hits):
                        found |= c.candidates(own, hits)
                distinct = np.unique(own) if found else own
                for item, at in sorted(found.items()):
                    q = len(self.sets[item])
                    shared = int(T.find(distinct, self.sets[item])[1].sum())
                    if shared * self.threshold.denominator >= q * self.threshold.numerator:
                        out[text].append((self.ids[item], q, shared, at))
        return out
