"""Vectorised word and shingle hashing shared by the corpus operators.

Texts travel as UTF-8 bytes.  All words of a whole batch of texts are hashed in
a handful of numpy passes over the concatenated buffer, so no Python object is
made per word.  Hashes are 64 bits wide and depend on nothing but the bytes:
every executor, worker restart and rerun computes the same values.

Nulls count as empty texts; empty texts have no words and no shingles.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_MIX1, _MIX2 = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53)
_S33 = U64(33)
_STEP = U64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads every input bit over all 64 output bits."""
    x = x ^ (x >> _S33)
    x = x * _MIX1
    x ^= x >> _S33
    x *= _MIX2
    x ^= x >> _S33
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out, x = np.empty(n, dtype=U64), 1
    for i in range(n):
        out[i] = x
        x = x * base & 0xFFFFFFFFFFFFFFFF
    return out


_BASE = 0x9E3779B97F4A7C15 | 1
_RUN = 4096
_POW = _powers(_BASE, _RUN)
_BYTE = mix64((np.arange(256, dtype=U64) + U64(1)) * _STEP)

#: Bytes that part words: space and the controls 0x09 to 0x0D.
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: The same and every other ASCII byte that is neither letter nor digit.
NON_WORD = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def as_bytes(texts, lower: str = "ascii") -> list[bytes]:
    """UTF-8 of each text, null as empty; lower: 'ascii' folds A-Z only, 'unicode' folds all, '' nothing."""
    if lower == "unicode":
        return [t.lower().encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    return [t.lower() for t in raw] if lower == "ascii" else raw


def portions(texts, size: int = 1 << 20) -> list[slice]:
    """Runs of texts of about a million characters each (one text at least): what is hashed at a time, so that arrays stay small."""
    out, begin, total = [], 0, 0
    for i, t in enumerate(texts):
        total += len(t) if t else 0
        if total >= size:
            out.append(slice(begin, i + 1))
            begin, total = i + 1, 0
    if begin < len(texts):
        out.append(slice(begin, len(texts)))
    return out


def word_hashes(texts: list[bytes], gap: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and the number of words of each text."""
    counts = np.zeros(len(texts), dtype=np.int64)
    if not texts:
        return np.empty(0, dtype=U64), counts
    buffer = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    inside = ~gap[buffer]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.empty(0, dtype=U64), counts
    lengths = end - start
    at = np.flatnonzero(inside)
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    offset = np.arange(len(at)) - np.repeat(first, lengths)
    value = _BYTE[buffer[at]] * _POW[offset % _RUN]
    if int(lengths.max()) > _RUN:
        far = offset >= _RUN
        value[far] = mix64(value[far] + (offset[far] // _RUN).astype(U64) * _STEP)
    hashes = mix64(np.add.reduceat(value, first) + lengths.astype(U64) * _STEP)
    ends = np.cumsum([len(t) + 1 for t in texts])
    bound = np.searchsorted(start, ends)
    counts[:] = np.diff(bound, prepend=0)
    return hashes, counts


def shingle_hashes(words: np.ndarray, counts: np.ndarray, k: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text in order, repeats kept, and their number by text.

    whole: a text of one to k-1 words has its whole sequence as its one shingle; else it has none.
    """
    n = len(words)
    made = np.where(counts >= k, counts - k + 1, (counts > 0) if whole else 0).astype(np.int64)
    if not int(made.sum()):
        return np.empty(0, dtype=U64), made
    begin = np.concatenate(([0], np.cumsum(counts)[:-1]))
    first = np.concatenate(([0], np.cumsum(made)[:-1]))
    at = np.arange(int(made.sum())) - np.repeat(first - begin, made)
    size = np.repeat(np.minimum(counts, k), made)
    out = size.astype(U64) * _STEP
    for j in range(k):
        here = words[np.minimum(at + j, n - 1)] * U64(_POW[j + 1]) if j else words[at].copy()
        here = mix64(here) if j else here
        mixed = (out ^ here) * _MIX1 + (here >> _S33)
        out = np.where(size > j, mixed, out) if whole and j else mixed
    return mix64(out), made


def distinct_sets(hashes: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct hashes of each text."""
    ends = np.cumsum(counts)
    return [np.unique(hashes[e - c : e]) if c else np.empty(0, dtype=U64) for c, e in zip(counts.tolist(), ends.tolist(), strict=True)]


_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Whether each code point is a letter; built once a process."""
    if not _LETTER:
        _LETTER.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _LETTER[0]


class Words:
    """All words (runs of letters, lower-cased) of a batch of texts.

    codes: code points of the batch; start, length: of each word in codes;
    hashes: of each word; counts: words of each text; distinct, first, which:
    the distinct hashes, a word that has each, and the distinct one of each word.
    """

    def __init__(self, texts):
        lower = [t.lower() if t else "" for t in texts]
        self.codes = np.frombuffer(("\x00".join(lower) + "\x00").encode("utf-32-le", "surrogatepass"), dtype=np.uint32) if lower else np.empty(0, dtype=np.uint32)
        inside = _letters()[self.codes]
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        self.start, end = edge[0::2], edge[1::2]
        self.length = end - self.start
        bound = np.searchsorted(self.start, np.cumsum([len(t) + 1 for t in lower])) if lower else np.empty(0, dtype=np.int64)
        self.counts = np.diff(bound, prepend=0)
        if len(self.start):
            first = np.concatenate(([0], np.cumsum(self.length)[:-1]))
            at = np.flatnonzero(inside)
            offset = np.arange(len(at)) - np.repeat(first, self.length)
            value = mix64((self.codes[at].astype(U64) + U64(1)) * _STEP) * _POW[offset % _RUN]
            far = offset >= _RUN
            if far.any():
                value[far] = mix64(value[far] + (offset[far] // _RUN).astype(U64) * _STEP)
            self.hashes = mix64(np.add.reduceat(value, first) + self.length.astype(U64) * _STEP)
        else:
            self.hashes = np.empty(0, dtype=U64)
        self.distinct, self.first, self.which = np.unique(self.hashes, return_index=True, return_inverse=True)

    def padded(self, words: np.ndarray, before: int, after: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code points of the given words, each with 2s before and 3s after it, where each begins, and its size."""
        size = self.length[words] + before + after
        begin = np.concatenate(([0], np.cumsum(size)[:-1])) if len(size) else np.empty(0, dtype=np.int64)
        out = np.empty(int(size.sum()), dtype=np.uint32)
        offset = np.arange(len(out)) - np.repeat(begin, size)
        source = np.repeat(self.start[words] - before, size) + offset
        head, tail = offset < before, offset >= np.repeat(size - after, size)
        out[:] = self.codes[np.clip(source, 0, max(len(self.codes) - 1, 0))] if len(out) else 0
        out[head], out[tail] = 2, 3
        return out, begin, size


def gram_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n code points that begin at each place; the last n-1 places are not valid."""
    out = np.full(len(codes), n, dtype=U64) * _STEP
    value = (codes.astype(U64) + U64(1)) * _STEP
    for j in range(n):
        shifted = np.zeros_like(value)
        shifted[: len(value) - j] = value[j:] if j else value
        out = mix64(out ^ (shifted + U64(j)))
    return out


def string_gram_hash(grams: list[str]) -> np.ndarray:
    """gram_hashes of whole strings that all have the same number of code points."""
    if not grams:
        return np.empty(0, dtype=U64)
    n = len(grams[0])
    codes = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return gram_hashes(codes, n)[::n]


def find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key in the sorted table, and whether it is there."""
    if not len(table):
        return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def sums_by_text(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of values (one per word) over each text; 0 for texts without words."""
    total = np.concatenate((np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)))
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def maxima_by_text(values: np.ndarray, counts: np.ndarray, empty: float = 0.0) -> np.ndarray:
    out = np.full(len(counts), empty, dtype=np.float64)
    has = counts > 0
    if len(values):
        begin = (np.cumsum(counts) - counts)[has]
        out[has] = np.maximum.reduceat(values, begin)
    return out
