"""Token counts by a map-side two-tier lookup.

Byte-level BPE never merges across pre-tokens, so a text's token count is the
sum over its pre-tokens.  Tier one is a broadcast table of the lengths of the
most frequent pre-tokens, counted in a bounded sample of the texts (about
``SAMPLE_DOCS`` documents and ``SAMPLE_BYTES`` bytes); tier two is each worker's
cache, which encodes what tier one misses.  Pre-tokens are never shuffled.

The table holds at most ``FREQUENT`` entries and a worker's cache at most
``CACHED``, none of more than ``LONGEST`` characters; longer pre-tokens are
encoded each time.  So memory is bounded at any input size.  Either tier only
saves work: counts always equal the library's, whatever the sample holds.

The tokenizer is given by a path that the workers can read, or by a function
that each worker calls for its own path.

Defined results: null counts as the empty text, which has 0 tokens; special
strings inside texts are handled as the library does by default (texts that
hold one are encoded by it whole); texts with characters outside the checked
alphabet are split by the library's own pre-tokeniser; an empty table gives an
empty table; columns of the input named n_bytes, n_tokens or over_limit are
replaced, all others are kept whatever their names.
"""

from __future__ import annotations

import functools
import os
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import col
from .batches import bound_batches, fetched
from .rows import bounded_sample, packed, unpacked

FREQUENT = 32_768
LONGEST = 64
CACHED = 400_000
#: What the table of frequent pre-tokens is counted in at most: documents, bytes of text, bytes of one text.
SAMPLE_DOCS, SAMPLE_BYTES, SAMPLE_TEXT = 20_000, 16 << 20, 1 << 20
_CHECKED = 0x3000
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"


@functools.lru_cache(maxsize=1)
def _splitters():
    """The library's pre-tokeniser, a pattern that splits alike, and a pattern of characters for which that is not checked."""
    from tokenizers.pre_tokenizers import ByteLevel

    library, split = ByteLevel(add_prefix_space=False), re.compile(_SPLIT)
    spans: list[list[int]] = []
    for c in range(_CHECKED):
        around = [x.format(chr(c)) for x in ("a{0}", "1{0}", "!{0}", "{0}a", " {0}")]
        if any(len(split.findall(x)) != len(library.pre_tokenize_str(x)) for x in around):
            continue
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    same = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)
    return library, split, re.compile(f"[^{same}]")


class Counter50k:
    """Counts tokens of texts as the tokenizers library does, by pre-token."""

    def __init__(self, path: str | Callable[[], str], frequent: dict[str, int] | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path() if callable(path) else path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.frequent = frequent or {}
        self.cache: dict[str, int] = {}
        self.library, self.split, self.odd = _splitters()
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added))) if added else None

    def pieces(self, text: str) -> list[str]:
        if not self.odd.search(text):
            return self.split.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def lengths(self, pieces: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch(pieces, add_special_tokens=False)]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special and self.special.search(text):
            return len(self.tokenizer.encode(text, add_special_tokens=False))
        pieces = self.pieces(text)
        found = list(map(self.frequent.get, pieces))
        if None not in found:
            return sum(found)
        total, rest, long = 0, [], []
        for piece, n in zip(pieces, found, strict=True):
            if n is not None:
                total += n
            elif len(piece) <= LONGEST:
                rest.append(piece)
            else:
                long.append(piece)
        if long:
            total += sum(self.lengths(long))
        missing = list({p for p in rest if p not in self.cache})
        if len(missing) > CACHED:
            return len(self.tokenizer.encode(text, add_special_tokens=False))
        if missing:
            if len(self.cache) + len(missing) > CACHED:
                self.cache.clear()
                missing = list(set(rest))
            self.cache.update(zip(missing, self.lengths(missing), strict=True))
        return total + sum(map(self.cache.__getitem__, rest))


def frequent_lengths(docs: DataFrame, path: str | Callable[[], str], id_col: str = "doc_id", text_col: str = "text", size: int = FREQUENT) -> dict[str, int]:
    """Token lengths of the most frequent pre-tokens of a bounded sample; each task counts its part of it."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter, counts = Counter50k(path), Counter()
        for batch in batches:
            for text in batch["text"]:
                counts.update(p for p in counter.pieces(text) if len(p) <= LONGEST)
        pieces = list(counts)
        yield pd.DataFrame({"piece": pd.Series(pieces, dtype=object), "n": pd.Series([counts[p] for p in pieces], dtype="int64"), "tokens": pd.Series(counter.lengths(pieces), dtype="int64")})

    sample = bounded_sample(docs, id_col, text_col, SAMPLE_DOCS, SAMPLE_BYTES, SAMPLE_TEXT, seed="tokens")
    found = fetched(sample.mapInPandas(count, "piece string, n bigint, tokens bigint")).groupby("piece").agg({"n": "sum", "tokens": "first"})
    found = found.sort_index().sort_values("n", ascending=False, kind="stable").head(size)
    return dict(zip(found.index, found["tokens"].tolist(), strict=True))


def count_tokens(docs: DataFrame, path: str | Callable[[], str], id_col: str = "doc_id", text_col: str = "text", limit: int = 512, size: int = FREQUENT) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit (more than limit tokens)."""
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(frequent_lengths(docs, path, id_col, text_col, size))

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Counter50k(path, shared.value)
        for batch in batches:
            yield pd.Series([counter.count(t) for t in batch], dtype="int64")

    text = col(text_col)
    size_of = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    out = docs.select(packed(docs).alias("row"), size_of.alias("n_bytes"), tokens.asNondeterministic()(text).alias("n_tokens"))
    return out.select(*unpacked(docs, but=("n_bytes", "n_tokens", "over_limit")), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
