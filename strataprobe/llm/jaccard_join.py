"""Exact n-gram Jaccard self-join by a token-group matrix.

1. Every document becomes its set of word shingles.  Documents of equal sets
   are one node of the graph.
2. Two sets can only reach the threshold if they share a token among their
   first ``n - ceil(t * n) + 1`` in one fixed order.  The order puts tokens that
   very many documents hold last, so prefixes are made of rare tokens.  (Any
   order gives the same links; it only decides how much is compared.)
3. Every node has a sketch: how many of its tokens fall into each of 64 classes
   (of members of a group, into more classes the larger they are).
   The sum of the lesser counts of two sketches bounds their overlap, so nodes
   that no holder of any of their prefix tokens can link with drop out.
4. The rest are partitioned into groups of similar documents: same most frequent
   prefix token (counted among the nodes that are left, so that it is mostly that
   of a family of copies), same magnitude of size, dealt into chunks of bounded weight.  Each group is stored
   as one row of the token-group matrix: its token union, per member its places
   in the union and its sketch, and the union of the sketches (by class the
   greatest count).
5. Groups that share a prefix token meet if their sketches, of the groups and
   then of the members, let any two of their members link.  Then for every member the overlap with the other group's token
   union bounds its overlap with any document there; only members that this
   bound lets through open the group, and for those the intersections are
   counted exactly, as a product of the two groups' token columns.
6. A pair of groups gives one row per linked document, never a pair of
   documents; connected components of these rows are the classes.

A class of any size is spread over chunks, so no task holds it, and no link
between different sets is lost: every pair above the threshold lies in exactly
one pair of groups, in which all pairs that the bound admits are counted.
Shingles are compared by 64-bit hashes, sets by 128-bit digests.

Defined results: null and empty texts, or texts without words, have no shingles
and link with nothing; texts with fewer words than a shingle have their whole
sequence as one; null ids are members of classes but never name one that has
another id; repeated ids are separate rows; an empty table gives an empty table;
jaccard_classes reads only the id and text columns, and keep_one_per_class
changes no column, whatever the others are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import col
from . import textcore as T
from .batches import bound_batches, fetched, most_frequent, rows_per_batch
from .components import connected_components
from .rows import HOT_ROWS, packed, spread_join, unpacked
from .scratch import Scratch

#: Tokens of a chunk of a group, and members at most.
WEIGHT, MEMBERS = 1 << 18, 1024
#: A token seen this often (counting a batch of texts only if twice in it) goes last in the order; so many at most are broadcast.
COMMON, COMMON_MOST = 32, 1 << 17
#: Rows of the list of documents to fetch again up to which that list is broadcast.
BROADCAST_ROWS = 200_000
_CHUNK_TOKENS = 1 << 21
#: Smaller groups, about, that travel together to a larger one.
BUNDLE = 32
#: Groups, of a few megabytes at most, that a worker holds at a time.
GROUPS_PER_BATCH = 8
#: Groups of one token that meet in one task.
MEET = 256
#: Rows of one token above which joins by token spread them over tasks.
HOT = HOT_ROWS
#: Classes of a sketch; a count at the limit of a byte bounds nothing.
CLASSES, _FULL = 64, 255
#: Holders of a token up to which each is held against the others by sketch; nodes of larger lists all go on.
LIST = 512


def _sets(texts, k: int) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for part in T.portions(texts):
        words, counts = T.word_hashes(T.as_bytes(texts[part]))
        out += T.distinct_sets(*T.shingle_hashes(words, counts, k))
    return out


def _digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def common_tokens(docs: DataFrame, text_col: str, k: int, scratch: Scratch, least: int = COMMON, most: int = COMMON_MOST) -> np.ndarray:
    """Tokens that many documents hold, from counts over all documents."""

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pd.DataFrame:
            tokens, n = np.unique(np.concatenate(held), return_counts=True)
            return pd.DataFrame({"token": tokens[n > 1].view(np.int64), "n": n[n > 1]})

        for batch in batches:
            for tokens in _sets(batch["text"], k):
                held.append(tokens)
                size += len(tokens)
            if size > _CHUNK_TOKENS:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    partial = docs.select(col(text_col).alias("text")).mapInPandas(counts, "token bigint, n bigint")
    many = scratch.keep(partial.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "common")
    return np.sort(fetched(most_frequent(many, "token", most).select("token"))["token"].to_numpy(dtype=np.int64).view(T.U64))


def sketch(tokens: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """Tokens of a set by class (a power of two of classes, by their first bits), a byte each."""
    return np.minimum(np.bincount((tokens >> T.U64(65 - classes.bit_length())).astype(np.int64), minlength=classes), _FULL).astype(np.uint8)


def fine_classes(n: int) -> int:
    """Classes for sets of about n tokens, of which then four to eight fall into each."""
    return 1 << min(13, max(6, int(n).bit_length() - 3))


def may_link(a: np.ndarray, b: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Whether sketches (one a row) admit an overlap of at least need; of sketches of different fineness the finer is summed up."""
    full = (a == _FULL).any(axis=1) | (b == _FULL).any(axis=1)
    least = min(a.shape[1], b.shape[1])
    a, b = (x if x.shape[1] == least else x.reshape(len(x), least, -1).sum(axis=2, dtype=np.int64) for x in (a, b))
    return full | (np.minimum(a, b).sum(axis=1, dtype=np.int64) >= need)


def _need(n, t: Fraction):
    """Least overlap with a set of n tokens that a partner must have."""
    return -(-n * t.numerator // t.denominator)


def _prefixes(docs: DataFrame, id_col: str, text_col: str, k: int, t: Fraction, common: np.ndarray) -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(common)
    kind = docs.select(col(id_col)).schema[0].dataType.simpleString()

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = _sets(batch["text"], k)
            n = np.array([len(s) for s in sets], dtype=np.int64)
            late = T.find(shared.value, np.concatenate(sets))[1] if len(sets) else np.empty(0, dtype=bool)
            ends, prefixes, tokens = np.cumsum(n), [], []
            for s, e, null in zip(sets, ends.tolist(), batch["id"].isna(), strict=True):
                own = late[e - len(s) : e]
                take = len(s) - int(_need(len(s), t)) + 1 if len(s) else 0
                prefixes.append(np.concatenate((s[~own], s[own]))[:take].view(np.int64))
                tokens.append(s.tobytes() if null else None)
            yield pd.DataFrame({"id": batch["id"], "n": n, "digest": [_digest(s) for s in sets], "sketch": [sketch(s).tobytes() for s in sets], "prefix": prefixes, "tokens": tokens})

    return docs.select(col(id_col).alias("id"), col(text_col).alias("text")).mapInPandas(make, f"id {kind}, n bigint, digest binary, sketch binary, prefix array<bigint>, tokens binary")


def _rows_of(column, classes: int = CLASSES) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint8).reshape(-1, classes)


def _linkable(t: Fraction):
    """Of rows (token, node, n, sketch) sorted by token, the nodes that some other holder of the token may link with."""

    def of(frame: pd.DataFrame) -> np.ndarray:
        token, n, sketches = frame["token"].to_numpy(), frame["n"].to_numpy(dtype=np.int64), _rows_of(frame["sketch"])
        keep, step, left = np.zeros(len(frame), dtype=bool), 1, np.arange(len(frame) - 1)
        while len(left):
            left = left[token[left] == token[left + step]]
            large, small = np.maximum(n[left], n[left + step]), np.minimum(n[left], n[left + step])
            close = left[small * t.denominator >= large * t.numerator]
            for low in range(0, len(close), 1 << 16):
                i = close[low : low + (1 << 16)]
                total = n[i] + n[i + step]
                need = -(-total * t.numerator // (t.numerator + t.denominator))
                ok = i[may_link(sketches[i], sketches[i + step], need)]
                keep[ok] = keep[ok + step] = True
            step += 1
            left = left[left + step < len(frame)]
        return np.unique(frame["node"].to_numpy(dtype=np.int64)[keep])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            last = held["token"].iloc[-1]
            cut = int(np.searchsorted((held["token"] == last).to_numpy(), True))  # the last token's rows may go on
            if cut:
                yield pd.DataFrame({"node": of(held.iloc[:cut].reset_index(drop=True))})
                held = held.iloc[cut:].reset_index(drop=True)
        if held is not None and len(held):
            yield pd.DataFrame({"node": of(held)})

    return run


def _member_tokens(docs: DataFrame, members: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """members(rep, digest, node, group, copies, tokens) with the tokens of each, from its document's text."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = _sets(batch["text"], k)
            same = np.array([_digest(s) == bytes(d) for s, d in zip(sets, batch["digest"], strict=True)], dtype=bool)
            out = batch[["group", "node", "copies"]][same].copy()
            out["tokens"] = [s.tobytes() for s, ok in zip(sets, same, strict=True) if ok]
            yield out

    by_id = members.where("rep IS NOT NULL").drop("tokens")
    if by_id.count() <= BROADCAST_ROWS:
        by_id = F.broadcast(by_id)
    texts = docs.select(col(id_col).alias("rep"), col(text_col).alias("text")).where("rep IS NOT NULL")
    found = texts.join(by_id, "rep").select("group", "node", "copies", "digest", "text").mapInPandas(make, "group bigint, node bigint, copies bigint, tokens binary")
    return found.unionByName(members.where("rep IS NULL").select("group", "node", "copies", "tokens"))


def _matrix_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Groups, with their members in a list, as rows of the matrix."""
    for batch in batches:
        out = []
        for group, members in zip(batch["group"], batch["members"], strict=True):
            own = sorted({m["node"]: (m["copies"], m["tokens"]) for m in members}.items())
            sets = [np.frombuffer(tokens, dtype=T.U64) for _, (_, tokens) in own]
            union, places = np.unique(np.concatenate(sets), return_inverse=True)
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            sketches = np.array([sketch(s, fine_classes(sizes.max())) for s in sets])
            nodes, copies = (np.array(x, dtype=np.int64).tobytes() for x in ([n for n, _ in own], [c for _, (c, _) in own]))
            out.append((group, nodes, copies, sizes.tobytes(), union.tobytes(), places.astype(np.int32).tobytes(), sketches.tobytes(), sketches.max(axis=0).tobytes(), len(own), int(sizes.min()), int(sizes.max())))
        yield pd.DataFrame(out, columns=_NAMES)


_MATRIX = "group bigint, nodes binary, copies binary, sizes binary, union binary, places binary, sketches binary, sketch binary, members int, least bigint, most bigint"
_NAMES = [c.split()[0] for c in _MATRIX.split(", ")]


class _Sketched:
    """The sizes and sketches of a group."""

    def __init__(self, sizes: bytes, sketch: bytes, sketches: bytes):
        self.sizes = np.frombuffer(sizes, dtype=np.int64)
        self.union, self.members = _rows_of([sketch], len(sketch)), _rows_of([sketches], len(sketch))


def _any_may_link(a: _Sketched, b: _Sketched, t: Fraction) -> bool:
    """Whether sketches let any member of one group link with any of the other; by the unions' first."""
    if not may_link(a.union, b.union, _need(max(a.sizes.min(), b.sizes.min()), t))[0]:
        return False
    if len(a.sizes) > len(b.sizes):
        a, b = b, a
    for n, own in zip(a.sizes.tolist(), a.members, strict=True):
        close = np.flatnonzero(np.minimum(b.sizes, n) * t.denominator >= np.maximum(b.sizes, n) * t.numerator)
        need = -(-(b.sizes[close] + n) * t.numerator // (t.numerator + t.denominator))
        if len(close) and may_link(np.broadcast_to(own, (len(close), len(own))), b.members[close], need).any():
            return True
    return False


def _groups_may_link(t: Fraction):
    @F.pandas_udf("boolean")
    def check(sizes_a: pd.Series, sketch_a: pd.Series, sketches_a: pd.Series, sizes_b: pd.Series, sketch_b: pd.Series, sketches_b: pd.Series) -> pd.Series:
        rows = zip(sizes_a, sketch_a, sketches_a, sizes_b, sketch_b, sketches_b, strict=True)
        return pd.Series([_any_may_link(_Sketched(*r[:3]), _Sketched(*r[3:]), t) for r in rows], dtype=bool)

    return check


class Group:
    """A row of the matrix, unpacked."""

    def __init__(self, row: dict):
        get = lambda name, kind: np.frombuffer(row[name], dtype=kind)
        self.nodes, self.copies, self.sizes = get("nodes", np.int64), get("copies", np.int64), get("sizes", np.int64)
        self.union, self.places = get("union", T.U64), get("places", np.int32)
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.owner = np.repeat(np.arange(len(self.sizes)), self.sizes)

    def bound(self, inside: np.ndarray) -> np.ndarray:
        """Of each member, how many of its tokens are among the marked places of the union."""
        return np.add.reduceat(inside[self.places].astype(np.int64), self.begin)

    def columns(self, column: np.ndarray, rows: np.ndarray, low: int, high: int) -> np.ndarray:
        """0/1 matrix of the given members over the union's places that have columns low to high-1."""
        at = np.full(len(self.sizes), -1, dtype=np.int64)
        at[rows] = np.arange(len(rows))
        row, col = at[self.owner], column[self.places]
        use = (row >= 0) & (col >= low) & (col < high)
        out = np.zeros((len(rows), high - low), dtype=np.float32)
        out[row[use], col[use] - low] = 1.0
        return out


def compare_groups(a: Group, b: Group, t: Fraction, same: bool) -> list[tuple[int, int, int]]:
    """Of a pair of groups, (node, least node that it is connected with here, copies of all that it links with)."""
    at, shared = T.find(a.union, b.union)
    in_a, in_b = at[shared], np.flatnonzero(shared)
    both = in_b
    column_a, column_b = np.full(len(a.union), -1, dtype=np.int64), np.full(len(b.union), -1, dtype=np.int64)
    column_a[in_a], column_b[in_b] = np.arange(len(both)), np.arange(len(both))
    rows_a = np.flatnonzero(a.bound(column_a >= 0) >= _need(a.sizes, t))
    rows_b = np.flatnonzero(b.bound(column_b >= 0) >= _need(b.sizes, t))
    if not len(rows_a) or not len(rows_b):
        return []
    common = np.zeros((len(rows_a), len(rows_b)), dtype=np.float64)
    step = max(256, (1 << 21) // max(len(rows_a), len(rows_b)))
    for low in range(0, len(both), step):
        high = min(low + step, len(both))
        common += a.columns(column_a, rows_a, low, high) @ b.columns(column_b, rows_b, low, high).T
    common = np.rint(common).astype(np.int64)
    total = a.sizes[rows_a][:, None] + b.sizes[rows_b][None, :] - common
    linked = common * t.denominator >= total * t.numerator
    if same:
        np.fill_diagonal(linked, False)
    i, j = np.nonzero(linked)
    if not len(i):
        return []
    nodes_a, nodes_b = a.nodes[rows_a], b.nodes[rows_b]
    root = {int(x): int(x) for x in (*nodes_a[np.unique(i)], *nodes_b[np.unique(j)])}

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(nodes_a[i].tolist(), nodes_b[j].tolist(), strict=True):
        x, y = top(x), top(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    links: dict[int, int] = dict(zip(nodes_a.tolist(), (linked @ b.copies[rows_b]).tolist(), strict=True))
    if not same:
        for x, n in zip(nodes_b.tolist(), (a.copies[rows_a] @ linked).tolist(), strict=True):
            links[x] = links.get(x, 0) + n
    return [(x, top(x), links[x]) for x in root]


def _compare(t: Fraction):
    """Links between a row's group and those listed with it, or without a list within its own group."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                group, found = Group(row), []
                for other in row.get("others", [None]):
                    found += compare_groups(group, group if other is None else Group(other), t, other is None)
                if found:
                    yield pd.DataFrame(found, columns=["node", "near", "links"])

    return run


def _held_by_several(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows (token, node, ...) of the tokens that more than one row has, with the number of rows as holders; a frequent token's rows are spread over tasks."""
    often = scratch.keep(rows.groupBy("token").agg(F.count("*").alias("holders")).where("holders > 1"), "holders")
    return spread_join(rows, often, "token", often.select("token", F.col("holders").alias("n")), F.col("node"), HOT)


def _meetings(cells: DataFrame, scratch: Scratch, block: int) -> DataFrame:
    """(group, group_b) of the groups that share a token, group being the lesser.

    The groups of a token are dealt into blocks, and every pair of blocks is a
    join key of its own, so that a token of very many groups is spread over tasks.
    """
    counts = scratch.keep(cells.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > block), "meeting")
    holders = counts.select("token", F.ceil(F.col("n") / F.lit(block)).cast("int").alias("blocks"))
    dealt = spread_join(cells, holders, "token", counts, F.col("group"), HOT, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.select("token", "group", F.pmod(F.xxhash64("group"), F.col("blocks")).cast("int").alias("own"), "blocks")
    left = dealt.select("token", "group", F.col("own").alias("x"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("y"))
    right = dealt.select("token", F.col("group").alias("group_b"), F.explode(F.sequence(F.lit(0), "own")).alias("x"), F.col("own").alias("y"))
    # of two groups of one block each comes from either side, of two blocks the lesser block's from the left
    met = left.join(right, ["token", "x", "y"]).where("x < y OR group < group_b")
    return met.select(F.least("group", "group_b").alias("group"), F.greatest("group", "group_b").alias("group_b"))


def jaccard_classes(docs: DataFrame, k: int = 5, threshold: str | Fraction = Fraction(4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id (least id of its class) and n_links (documents that it links with)."""
    t = Fraction(threshold)
    if not 0 < t <= 1:
        raise ValueError("the threshold lies in (0, 1]")
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark)
    first = scratch.keep(_prefixes(docs, id_col, text_col, k, t, common_tokens(docs, text_col, k, scratch)), "prefixes")
    nodes = first.where("n > 0").groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("n", "sketch", "prefix", "tokens")])
    nodes = scratch.keep(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    rows = scratch.keep(first.select("id", "n", "digest"), "rows")
    scratch.drop(first)

    spread = nodes.select("node", "n", F.explode("prefix").alias("token"))
    shared = scratch.keep(_held_by_several(spread, scratch), "shared")
    listed = shared.where(F.col("holders") <= LIST).join(nodes.select("node", "sketch"), "node").select("token", "node", "n", "sketch")
    near = listed.repartition("token").sortWithinPartitions("token").mapInPandas(_linkable(t), "node bigint").union(shared.where(F.col("holders") > LIST).select("node")).distinct()
    alive = scratch.keep(shared.drop("holders").join(scratch.keep(near, "near"), "node"), "alive")
    scratch.drop(shared)
    postings = scratch.keep(_held_by_several(alive, scratch), "postings")
    scratch.drop(alive)

    home = postings.groupBy("node", "n").agg(F.max(F.struct("holders", "token")).alias("home"))
    magnitude = F.floor(F.log2(F.col("n").cast("double"))).cast("int")
    room = F.greatest(F.lit(1.0), F.least(F.lit(float(MEMBERS)), F.lit(float(WEIGHT)) / F.pow(F.lit(2.0), magnitude)))
    chunk = F.pmod(F.xxhash64("node"), F.ceil(F.col("home.holders") / room))
    home = scratch.keep(home.select("node", F.xxhash64(F.col("home.token"), magnitude, chunk).alias("group")), "groups")

    members = scratch.keep(home.join(nodes.select("node", "rep", "digest", "copies", "tokens"), "node"), "members")
    listed = _member_tokens(docs, members, id_col, text_col, k).groupBy("group").agg(F.collect_list(F.struct("node", "copies", "tokens")).alias("members"))
    with rows_per_batch(spark, GROUPS_PER_BATCH):
        matrix = scratch.keep(listed.mapInPandas(_matrix_rows, _MATRIX), "matrix")

    cells = scratch.keep(postings.select("token", "node").join(home, "node").select("token", "group").distinct(), "cells")
    meet = _meetings(cells, scratch, MEET).distinct()
    slim = matrix.select("group", "sketch", "sizes", "sketches", "least", "most", F.octet_length("places").alias("weight"))
    other = lambda df: df.select(*[F.col(c).alias(f"{c}_b") for c in df.columns])
    bounded = meet.join(slim, "group").join(other(slim), "group_b")
    sizes = (F.col("least") * t.numerator <= F.col("most_b") * t.denominator) & (F.col("least_b") * t.numerator <= F.col("most") * t.denominator)
    looked = [f"{c}{side}" for side in ("", "_b") for c in ("sizes", "sketch", "sketches")]
    bounded = bounded.where(sizes).withColumn("open", _groups_may_link(t).asNondeterministic()(*looked)).where("open")
    heavy = (F.col("weight") > F.col("weight_b")) | ((F.col("weight") == F.col("weight_b")) & (F.col("group") < F.col("group_b")))
    bounded = bounded.select(F.when(heavy, F.col("group")).otherwise(F.col("group_b")).alias("large"), F.when(heavy, F.col("group_b")).otherwise(F.col("group")).alias("small"))
    with rows_per_batch(spark, 16 * GROUPS_PER_BATCH):
        blocks = scratch.keep(bounded, "blocks")
    # the smaller group travels; the larger one is sent once to every bundle of those that it meets
    packs = blocks.groupBy("large").agg(F.ceil(F.count("*") / F.lit(BUNDLE)).alias("bundles"))
    blocks = blocks.join(packs, "large").select("large", F.col("small").alias("group"), F.pmod(F.xxhash64("small"), F.col("bundles")).alias("bundle"))
    blocks = F.broadcast(blocks) if matrix.count() <= BROADCAST_ROWS and blocks.count() <= BROADCAST_ROWS else blocks
    whole = matrix.drop("sketch", "sketches", "members", "least", "most")
    bundles = whole.join(blocks, "group").groupBy("large", "bundle").agg(F.collect_list(F.struct(*whole.columns)).alias("others"))
    across = whole.join(bundles.withColumnRenamed("large", "group"), "group").select(*whole.columns, "others").mapInPandas(_compare(t), "node bigint, near bigint, links bigint")
    within = matrix.where("members > 1").select(*whole.columns).mapInPandas(_compare(t), "node bigint, near bigint, links bigint")
    with rows_per_batch(spark, GROUPS_PER_BATCH):
        found = scratch.keep(within.union(across), "links")
    for done in (matrix, members, cells, postings):
        scratch.drop(done)

    labels = connected_components(found.select(F.col("node").alias("a"), F.col("near").alias("b")), scratch)
    degree = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.select("node", "digest", "rep", "copies").join(degree, "node", "left").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = scratch.keep(named, "named")
    least = scratch.keep(named.groupBy("label").agg(F.min("rep").alias("component_id")), "classes")
    classes = named.join(least, "label").select("digest", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    classes = scratch.keep(classes, "by-digest")
    counts = scratch.keep(nodes.select("digest", F.col("copies").alias("n")), "copies")
    for done in (found, named, least, labels, nodes):
        scratch.drop(done)
    out = spread_join(rows.where("n > 0"), classes, "digest", counts)
    out = out.unionByName(rows.where("n = 0"), allowMissingColumns=True)
    return out.select("id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one_per_class(docs: DataFrame, k: int = 5, threshold: str | Fraction = Fraction(4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, that of the least id; rows without shingles or links all stay.

    Rows are told apart by id and text.  Null ids come after all others; of rows
    equal in both, one stays.
    """
    scratch = Scratch(docs.sparkSession)
    text = col(text_col)
    name = F.coalesce(F.lpad(col(id_col).cast("string"), 20, "0"), F.lit("~"))
    key = F.concat(name, F.lit("/"), F.md5(F.coalesce(text, F.lit(""))))
    classes = jaccard_classes(docs.select(key.alias("key"), text.alias("text")), k, threshold, "key", "text")
    linked = classes.where("n_shingles > 0 AND n_links > 0").groupBy(F.col("id").alias("key")).agg(F.min("component_id").alias("class"), F.count("*").alias("n"))
    linked = scratch.keep(linked, "linked")
    keyed = docs.select(packed(docs).alias("row"), key.alias("key"))
    few = linked.withColumnRenamed("key", "linked")
    few = F.broadcast(few) if linked.count() <= BROADCAST_ROWS else few
    kept = keyed.join(few, F.col("key") == F.col("linked"), "left").where("class IS NULL OR class = key")
    if not linked.where("n > 1").isEmpty():
        kept = kept.where("n IS NULL OR n = 1").unionByName(kept.where("n > 1").dropDuplicates(["key"]))
    return kept.select(*unpacked(docs))
