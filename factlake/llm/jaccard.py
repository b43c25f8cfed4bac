"""N-gram Jaccard join by signature trees.

Exact: documents whose sets of word shingles have a Jaccard similarity of ``least`` per cent or more are linked, and each
document gets the smallest doc_id that links reach. No pair is emitted for a group's sake:

1. Each document's set gets a key; equal sets are one class from here on.
2. Two linked sets share so much that, of the ``SHARE`` of a set's shingles with the lowest hashes, a known number lies in the
   other set's lowest too, whatever its size. Shingles are grouped by hash range; classes with fewer shared ones than that number drop out.
   A shingle that several sets of one batch share is counted there, and leaves the batch once, without its sets: so one that a third of all documents
   share costs its range a few bytes per batch, not per document.
3. Of the others, shingles are counted. Linked sets share one of their rarest shingles (prefix filter); classes that share
   one, directly or through others, form a block.
4. A block's sets hang in a signature tree: nodes hold the OR of their sets' bitmaps, the range of sizes and the most
   shingles that fell on an occupied bit. A dual traversal drops pairs of nodes by size, by the largest overlap their bitmaps
   allow, or because all their sets are connected already; pairs of sets that remain are verified exactly. Blocks above
   ``CROWD`` sets are dealt out as pairs of parts, each with a tree of its own.
5. Verified links are closed to components.

Hashes have 64 bits, for shingles and for set keys.

Defined results: null text, empty text and text without words have an empty set, which links with nothing; a null doc_id can't
be a component's smallest id unless all are null; repeated rows share a class; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, carried, lean, restored, slices, written
from .components import connected
from .hashing import U, mixed, shingles

WORDS, LEAST = 5, 75
#: Share of a set's shingles that step 2 looks at; shingles of a hash range; sets of a tree; sets below a tree node.
SHARE, RANGE, CROWD, LEAF = 0.35, 2_000_000, 3000, 8
#: Bits of a set's map at most: larger sets share bits more often, which the bound on overlaps allows for.
MOST_BITS = 1 << 15
#: Tables of at most this many rows (two numbers each) are broadcast to the texts.
BROADCAST_ROWS = 300_000


def _needed(n, least: int = LEAST):
    """The least overlap that a set of n shingles has with a linked one."""
    return -(-n * least // 100)


def _looked_at(n, least: int = LEAST):
    """How many lowest shingles step 2 looks at: enough that a linked set shares one, and SHARE of them."""
    return np.minimum(n, np.maximum(n - _needed(n, least) + 1, np.ceil(SHARE * n))).astype(np.int64)


def _least_shared(n: int, least: int = LEAST) -> int:
    """How many of the shingles that step 2 looks at a set of n shares, at least, with those of any linked set.

    Whichever of two linked sets is cut off at the lower hash, what it looks at of the overlap the other looks at too.
    """
    other = np.arange(_needed(n, least), n * 100 // least + 1)
    overlap = -(-least * (n + other) // (100 + least))
    own, theirs = (_looked_at(m, least) - (m - overlap) for m in (np.int64(n), other))
    return max(1, int(np.minimum(own, theirs)[overlap <= np.minimum(n, other)].min()))


def key_of(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def _texts(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [(t or "").encode() for t in batch.column(column).to_pylist()]


def sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n (size of the set), set_key, text_key (a hash of the text)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            found = [(len(s), key_of(s)) for s in shingles(_texts(batch, 1), words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([k for _, k in found], pa.int64()), batch.column(2)], ["doc_id", "n", "set_key", "text_key"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text")).mapInArrow(rows, "doc_id long, n long, set_key long, text_key long")


def _range_of(tokens: np.ndarray, ranges: int) -> np.ndarray:
    """The hash range of each shingle; hashes are spread anew, for these may be the lowest only."""
    return ((mixed(tokens) >> U(32)) * U(ranges) >> U(32)).astype(np.int64)


def _ranged(tokens: list[np.ndarray], keys: list[int], ranges: int) -> Iterator[tuple]:
    """(range, keys, shingles of each key, shingles) for each hash range with shingles; order by key and shingle is kept."""
    sizes = np.array([len(t) for t in tokens], np.int64)
    flat = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(keys)), sizes)
    place = _range_of(flat, ranges)
    order = np.argsort(place, kind="stable")
    flat, owner, place = flat[order], owner[order], place[order]
    every = np.array(keys, np.int64)
    edges = np.searchsorted(place, np.arange(ranges + 1))
    for r in range(ranges):
        a, b = edges[r], edges[r + 1]
        if b > a:
            own, counts = np.unique(owner[a:b], return_counts=True)
            yield r, every[own].tobytes(), counts.astype(np.uint32).tobytes(), flat[a:b]


def _low(tokens: np.ndarray) -> bytes:
    """Five bytes of each hash; with the hash range, that is enough to find what may be shared."""
    return np.ascontiguousarray(tokens.view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _wide(low: bytes) -> np.ndarray:
    out = np.zeros((len(low) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(low, np.uint8).reshape(-1, 5)
    return out.view(np.uint64).ravel()


RANGED = "part int, keys binary, counts binary, tokens binary"
#: What step 2 sends to a hash range: keys, how many single shingles each has there, these, how many of each key's are known to be shared, and shared shingles.
LOOKED = "part int, keys binary, counts binary, tokens binary, known binary, told binary"


def _combined(tokens: list[np.ndarray], keys: list[int], ranges: int) -> Iterator[tuple]:
    """The LOOKED rows of a batch of sets."""
    sizes = np.array([len(t) for t in tokens], np.int64)
    flat = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
    every = np.array(keys, np.int64)
    owner = np.repeat(np.arange(len(every)), sizes)
    # Shingles that sets of different keys have in this batch.
    order = np.argsort(flat, kind="stable")
    first = np.flatnonzero(np.concatenate((np.ones(min(len(flat), 1), bool), flat[order][1:] != flat[order][:-1])))
    shared, told = np.zeros(len(flat), bool), flat[:0]
    if len(first):
        own = every[owner[order]]
        several = np.minimum.reduceat(own, first) != np.maximum.reduceat(own, first)
        shared[order] = np.repeat(several, np.diff(np.append(first, len(flat))))
        told = flat[order][first[several]]
    place, told_place = _range_of(flat, ranges), _range_of(told, ranges)
    order = np.argsort(place, kind="stable")
    flat, owner, place, shared = flat[order], owner[order], place[order], shared[order]
    told = told[np.argsort(told_place, kind="stable")]
    edges, told_edges = np.searchsorted(place, np.arange(ranges + 1)), np.searchsorted(np.sort(told_place), np.arange(ranges + 1))
    for r in range(ranges):
        a, b = edges[r], edges[r + 1]
        if b > a:
            own, at = np.unique(owner[a:b], return_inverse=True)
            known = np.bincount(at, shared[a:b], len(own)).astype(np.uint32)
            counts = np.bincount(at, ~shared[a:b], len(own)).astype(np.uint32)
            yield r, every[own].tobytes(), counts.tobytes(), _low(flat[a:b][~shared[a:b]]), known.tobytes(), _low(told[told_edges[r] : told_edges[r + 1]])


SHARED = "bucket int, keys binary, counts binary"


def _shared_counts(table: pa.Table, buckets: int) -> pa.Table:
    """Of a hash range: for each set key, how many of its shingles another key has too; a row per bucket of keys."""
    joined = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in table[name].to_pylist()])
    every, own, known = joined("keys", np.int64), joined("counts", np.uint32), joined("known", np.uint32)
    single = np.concatenate([_wide(t) for t in table["tokens"].to_pylist()])
    told = np.concatenate([_wide(t) for t in table["told"].to_pylist()])
    tokens, keys, mark = np.concatenate((single, told)), np.concatenate((np.repeat(every, own), np.zeros(len(told), np.int64))), np.arange(len(single) + len(told)) >= len(single)
    order = np.argsort(tokens)
    tokens, keys, mark = tokens[order], keys[order], mark[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(len(tokens), 1), bool), tokens[1:] != tokens[:-1])))
    again = keys[:0]
    if len(first):
        several = (np.minimum.reduceat(keys, first) != np.maximum.reduceat(keys, first)) | np.logical_or.reduceat(mark, first)
        again = keys[np.repeat(several, np.diff(np.append(first, len(keys)))) & ~mark]
    found, at = np.unique(np.concatenate((every[known > 0], again)), return_inverse=True)
    counts = np.bincount(at, np.concatenate((known[known > 0], np.ones(len(again), np.uint32))), len(found)).astype(np.int64)
    bucket = _range_of(found.view(np.uint64), buckets)
    order = np.argsort(bucket, kind="stable")
    found, counts, edges = found[order], counts[order], np.searchsorted(bucket[order], np.arange(buckets + 1))
    some = np.flatnonzero(np.diff(edges)).tolist()
    own = lambda x: pa.array([x[edges[k] : edges[k + 1]].tobytes() for k in some], pa.binary())
    return pa.table({"bucket": pa.array(some, pa.int32()), "keys": own(found), "counts": own(counts.astype(np.uint32))})


def _summed(table: pa.Table) -> pa.Table:
    """Of a bucket of keys: each key's sum over all hash ranges."""
    joined = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in table[name].to_pylist()])
    keys, at = np.unique(joined("keys", np.int64), return_inverse=True)
    return pa.table({"set_key": pa.array(keys), "shared": pa.array(np.bincount(at, joined("counts", np.uint32), len(keys)).astype(np.int64))})


def _suspects(docs: DataFrame, classes: DataFrame, total: int, words: int, least: int) -> DataFrame:
    """Classes that may be linked with another, by step 2."""
    ranges = max(1, -(-int(total * SHARE) // RANGE))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [s for s in shingles(_texts(batch, 0), words) if len(s)]
            low = [s[: int(_looked_at(np.int64(len(s)), least))] for s in found]
            out = list(_combined(low, [key_of(s) for s in found], ranges))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.binary() if i else pa.int32()) for i in range(6)], [f.split()[0] for f in LOOKED.split(", ")])

    ranged = docs.select(F.col("text").cast("string")).mapInArrow(rows, LOOKED)
    shared = ranged.groupBy("part").applyInArrow(lean(partial(_shared_counts, buckets=ranges)), SHARED)
    shared = shared.groupBy("bucket").applyInArrow(lean(_summed), "set_key long, shared long")

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_least_shared(n, least) for n in batch.column(0).to_pylist()], pa.int64())], ["n", "bound"])

    bound = F.broadcast(classes.select("n").distinct().mapInArrow(bounds, "n long, bound long"))
    # Each copy of the class has counted its shared shingles once.
    return classes.join(shared, "set_key").join(bound, "n").filter(F.col("shared") >= F.col("copies") * F.col("bound")).select("set_key", "n", "least_id", "text_key")


def _whole_sets(docs: DataFrame, suspects: DataFrame, words: int) -> DataFrame:
    """set_key, n, tokens (all shingle hashes, in order) of the suspects, from one document of each."""
    wanted = suspects.select(F.col("least_id").alias("_id"), F.col("text_key").alias("_text_key"))
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = list(shingles(_texts(batch, 0), words))
            yield pa.RecordBatch.from_arrays([pa.array([key_of(s) for s in found], pa.int64()), pa.array([len(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], ["set_key", "n", "tokens"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("k"))
    picked = keyed.join(wanted, (F.col("k") == F.col("_text_key")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    return picked.select("text").mapInArrow(rows, "set_key long, n long, tokens binary")


def _blocks(whole: DataFrame, total: int, least: int) -> DataFrame:
    """(key, root) of classes that share one of their rarest shingles, directly or through others."""
    ranges = max(1, -(-total // RANGE))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            out = list(_ranged([np.frombuffer(t, np.uint64) for t in batch.column(1).to_pylist()], batch.column(0).to_pylist(), ranges))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))] + [pa.array([x[3].tobytes() for x in out], pa.binary())], ["part", "keys", "counts", "tokens"])

    def count(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(k, np.int64) for k in table["keys"].to_pylist()]
        sizes = [np.frombuffer(c, np.uint32) for c in table["counts"].to_pylist()]
        _, at, times = np.unique(np.concatenate([np.frombuffer(t, np.uint64) for t in table["tokens"].to_pylist()]), return_inverse=True, return_counts=True)
        often = np.minimum(times, 65535).astype(np.uint16)[at]
        keys, sizes = np.concatenate(keys), np.concatenate(sizes)
        ends = np.cumsum(sizes)
        return pa.table({"set_key": pa.array(keys), "part": pa.array([table["part"][0].as_py()] * len(keys), pa.int32()), "often": pa.array([often[e - s : e].tobytes() for s, e in zip(sizes, ends, strict=True)], pa.binary())})

    counted = whole.select("set_key", "tokens").mapInArrow(spread, RANGED).groupBy("part").applyInArrow(lean(count), "set_key long, part int, often binary")
    counted = counted.groupBy("set_key").agg(F.sort_array(F.collect_list(F.struct("part", "often"))).alias("parts"))  # one entry per hash range

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            out_tokens, out_keys = [], []
            for key, raw, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                tokens, often = np.frombuffer(raw, np.uint64), np.frombuffer(b"".join(parts), np.uint16)
                tokens = tokens[np.argsort(_range_of(tokens, ranges), kind="stable")]
                order = np.lexsort((tokens, often))[: int(len(tokens) - _needed(len(tokens), least) + 1)]
                order = order[often[order] > 1]
                out_tokens.append(tokens[order].view(np.int64))
                out_keys.append(np.full(len(order), key, np.int64))
            if out_keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_tokens)), pa.array(np.concatenate(out_keys))], ["token", "set_key"])

    prefix = whole.join(counted, "set_key").select("set_key", "tokens", F.col("parts.often")).mapInArrow(rarest, "token long, set_key long")
    prefix = written(prefix.distinct(), "jaccard-prefix")
    least_key = prefix.groupBy("token").agg(F.min("set_key").alias("b"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    return connected(prefix.join(least_key, "token").select(F.col("set_key").alias("a"), "b"))


class Tree:
    """Signature tree over sets in their order: level 0 are the sets, each further level joins LEAF nodes of the one below."""

    def __init__(self, tokens: list[np.ndarray]) -> None:
        sizes = np.array([len(t) for t in tokens], np.int64)
        bits = min(MOST_BITS, max(256, 1 << int(4 * sizes.max() - 1).bit_length()))
        packed, excess, row = np.zeros((len(tokens), bits // 8), np.uint8), sizes.copy(), np.zeros(bits, bool)
        for i, t in enumerate(tokens):
            row[:] = False
            row[(t & U(bits - 1)).astype(np.int64)] = True
            packed[i], excess[i] = np.packbits(row), sizes[i] - row.sum()
        self.levels = [(packed.view(np.uint64), sizes, sizes, excess)]
        while len(self.levels[-1][1]) > 1:
            maps, low, high, excess = self.levels[-1]
            at = np.arange(0, len(low), LEAF)
            self.levels.append((np.bitwise_or.reduceat(maps, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(excess, at)))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def links(tokens: list[np.ndarray], least: int = LEAST) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets: verified pairs, each joining two components."""
    n = len(tokens)
    order = sorted(range(n), key=lambda i: (int(tokens[i][0]), len(tokens[i])))
    tokens = [tokens[i] for i in order]
    root, found = np.arange(n), []

    def verify(i: int, j: int) -> None:
        a, b = len(tokens[i]), len(tokens[j])
        both = overlap(tokens[i], tokens[j])
        if 100 * both >= least * (a + b - both):
            found.append((order[i], order[j]))
            root[root == root[j]] = root[i]

    if n <= LEAF:
        for i in range(n):
            for j in range(i + 1, n):
                if root[i] != root[j] and min(len(tokens[i]), len(tokens[j])) * 100 >= least * max(len(tokens[i]), len(tokens[j])):
                    verify(i, j)
        return found
    tree = Tree(tokens)
    top = len(tree.levels) - 1
    todo = [(top, 0, 0)]
    while todo:
        level, a, b = todo.pop()
        if level == 0:
            if root[a] != root[b]:
                verify(a, b)
            continue
        below = LEAF ** (level - 1)
        width = LEAF**level
        mine, theirs = root[a * width : (a + 1) * width], root[b * width : (b + 1) * width]
        if (mine == mine[0]).all() and (theirs == mine[0]).all():
            continue
        maps, low, high, excess = tree.levels[level - 1]
        x, y = np.arange(a * LEAF, min((a + 1) * LEAF, len(low))), np.arange(b * LEAF, min((b + 1) * LEAF, len(low)))
        most = np.bitwise_count(maps[x][:, None] & maps[y][None]).sum(2).astype(np.int64) + np.minimum(excess[x][:, None], excess[y][None])
        most = np.minimum(most, np.minimum(high[x][:, None], high[y][None]))
        can = (most * (100 + least) >= least * (low[x][:, None] + low[y][None])) & (high[x][:, None] * 100 >= least * low[y][None]) & (high[y][None] * 100 >= least * low[x][:, None])
        pairs = [(level - 1, int(x[i]), int(y[j])) for i, j in zip(*np.nonzero(can), strict=True) if a != b or i < j or (i == j and below >= 1 and level > 1)]
        todo += sorted(pairs, key=lambda p: p[1] == p[2])  # a node with itself comes first, so that near ones are connected early
    return found


def _tree_links(whole: DataFrame, blocks: DataFrame, least: int) -> DataFrame:
    """Verified links (a, b) among the classes of each block."""
    sizes = blocks.groupBy("root").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    rows = whole.join(blocks.withColumnRenamed("key", "set_key"), "set_key").join(sizes, "root")
    parts = F.ceil(F.col("size") / CROWD).cast("int")
    own = F.pmod(F.xxhash64("set_key"), F.col("parts")).cast("int")
    rows = rows.withColumn("parts", parts).withColumn("own", own)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("unit", F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other")))
    rows = rows.select("root", "unit", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "set_key", "tokens")

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(unit: dict[int, bytes]) -> pa.RecordBatch:
            keys = sorted(unit)
            pairs = links([np.frombuffer(unit[k], np.uint64) for k in keys], least)
            return pa.RecordBatch.from_arrays([pa.array([keys[i] for i, _ in pairs], pa.int64()), pa.array([keys[j] for _, j in pairs], pa.int64())], ["a", "b"])

        last, unit = None, {}
        for batch in batches:
            for root, i, j, key, tokens in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3, 4, 5)), strict=True):
                if (root, i, j) != last and unit:
                    yield of(unit)
                    unit = {}
                last = (root, i, j)
                unit[key] = tokens
        if unit:
            yield of(unit)

    return rows.repartition("unit").sortWithinPartitions("unit", "root", "i", "j").mapInArrow(traverse, "a long, b long")


def joined(docs: DataFrame, words: int = WORDS, least: int = LEAST, with_text_key: bool = False) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, set_key (equal sets, equal keys), component_key (null: alone), and text_key if asked for."""
    own = written(sets(docs, words), "jaccard-sets")
    classes = written(own.filter("n > 0").groupBy("set_key").agg(F.first("n").alias("n"), F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("copies"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).getField("text_key").alias("text_key")), "jaccard-classes")
    total = own.agg(F.sum("n")).first()[0] or 0
    suspects = written(_suspects(docs, classes, total, words, least), "jaccard-suspects")
    whole = written(_whole_sets(docs, suspects, words).dropDuplicates(["set_key"]), "jaccard-whole")
    blocks = written(_blocks(whole, whole.agg(F.sum("n")).first()[0] or 0, least), "jaccard-blocks")
    found = connected(_tree_links(whole, blocks, least))
    linked = classes.join(found.withColumnRenamed("key", "set_key"), "set_key", "left").withColumn("root", F.coalesce("root", "set_key"))
    least_of = linked.groupBy("root").agg(F.min("least_id").alias("component_id"), F.sum("copies").alias("members")).filter("members > 1")
    together = linked.join(least_of, "root").select("set_key", "component_id", F.col("root").alias("component_key"))
    out = own.join(together, "set_key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "set_key", "component_key", *["text_key"] * with_text_key)


def one_of_each(docs: DataFrame, words: int = WORDS, least: int = LEAST) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest doc_id (then text hash); documents without words all stay.

    The others are anti-joined by id and text hash, so the texts aren't shuffled while those are few.
    """
    found = joined(docs, words, least, with_text_key=True)
    ranked = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("text_key").alias("c"))
    worded = written(found.filter("n_shingles > 0").select("doc_id", "text_key", F.coalesce("component_key", "set_key").alias("key")), "jaccard-groups")
    first = worded.groupBy("key").agg(F.min(ranked).alias("first"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    others = worded.join(first, "key").filter(~(F.col("doc_id").eqNullSafe(F.col("first.b")) & (F.col("text_key") == F.col("first.c")))).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    others = written(others.distinct(), "jaccard-others")
    keyed = carried(docs, "doc_id", "text").withColumn("_text_key", F.xxhash64(F.col("text").cast("string")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_key"))
    kept = keyed.join(F.broadcast(others) if others.count() <= BROADCAST_ROWS else others, same, "left_anti")
    twice = worded.groupBy("doc_id", "text_key").count().filter("count > 1")
    if twice.limit(1).count():  # rows that repeat id and text: one of them stays
        with_words = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)) > 0
        kept = kept.filter(with_words).dropDuplicates(["doc_id", "_text_key"]).unionByName(kept.filter(~with_words))
    return kept.select(*restored(kept, docs.columns))
