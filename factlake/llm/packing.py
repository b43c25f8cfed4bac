"""Best-fit packing of tokenized documents by patterns that non-negative least squares fits to the length histogram.

Executors tokenize and report each piece's length. The driver gets the histogram of lengths (at most ``size`` numbers),
enumerates patterns of up to three pieces that fill a sequence exactly, fits repeat counts to the histogram by non-negative
least squares, rounds them down, and packs what is left over by best fit, still on the histogram. Executors rank the pieces of
each length, salted, and look up their sequence and offset. What the driver holds and sends depends on ``size`` alone.

Defined results: null or empty text is the end token alone; repeated rows are packed once each; a null doc_id stays null; an
empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, written

SIZE, END = 4096, 1
#: Patterns fitted at most, sweeps of the fit, words kept by a worker's memo, rows of one length ranked in one task.
PATTERNS, SWEEPS, MEMO, PER_TASK = 40_000, 25, 1_300_000, 5_000
#: Bytes of text whose words are looked up together; packers of short id lists.
CHUNK, PACKS = 1 << 20, [struct.Struct(f"<{n}I").pack for n in range(64)]
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: Between a letter and a mark after it (an apostrophe apart) the pre-tokenizer always cuts.
MARK = re.compile(rb"[!-&(-/:-@\[-`{-~](?<=[a-z].)")


class Tokens:
    """Token ids of white-space separated words, remembered.

    ASCII white space always ends a token of this vocabulary's pre-tokenizer, so a text's ids are its words' ids. Its normalizer
    lowers letters, so ASCII ones may be lowered before, except near the special tokens' brackets.
    """

    def __init__(self, path: str, most: int = MEMO) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer, self.memo, self.most = Tokenizer.from_file(path), {}, most

    def of(self, texts: list[bytes]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text."""
        group: list[list[bytes]] = []
        size = 0
        for text in texts:
            group.append((text if b"<|" in text else MARK.sub(rb" \g<0>", text.lower())).split())
            size += len(text)
            if size > CHUNK:
                yield from self._ids(group)
                group, size = [], 0
        yield from self._ids(group)

    def _ids(self, group: list[list[bytes]]) -> Iterator[bytes]:
        words = set().union(*group)
        new = list(words.difference(self.memo))
        if len(self.memo) + len(new) > self.most:
            self.memo.clear()
            new = list(words)
        found = self.tokenizer.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)
        self.memo.update((w, PACKS[len(i)](*i) if len(i := e.ids) < len(PACKS) else np.array(i, "<u4").tobytes()) for w, e in zip(new, found, strict=True))
        for each in group:
            yield b"".join(map(self.memo.__getitem__, each))


@cache
def _tokens(path: str, most: int) -> Tokens:
    return Tokens(path, most)


def pieces(docs: DataFrame, path: str, size: int = SIZE, end: int = END, memo: int = MEMO) -> DataFrame:
    """Documents as pieces of at most ``size`` token ids: doc_id, piece, start, length, ids_crc32. A worker remembers the ids of ``memo`` words at most (some 200 bytes each)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, tail = _tokens(path, memo), np.array([end], "<u4").tobytes()
        for batch in slices(batches, 1):
            rows: list[list] = [[], [], [], [], []]
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            for doc, ids in zip(batch.column(0).to_pylist(), tokens.of(texts), strict=True):
                ids += tail
                for n, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    for column, value in zip(rows, (doc, n, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def patterns(counts: np.ndarray) -> np.ndarray:
    """Rows of three lengths (0: none) that fill a sequence exactly; of many, those of the most frequent lengths."""
    size = len(counts) - 1
    there = np.flatnonzero(counts[:size])
    there = there[there > 0]
    found = [[(a, size - a, 0) for a in there if a >= size - a and counts[size - a]]]
    # Triples: the more frequent the rarest of the three lengths, the sooner.
    order = there[np.argsort(-counts[there], kind="stable")]
    half = order[: int(np.sqrt(6 * PATTERNS)) * 3]
    a, b = np.meshgrid(half, half)
    a, b = a.ravel(), b.ravel()
    c = size - a - b
    fit = (c > 0) & (a >= b) & (b >= c)
    a, b, c = a[fit], b[fit], c[fit]
    fit = counts[c] > 0
    a, b, c = a[fit], b[fit], c[fit]
    best = np.argsort(-np.minimum(np.minimum(counts[a], counts[b]), counts[c]), kind="stable")[:PATTERNS]
    found.append(list(zip(a[best], b[best], c[best], strict=True)))
    rows = [p for part in found for p in part]
    return np.array(rows, np.int64).reshape(-1, 3)


def fitted(rows: np.ndarray, counts: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """Non-negative repeat counts of the patterns whose use of lengths is nearest to the histogram, by coordinate descent."""
    left, out = counts.astype(float).tolist(), [0.0] * len(rows)
    sparse = []
    for row in rows.tolist():
        uses: dict[int, int] = {}
        for n in row:
            if n:
                uses[n] = uses.get(n, 0) + 1
        sparse.append((list(uses.items()), sum(k * k for k in uses.values())))
    for _ in range(sweeps):
        moved = 0.0
        for j, (uses, norm) in enumerate(sparse):
            step = 0.0
            for n, k in uses:
                step += k * left[n]
            step = max(-out[j], step / norm)
            if step:
                out[j] += step
                moved = max(moved, abs(step))
                for n, k in uses:
                    left[n] -= k * step
        if moved < 0.25:
            break
    return np.array(out)


def plan(counts: np.ndarray) -> list[tuple[list[tuple[int, int]], int]]:
    """Groups of equal sequences: ([(length, pieces of it)], how many sequences) that hold the histogram's pieces exactly."""
    size = len(counts) - 1
    left = counts.astype(np.int64).copy()
    groups: list[tuple[list[tuple[int, int]], int]] = []
    if left[size]:
        groups.append(([(size, 1)], int(left[size])))
        left[size] = 0
    rows = patterns(left)
    for row, times in zip(rows.tolist(), np.floor(fitted(rows, left) + 1e-9).astype(np.int64).tolist(), strict=True):
        uses: dict[int, int] = {}
        for n in row:
            if n:
                uses[n] = uses.get(n, 0) + 1
        times = min([times, *(int(left[n]) // k for n, k in uses.items())])
        if times > 0:
            groups.append((list(uses.items()), times))
            for n, k in uses.items():
                left[n] -= k * times
    return groups + _best_fit(left)


def _best_fit(left: np.ndarray) -> list[tuple[list[tuple[int, int]], int]]:
    """Best fit, longest first, of a histogram; sequences with equal contents move together."""
    size = len(left) - 1
    room: dict[int, list[tuple[tuple, int]]] = {}
    open_rooms = np.zeros(size + 1, bool)
    for n in range(size, 0, -1):
        todo = int(left[n])
        while todo:
            fits = np.flatnonzero(open_rooms[n:])
            if not len(fits):
                each = size // n
                many, rest = divmod(todo, each)
                for k, times in ((each, many), (rest, 1 if rest else 0)):
                    if times:
                        room.setdefault(size - n * k, []).append((((n, k),), times))
                        open_rooms[size - n * k] = True
                break
            space = int(fits[0]) + n
            contents, times = room[space].pop()
            if not room[space]:
                open_rooms[space] = False
            each = min(space // n, todo)
            used = min(times, todo // each)
            if used < times:
                room.setdefault(space, []).append((contents, times - used))
                open_rooms[space] = True
            room.setdefault(space - n * each, []).append(((*contents, (n, each)), used))
            open_rooms[space - n * each] = True
            todo -= used * each
    return [(list(contents), times) for same in room.values() for contents, times in same]


def slots(groups: list[tuple[list[tuple[int, int]], int]]) -> np.ndarray:
    """Where the pieces of a length go, by rank: sorted rows (length, first rank, pieces per sequence, first sequence, offset)."""
    ranks: dict[int, int] = {}
    rows, first = [], 0
    for contents, times in groups:
        offset = 0
        for n, k in contents:
            rows.append((n, ranks.get(n, 0), k, first, offset))
            ranks[n] = ranks.get(n, 0) + k * times
            offset += n * k
        first += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def packed(docs: DataFrame, path: str, size: int = SIZE, end: int = END, memo: int = MEMO) -> DataFrame:
    """Pieces with the sequence and the offset that they get; other columns of ``docs`` are left out."""
    cut = written(pieces(docs, path, size, end, memo), "packing-pieces")
    counts = np.zeros(size + 1, np.int64)
    for length, n in cut.groupBy("length").count().collect():  # one row per length, at most ``size``
        counts[length] = n
    table = slots(plan(counts))
    salts = max(1, min(4096, -(-int(counts.max(initial=0)) // PER_TASK)))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    before = salted.groupBy("length", "salt").count()
    before = before.select("length", "salt", (F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "start")) - 1
    ranked = salted.withColumn("own", own).join(before, ["length", "salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("own") + F.col("before")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (table[:, 0] << 48) | table[:, 1]
        for batch in batches:
            length, rank = batch.column(3).to_numpy(zero_copy_only=False), batch.column(5).to_numpy(zero_copy_only=False)
            at = table[np.searchsorted(keys, (length << 48) | rank, "right") - 1] if batch.num_rows else table[:0]
            nth = rank - at[:, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(at[:, 3] + nth // np.maximum(at[:, 2], 1)), pa.array(at[:, 4] + nth % np.maximum(at[:, 2], 1) * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, PIECES + ", sequence_id long, offset long")
