"""Removal of long byte strings that an earlier document holds, by hashes at winnowed anchors and of single windows.

This stands in place of distributed prefix doubling: nothing is ranked anew at growing offsets, and positions aren't sorted by
Spark. Ranks below are hashes. Of each window of LENGTH bytes, the anchor is the position whose ``STEP``-byte string has the
lowest hash. Equal windows have equal anchors, so nothing is lost:

1. Ranks of STEP bytes at anchors, sorted by hash range: anchors whose string is in one document only drop out.
2. Ranks of pairs (string at the anchor, the whole stretch of windows that have this anchor): where an earlier document has
   the same pair, all these windows go. Of anchors with equal strings but different stretches, the earliest of each stretch go on.
3. Ranks of their single windows of LENGTH bytes: a window goes if an earlier document has it.

Each step's verdicts return as a byte per anchor or window, in the order in which a text has them; the texts themselves
aren't shuffled as long as the verdicts are few enough to broadcast (BROADCAST_BYTES, measured), and joined by shuffle beyond.

Equal texts are one to steps 1 to 3, under the smallest doc_id that has the text; its other documents lose all windows.
A rank is a hash: 48 bits within a hash range for each half of a pair, 64 bits for windows and texts.

Defined results: null text is empty; a text under LENGTH bytes loses nothing; a null doc_id is later than any other, and no
null is earlier than another; repeated rows with one doc_id don't remove each other; an empty table gives an empty result.
"""

from __future__ import annotations

import gc
import hashlib
import time
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, slices, written
from .hashing import BASE, U, chunks, mixed, prefix, window

LENGTH, STEP = 50, 20
#: Anchors or windows of a hash range; bytes of verdicts that are broadcast at most.
RANGE, BROADCAST_BYTES = 1_200_000, 10 << 20
LAST = (1 << 63) - 1
GONE, LOOK = 1, 2
PART = "part int, keys binary, ids binary, counts binary, first binary, second binary"


class Anchors(NamedTuple):
    """Of some texts: text number, first window, windows, rank of the string at the anchor, rank of the stretch."""

    text: np.ndarray
    start: np.ndarray
    many: np.ndarray
    rank: np.ndarray
    stretch: np.ndarray


def anchors(texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, Anchors]]:
    """(first text, last text, prefix sums, anchors) chunk by chunk; starts count from the chunk's first byte."""
    span = LENGTH - STEP + 1
    for first, last in chunks(texts):
        part = texts[first:last]
        raw = np.frombuffer(b"".join(part), np.uint8)
        sums = prefix(raw)
        ends = np.cumsum([len(t) for t in part])
        if len(raw) < LENGTH:
            none = np.zeros(0, np.int64)
            yield first, last, sums, Anchors(none, none, none, none.astype(np.uint64), none.astype(np.uint64))
            continue
        at = np.arange(len(raw) - STEP + 1)
        rank = mixed(window(sums, at, at + STEP))
        # The lowest hash of each window, the leftmost of equals: minima over stretches that double.
        low, reach = (rank & U(0xFFFFFFFF00000000)) | at.astype(np.uint64), 1
        while reach * 2 <= span:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        if reach < span:
            low = np.minimum(low[: len(low) - (span - reach)], low[span - reach :])
        own = (low & U(0xFFFFFFFF)).astype(np.int64)
        begin = np.arange(len(own))
        text = np.searchsorted(ends, begin, "right")
        inside = begin + LENGTH <= ends[np.minimum(text, len(ends) - 1)]
        begin, own, text = begin[inside], own[inside], text[inside]
        new = np.flatnonzero(np.concatenate((np.ones(min(len(own), 1), bool), (own[1:] != own[:-1]) | (text[1:] != text[:-1]))))
        start = begin[new]
        many = np.diff(np.append(new, len(own)))
        stretch = mixed(window(sums, start, start + many + LENGTH - 1) + (own[new] - start).astype(np.uint64) * U(1 << 20) + many.astype(np.uint64))
        yield first, last, sums, Anchors(text[new] + first, start, many, rank[own[new]], stretch)


def _place(rank: np.ndarray, parts: int) -> np.ndarray:
    """The hash range of each rank; ranks are spread anew, since anchors have the lowest of theirs."""
    return ((mixed(rank ^ BASE) >> U(32)) * U(parts) >> U(32)).astype(np.int64)


def _six(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _eight(six: bytes) -> np.ndarray:
    out = np.zeros((len(six) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(six, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _parts(place: np.ndarray, owner: np.ndarray, keys: np.ndarray, ids: np.ndarray, first: np.ndarray, second: np.ndarray | None, parts: int) -> pa.RecordBatch:
    """A row for each hash range: keys and ids of the texts with ranks there, how many each has, the ranks in text order."""
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    edges = np.searchsorted(place, np.arange(parts + 1))
    rows = []
    for p in np.flatnonzero(np.diff(edges)).tolist():
        a, b = edges[p], edges[p + 1]
        texts, counts = np.unique(owner[a:b], return_counts=True)
        own = order[a:b]
        rows.append((p, keys[texts].tobytes(), ids[texts].tobytes(), counts.astype(np.uint32).tobytes(), first[own].tobytes() if second is None else _six(first[own]), b"" if second is None else _six(second[own])))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int32() if i == 0 else pa.binary()) for i in range(6)], [f.split()[0] for f in PART.split(", ")])


def _once(texts: list[bytes], keys: np.ndarray, ids: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Each distinct text of a batch with its least id."""
    order = np.lexsort((ids, keys))
    first = order[np.concatenate((np.ones(min(len(keys), 1), bool), keys[order][1:] != keys[order][:-1]))]
    return [texts[i] for i in first], keys[first], ids[first]


def _columns(batch: pa.RecordBatch) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Texts, their keys, and ids (null: LAST) of the first three columns."""
    return [(t or "").encode() for t in batch.column(0).to_pylist()], np.array(batch.column(1).to_pylist(), np.int64), np.array([LAST if i is None else i for i in batch.column(2).to_pylist()], np.int64)


def _first_ranks(parts: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, keys, ids = _once(*_columns(batch))
            found = [a for *_, a in anchors(texts)]
            if found:
                a = Anchors(*map(np.concatenate, zip(*found, strict=True)))
                yield _parts(_place(a.rank, parts), a.text, keys, ids, a.rank, a.stretch, parts)

    return rows


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, id and place within its text, of each rank of a hash range."""
    joined = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in table[name].to_pylist()])
    counts = joined("counts", np.uint32).astype(np.int64)
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.repeat(joined("keys", np.int64), counts), np.repeat(joined("ids", np.int64), counts), nth


def _starts(*sorted_keys: np.ndarray) -> np.ndarray:
    new = np.zeros(max(len(sorted_keys[0]) - 1, 0), bool)
    for k in sorted_keys:
        new |= k[1:] != k[:-1]
    return np.flatnonzero(np.concatenate((np.ones(min(len(sorted_keys[0]), 1), bool), new)))


FLAGS = "bucket int, part int, keys binary, counts binary, places binary, flags binary"


def _flagged(part: int, keys: np.ndarray, nth: np.ndarray, flags: np.ndarray, buckets: int) -> pa.Table:
    """The flags other than zero of a hash range: a row per bucket of texts, with each text's places (in its own order) and flags."""
    some = flags > 0
    keys, nth, flags = keys[some], nth[some], flags[some]
    bucket = _place(keys.view(np.uint64), buckets)
    order = np.lexsort((nth, keys, bucket))
    keys, nth, flags, bucket = keys[order], nth[order], flags[order], bucket[order]
    once = _starts(keys, nth)
    keys, nth, flags, bucket = keys[once], nth[once], flags[once], bucket[once]
    text = _starts(keys)
    counts = np.diff(np.append(text, len(keys)))
    rows = []
    for b in np.unique(bucket).tolist():
        low, high = np.searchsorted(bucket, (b, b + 1))
        own = slice(*np.searchsorted(text, (low, high)))
        rows.append((b, part, keys[text[own]].tobytes(), counts[own].astype(np.uint32).tobytes(), nth[low:high].astype(np.uint32).tobytes(), flags[low:high].tobytes()))
    return pa.table({f.split()[0]: pa.array([r[i] for r in rows], pa.int32() if i < 2 else pa.binary()) for i, f in enumerate(FLAGS.split(", "))})


def _gathered(table: pa.Table) -> pa.Table:
    """All hash ranges' flags of a bucket of texts, as one row per text."""
    joined = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in table[name].to_pylist()])
    counts, places, flags = joined("counts", np.uint32), joined("places", np.uint32), joined("flags", np.uint8)
    keys = np.repeat(joined("keys", np.int64), counts)
    part = np.repeat(np.array(table["part"].to_pylist(), np.uint32), [len(x) for x in table["flags"].to_pylist()])
    order = np.lexsort((places, part, keys))
    keys, part, places, flags = keys[order], part[order], places[order], flags[order]
    at = _starts(keys)
    cuts = list(zip(at.tolist(), [*at[1:].tolist(), len(keys)], strict=True))
    look = np.maximum.reduceat(flags, at) == LOOK if len(at) else np.zeros(0, bool)
    own = {n: [x[a:b].tobytes() for a, b in cuts] for n, x in (("parts", part), ("places", places), ("flags", flags))}
    return pa.table({"text_key": pa.array(keys[at], pa.int64()), "own": pa.array([dict(zip(own, v, strict=True)) for v in zip(*own.values(), strict=True)], pa.struct([(n, pa.binary()) for n in own])), "look": pa.array(look)})


def _ranked_pairs(table: pa.Table, buckets: int) -> pa.Table:
    """Steps 1 and 2 in a hash range."""
    keys, ids, nth = _unpacked(table)
    rank, stretch = (np.concatenate([_eight(x) for x in table[c].to_pylist()]) for c in ("first", "second"))
    order = np.argsort(rank)
    at = _starts(rank[order])
    own = ids[order]
    several = np.minimum.reduceat(own, at) != np.maximum.reduceat(own, at)
    order = order[np.repeat(several, np.diff(np.append(at, len(order))))]
    keys, ids, nth, rank, stretch = (x[order] for x in (keys, ids, nth, rank, stretch))
    _, text = np.unique(keys, return_inverse=True)
    least = np.full(text.max(initial=-1) + 1, LAST, np.int64)
    np.minimum.at(least, text, ids)
    ids = least[text]  # equal texts of several batches count under their least id
    order = np.lexsort((ids, stretch, rank))
    keys, ids, nth, rank, stretch = (x[order] for x in (keys, ids, nth, rank, stretch))
    pair, string = _starts(rank, stretch), _starts(rank)
    if not len(pair):
        return _flagged(0, keys, nth, np.zeros(0, np.uint8), buckets)
    earliest = np.repeat(np.minimum.reduceat(ids, pair), np.diff(np.append(pair, len(ids))))
    pairs = np.searchsorted(pair, np.append(string, len(ids)))
    low, high = np.minimum.reduceat(ids[pair], pairs[:-1]), np.maximum.reduceat(ids[pair], pairs[:-1])
    differ = np.repeat((np.diff(pairs) > 1) & (low != high), np.diff(np.append(string, len(ids))))
    flags = np.where(ids > earliest, GONE, np.where(differ, LOOK, 0)).astype(np.uint8)
    return _flagged(table["part"][0].as_py(), keys, nth, flags, buckets)


def _ranked_windows(table: pa.Table, buckets: int) -> pa.Table:
    """Step 3 in a hash range."""
    keys, ids, nth = _unpacked(table)
    rank = np.concatenate([np.frombuffer(x, np.uint64) for x in table["first"].to_pylist()])
    order = np.lexsort((ids, rank))
    rank, ids = rank[order], ids[order]
    at = _starts(rank)
    flags = (ids > np.repeat(ids[at], np.diff(np.append(at, len(ids))))).astype(np.uint8) * GONE
    return _flagged(table["part"][0].as_py(), keys[order], nth[order], flags, buckets)


def _by_text(flags: DataFrame, name: str) -> DataFrame:
    """One row per text with its flags of all hash ranges."""
    return flags.groupBy("bucket").applyInArrow(lean(_gathered), "text_key long, own struct<parts:binary,places:binary,flags:binary>, look boolean").withColumnRenamed("own", name)


def _with(docs: DataFrame, info: DataFrame, names: list[str]) -> DataFrame:
    size = info.agg(F.sum(sum((F.coalesce(9 * F.octet_length(F.col(n)["flags"]), F.lit(0)) for n in names), F.lit(64)))).first()[0] or 0
    return docs.join(F.broadcast(info) if size <= BROADCAST_BYTES else info, "text_key", "left")


def _filled(place: np.ndarray, owner: np.ndarray, flags: dict[int, dict], parts: int) -> np.ndarray:
    """The verdict of each rank, put back by the order that _parts() used; flags: by owner."""
    out = np.zeros(len(place), np.uint8)
    if not flags or not len(place):
        return out
    code = owner.astype(np.int64) * parts + place
    order = np.argsort(code, kind="stable")
    joined = lambda name, kind: [np.frombuffer(f[name], kind) for f in flags.values()]
    said = joined("flags", np.uint8)
    wanted = np.repeat(np.fromiter(flags, np.int64), [len(x) for x in said]) * parts + np.concatenate(joined("parts", np.uint32))
    out[order[np.searchsorted(code[order], wanted) + np.concatenate(joined("places", np.uint32))]] = np.concatenate(said)
    return out


def _windows(a: Anchors, look: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, start) of the windows of the anchors to look at."""
    picked = np.flatnonzero(look)
    many = a.many[picked]
    anchor = np.repeat(picked, many)
    return anchor, a.start[anchor] + np.arange(len(anchor)) - np.repeat(np.cumsum(many) - many, many)


def _second_ranks(parts: int, window_parts: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, keys, ids = _columns(batch)
            verdicts = batch.column(3).to_pylist()
            owners, ranks = [], []
            for first, last, sums, a in anchors(texts):
                flags = _filled(_place(a.rank, parts), a.text, {i: verdicts[i] for i in range(first, last) if verdicts[i]}, parts)
                anchor, start = _windows(a, flags == LOOK)
                owners.append(a.text[anchor])
                ranks.append(mixed(window(sums, start, start + LENGTH)))
            if owners:
                rank = np.concatenate(ranks)
                yield _parts(_place(rank, window_parts), np.concatenate(owners), keys, ids, rank, None, window_parts)

    return rows


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:long,end:long>>"


def _final(parts: int, window_parts: int, spans: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, _, ids = _columns(batch)
            verdicts, seconds, least = batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist()
            copy = [l is not None and l < i for l, i in zip(least, ids.tolist(), strict=True)]
            runs: dict[int, list] = {}
            busy = [i for i in range(len(texts)) if verdicts[i] and not copy[i]]
            for first, last, sums, a in anchors([texts[i] for i in busy]):
                flags = _filled(_place(a.rank, parts), a.text, {n: verdicts[busy[n]] for n in range(first, last)}, parts)
                anchor, start = _windows(a, flags == LOOK)
                again = _filled(_place(mixed(window(sums, start, start + LENGTH)), window_parts), a.text[anchor], {n: seconds[busy[n]] for n in range(first, last) if seconds[busy[n]]}, window_parts)
                gone = flags == GONE
                begins = np.concatenate((a.start[gone], start[again == GONE]))
                ends = np.concatenate((a.start[gone] + a.many[gone] - 1 + LENGTH, start[again == GONE] + LENGTH))
                owner = np.concatenate((a.text[gone], a.text[anchor][again == GONE]))
                offset = np.cumsum([0] + [len(texts[busy[n]]) for n in range(first, last)])
                for n in np.unique(owner).tolist():
                    mine = owner == n
                    order = np.argsort(begins[mine], kind="stable")
                    b, e = begins[mine][order] - offset[n - first], np.maximum.accumulate(ends[mine][order]) - offset[n - first]
                    new = np.flatnonzero(np.concatenate(([True], b[1:] > e[:-1])))
                    runs[busy[n]] = list(zip(b[new].tolist(), e[np.append(new[1:], len(b)) - 1].tolist(), strict=True))
            out = []
            for i, text in enumerate(texts):
                own = [(0, len(text))] if copy[i] and len(text) >= LENGTH else runs.get(i, [])
                at, kept = 0, []
                for b, e in own:
                    kept.append(text[at:b])
                    at = e
                kept = b"".join([*kept, text[at:]])
                out.append((len(text), len(text) - len(kept), len(own), hashlib.sha256(kept).hexdigest(), [{"start": b, "end": e} for b, e in own] if spans else None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(2), *(pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])

    return rows


def _forget(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps whose results are written: its cleaner follows the driver's garbage collections."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def removed(docs: DataFrame, spans: bool = True) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if ``spans``, the removed byte ranges."""
    spark = docs.sparkSession
    rows = docs.select(F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_key"), F.col("doc_id").cast("long").alias("doc_id"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // (RANGE * (LENGTH - STEP + 2) // 2)))
    flags = rows.filter(F.octet_length("text") >= LENGTH).mapInArrow(_first_ranks(parts), PART).groupBy("part").applyInArrow(lean(partial(_ranked_pairs, buckets=parts)), FLAGS)
    flags = written(_by_text(flags, "flags"), "suffix-pairs")
    _forget(spark)
    copies = rows.groupBy("text_key").agg(F.min("doc_id").alias("least_id"), F.max(F.coalesce("doc_id", F.lit(LAST))).alias("last")).filter("least_id < last").drop("last")
    info = written(flags.join(copies, "text_key", "full"), "suffix-info")
    looks = info.filter("look").select("text_key", "flags", "least_id")
    # Only the earliest document of each text stands for it.
    asked = _with(rows, looks, ["flags"]).filter(F.col("flags").isNotNull() & (F.col("least_id").isNull() | (F.col("doc_id") == F.col("least_id"))))
    seen = asked.select("text", "text_key", "doc_id", "flags").mapInArrow(_second_ranks(parts, parts), PART).groupBy("part").applyInArrow(lean(partial(_ranked_windows, buckets=parts)), FLAGS)
    seen = written(_by_text(seen, "again"), "suffix-windows")
    _forget(spark)
    every = written(info.drop("look").join(seen.drop("look"), "text_key", "left"), "suffix-verdicts")
    return _with(rows, every, ["flags", "again"]).select("text", "text_key", "doc_id", "flags", "again", "least_id").mapInArrow(_final(parts, parts, spans), OUT)
