"""Substring deduplication by paragraph MinHash banding.

A text's paragraphs are of three sorts:

- its lines of ``LINE`` words or more;
- passages cut where the content says, since repeated ones needn't begin or end at a line: of each run of ``SPREAD`` word shingles the one with
  the lowest hash is an anchor, and a passage of ``SHORT`` words or more reaches from one anchor to the next, the next anchor's words included
  for comparison. Equal stretches of ``2 * SPREAD + WORDS`` words have an anchor-to-anchor passage in common wherever they lie;
- a whole text of fewer than ``SHORT`` words, by its words' hash.

1. Each paragraph's shingles get minima under several hash functions, ``ROWS`` to a band; as many bands as it takes that
   similar paragraphs (Jaccard ``LEAST`` per cent) share one with probability RECALL. Band keys are grouped by hash range.
2. Paragraphs that share a band key with another text's are candidates. Equal paragraphs are one class; different ones that
   collide meet in each band key they share, and exact Jaccard similarities are verified there (by the tree of the n-gram
   Jaccard join, which leaves out pairs that are connected already, and deals large groups out as pairs of parts).
3. Verified links close to components. Of each document, found paragraphs that touch or overlap form stretches; those of stretches under ``LINE`` words
   (but for whole texts) are left out, as headings and set phrases are no repeated passages. A component that reaches two documents
   keeps its paragraphs in the smallest doc_id.

Defined results: null text is empty; texts without words are never repeated; a null doc_id is later than any other; repeated rows with
one doc_id don't repeat each other; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import carried, lean, restored, slices, written
from .components import connected
from .hashing import BASE, FOLDED, SPACE, U, chunks, mixed, powers, prefix, window
from .jaccard import _tree_links
from .suffix import FLAGS, GONE, LAST, LOOK, PART, _by_text, _columns, _eight, _filled, _flagged, _forget, _once, _parts, _place, _starts, _unpacked, _with

WORDS, LEAST, SPREAD, SHORT, LINE = 5, 75, 22, 10, 15
ROWS, RECALL = 2, 0.99
RANGE = 2_000_000


def bands(least: int = LEAST, rows: int = ROWS, recall: float = RECALL) -> int:
    """Bands of ``rows`` minima with which paragraphs of the least similarity collide with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - (least / 100) ** rows))


class Paragraphs(NamedTuple):
    """Of some texts: text number, number in the text, byte range, number and hash of the words, band keys [bands, paragraphs], and shingles with each paragraph's first and last (inclusive)."""

    text: np.ndarray
    nth: np.ndarray
    start: np.ndarray
    end: np.ndarray
    many: np.ndarray
    words: np.ndarray
    keys: np.ndarray
    shingles: np.ndarray
    first: np.ndarray
    last: np.ndarray


_SEEDS = mixed(np.arange(1, 65, dtype=np.uint64) * BASE) | U(1)


def _anchors(shingles: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Shingle numbers that are the lowest of a run of SPREAD; low, high: each text's range of shingles."""
    key = (shingles & U(0xFFFFFFFF00000000)) | np.arange(len(shingles), dtype=np.uint64)
    found = [key[:0]]
    least, reach = key, 1
    while reach * 2 <= SPREAD:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if len(key) >= SPREAD:
        least = np.minimum(least[: len(least) - (SPREAD - reach)], least[SPREAD - reach :])
        at = np.arange(len(least))
        text = np.searchsorted(high, at, "right")
        text = np.minimum(text, len(high) - 1)
        found.append(least[(at >= low[text]) & (at + SPREAD <= high[text])])
    found += [key[a:b].min(keepdims=True) for a, b in zip(low, high, strict=True) if 0 < b - a < SPREAD]
    return np.unique((np.concatenate(found) & U(0xFFFFFFFF)).astype(np.int64))


def paragraphs(texts: list[bytes], many: int) -> Iterator[tuple[int, int, Paragraphs]]:
    """(first text, last text, paragraphs) chunk by chunk; ``many`` bands."""
    for first, last in chunks(texts):
        part = texts[first:last]
        raw = np.frombuffer(b"\n".join(part) + b"\n", np.uint8)
        sizes = np.array([len(t) + 1 for t in part])
        gap = SPACE[raw]
        begin = np.flatnonzero(~gap & np.concatenate(([True], gap[:-1])))
        close = np.flatnonzero(gap & np.concatenate(([False], ~gap[:-1])))
        word = mixed(window(prefix(raw, FOLDED), begin, close) + (close - begin).astype(np.uint64))
        bounds = np.concatenate(([0], np.searchsorted(begin, np.cumsum(sizes))))
        whole = np.zeros(max(len(word) - WORDS + 1, 0), np.uint64)
        for k in range(WORDS):
            whole = whole * BASE + word[k : k + len(whole)]
        whole = mixed(whole)
        low, high = bounds[:-1], np.maximum(bounds[1:] - WORDS + 1, bounds[:-1])
        # Shingles across texts are no anchors: ranges are set so that runs with them are left out.
        anchors = _anchors(whole, np.minimum(low, len(whole)), np.minimum(high, len(whole)))
        some = np.flatnonzero(high > low)
        cuts = np.unique(np.concatenate((anchors, low[some])))
        owner = np.searchsorted(bounds[1:], cuts, "right")
        inner = np.concatenate((owner[1:] == owner[:-1], [False])) if len(cuts) else np.zeros(0, bool)
        until = np.where(inner, np.append(cuts[1:], 0), bounds[1:][owner]) if len(cuts) else cuts
        last_word = np.minimum(np.where(inner, until, high[owner] - 1) + WORDS, bounds[1:][owner]) if len(cuts) else cuts
        keep = last_word - cuts >= SHORT
        text_end = np.cumsum(sizes) - 1
        stop = np.where(until < bounds[1:][owner], begin[np.minimum(until, len(begin) - 1)], text_end[owner]) if len(cuts) else cuts
        line = np.searchsorted(np.flatnonzero(raw == 10), begin)
        lines = np.flatnonzero(np.concatenate((np.ones(min(len(line), 1), bool), line[1:] != line[:-1])))
        line_end = np.append(lines[1:], len(line))[: len(lines)]
        long = line_end - lines >= LINE
        few = np.flatnonzero((np.diff(bounds) > 0) & (np.diff(bounds) < SHORT))
        cuts = np.concatenate((cuts[keep], lines[long], bounds[:-1][few]))
        last_word = np.concatenate((last_word[keep], line_end[long], bounds[1:][few]))
        stop = np.concatenate((stop[keep], close[line_end[long] - 1], close[bounds[1:][few] - 1]))
        if not len(cuts):
            none = np.zeros(0, np.int64)
            yield first, last, Paragraphs(none, none, none, none, none, none.astype(np.uint64), np.zeros((many, 0), np.uint64), whole, none, none)
            continue
        owner = np.searchsorted(bounds[1:], cuts, "right")
        order = np.lexsort((last_word, cuts, owner))
        cuts, last_word, stop, owner = cuts[order], last_word[order], stop[order], owner[order]
        last_shingle = last_word - WORDS
        nth = np.arange(len(cuts)) - np.searchsorted(owner, owner)
        sums = np.zeros(len(word) + 1, np.uint64)
        np.cumsum(word * powers(len(word) + 1)[0][: len(word)], out=sums[1:])
        words = mixed(window(sums, cuts, last_word) + (last_word - cuts).astype(np.uint64))
        keys = np.zeros((many, len(cuts)), np.uint64)
        pairs = np.stack([cuts, np.maximum(last_shingle, cuts) + 1], 1).ravel()
        padded = np.append(whole, U(0xFFFFFFFFFFFFFFFF))
        for b in range(many):
            both = np.full(len(cuts), U(b + 1))
            for r in range(ROWS):
                minima = np.minimum.reduceat(mixed(padded ^ _SEEDS[b * ROWS + r]), np.minimum(pairs, len(padded) - 1))[::2]
                both = mixed(both * BASE + minima)
            keys[b] = np.where(last_shingle < cuts, mixed(words ^ _SEEDS[b]), both)
        offset = np.concatenate(([0], np.cumsum(sizes)))[owner]
        yield first, last, Paragraphs(owner + first, nth, begin[cuts] - offset, stop - offset, last_word - cuts, words, keys, whole, cuts, last_shingle)


def _band_keys(parts: int, many: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, keys, ids = _once(*_columns(batch))
            found = [p for *_, p in paragraphs(texts, many)]
            if found:
                owner = np.concatenate([np.repeat(p.text, many) for p in found])
                band = np.concatenate([p.keys.T.ravel() for p in found])
                words = np.concatenate([np.repeat(p.words, many) for p in found])
                if len(owner):
                    yield _parts(_place(band, parts), owner, keys, ids, band, words, parts)

    return rows


def _collisions(table: pa.Table, buckets: int) -> pa.Table:
    """In a hash range: paragraphs with a band key of another text (GONE: of equal words only; LOOK: of other words)."""
    keys, _, nth = _unpacked(table)
    band, words = (np.concatenate([_eight(x) for x in table[c].to_pylist()]) for c in ("first", "second"))
    order = np.argsort(band)
    at = _starts(band[order])
    spread = np.diff(np.append(at, len(order)))
    own, said = keys[order], words[order]
    several = np.repeat(np.minimum.reduceat(own, at) != np.maximum.reduceat(own, at), spread)
    differ = np.repeat(np.minimum.reduceat(said, at) != np.maximum.reduceat(said, at), spread)
    flags = np.where(several, np.where(differ, LOOK, GONE), 0).astype(np.uint8)
    return _flagged(table["part"][0].as_py(), own, nth[order], flags, buckets)


def _verdicts(p: Paragraphs, first: int, verdicts: list, whole: list, parts: int, many: int) -> np.ndarray:
    """Each paragraph's highest flag over its bands; a text that other documents have whole is flagged throughout."""
    owner = np.repeat(p.text, many)
    flags = _filled(_place(p.keys.T.ravel(), parts), owner, {i: verdicts[i] for i in set(p.text.tolist()) if verdicts[i]}, parts)
    out = flags.reshape(-1, many).max(1, initial=0)
    return np.maximum(out, np.array([GONE if whole[t] else 0 for t in p.text.tolist()], np.uint8))


CLASS = "doc_id long, text_key long, paragraph int, start long, end long, words int, class long"


def _candidates(parts: int, many: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, _, _ = _columns(batch)
            text_keys, docs, verdicts, whole = batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()
            some = [i for i in range(len(texts)) if verdicts[i] or whole[i]]
            for first, _, p in paragraphs([texts[i] for i in some], many):
                flags = _verdicts(p, first, [verdicts[i] for i in some], [whole[i] for i in some], parts, many)
                k = np.flatnonzero(flags)
                yield pa.RecordBatch.from_arrays([pa.array([docs[some[t]] for t in p.text[k].tolist()], pa.int64()), pa.array([text_keys[some[t]] for t in p.text[k].tolist()], pa.int64()), pa.array(p.nth[k].astype(np.int32)), pa.array(p.start[k].astype(np.int64)), pa.array(p.end[k].astype(np.int64)), pa.array(p.many[k].astype(np.int32)), pa.array(p.words[k].view(np.int64))], ["doc_id", "text_key", "paragraph", "start", "end", "words", "class"])

    return rows


def _near(parts: int, many: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, _, _ = _columns(batch)
            verdicts = batch.column(3).to_pylist()
            some = [i for i in range(len(texts)) if verdicts[i]]
            for first, _, p in paragraphs([texts[i] for i in some], many):
                flags = _verdicts(p, first, [verdicts[i] for i in some], [False] * len(some), parts, many)
                k = np.flatnonzero((flags == LOOK) & (p.many >= WORDS))
                k = k[np.unique(p.words[k], return_index=True)[1]]
                tokens = [np.unique(p.shingles[p.first[i] : p.last[i] + 1]).tobytes() for i in k.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(p.words[k].view(np.int64)), pa.array(list(p.keys[:, k].T.copy().view(np.int64)), pa.list_(pa.int64())), pa.array(tokens, pa.binary())], ["set_key", "bands", "tokens"])

    return rows


def repeated(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """One row per repeated paragraph: doc_id, paragraph, start, end (bytes), component_id, kept_doc_id, removed."""
    spark, many = docs.sparkSession, bands(least)
    rows = docs.select(F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_key"), F.col("doc_id").cast("long").alias("doc_id"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total * many // (RANGE * 7 * SPREAD // 2)))
    flags = rows.filter(F.octet_length("text") > 0).mapInArrow(_band_keys(parts, many), PART).groupBy("part").applyInArrow(lean(partial(_collisions, buckets=parts)), FLAGS)
    flags = written(_by_text(flags, "flags"), "paragraph-flags")
    _forget(spark)
    copies = rows.groupBy("text_key").agg((F.count_distinct(F.coalesce("doc_id", F.lit(LAST))) > 1).alias("copied")).filter("copied")
    info = written(flags.join(copies, "text_key", "full"), "paragraph-info")
    asked = _with(rows, info, ["flags"]).filter("flags is not null or copied").select("text", "text_key", "doc_id", "flags", F.coalesce("copied", F.lit(False)).alias("copied"))
    found = written(asked.mapInArrow(_candidates(parts, many), CLASS), "paragraph-classes")
    looks = info.filter("look").select("text_key", "flags")
    near = _with(rows, looks, ["flags"]).filter("flags is not null").select("text", "text_key", "doc_id", "flags")
    near = written(near.mapInArrow(_near(parts, many), "set_key long, bands array<long>, tokens binary").dropDuplicates(["set_key"]), "paragraph-near")
    keyed = near.select("set_key", F.explode("bands").alias("root"))
    shared = keyed.groupBy("root").count().filter("count > 1").select("root")
    blocks = written(keyed.join(shared, "root").select(F.col("set_key").alias("key"), "root"), "paragraph-bands")
    roots = connected(_tree_links(near.select("set_key", F.lit(0).alias("n"), "tokens"), blocks, least))
    rooted = found.join(roots.select(F.col("key").alias("class"), "root"), "class", "left").withColumn("component_id", F.coalesce("root", "class"))
    rooted = written(rooted.select("doc_id", "text_key", "paragraph", "start", "end", "words", "component_id"), "paragraph-rooted")
    place = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("paragraph").alias("c"))
    known = F.coalesce("doc_id", F.lit(LAST))
    shared = lambda found: found.groupBy("component_id").agg(F.min(place).alias("first"), F.min(known).alias("low"), F.max(known).alias("high")).filter("low < high").select("component_id", "first")
    long = written(_stretches(rooted.join(shared(rooted).select("component_id"), "component_id", "left_semi")), "paragraph-stretches")
    return long.join(shared(long), "component_id").select("doc_id", "paragraph", "start", "end", "component_id", F.col("first.b").alias("kept_doc_id"), (~F.col("doc_id").eqNullSafe(F.col("first.b"))).alias("removed"))


def _stretches(found: DataFrame) -> DataFrame:
    """The paragraphs that lie in a stretch of LINE words or more of touching ones, or are a whole short text (which has one paragraph, of fewer than SHORT words)."""
    text = Window.partitionBy("doc_id", "text_key")
    before = text.orderBy("start", "end", "paragraph").rowsBetween(Window.unboundedPreceding, -1)
    rows = found.withColumn("_reach", F.max("end").over(before)).withColumn("_new", F.coalesce(F.col("start") > F.col("_reach"), F.lit(True)))
    rows = rows.withColumn("_nth", F.sum(F.col("_new").cast("int")).over(text.orderBy("start", "end", "paragraph").rowsBetween(Window.unboundedPreceding, 0)))
    # Each passage's last WORDS words are the next anchor's, so they count once.
    own = F.greatest(F.col("words") - WORDS, F.lit(0)).cast("long")
    stretch = Window.partitionBy("doc_id", "text_key", "_nth")
    rows = rows.withColumn("_words", F.greatest(F.max("words").over(stretch), F.sum(F.when(F.col("words") < LINE, own)).over(stretch) + WORDS))
    return rows.filter((F.col("words") < SHORT) | (F.col("_words") >= LINE)).select(*found.columns)


def deduplicated(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``docs`` with removed paragraphs cut from their texts (rows are joined by doc_id, and only those that lose something)."""
    cuts = repeated(docs, least).filter("removed").groupBy(F.col("doc_id").alias("_id")).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("_cuts"))  # of one document
    raw = F.col("text").cast("binary")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, c):
        kept = F.substring(raw, (acc["at"] + 1).cast("int"), F.greatest(c["start"] - acc["at"], F.lit(0)).cast("int")).cast("string")
        return F.struct(F.greatest(acc["at"], c["end"]).alias("at"), F.concat(acc["out"], F.array(kept)).alias("out"))

    done = F.aggregate("_cuts", start, step)
    text = F.concat(F.array_join(done["out"], ""), F.substring(raw, (done["at"] + 1).cast("int"), F.octet_length("text")).cast("string"))
    own = carried(docs, "doc_id", "text")
    out = own.join(cuts, own["doc_id"].cast("long") == F.col("_id"), "left")
    return out.select(*restored(out, docs.columns, text=F.when(F.col("_cuts").isNull(), F.col("text")).otherwise(text)))
