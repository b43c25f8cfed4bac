"""Removal of long byte strings that an earlier document holds, by distributed prefix doubling.

Each position of each text gets a rank: first of the ``start`` bytes from there, then of pairs (rank here, rank ``offset`` bytes further) at
growing offsets, until ranks stand for ``LENGTH`` bytes. A round groups the pairs of all positions, drops those that lie in one document only, lets Spark sort
the others by range, and numbers them in sorted order; these ordinals are the next round's ranks. A position that drops out can't begin a string that
repeats, so its pairs end with it. In the last round each rank knows its smallest doc_id, and positions of later documents are removed.

Byte strings are compared as they are; only texts are named by a 64-bit hash. It shuffles rows for positions, round after round, so it costs many times what suffix.removed()
does, which the query uses; both give the same rows.

Defined results: null text is empty; a text under LENGTH bytes loses nothing; a null doc_id is later than any other, and no
null is earlier than another; repeated rows with one doc_id don't remove each other; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, written
from .suffix import LAST, LENGTH, OUT


def _positions(texts: DataFrame, start: int) -> DataFrame:
    """(row, id, pos, string): the ``start`` bytes at each position of each text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=1 << 18):
            for raw, row, doc in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                n = max(len(raw) - start + 1, 0)
                flat = np.frombuffer(raw, np.uint8)
                for at in range(0, n, 1 << 16):
                    many = min(n - at, 1 << 16)
                    strings = np.lib.stride_tricks.sliding_window_view(flat[at : at + many + start - 1], start)
                    found = pa.FixedSizeBinaryArray.from_buffers(pa.binary(start), many, [None, pa.py_buffer(np.ascontiguousarray(strings).tobytes())])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(many, row)), pa.array(np.full(many, doc)), pa.array(np.arange(at, at + many)), found.cast(pa.binary())], ["row", "id", "pos", "string"])

    return texts.select("raw", "row", "id").mapInArrow(rows, "row long, id long, pos long, string binary")


def _ranked(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` whose keys lie in several documents, with the keys' ordinal in sorted order (``rank``) and their least id."""
    groups = rows.groupBy(*keys).agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most").drop("most")
    numbered = written(groups.orderBy(*keys).withColumn("ordinal", F.monotonically_increasing_id()), "doubling-ranks")
    return written(rows.join(numbered, list(keys)).select("row", "id", "pos", F.col("ordinal").alias("rank"), "least"), "doubling-positions")


def _after(ranks: DataFrame, offset: int) -> DataFrame:
    """Pairs of the rank at each position and the rank ``offset`` bytes further in the same text."""
    further = ranks.select("row", (F.col("pos") - offset).alias("pos"), F.col("rank").alias("next"))
    return ranks.select("row", "id", "pos", "rank").join(further, ["row", "pos"])


def removed(docs: DataFrame, start: int = 25, length: int = LENGTH) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed byte ranges, as suffix.removed() gives them."""
    text: Column = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))
    texts = rows.dropDuplicates(["doc_id", "text"]).filter(F.octet_length("text") >= length)
    texts = texts.select(F.col("text").cast("binary").alias("raw"), "row", F.coalesce("doc_id", F.lit(LAST)).alias("id"))
    ranks, reach = _ranked(_positions(texts, start), "string"), start
    while reach < length:
        offset = min(reach, length - reach)
        ranks, reach = _ranked(_after(ranks, offset), "rank", "next"), reach + offset
    gone = ranks.filter(F.col("least") < F.col("id")).select("row", "pos").distinct()
    order = Window.partitionBy("row").orderBy("pos")
    new = F.coalesce((F.col("pos") - F.lag("pos").over(order) > length).cast("int"), F.lit(1))
    runs = gone.withColumn("new", new).withColumn("run", F.sum("new").over(order)).groupBy("row", "run").agg(F.min("pos").alias("start"), (F.max("pos") + length).alias("end"))
    runs = runs.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("removed"))  # of one text

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for t, own in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw, at, kept, own = t.encode(), 0, [], own or []
                for r in own:
                    kept.append(raw[at : r["start"]])
                    at = r["end"]
                kept = b"".join([*kept, raw[at:]])
                out.append((len(raw), len(raw) - len(kept), len(own), hashlib.sha256(kept).hexdigest(), own))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds))], [f.split()[0] for f in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed")])

    return rows.join(runs, "row", "left").select("text", "doc_id", "removed").mapInArrow(cut, OUT)
