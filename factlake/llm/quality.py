"""Quality rules and an isolation forest over their statistics.

Executors count each text's rule statistics once and write them. All labelled documents that pass the base rules take part in learning: one half
(by id hash) grows the trees of an isolation forest, each from ROWS of them that it draws at random from the whole half, which is what such a tree is;
its anomaly score comes from path lengths over random splits of ratios of the counts. The ratios that the forest sees, and the score above which a
document goes, are calibrated on the whole other half, which the trees haven't seen: those that tell bad from good best while at least KEEP of the good
ones stay. Executors score that half and count its documents by score level, so the shares at every level are exact at any size; the driver gets the
drawn rows (TREES * ROWS, twice as many at most on average) and one number per level.

Defined results: null or empty text has no words, fails the base rules and isn't kept; without labelled rows of good and bad
quality nothing but the base rules rejects; of several labels of one document the lowest quality counts, and of several texts the one of the least ratios;
a half that lacks good or bad documents is replaced by both halves; results don't depend on how rows are dealt to partitions; repeated rows get equal rows;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, written

SPACE, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
UPPER, DIGITS, MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:!?"
#: Trees and rows a tree; share of good labelled documents kept at least; levels of the score from 0 to 1 that limits are chosen from.
TREES, ROWS, KEEP, LEVELS = 100, 256, 0.995, 1 << 14
#: Sets of ratios (places in measured()'s list) that a forest may see; calibration takes the one that tells bad from good best.
#: Ratios that are zero for nearly all documents isolate the few others, good or bad, so more ratios aren't always better.
VIEWS = ((0, 1), (1, 3), (0, 1, 2, 3), (0, 1, 6, 7, 8, 9), tuple(range(11)))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
LEAST_WORDS, MOST_REPEATED = 50, 50


def repeated(words: list[bytes]) -> int:
    """Words in three-word windows that occur at least twice, their first occurrences included."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    times, last, total = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if times[w] > 1:
            total += i + 3 - max(i, last)
            last = i + 3
    return total


def measured(text: str | None) -> tuple[tuple[int, ...], list[float]]:
    """The counts of COUNTS, and the ratios that the forest sees (none depends on length alone)."""
    text = text or ""
    raw = text.encode()
    without = lambda chars: len(raw) - len(raw.translate(None, chars))
    words, lines, seen, doubled, ended = raw.split(), raw.split(b"\n"), set(), 0, 0
    for line in lines:
        if line and line.strip():
            doubled += line in seen
            seen.add(line)
            ended += line.rstrip()[-1:] in b".!?"
    n, chars, symbols, again = len(words), len(text) - without(SPACE), without(SYMBOLS), repeated(words)
    counts = (n, chars, symbols, doubled, again)
    some, filled = max(n, 1), max(len(seen) + doubled, 1)
    letters = max(len(raw), 1)
    ratios = [chars / some, symbols / some, doubled / filled, again / some, len(set(words)) ** 1.1 / some, without(DIGITS) / letters, without(MARKS) / some, without(UPPER) / some, np.log1p(some / filled), np.log1p(max(map(len, words), default=0)), ended / filled]
    return counts, ratios


class Forest(NamedTuple):
    """Trees as equal-sized arrays; a leaf points to itself. length: path length at a leaf, with what its rows would add. view: the ratios it sees."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    length: np.ndarray
    depth: int
    usual: float
    view: tuple[int, ...]


def _expected(n: float) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


def grown(rows: np.ndarray, view: tuple[int, ...] | None = None, trees: int = TREES, size: int = ROWS, seed: int = 7) -> Forest:
    """An isolation forest: random features, random cuts between a node's extremes, up to the mean depth of a sample."""
    rng, size = np.random.default_rng(seed), min(size, len(rows))
    return planted([rows[rng.choice(len(rows), size, replace=False)] for _ in range(trees)], view, seed)


def planted(drawn: list[np.ndarray], view: tuple[int, ...] | None = None, seed: int = 7) -> Forest:
    """An isolation forest with a tree from each table of drawn rows; the tables are of one size."""
    view = tuple(range(drawn[0].shape[1])) if view is None else view
    rng, size, trees = np.random.default_rng(seed + 1), len(drawn[0]), len(drawn)
    depth = max(1, int(np.ceil(np.log2(max(size, 2)))))
    nodes = 2 ** (depth + 1)
    feature, cut, length = np.zeros((trees, nodes), np.int64), np.zeros((trees, nodes)), np.zeros((trees, nodes))
    left = np.tile(np.arange(nodes), (trees, 1))
    right = left.copy()
    for t in range(trees):
        todo, free = [(0, drawn[t][:, view], 0)], 1
        while todo:
            at, own, level = todo.pop()
            low, high = own.min(0), own.max(0)
            ways = np.flatnonzero(high > low)
            if level >= depth or len(own) <= 1 or not len(ways):
                length[t, at] = level + _expected(len(own))
                continue
            f = rng.choice(ways)
            c = rng.uniform(low[f], high[f])
            feature[t, at], cut[t, at], left[t, at], right[t, at] = f, c, free, free + 1
            below = own[:, f] < c
            todo += [(free, own[below], level + 1), (free + 1, own[~below], level + 1)]
            free += 2
    return Forest(feature, cut, left, right, length, depth, _expected(size), view)


def scores(forest: Forest, rows: np.ndarray) -> np.ndarray:
    """Anomaly scores between 0 and 1: 2 to minus the mean path length over the usual one."""
    rows = rows[:, forest.view]
    total, every = np.zeros(len(rows)), np.arange(len(rows))
    for t in range(len(forest.feature)):
        at = np.zeros(len(rows), np.int64)
        for _ in range(forest.depth):
            at = np.where(rows[every, forest.feature[t, at]] < forest.cut[t, at], forest.left[t, at], forest.right[t, at])
        total += forest.length[t, at]
    return 2.0 ** (-total / len(forest.feature) / max(forest.usual, 1e-9))


def _failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < LEAST_WORDS) | (100 * counts[:, 4] > MOST_REPEATED * counts[:, 0])


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, the base verdict and the ratios of each document."""
    fields = ["doc_id long", *(f"{c} long" for c in COUNTS), "base_failed boolean", "ratios array<double>"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            found = [measured(t.as_py()) for t in batch.column(1)]
            counts = np.array([c for c, _ in found], np.int64).reshape(-1, len(COUNTS))
            columns = [batch.column(0), *(pa.array(c) for c in counts.T), pa.array(_failed(counts)), pa.array([r for _, r in found], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in fields])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(rows, ", ".join(fields))


def _table(ratios: pa.Array) -> np.ndarray:
    """Ratios of a batch, a row per document."""
    return ratios.flatten().to_numpy(zero_copy_only=False).reshape(len(ratios), -1) if len(ratios) else np.zeros((0, len(measured("")[1])))


def _level(scores: np.ndarray) -> np.ndarray:
    """The lowest level (a multiple of 1 / LEVELS) that isn't below a score: scores above a level are those of higher levels."""
    return np.clip(np.ceil(scores * LEVELS), 0, LEVELS).astype(np.int64)


def chosen(good: np.ndarray, bad: np.ndarray, keep: float = KEEP) -> tuple[float, float]:
    """(gap, limit) from the numbers of good and bad documents at each level: the limit with the largest gap between the shares of bad and good above it, among those that keep enough good."""
    if not good.sum() or not bad.sum():
        return 0.0, float("inf")
    above = lambda n: n.sum() - np.cumsum(n)
    gaps = np.where(above(good) <= (1 - keep) * good.sum(), above(bad) / bad.sum() - above(good) / good.sum(), -1.0)
    best = int(np.argmax(gaps))
    return (float(gaps[best]), best / LEVELS) if gaps[best] > 0 else (0.0, float("inf"))


def calibrated(good: np.ndarray, bad: np.ndarray, keep: float = KEEP) -> tuple[float, float]:
    """(gap, limit) from the scores of good and bad documents."""
    return chosen(*(np.bincount(_level(x), minlength=LEVELS + 1) for x in (good, bad)), keep)


def _mixed(keys: np.ndarray, tree: int) -> np.ndarray:
    """A hash of each key for a tree (splitmix64)."""
    x = keys + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def drawn(rows: DataFrame, total: int, trees: int = TREES, size: int = ROWS) -> list[np.ndarray]:
    """For each tree the ratios of the ``size`` rows that its hash puts first, among all ``total`` of them (doc_id and ratios, one row for each document)."""
    most = np.uint64(min(2**64 - 1, 2 * size * 2**64 // total))  # twice as many as needed are sent: fewer than needed come with a chance below 1e-25

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, table = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), _table(batch.column(2))
            for t in range(trees):
                hashes = _mixed(keys, t)
                at = np.flatnonzero(hashes <= most)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t, np.int32)), pa.array(hashes[at].view(np.int64)), batch.column(1).take(pa.array(at)), pa.array([r.tobytes() for r in table[at]], pa.binary())], ["tree", "hash", "doc_id", "ratios"])

    found = rows.select(F.xxhash64("doc_id"), "doc_id", "ratios").mapInArrow(draw, "tree int, hash long, doc_id long, ratios binary").toArrow()
    tree, key, doc = (found.column(i).to_numpy() for i in range(3))
    order, ratios = np.lexsort((doc, key.view(np.uint64), tree)), np.frombuffer(b"".join(found.column(3).to_pylist())).reshape(len(tree), -1)
    least = min(size, total)
    return [ratios[order[at : at + least]] for at in np.searchsorted(tree[order], np.arange(trees))]


def _levels(rows: DataFrame, forests: list[Forest]) -> np.ndarray:
    """Numbers of documents by half, forest, kind (bad, good) and score level, over all rows (half, good, ratios)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = LEVELS + 1
        total = np.zeros(4 * len(forests) * width, np.int64)
        for batch in batches:
            half, good = (batch.column(i).cast(pa.int64()).to_numpy(zero_copy_only=False) for i in (0, 1))
            table = _table(batch.column(2))
            for f, forest in enumerate(forests):
                np.add.at(total, ((half * len(forests) + f) * 2 + good) * width + _level(scores(forest, table)), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["place", "n"])

    out = np.zeros((2, len(forests), 2, LEVELS + 1), np.int64)
    found = rows.select("half", "good", "ratios").mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    out.reshape(-1)[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out


def trained(docs: DataFrame, labels: DataFrame) -> tuple[Forest | None, float]:
    """Forest and score limit from all labelled documents that pass the base rules."""
    return _learned(written(counted(docs), "quality-counts"), labels)


def _learned(stats: DataFrame, labels: DataFrame) -> tuple[Forest | None, float]:
    worst = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    passed = stats.filter("not base_failed").select("doc_id", "ratios").join(worst, "doc_id").groupBy("doc_id").agg(F.min("ratios").alias("ratios"), (F.min("quality") == 1).alias("good"))
    rows = written(passed.withColumn("half", F.pmod(F.shiftright(F.xxhash64("doc_id"), 7), F.lit(2)).cast("int")), "quality-labelled")
    sizes = {(r.half, r.good): r["count"] for r in rows.groupBy("half", "good").count().collect()}  # four numbers
    number = lambda good, *halves: sum(sizes.get((h, good), 0) for h in halves)
    if number(True, 0, 1) < 8 or not number(False, 0, 1):
        return None, float("inf")
    alone = all(number(good, 0) for good in (True, False))
    tables = drawn(rows.filter("half = 0") if alone else rows, sum(n for (half, _), n in sizes.items() if half == 0 or not alone))
    forests = [planted(tables, v) for v in VIEWS]
    levels = _levels(rows, forests)
    levels = levels[1] if all(number(good, 1) for good in (True, False)) else levels.sum(0)
    return _best(forests, [chosen(good, bad) for bad, good in levels])


def _best(forests: list[Forest], found: list[tuple[float, float]]) -> tuple[Forest, float]:
    """The forest with the largest gap, and its limit."""
    at = max(range(len(forests)), key=lambda i: found[i][0])
    return forests[at], found[at][1]


def fitted(rows: list[tuple[bool, list[float]]]) -> tuple[Forest | None, float]:
    """Forest and limit from (good, ratios) of documents in memory, in a fixed order: every other one grows the forest, the rest calibrates it."""
    both = [np.array([r for g, r in rows if g == kind]).reshape(-1, len(measured("")[1])) for kind in (True, False)]
    if len(both[0]) < 8 or not len(both[1]):
        return None, float("inf")
    grow, (good, bad) = np.vstack([x[0::2] for x in both]), (x[1::2] if len(x) > 1 else x for x in both)
    forests = [grown(grow, v) for v in VIEWS]
    return _best(forests, [calibrated(scores(f, good), scores(f, bad)) for f in forests])


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: the counts, base_failed, kept and the anomaly score."""
    stats = written(counted(docs), "quality-counts")
    forest, limit = _learned(stats, labels)

    def verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad = batch.column(len(COUNTS) + 1).to_numpy(zero_copy_only=False)
            anomaly = scores(forest, _table(batch.column(len(COUNTS) + 2))) if forest else np.zeros(len(bad))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(~bad & (anomaly <= limit)), pa.array(anomaly)], [*batch.schema.names[:-1], "kept", "anomaly"])

    return stats.mapInArrow(verdicts, ", ".join(["doc_id long", *(f"{c} long" for c in COUNTS), "base_failed boolean", "kept boolean", "anomaly double"]))
