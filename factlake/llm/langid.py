"""Language identification by a bidirectional gated recurrent network over bytes.

The driver trains on a bounded sample: windows of bytes, gradients by backpropagation through time, Adam, all in numpy; executors
cut the windows, so only they reach the driver. Executors run the network over every byte of every text, WINDOW bytes at a time with
MARGIN further bytes on both sides (so a very long text costs no more memory than a short one, and every byte has its context), label each
position, and pool a document's position probabilities by their mean. Places before and after a text leave both directions' states as they are,
in training as in prediction.

Defined results: null text, empty text and text without a letter are ``und`` with score 0; without training rows everything is
``und`` with score 0; repeated rows get equal rows; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, restored, slices, written

#: Units a direction, bytes a window, bytes of context on each side, windows a step of the network on executors.
UNITS, WINDOW, MARGIN, TOGETHER = 8, 64, 8, 1024
CELLS = WINDOW + 2 * MARGIN
#: The number of a place without a byte, and what it adds to the update gate: the gate is 1, so the state stays.
PAD, SHUT = 256, np.float32(40)
#: Training: documents at most, windows a document, windows a batch, steps, learning rate, share of windows cut short.
SAMPLE, WINDOWS, BATCH, STEPS, RATE, SHORT = 1600, 24, 256, 260, 0.02, 0.4
FOLDS, HELD_OUT, UNKNOWN = 4, 2, "und"
LETTER = re.compile(r"[^\W\d_]")


class Network(NamedTuple):
    """table: what a byte adds to update, reset and candidate gates, by direction; turn: the same for the state; shift: the candidate's bias; out, bias: to labels."""

    table: np.ndarray  # [2 * 257, 3 * units], of each direction the bytes and PAD
    turn: np.ndarray  # [2, units, 3 * units]
    shift: np.ndarray  # [2, 1, units]
    out: np.ndarray  # [2, units, labels]
    bias: np.ndarray  # [labels]


def fresh(labels: int, units: int = UNITS, seed: int = 3) -> Network:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
    table = draw(2, PAD + 1, 3 * units, s=0.3)
    table[:, PAD] = 0
    table[:, PAD, :units] = SHUT
    return Network(table.reshape(-1, 3 * units), draw(2, units, 3 * units, s=units**-0.5), np.zeros((2, 1, units), np.float32), draw(2, units, labels, s=units**-0.5), np.zeros(labels, np.float32))


def _places(windows: np.ndarray) -> np.ndarray:
    """Rows of the table by step, direction and window: the second direction reads from the end."""
    both = np.stack([windows.T, windows.T[::-1] + np.int64(PAD + 1)], 1)
    return both.astype(np.int64)


def forward(net: Network, places: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States [steps, 2, windows, units]; keep collects what backward() needs."""
    steps, _, n = places.shape
    u = net.turn.shape[1]
    states = np.zeros((steps, 2, n, u), np.float32)
    state = np.zeros((2, n, u), np.float32)
    for t in range(steps):
        given = net.table[places[t]]
        own = np.matmul(state, net.turn)
        gates = np.tanh((given[..., : 2 * u] + own[..., : 2 * u]) * np.float32(0.5))
        gates *= np.float32(0.5)
        gates += np.float32(0.5)
        update, reset = gates[..., :u], gates[..., u:]
        inner = own[..., 2 * u :] + net.shift
        new = np.tanh(given[..., 2 * u :] + reset * inner)
        if keep is not None:
            keep.append((state, update, reset, inner, new))
        state = new + update * (state - new)
        states[t] = state
    return states


def position_scores(net: Network, states: np.ndarray) -> np.ndarray:
    """Label scores [steps, windows, labels] from both directions' states at each position."""
    return states[:, 0] @ net.out[0] + states[::-1, 1] @ net.out[1] + net.bias


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def backward(net: Network, places: np.ndarray, kept: list, states: np.ndarray, error: np.ndarray) -> Network:
    """Gradients, from the error [steps, windows, labels] of the positions' scores, by backpropagation through time."""
    steps, _, n = places.shape
    u = net.turn.shape[1]
    flat = error.reshape(-1, error.shape[-1])
    out = np.stack([states[:, 0].reshape(-1, u).T @ flat, states[::-1, 1].reshape(-1, u).T @ flat])
    from_labels = np.stack([error @ net.out[0].T, (error @ net.out[1].T)[::-1]], 1)
    turn, shift = np.zeros_like(net.turn), np.zeros_like(net.shift)
    given = np.zeros((steps, 2, n, 3 * u), np.float32)
    carried = np.zeros((2, n, u), np.float32)
    for t in reversed(range(steps)):
        before, update, reset, inner, new = kept[t]
        d = carried + from_labels[t]
        d_new = d * (1 - update) * (1 - new * new)
        d_inner = d_new * reset
        gates = np.concatenate([d * (before - new) * update * (1 - update), d_new * inner * reset * (1 - reset), d_inner], -1)
        turn += np.matmul(before.transpose(0, 2, 1), gates)
        shift += d_inner.sum(1, keepdims=True)
        given[t] = gates
        given[t][..., 2 * u :] = d_new
        carried = d * update + np.matmul(gates, net.turn.transpose(0, 2, 1))
    order = np.argsort(places.ravel(), kind="stable")
    rows, starts = np.unique(places.ravel()[order], return_index=True)
    table = np.zeros_like(net.table)
    table[rows] = np.add.reduceat(given.reshape(-1, 3 * u)[order], starts, axis=0)
    return Network(table, turn, shift, out, flat.sum(0))


def trained(windows: np.ndarray, labels: np.ndarray, kinds: int, steps: int = STEPS, seed: int = 5) -> Network:
    """A network for windows [n, length] of bytes and PAD with a label each; every label gets the same weight in a batch, on average."""
    rng, net = np.random.default_rng(seed), fresh(kinds)
    share = 1.0 / np.maximum(np.bincount(labels, minlength=kinds), 1)[labels]
    share /= share.sum()
    first, second = ([np.zeros_like(p) for p in net] for _ in range(2))
    for step in range(1, steps + 1):
        pick = rng.choice(len(windows), BATCH, p=share)
        places, kept = _places(windows[pick]), []
        states = forward(net, places, kept)
        error = softmax(position_scores(net, states))
        error[:, np.arange(BATCH), labels[pick]] -= 1
        error *= (windows[pick].T < PAD)[..., None] / np.float32(error.shape[0] * BATCH)
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        moved = []
        for p, g, a, b in zip(net, backward(net, places, kept, states, error), first, second, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            moved.append((p - rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(np.float32))
        net = Network(*moved)
    return net


def probabilities(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean label probabilities of each text's positions; an empty text gets zeros."""
    sizes = np.array([len(t) for t in texts], np.int64)
    many = -(-sizes // WINDOW)
    # Each text has whole windows and a margin before and after; what no byte fills is PAD.
    room = many * WINDOW + 2 * MARGIN
    first = np.cumsum(room) - room
    cells = np.full(int(room.sum()), PAD, np.uint16)
    for t, at in zip(texts, first.tolist(), strict=True):
        cells[at + MARGIN : at + MARGIN + len(t)] = np.frombuffer(t, np.uint8)
    owner = np.repeat(np.arange(len(texts)), many)
    start = first[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)) * WINDOW
    total = np.zeros((len(owner), net.bias.shape[0]))
    for at in range(0, len(owner), TOGETHER):
        windows = cells[start[at : at + TOGETHER, None] + np.arange(CELLS)]
        scores = position_scores(net, forward(net, _places(windows)))[MARGIN : MARGIN + WINDOW]
        total[at : at + TOGETHER] = (softmax(scores) * (windows[:, MARGIN : MARGIN + WINDOW].T < PAD)[..., None]).sum(0)
    out = np.zeros((len(texts), net.bias.shape[0]))
    np.add.at(out, owner, total)
    return out / np.maximum(sizes, 1)[:, None]


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def windows_of(text: str, most: int = WINDOWS) -> np.ndarray:
    """Windows [n, CELLS] for training from anywhere in a text, some cut short; drawn by the text's own seed. None from a text without a letter."""
    raw = text.encode()
    if not LETTER.search(text):
        return np.zeros((0, CELLS), np.uint16)
    rng, n = np.random.default_rng(crc32(raw)), min(most, 1 + len(raw) // WINDOW)
    out = np.full((n, CELLS), PAD, np.uint16)
    for row, at in zip(out, rng.integers(0, max(1, len(raw) - CELLS + 1), n), strict=True):
        part = np.frombuffer(raw[at : at + (rng.integers(8, CELLS) if rng.random() < SHORT else CELLS)], np.uint8)
        before = rng.integers(0, CELLS - len(part) + 1)
        row[before : before + len(part)] = part
    return out


def sample(docs: DataFrame, most: int = SAMPLE) -> list:
    """Lang and windows of at most ``most`` labelled documents that aren't held out, those of the lowest id hashes; of rows with one id the first by lang and windows."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    lowest = known.select(F.col("doc_id").cast("long").alias("_id")).distinct().orderBy(F.xxhash64("_id"), "_id").limit(most)
    rows = known.join(F.broadcast(lowest), known["doc_id"].cast("long") == F.col("_id"), "left_semi")  # at most ``most`` numbers

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [windows_of(t).tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(found, pa.binary())], ["id", "lang", "windows"])

    cuts = rows.filter(F.col("text").isNotNull()).select(F.col("text").cast("string"), F.col("doc_id").cast("long"), F.col("lang").cast("string")).mapInArrow(cut, "id long, lang string, windows binary")
    return sorted(cuts.groupBy("id").agg(F.min(F.struct("lang", "windows")).alias("one")).select("id", "one.lang", "one.windows").collect())


def learned(rows: list) -> tuple[Network | None, list[str]]:
    """The network and its labels, from sample()'s rows."""
    kinds = sorted({r.lang for r in rows})
    windows = [np.frombuffer(r.windows, np.uint16).reshape(-1, CELLS) for r in rows]
    labels = np.repeat([kinds.index(r.lang) for r in rows], [len(w) for w in windows]) if rows else np.zeros(0, np.int64)
    return (trained(np.concatenate(windows), labels, len(kinds)), kinds) if len(labels) else (None, kinds)


def predicted(docs: DataFrame, net: Network | None, kinds: list[str], *keep: str) -> DataFrame:
    """Columns ``keep`` of docs, lang_pred and score."""

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(0).to_pylist()]
            found = probabilities(net, [t.encode() if LETTER.search(t) else b"" for t in texts]) if net else np.zeros((len(texts), 1))
            best, score = found.argmax(1) if len(texts) else [], found.max(1) if len(texts) else []
            names = [kinds[i] if s > 0 else UNKNOWN for i, s in zip(best, score, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(names, pa.string()), pa.array(np.clip(np.array(score, float), 0, 1))], [*batch.schema.names[1:], "lang_pred", "score"])

    rows = docs.select(F.col("text").cast("string").alias("_text"), *keep)
    kept = docs.select(*keep).schema
    return rows.mapInArrow(label, kept.add("lang_pred", "string").add("score", "double"))


def identified(docs: DataFrame, most: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    net, kinds = learned(sample(docs, most))
    return predicted(docs, net, kinds, "doc_id").select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


#: Tables of at most this many rejected documents (two numbers each) are broadcast to the texts.
BROADCAST_ROWS = 300_000


def accepted(docs: DataFrame, least: float = 0.4, most: int = SAMPLE) -> DataFrame:
    """``docs`` without the documents whose language can't be told: ``und``, or a pooled probability below ``least``.

    The network only names the rejected ones, by id and text hash; the documents themselves don't pass through Python.
    """
    net, kinds = learned(sample(docs, most))
    keyed = carried(docs, "doc_id", "text").withColumns({"_id": F.col("doc_id").cast("long"), "_text_key": F.xxhash64(F.col("text").cast("string"))})
    rejected = predicted(keyed, net, kinds, "_id", "_text_key").filter((F.col("lang_pred") == UNKNOWN) | (F.col("score") < least))
    rejected = written(rejected.select(F.col("_id").alias("_gone"), F.col("_text_key").alias("_gone_key")).distinct(), "language-rejected")
    same = keyed["_id"].eqNullSafe(F.col("_gone")) & (keyed["_text_key"] == F.col("_gone_key"))
    kept = keyed.join(F.broadcast(rejected) if rejected.count() <= BROADCAST_ROWS else rejected, same, "left_anti")
    return kept.select(*restored(kept, docs.columns))
