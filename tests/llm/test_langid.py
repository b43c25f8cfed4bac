from __future__ import annotations

import zlib

import numpy as np
import pytest

from factlake.llm import langid, queries


def test_gradients():
    net = langid.Network(*[p.astype(float) for p in langid.fresh(3, 4)])
    windows, labels = np.random.default_rng(0).integers(0, 256, (5, 7)).astype(np.uint8), np.array([0, 1, 2, 1, 0])

    def loss(n):
        return -np.log(langid.softmax(langid.position_scores(n, langid.forward(n, langid._places(windows))))[:, np.arange(5), labels]).sum()

    kept = []
    states = langid.forward(net, langid._places(windows), kept)
    error = langid.softmax(langid.position_scores(net, states))
    error[:, np.arange(5), labels] -= 1
    for k, g in enumerate(langid.backward(net, langid._places(windows), kept, states, error)):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        ends = []
        for step in (0.01, -0.01):
            p = net[k].copy()
            p[at] += step
            ends.append(loss(net._replace(**{net._fields[k]: p})))
        assert (ends[0] - ends[1]) / 0.02 == pytest.approx(g[at], rel=1e-3)


def test_windows_pool_every_byte_with_its_context():
    net = langid.fresh(2)
    texts = [b"", b"a", b"ab" * 32, b"ab" * 33, b"xyz" * 500]
    found = langid.probabilities(net, texts)
    for t, f in zip(texts, found, strict=True):
        total = np.zeros(2)
        for at in range(0, len(t), langid.WINDOW):
            low, high = max(0, at - langid.MARGIN), min(len(t), at + langid.WINDOW + langid.MARGIN)
            part = np.frombuffer(t[low:high], np.uint8)[None]  # without any padding
            p = langid.softmax(langid.position_scores(net, langid.forward(net, langid._places(part))))
            total += p[at - low : at - low + langid.WINDOW, 0][: len(t) - at].sum(0)
        assert f == pytest.approx(total / max(len(t), 1), abs=1e-5)


def test_padding_stays_without_effect_in_training():
    windows = [langid.windows_of(t) for t in ("una frase breve", "a much longer sentence " * 20)]
    net = langid.trained(np.concatenate(windows), np.repeat([0, 1], [len(w) for w in windows]), 2, steps=5)
    table = net.table.reshape(2, langid.PAD + 1, -1)
    assert (table[:, langid.PAD, : langid.UNITS] == langid.SHUT).all() and not table[:, langid.PAD, langid.UNITS :].any()
    assert all((w < langid.PAD).any(1).all() for w in windows) and not len(langid.windows_of("123 456"))


def test_short_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net, kinds = langid.learned(langid.sample(docs))
    held = [r for r in docs.filter("lang is not null").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and len(r.text) >= 60]
    found = langid.probabilities(net, [r.text.encode()[:30] for r in held])
    assert np.mean([kinds[i] == r.lang for i, r in zip(found.argmax(1), held, strict=True)]) >= 0.97


def test_the_sample_is_the_same_however_rows_are_dealt(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert langid.sample(docs, 50) == langid.sample(docs.repartition(7).union(docs), 50)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.op7_language(spark, folder).collect()
    assert len(rows) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) >= 0.99


def test_odd_documents(odd, none):
    rows = langid.identified(odd).collect()
    assert len(rows) == odd.count()
    assert [(r.lang_pred, r.score) for r in rows if r.doc_id in (3, 4, 8, 9)] == [("und", 0.0)] * 4
    assert langid.identified(none).count() == langid.accepted(none).count() == 0
    kept = langid.accepted(odd, least=0.0)
    assert kept.columns == odd.columns and {3, 4, 8, 9}.isdisjoint({r.doc_id for r in kept.collect()})


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "some text", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in langid.identified(df).collect()} == {("und", 0.0)}
