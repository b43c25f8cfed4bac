from __future__ import annotations

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from factlake.llm import packing
from factlake.llm.queries import tokenizer_path

PATH = tokenizer_path()


@pytest.mark.parametrize("text", ["<|endoftext|> a<|startoftext|>b", "don't I'LL we've. A.B, Ünïcode, é. 12,5. x y \x1c z.\x85", "Ⅷ ΑΣ. İstanbul, ß. ŉ", "A.<|ENDOFTEXT|> it'S X,. a.,b c., D.\n", "é. É, x%%% y&&& z", "", "a" * 5000])
def test_remembered_words_give_the_tokenizers_ids(text):
    expected = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(next(iter(packing.Tokens(PATH).of([text.encode()]))), "<u4").tolist() == expected


def test_memo_may_be_cleared(monkeypatch):
    monkeypatch.setattr(packing, "MEMO", 10)
    own, plain = packing.Tokens(PATH), Tokenizer.from_file(PATH)
    texts = [f"word{i} other{i} and more words {i}" for i in range(30)]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.of([t.encode() for t in texts])] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def held(groups, size):
    counts = np.zeros(size + 1, int)
    for contents, times in groups:
        assert sum(n * k for n, k in contents) <= size and times > 0
        for n, k in contents:
            counts[n] += k * times
    return counts


@pytest.mark.parametrize("seed", range(5))
def test_plans_hold_every_piece(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(rng.geometric(0.02, 3000), 256)
    counts = np.bincount(lengths, minlength=257)
    groups = packing.plan(counts)
    assert (held(groups, 256) == counts).all()
    bound = -(-int(lengths.sum()) // 256)
    assert bound <= sum(t for _, t in groups) <= bound * 1.02 + 2


def test_plan_of_nothing_and_of_large_pieces():
    assert packing.plan(np.zeros(257, int)) == []
    counts = np.zeros(257, int)
    counts[200] = 9
    assert sum(t for _, t in packing.plan(counts)) == 9


def test_fit_is_non_negative_and_near():
    counts = np.zeros(11, int)
    counts[[4, 6, 5]] = [10, 10, 8]
    rows = packing.patterns(counts)
    times = packing.fitted(rows, counts)
    assert (times >= 0).all() and {tuple(r) for r in rows.tolist()} >= {(6, 4, 0), (5, 5, 0)}


def check(df, docs):
    plain = Tokenizer.from_file(PATH)
    expected = []
    for r in docs.select("doc_id", "text").collect():
        ids = np.array([*plain.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        expected += [(r.doc_id, n, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())) for n, at in enumerate(range(0, len(ids), 4096))]
    rows = df.collect()
    assert sorted(map(repr, ((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows))) == sorted(map(repr, expected))
    filled: dict[int, int] = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values(), default=0) <= 4096
    return len(filled), sum(filled.values())


def test_query_against_brute_force(spark, small):
    from factlake.llm.queries import op1_packing

    n, total = check(op1_packing(spark, small), spark.read.parquet(f"{small}/documents.parquet"))
    assert n <= -(-total // 4096) + 1


def test_odd_documents(odd, none):
    check(packing.packed(odd, PATH), odd)
    assert packing.packed(none, PATH).count() == 0
