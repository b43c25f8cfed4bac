from __future__ import annotations

import hashlib
import random

import pytest

from factlake.llm import doubling, queries, suffix


def brute(rows):
    order = lambda d: suffix.LAST if d is None else d
    first: dict[bytes, int] = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            s = b[i : i + 50]
            first[s] = min(first.get(s, suffix.LAST), order(d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone, last = bytearray(len(b)), 0
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < order(d):
                a = max(i, last)
                gone[a : i + 50] = b"\1" * (i + 50 - a)
                last = i + 50
        kept = bytes(x for i, x in enumerate(b) if not gone[i])
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(map(repr, out))


def got(df):
    return sorted(map(repr, ((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())))


def crafted(seed):
    rng = random.Random(seed)
    letters = "abcdefghij klmnoé"
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    parts = [text(rng.choice([48, 49, 50, 51, 80, 200])) for _ in range(12)]
    rows = [(i, "".join(rng.choice([*parts, text(rng.randrange(60))]) for _ in range(rng.randrange(6)))) for i in range(120)]
    rows += [(None, parts[4] * 2), (None, parts[4] * 2), (3, rows[3][1]), (500, ""), (501, None), (502, "a" * 300), (503, "a" * 70), (504, "ab" * 60), (505, "ab" * 40 + "a"), (506, rows[3][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = crafted(seed)
    assert got(suffix.removed(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


@pytest.mark.parametrize("start", [7, 25, 50])
def test_doubling_against_brute_force(spark, start):
    """Rounds at offsets 7, 14, 22; 25; none."""
    rows = crafted(5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(doubling.removed(df, start)) == brute(rows)


def test_doubling_ranks_are_ordinals_of_sorted_strings(spark):
    rows = crafted(6)
    texts = {i: t.encode() for i, (_, t) in enumerate(rows) if t}
    df = spark.createDataFrame([(bytearray(t), i, i) for i, t in texts.items()], "raw binary, row long, id long")
    ranks = doubling._ranked(doubling._positions(df, 10), "string")
    for length, found in ((10, ranks.collect()), (20, doubling._ranked(doubling._after(ranks, 10), "rank", "next").collect())):
        rank = {texts[r.row][r.pos : r.pos + length]: r["rank"] for r in found}
        there = sorted(rank)
        assert [rank[s] for s in there] == sorted(rank.values()) and len(set(rank.values())) == len(there)
        every = {}
        for i, t in texts.items():
            for p in range(len(t) - length + 1):
                every.setdefault(t[p : p + length], set()).add(i)
        assert set(there) == {s for s, ids in every.items() if len(ids) > 1}


def test_doubling_of_odd_documents(odd, none):
    few = odd.filter("length(text) < 5000 or text is null")
    assert got(doubling.removed(few)) == brute([(r.doc_id, r.text) for r in few.collect()])
    assert doubling.removed(none).count() == 0


def test_ranges_and_shuffled_verdicts(spark, monkeypatch):
    monkeypatch.setattr(suffix, "RANGE", 40)
    monkeypatch.setattr(suffix, "BROADCAST_BYTES", -1)
    rows = crafted(3)
    assert got(suffix.removed(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_query_against_brute_force(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert got(queries.op9_suffix(spark, small)) == brute(rows)


def test_spans_cover_what_is_removed(spark):
    rows = crafted(4)
    texts = {d: t for d, t in rows if d is not None}
    for r in suffix.removed(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        if r.doc_id is not None:
            raw = (texts[r.doc_id] or "").encode()
            kept, at = b"", 0
            for s in r.removed:
                kept, at = kept + raw[at : s.start], s.end
            assert hashlib.sha256(kept + raw[at:]).hexdigest() == r.kept_sha256 and sum(s.end - s.start for s in r.removed) == r.n_removed


def test_odd_documents(odd, none):
    assert got(suffix.removed(odd)) == brute([(r.doc_id, r.text) for r in odd.collect()])
    assert suffix.removed(none).count() == 0


def test_a_copy_without_id_is_later_than_its_original(spark):
    alone, often, nowhere = ("".join(random.Random(k).choice("abcdefgh ij") for _ in range(120)) for k in range(3))
    rows = [(1, alone), (None, alone), (2, often), (None, often), (None, often), (None, nowhere), (None, nowhere), (3, "short"), (None, "short")]
    found = suffix.removed(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sum(r.n_removed for r in found.collect()) == 3 * 120 and got(found) == brute(rows)
