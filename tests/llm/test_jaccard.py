from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from factlake.llm import jaccard, queries
from factlake.llm.components import connected

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def sets_of(rows):
    out = []
    for text in rows:
        w = WORD.findall((text or "").encode().lower())
        out.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def brute(rows):
    """(n_shingles, component_id) of (doc_id, text) rows."""
    sets, root, index = sets_of([t for _, t in rows]), list(range(len(rows))), defaultdict(list)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        both = Counter(j for x in s for j in index[x])
        for j, k in both.items():
            if 100 * k >= 75 * (len(s) + len(sets[j]) - k):
                root[find(i)] = find(j)
        for x in s:
            index[x].append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return [(d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def got(df):
    return sorted(map(repr, ((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())))


def variants(rng, n):
    words = [f"w{i}" for i in range(300)]
    out = []
    for _ in range(n):
        base = [rng.choice(words) for _ in range(rng.choice([3, 4, 5, 6, 30, 100]))]
        for _ in range(rng.randrange(1, 7)):
            own = list(base)
            for _ in range(rng.randrange(0, 4)):
                own[rng.randrange(len(own))] = rng.choice(words)
            out.append(" ".join(own).replace("w1", rng.choice(["W1", "w1"])))
    return out


def test_against_brute_force(spark):
    rng = random.Random(7)
    rows = list(enumerate(variants(rng, 60)))
    rng.shuffle(rows)
    assert got(jaccard.joined(spark.createDataFrame(rows, "doc_id long, text string"))) == sorted(map(repr, brute(rows)))


def test_query_against_brute_force(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert got(queries.op6_jaccard(spark, small)) == sorted(map(repr, brute(rows)))


def test_large_blocks_are_dealt_out(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[:k] + ["x"] + base[k + 1 :])) for i, k in enumerate(rng.choice(range(60)) for _ in range(120))]
    monkeypatch.setattr(jaccard, "CROWD", 10)
    monkeypatch.setattr(jaccard, "RANGE", 50)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", -1)
    assert got(jaccard.joined(spark.createDataFrame(rows, "doc_id long, text string"))) == sorted(map(repr, brute(rows)))


@pytest.mark.parametrize("seed", range(6))
def test_tree_links_as_all_pairs_do(seed):
    rng = np.random.default_rng(seed)
    base = [np.sort(rng.choice(1 << 40, rng.integers(4, 60), replace=False)) for _ in range(12)]
    sets = []
    for b in base:
        for _ in range(rng.integers(1, 12)):
            own = b[rng.random(len(b)) > 0.08]
            sets.append(np.unique(np.concatenate((own if len(own) else b, rng.choice(1 << 40, rng.integers(0, 3))))).astype(np.uint64))
    n, root = len(sets), list(range(len(sets)))

    def close(pairs):
        own = list(range(n))
        for i, j in pairs:
            a, b = own[i], own[j]
            own = [a if x == b else x for x in own]
        return [own.index(x) for x in own]

    linked = []
    for i in range(n):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                linked.append((i, j))
    found = jaccard.links(sets)
    assert close(found) == close(linked) and len(found) < max(1, n) and root


def test_components(spark):
    rng = random.Random(9)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1080)] + [(5, 5)]
    root = list(range(1100))
    for a, b in links:
        x, y = root[a], root[b]
        root = [min(x, y) if r in (x, y) else r for r in root]
    found = {r.key: r.root for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {k: root[k] for a, b in links if a != b for k in (a, b)}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_documents(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert got(jaccard.joined(odd)) == sorted(map(repr, brute(rows)))
    assert jaccard.joined(none).count() == 0 and jaccard.one_of_each(none).columns == none.columns
    kept = [(r.doc_id, r.text) for r in jaccard.one_of_each(odd).collect()]
    assert sorted(map(repr, kept)) == sorted(map(repr, [rows[0], *rows[4:]]))


@pytest.mark.parametrize("few, many", [(3, 4), (6, 8), (15, 20)])
def test_extended_texts_link_at_the_limit(spark, few, many):
    """Jaccard is 75 / 100 exactly; the larger set's own shingles may be its lowest."""
    rows = []
    for i in range(300):
        words = [f"{i}x{k}" for k in range(many + 4)]
        rows += [(2 * i, " ".join(words[: few + 4])), (2 * i + 1, " ".join(words))]
    assert got(jaccard.joined(spark.createDataFrame(rows, "doc_id long, text string"))) == sorted(map(repr, brute(rows)))


@pytest.mark.parametrize("least", [50, 75, 90])
def test_least_shared_holds_for_all_partners(least):
    for a in range(1, 90):
        low = jaccard._least_shared(a, least)
        for b in range(1, 2 * a + 1):
            for both in range(1, min(a, b) + 1):
                if 100 * both >= least * (a + b - both):
                    looked = [int(jaccard._looked_at(np.int64(n), least)) - (n - both) for n in (a, b)]
                    assert 1 <= low <= max(1, min(looked))


def test_shared_counts_are_those_of_single_shingles():
    """Combined per batch or not, each set is told how many of its shingles a set of another key has, once for each of its copies."""
    rng = np.random.default_rng(4)
    batches, ranges = [], 3
    for _ in range(4):
        sets = [np.unique(rng.integers(0, 60, rng.integers(1, 25)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(12)]
        batches.append((sets + sets[:2], list(range(len(batches) * 100, len(batches) * 100 + 12)) + [len(batches) * 100, len(batches) * 100 + 1]))
    holders = defaultdict(set)
    for sets, keys in batches:
        for s, k in zip(sets, keys, strict=True):
            for t in s.tolist():
                holders[t].add(k)
    expected = Counter()
    for sets, keys in batches:
        for s, k in zip(sets, keys, strict=True):
            expected[k] += sum(len(holders[t]) > 1 for t in s.tolist())
    import pyarrow as pa

    names, parts, total = [f.split()[0] for f in jaccard.LOOKED.split(", ")], defaultdict(list), Counter()
    for sets, keys in batches:
        for row in jaccard._combined(sets, keys, ranges):
            parts[row[0]].append(row)
    for rows in parts.values():
        table = pa.table({n: [r[i] for r in rows] for i, n in enumerate(names)})
        found = jaccard._shared_counts(table, 2)
        for k, c in zip(found["keys"].to_pylist(), found["counts"].to_pylist(), strict=True):
            total.update(dict(zip(np.frombuffer(k, np.int64).tolist(), np.frombuffer(c, np.uint32).tolist(), strict=True)))
    assert +total == +expected


def test_a_shingle_that_a_third_of_documents_share_leaves_a_batch_once():
    common = np.arange(1, 6, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    own = np.random.default_rng(2).integers(1 << 40, 1 << 63, (3000, 3)).astype(np.uint64)
    sets = [np.sort(np.concatenate((common, own[k]))) for k in range(3000)]
    rows = list(jaccard._combined(sets, list(range(3000)), 1))
    assert len(rows) == 1 and len(rows[0][5]) == 5 * len(common) and len(rows[0][3]) <= 5 * 9000
