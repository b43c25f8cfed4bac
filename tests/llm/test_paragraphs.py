from __future__ import annotations

import random
from collections import defaultdict

from factlake.llm import paragraphs, queries

WORDS = [a + b for a in "ba ke li mo nu pa re si to vu".split() for b in "bak lem nip rod sut xyz".split()]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_bands_reach_the_recall():
    n = paragraphs.bands()
    assert 1 - (1 - 0.75**2) ** n >= 0.99 > 1 - (1 - 0.75**2) ** (n - 1)


def test_paragraphs_depend_on_their_text_alone():
    rng = random.Random(6)
    texts = [prose(rng, rng.choice([0, 3, 12, 26, 40, 200])).encode() for _ in range(300)]
    alone = lambda t: [(s, e, w) for _, _, p in paragraphs.paragraphs([t], 2) for s, e, w in zip(p.start, p.end, p.words, strict=True)]
    together = defaultdict(list)
    for _, _, p in paragraphs.paragraphs(texts, 2):
        for k, s, e, w in zip(p.text, p.start, p.end, p.words, strict=True):
            together[int(k)].append((s, e, w))
    assert [together[i] for i in range(len(texts))] == [alone(t) for t in texts]


def test_planted_passages_are_found_wherever_they_lie(spark):
    rng = random.Random(4)
    passages = [prose(rng, 51 + i) for i in range(20)]
    rows, planted = [], defaultdict(set)
    for d in range(80):
        parts = [prose(rng, rng.randrange(40, 120)), prose(rng, rng.randrange(40, 120))]
        if d % 2:
            k = rng.randrange(len(passages))
            parts.insert(1, passages[k])
            planted[k].add(d)
        rows.append((d, " ".join(parts)))
    found = paragraphs.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in found} == set().union(*(s for s in planted.values() if len(s) > 1))
    for r in found:
        assert r.removed == (r.doc_id != r.kept_doc_id)
    cut = {r.doc_id: r.text for r in paragraphs.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(len(cut[d]) <= len(t) for d, t in rows) and sum(len(cut[d]) < len(t) for d, t in rows) > 10


def test_near_paragraphs_are_verified(spark):
    rng = random.Random(5)
    base = prose(rng, 24).split()  # one line by itself
    near, far = list(base), list(base)
    near[0] = "changed"
    for i in range(0, 24, 5):
        far[i] = "changed"
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far))]
    found = paragraphs.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    jaccard = lambda a, b: len(a & b) / len(a | b)
    sets = {d: {tuple(t.split()[i : i + 5]) for i in range(20)} for d, t in rows}
    assert jaccard(sets[1], sets[2]) >= 0.75 > jaccard(sets[1], sets[3])
    whole = {r.doc_id for r in found}
    assert 3 not in whole


def shingled(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_equal_lines_and_short_texts_always_meet(spark):
    rng, rows = random.Random(8), []
    for k in range(60):
        line = prose(rng, rng.choice([15, 16, 20, 30, 60, 200]))
        rows += [(len(rows) + i, "\n".join((prose(rng, rng.randrange(1, 40)), line, prose(rng, rng.randrange(1, 40))))) for i in range(2)]
    short = [(1000 + i, prose(random.Random(i // 2), 1 + i // 2 % 9)) for i in range(18)]
    found = paragraphs.repeated(spark.createDataFrame(rows + short, "doc_id long, text string")).collect()
    assert {r.doc_id for r in found} == {d for d, _ in rows + short}
    text = {d: t.encode() for d, t in rows + short}
    for k in range(60):
        line = text[2 * k].split(b"\n")[1]
        for d in (2 * k, 2 * k + 1):
            assert any(text[d][r.start : r.end] == line and r.component_id for r in found if r.doc_id == d)
    assert {r.doc_id for r in found if r.removed} == {d for d, _ in rows + short if d % 2}


def test_headings_and_set_phrases_are_left_alone(spark):
    rng = random.Random(9)
    rows = [(d, "\n".join(("The same heading of nine words stands over everything", prose(rng, 60), "All rights reserved by the authors of this text here", prose(rng, 30)))) for d in range(40)]
    assert paragraphs.repeated(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0


def test_recall_of_changed_lines(spark):
    """At each similarity of 0.75 or more, nine of ten changed lines are found at least; lines under 0.5 never meet as wholes."""
    rng, rows, alike = random.Random(10), [], {}
    for k in range(600):
        line = prose(rng, 60).split()
        other = list(line)
        for at in rng.sample(range(60), rng.choice([1, 1, 2, 3, 8])):
            other[at] = "changed" + str(rng.randrange(10**6))
        a, b = shingled(" ".join(line)), shingled(" ".join(other))
        alike[k] = len(a & b) / len(a | b)
        rows += [(2 * k, "\n".join((prose(rng, 20), " ".join(line)))), (2 * k + 1, "\n".join((prose(rng, 20), " ".join(other))))]
    found = paragraphs.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    groups = defaultdict(set)
    for r in found:
        groups[r.component_id].add(r.doc_id)
    met = {k for k in alike if any({2 * k, 2 * k + 1} <= g for g in groups.values())}
    for least, most in ((0.75, 0.8), (0.8, 0.9), (0.9, 1.0)):
        own = [k for k, j in alike.items() if least <= j < most]
        assert not own or sum(k in met for k in own) >= 0.9 * len(own), (least, len(own))


def test_query_finds_all_long_repeats(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    seen = defaultdict(set)
    for r in docs:
        w = r.text.lower().split()
        for k in range(len(w) - 50):
            seen[tuple(w[k : k + 51])].add(r.doc_id)
    planted = set().union(*(s for s in seen.values() if len(s) > 1))
    found = queries.op4_paragraphs(spark, small).collect()
    assert planted <= {r.doc_id for r in found}
    text = {r.doc_id: r.text.encode() for r in docs}
    groups = defaultdict(set)
    for r in found:
        assert 0 <= r.start < r.end <= len(text[r.doc_id])
        groups[r.component_id].add(r.doc_id)
    assert all(len(g) > 1 for g in groups.values())


def test_odd_documents(odd, none):
    found = paragraphs.repeated(odd).collect()
    assert {r.doc_id for r in found} == {1, 2, None} and all(r.removed == (r.doc_id != 1) for r in found if r.doc_id is not None)
    assert paragraphs.repeated(none).count() == 0 and paragraphs.deduplicated(none).columns == none.columns
    assert paragraphs.deduplicated(odd).count() == odd.count()
