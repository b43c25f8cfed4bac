from __future__ import annotations

import random

import numpy as np

from factlake.llm import quality, queries


def brute(words):
    n, covered = len(words), set()
    for i in range(n - 2):
        if any(i != j and words[i : i + 3] == words[j : j + 3] for j in range(n - 2)):
            covered.update(range(i, i + 3))
    return len(covered)


def test_repeated_words():
    rng = random.Random(2)
    for _ in range(300):
        words = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(30))]
        assert quality.repeated(words) == brute(words)


def test_counts():
    counts, ratios = quality.measured("a b#\né x $|\na b#\n\n \na b#\x1cc")
    assert counts == (8, 16, 5, 1, 0)
    assert quality.measured(None)[0] == (0,) * 5 and len(ratios) == len(quality.measured("")[1])


def test_forest_finds_outliers():
    rng = np.random.default_rng(0)
    rows = np.vstack([rng.normal(0, 1, (500, 3)), np.full((3, 3), 9.0)])
    scores = quality.scores(quality.grown(rows), rows)
    assert scores[-3:].min() > np.quantile(scores[:500], 0.99) and ((0 < scores) & (scores < 1)).all()


def test_calibration_keeps_good_rows():
    gap, limit = quality.calibrated(np.linspace(0.3, 0.5, 1000), np.linspace(0.45, 0.8, 100))
    assert gap > 0.5 and (np.linspace(0.3, 0.5, 1000) > limit).mean() <= 1 - quality.KEEP
    assert quality.calibrated(np.zeros(0), np.ones(3)) == (0.0, float("inf"))


def test_query_against_brute_force(spark, small):
    rows = {r.doc_id: r for r in queries.op3_quality(spark, small).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    for r in spark.read.parquet(f"{small}/documents.parquet").filter("n_chars < 3000").collect():
        own, words = rows[r.doc_id], r.text.encode().split()
        lines = [x for x in r.text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        assert (own.n_words, own.n_symbols, own.n_dup_lines, own.n_repeat_words) == (len(words), sum(r.text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), brute(words))
        assert own.word_chars == sum(len(w.decode()) for w in words)
        assert own.base_failed == (own.n_words < 50 or 100 * own.n_repeat_words > 50 * own.n_words)
        assert not (own.kept and own.base_failed)
    good = [rows[d] for d, q in labels.items() if q == 1 and not rows[d].base_failed]
    assert sum(r.kept for r in good) >= 0.98 * len(good)


def path(forest, tree, row):
    """A row's path length in one tree, step by step."""
    at = 0
    while forest.left[tree, at] != at:
        at = forest.left[tree, at] if row[forest.view[forest.feature[tree, at]]] < forest.cut[tree, at] else forest.right[tree, at]
    return forest.length[tree, at]


def test_verdicts_follow_from_path_lengths(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    forest, limit = quality.trained(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality.judged(docs, labels).collect():
        ratios = quality.measured(texts[r.doc_id])[1]
        mean = sum(path(forest, t, ratios) for t in range(quality.TREES)) / quality.TREES
        assert abs(r.anomaly - 2 ** (-mean / forest.usual)) < 1e-12
        assert r.kept == (not r.base_failed and r.anomaly <= limit)


def test_rows_may_be_dealt_in_any_way(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    more = labels.union(labels.limit(20)).union(labels.limit(20).withColumn("quality", 1 - labels["quality"])).cache()
    one, two, three = (sorted(map(tuple, quality.judged(d, x).collect())) for d, x in ((docs, more), (docs.repartition(7), more.repartition(5, "quality")), (docs.repartition(3), more.orderBy("doc_id", "quality"))))
    assert one == two == three


def test_rows_that_neither_trees_nor_limit_have_seen(spark):
    """Bad caught and good kept among labelled documents held out altogether."""
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").dropna(subset=["quality"])
    docs = spark.read.parquet(f"{folder}/documents.parquet").join(labels, "doc_id")
    rows = [(r.doc_id, r.quality == 1, *quality.measured(r.text)) for r in docs.select("doc_id", "quality", "text").orderBy("doc_id").collect()]
    passed = [(d, good, ratios) for d, good, counts, ratios in rows if not quality._failed(np.array([counts]))[0]]
    forest, limit = quality.fitted([(good, ratios) for d, good, ratios in passed if d % 3])
    held = [(good, quality.scores(forest, np.array([ratios]))[0] > limit) for d, good, ratios in passed if not d % 3]
    kept, caught = np.mean([not out for good, out in held if good]), np.mean([out for good, out in held if not good])
    print(f"good kept {kept:.3f}, bad caught {caught:.3f} of {len(held)}; view {forest.view}")
    assert kept >= 0.98 and caught > 2 * (1 - kept)


def test_odd_documents(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 0, 0), (2, None, 1)], "doc_id long, quality int, toxic int")
    rows = quality.judged(odd, labels).collect()
    assert len(rows) == odd.count() and not any(r.kept for r in rows if not r.n_words)
    assert quality.judged(none, labels.limit(0)).count() == 0


def many(spark, n, seed=1):
    """n labelled documents of 60 words; the bad ones, a tenth, have longer words, by a length that varies."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        bad = i % 10 == 0
        rows.append((i, " ".join(rng.choice("abcdefgh") * (rng.randrange(9, 19) if bad else rng.randrange(1, 8)) + str(rng.randrange(99)) for _ in range(60))))
        labels.append((i, 0 if bad else 1))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_all_labelled_documents_take_part(spark, monkeypatch):
    """Draws come from the whole growing half, and the limit counts every document of the other one."""
    docs, labels = many(spark, 9000)
    drawn, levels, seen = quality.drawn, quality._levels, []
    monkeypatch.setattr(quality, "drawn", lambda rows, total, *a: seen.append((rows, total, drawn(rows, total, *a))) or seen[-1][2])
    monkeypatch.setattr(quality, "_levels", lambda *a: seen.append(levels(*a)) or seen[-1])
    forest, limit = quality.trained(docs, labels)
    (rows, total, tables), counts = seen
    assert counts.sum((0, 2, 3)).tolist() == [9000] * len(quality.VIEWS) and abs(counts[1, 0].sum() - 4500) < 300 and total == 9000 - counts[1, 0].sum()
    assert [t.shape for t in tables] == [(quality.ROWS, len(quality.measured("")[1]))] * quality.TREES
    assert len({r.tobytes() for t in tables for r in t}) > 0.98 * rows.select("ratios").distinct().count()  # with 100 trees a row is in no tree by chance only
    halves = {r.doc_id: (r.half, r.ratios) for r in rows.select("doc_id", "half", "ratios").collect()}
    texts = {r.doc_id: (r.quality, r.text) for r in docs.join(labels, "doc_id").collect() if r.doc_id not in halves}
    scores = {kind: quality.scores(forest, np.array([quality.measured(t)[1] for q, t in texts.values() if q == kind])) for kind in (0, 1)}
    assert quality.calibrated(scores[1], scores[0])[1] == limit
    assert 0 < (scores[1] > limit).mean() <= 1 - quality.KEEP and (scores[0] > limit).mean() > 20 * (scores[1] > limit).mean()


def test_draws_are_the_first_by_hash_at_any_size(spark):
    for total in (5, 300, 3000):
        rows = spark.range(total).selectExpr("id as doc_id", "array(cast(id as double)) as ratios")
        keys = np.array([r[0] for r in rows.selectExpr("xxhash64(doc_id)").collect()], np.int64).view(np.uint64)
        for t, table in enumerate(quality.drawn(rows.repartition(3), total, 4)):
            assert table[:, 0].tolist() == np.argsort(quality._mixed(keys, t))[: quality.ROWS].tolist()
