from __future__ import annotations

from collections import Counter, defaultdict

import corpus_pipeline
import pyarrow as pa
from test_jaccard import brute
from test_packing import check
from test_secrets import spans

from factlake.llm import langid
from factlake.llm.common import written


def test_each_stage_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, after = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, small), "test-stage")
        after[name] = before, docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    before, kept = after["language ID"]
    told = {r.doc_id: r for r in langid.identified(before).collect()}
    assert {r.doc_id for r in kept.collect()} == {d for d, r in told.items() if r.lang_pred != "und" and r.score >= 0.4}
    before, kept = after["n-gram Jaccard join"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in brute(rows)})
    before, kept = after["secret scans"]
    texts = {r.doc_id: r.text for r in before.collect()}
    changed = 0
    for r in kept.collect():
        same = r.text == texts[r.doc_id]
        changed += not same
        assert same or (r.n_chars == len(r.text) and "[SECRET]" in r.text)
        assert not spans(r.text)
    assert changed == sum(bool(spans(t)) for t in texts.values()) and kept.count() == before.count()
    before, kept = after["mixing sources to target weights"]
    times = Counter(r.doc_id for r in kept.collect())
    assert max(times.values()) <= 2 and set(times) <= {r.doc_id for r in before.collect()}
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in before.collect():
        sizes[r.source] += len(r.text.encode().split())
        taken[r.source] += times[r.doc_id] * len(r.text.encode().split())
    assert abs(sum(taken.values()) - 1.5 * sum(sizes.values())) < 0.01 * sum(sizes.values())
    before, packed = after["best-fit packing"]
    check(packed, before)


def test_run_gives_what_the_stages_give(spark, small):
    rows = corpus_pipeline.run(spark, small).collect()
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, small), "test-stage")
    key = lambda rs: sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in rs)
    assert key(rows) == key(docs.collect())


def test_odd_documents(spark, odd, none):
    docs = odd
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, ""), "test-stage")
    assert docs.count() > 0
    docs = none
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, ""), "test-stage")
    assert docs.count() == 0


def test_written_rows_reach_workers_in_small_batches(spark):
    """Memory of a worker and of the JVM's side doesn't grow with the length of rows; all rows come, and the session's setting returns."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([batch.num_rows])], ["bytes", "rows"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    texts = spark.range(0, 9000, 1, 1).selectExpr("repeat(cast(id as string), 800) as text")
    rows = written(texts.mapInArrow(sizes, "bytes long, rows long"), "test-batches").collect()
    assert sum(r.rows for r in rows) == 9000 and max(r.bytes for r in rows) < 9 << 20 and sum(r.bytes for r in rows) > 25 << 20
    assert spark.conf.get(key) == before
