from __future__ import annotations

from collections import Counter
from math import comb

import numpy as np
import pytest
from oracle import connection, same
from pyspark.sql import functions as F

from factlake.llm import mixing, queries


def water(sizes, weights, share=1.5, cap=2.0):
    """Targets by resharing round for round."""
    goal, open_, target = share * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        level = (goal - sum(target[i] for i in range(len(sizes)) if i not in open_)) / sum(weights[i] for i in open_)
        over = {i for i in open_ if level * weights[i] > cap * sizes[i]}
        for i in over or open_:
            target[i] = cap * sizes[i] if over else level * weights[i]
        open_ -= over or open_
    return target


def test_query_equals_its_sql(spark, small):
    same(spark, small, queries.op8_mixing, queries.ORACLES["op8_mixing"])


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_targets_are_met(spark, folder):
    rows = queries.op8_mixing(spark, folder).collect()
    source = dict(connection(folder).sql("SELECT doc_id, source FROM documents").fetchall())
    sizes, taken, largest, target = Counter(), Counter(), Counter(), {}
    for r in rows:
        s = source[r.doc_id]
        sizes[s] += r["size"]
        taken[s] += r.taken
        largest[s] = max(largest[s], r["size"])
        target[s] = r.target
        assert r.taken in (0, r["size"], 2 * r["size"])
    names = sorted(sizes)
    expected = water([sizes[n] for n in names], [(3, 1, 2)[i % 3] for i in range(len(names))])
    for n, t in zip(names, expected, strict=True):
        assert target[n] == pytest.approx(t) and abs(taken[n] - t) <= max(0.005 * t, largest[n] / 2 if len(rows) < 500 else 0)


def test_reruns_agree(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    one, two = (sorted(map(tuple, mixing.digest(d).collect())) for d in (docs, docs.repartition(5, "text")))
    assert one == two


def shards_of(rows):
    """(shard, place) of each draw."""
    return [tuple(d.split(":")) for r in rows for d in r.draws.split(",") if d]


@pytest.mark.parametrize("shards", [5])
def test_each_shard_gets_its_quota_of_each_source(spark, shards):
    """The blocks that a shard holds are those that the tree dealt it: whole blocks in permuted order, and as many as its quota."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = mixing.digest(docs, shards=shards).collect()
    assert sum(len(r.draws.split(",")) if r.draws else 0 for r in rows) == sum(r.taken // r["size"] for r in rows if r["size"])
    sizes = mixing.sized(docs, "mix").select("doc_id", "_source", "_hash", "_size").cache()
    sources = mixing.opened(sizes, mixing.targets(sizes, 1.5, 2.0, mixing.WEIGHTS)).collect()
    plan = {r._source: (r._passes, 1 << r._bits, r._first, r._bits) for r in sources}
    quota = {s: p * blocks + (min(first + mixing.OPEN, blocks) if first is not None else 0) for s, (p, blocks, first, _) in plan.items()}
    table = spark.createDataFrame(list(quota.items()), "_source string, _quota long")
    ranges = {(r._source, r.shard): (r["first"], r["last"]) for r in mixing.split(table, shards, "mix").collect()}
    assert {s for s, _ in ranges} == set(quota) and all(sum(b - a for (n, _), (a, b) in ranges.items() if n == s) == q for s, q in quota.items())
    of = {r.doc_id: (r._source, r._hash) for r in sizes.collect()}
    seen = Counter()
    for r in rows:
        source, h = of[r.doc_id]
        passes, blocks, first, bits = plan[source]
        for n, d in enumerate(x for x in r.draws.split(",") if x):
            number = n * blocks + (h >> (mixing.BITS - bits))
            low, high = ranges[source, int(d.split(":")[0])]
            assert low <= number < high
            seen[source, number] += 1
    for s, q in quota.items():
        assert all(n < q for t, n in seen if t == s)


def test_shards_change_the_output_and_nothing_else_does(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    one, five, again = (mixing.digest(docs, shards=n).orderBy("doc_id").collect() for n in (1, 5, 5))
    assert [r.taken for r in one] == [r.taken for r in five] and five == again
    assert {s for s, _ in shards_of(one)} == {"0"} and {s for s, _ in shards_of(five)} == set("01234")
    mix = mixing.mixed(docs, shards=5).withColumn("_at", F.spark_partition_id()).collect()
    assert all(r._at == r._shard for r in mix)
    for n in range(5):
        order = [r._order for r in mix if r._shard == n]
        assert order == sorted(order)
    assert Counter(str(r._shard) + ":" + r._order[:12] for r in mix) == Counter(":".join(x) for x in shards_of(five))


@pytest.mark.parametrize("block, level", [(1, 2), (8, 10)])
def test_open_blocks_are_found_by_levels(spark, small, monkeypatch, block, level):
    monkeypatch.setattr(mixing, "BLOCK", block)
    monkeypatch.setattr(mixing, "LEVEL", level)
    monkeypatch.setattr(mixing, "OPEN", 2)
    sizes = mixing.sized(spark.read.parquet(f"{small}/documents.parquet"), "mix").select("_source", "_hash", "_size").cache()
    own = [tuple(r) for r in sizes.collect()]
    for r in mixing.opened(sizes, mixing.targets(sizes, 1.5, 2.0, mixing.WEIGHTS)).collect():
        left, at = round(r._target) - r._passes * r._ssize, 0
        if left:
            per = Counter()
            for s, h, n in own:
                if s == r._source:
                    per[h >> (mixing.BITS - r._bits)] += n
            while sum(per[b] for b in range(at + 1)) <= left:
                at += 1
            assert r._first == at and r._left == left - sum(per[b] for b in range(at))
            taken = sum(n for s, h, n in own if s == r._source and (h >> (mixing.BITS - r._bits) < at or h in r._ones))
            assert abs(taken - left) <= max(n for s, _, n in own if s == r._source)
        else:
            assert r._first is None and not r._ones


def test_hypergeometric_by_its_distribution(spark):
    total, good, drawn = 12, 5, 6
    u = [(i + 0.5) / 2000 for i in range(2000)]
    df = spark.createDataFrame([(x,) for x in u], "u double")
    lit = lambda n: F.lit(n).cast("long")
    got = Counter(r[0] for r in df.select(mixing.hypergeometric(lit(total), lit(good), lit(drawn), F.col("u"))).collect())
    for k in range(6):
        p = comb(good, k) * comb(total - good, drawn - k) / comb(total, drawn)
        assert abs(got[k] / 2000 - p) < 0.002


def test_tree_shares_exact_quotas(spark):
    quotas = {"=a": 1000, "=b": 37, "=c": 0, "": 1}
    df = spark.createDataFrame(list(quotas.items()), "_source string, _quota long")
    for shards in (1, 5, 16):
        rows = mixing.split(df, shards, "s").collect()
        for s, q in quotas.items():
            own = sorted((r["first"], r["last"]) for r in rows if r._source == s)
            assert own[0][0] == 0 and own[-1][1] == q and all(a[1] == b[0] for a, b in zip(own, own[1:], strict=False))
        per = Counter()
        for r in rows:
            per[r.shard] += r["last"] - r["first"]
        assert len(per) == shards and max(per.values()) - min(per.values()) <= shards.bit_length() + 1
        assert np.std([r["last"] - r["first"] for r in rows if r._source == "=a"]) < 60


def test_odd_documents(spark, odd, none, tmp_path):
    rows = mixing.digest(odd).collect()
    assert len(rows) == odd.count() and all(r.taken <= 2 * r["size"] for r in rows)
    path = f"{tmp_path}/d.parquet"
    odd.select("doc_id", "text", "source").coalesce(1).write.parquet(path)
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
    key = lambda t: sorted(map(repr, t))
    assert key(tuple(r) for r in rows) == key(con.sql(mixing.SQL).fetchall())
    again = [r.draws for r in rows if r.doc_id == 1]
    assert len(again) == 2 and again[0] == again[1]
    mix = mixing.mixed(odd, places=False)
    assert mix.columns == odd.columns and mix.count() > 0
    assert mixing.digest(none).count() == mixing.mixed(none).count() == 0


def test_no_python_in_the_plan(spark, small):
    plan = queries.op8_mixing(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
