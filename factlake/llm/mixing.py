"""Mixing sources to target weights through a multivariate-hypergeometric splitting tree.

Within its source a document has a seeded hash. The hash's leading bits are the number of its block, so blocks (about ``BLOCK``
documents each, at any size of a source) are numbered in permuted order. Taking a source to its target means drawing its blocks
in that order, pass after pass; its quota is how many block draws that takes. Of the last ``OPEN`` blocks single documents are taken,
so that the target is met to a small document.

The quotas of all sources are split among output shards: each inner node of a binary tree draws, for every source, how
many of its blocks go left, as if the node's blocks were shuffled and cut. A leaf so gets a number of blocks of each source and
takes the next ones in permuted order: shards are disjoint, and a document that is taken twice has its draws in distant
places. A shard's documents are ordered by a hash of their own. Everything is DataFrame expressions.

No window sees more than a source's ``2 ** LEVEL`` sums of hash ranges, a node's sources, or the documents of the open blocks. The
source table (one row per source) is ordered in one task and stands in one array per tree node, so it is for sources by the hundred
thousand at most.

Defined results: null text has size 0; a null source is a source of its own, the last; a null doc_id takes the hash of its
text; repeated rows count separately, but are taken or left together; an empty table gives an empty result; documents of size 0
take 0 words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, carried, restored, text_of, written

#: Documents of a block on average; blocks of which single documents are taken; bits of a hash, and those that each step of the search for the open blocks looks at.
BLOCK, OPEN, BITS, LEVEL = 8, 16, 60, 10
#: Shards at least, and words of a shard on average where there are more of them.
SHARDS, SHARD_WORDS = 16, 100_000_000
ROUNDS = 4
WEIGHTS = (3, 1, 2)
#: Source and shard tables of at most this many rows (about 1.2 KB and 60 bytes each) are broadcast to the documents.
BROADCAST_SOURCES, BROADCAST_RANGES = 20_000, 200_000


def _number(digest: Column, digits: int) -> Column:
    """The leading hexadecimal digits as a number."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")


def sized(docs: DataFrame, seed: str) -> DataFrame:
    """Adds size, source key and permutation hash to documents."""
    key = F.concat_ws("|", F.lit(seed), F.coalesce(docs["doc_id"].cast("string"), F.md5(text_of(docs))))
    return docs.withColumns({"_size": F.regexp_count(text_of(docs), F.lit(WORD)).cast("long"), "_source": F.coalesce(F.concat(F.lit("="), docs["source"].cast("string")), F.lit("")), "_hash": _number(F.md5(key), BITS // 4)})


def targets(sizes: DataFrame, share: float, cap: float, weights: tuple[int, ...]) -> DataFrame:
    """Source sizes and targets: ``share`` times all words by weight, none above ``cap`` times its source, the excess reshared.

    With whole passes, the words left after them, and the bits of a block number.
    """
    src = sizes.groupBy("_source").agg(F.sum("_size").alias("_ssize"), F.count(F.lit(1)).alias("_rows"))
    by_name = Window.orderBy(F.col("_source") == "", "_source")
    ordered = Window.orderBy(F.col("_cap") / F.col("_weight"), "_source")
    before, rest, every = ordered.rowsBetween(Window.unboundedPreceding, -1), ordered.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    src = src.withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), (((F.row_number().over(by_name) - 1) % len(weights)) + 1).cast("int")).cast("double"))
    src = src.withColumns({"_cap": F.lit(float(cap)) * F.col("_ssize"), "_all": F.lit(float(share)) * F.sum("_ssize").over(every)})
    src = src.withColumn("_level", (F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_weight").over(rest))
    src = src.withColumn("_level", F.min(F.when(F.col("_cap") > F.col("_level") * F.col("_weight"), F.struct((F.col("_cap") / F.col("_weight")).alias("at"), F.col("_source").alias("s"), F.col("_level").alias("level")))).over(every)["level"])
    src = src.withColumn("_target", F.coalesce(F.least("_cap", F.col("_level") * F.col("_weight")), F.col("_cap")))
    words = F.round("_target").cast("long")
    passes = F.when(F.col("_ssize") > 0, F.floor(words / F.col("_ssize"))).otherwise(0).cast("long")
    wanted = F.ceil(F.col("_rows") / BLOCK).cast("long")
    bits = F.when(wanted <= 1, 0).otherwise(F.char_length(F.bin(wanted - 1)))
    return src.select("_source", "_ssize", "_target", passes.alias("_passes"), (words - passes * F.col("_ssize")).alias("_left"), bits.cast("int").alias("_bits"))


def _leading(bits: str) -> Column:
    """The leading bits of the hash, as a number; bits: an SQL expression."""
    return F.expr(f"shiftright(_hash, {BITS} - ({bits}))")


def filled(rows: DataFrame, size: str, order: str, taken: str) -> DataFrame:
    """Marks rows of each source, in order, whose sizes fit into ``_left``: ROUNDS prefixes, each of what still fits, and at
    last the smallest row left, if that comes nearer than leaving it."""
    source = Window.partitionBy("_source")
    so_far = source.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn(taken, F.lit(False))
    for _ in range(ROUNDS):
        fits = ~F.col(taken) & (F.col(size) > 0) & (F.col(size) <= F.col("_left"))
        rows = rows.withColumn("_cum", F.when(fits, F.sum(F.when(fits, F.col(size))).over(so_far)))
        now = F.col("_cum") <= F.col("_left")
        rows = rows.withColumns({taken: F.col(taken) | F.coalesce(now, F.lit(False)), "_left": F.col("_left") - F.coalesce(F.max(F.when(now, F.col("_cum"))).over(source), F.lit(0))})
    rows = rows.drop("_cum")
    out = F.col(taken) | (F.col(size) <= 0)
    smallest = F.row_number().over(source.orderBy(out, size, order)) == 1
    return rows.withColumn(taken, F.col(taken) | (smallest & ~out & (F.col(size) < 2 * F.col("_left"))))


def opened(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """``sources`` with the first open block (``_first``, null if whole passes meet the target), ``_left`` words for the open blocks, and
    ``_ones``, the hashes taken of them.

    The open blocks begin where the sums over blocks in permuted order pass what is left. They are found by sums over ranges of
    hashes, LEVEL bits finer at each step and inside the range that the last step found, so no step sums single blocks of a whole source.
    """
    found = written(sources.withColumns({"_range": F.when(F.col("_left") > 0, F.lit(0).cast("long")), "_wide": F.lit(0)}), "mix-sources")
    for _ in range(-(-(found.agg(F.max("_bits")).first()[0] or 0) // LEVEL)):
        finer = F.least(F.col("_bits"), F.col("_wide") + LEVEL)
        inside = sizes.join(_known(found.filter(F.col("_range").isNotNull() & (F.col("_wide") < F.col("_bits")))), "_source").filter(_leading("_wide") == F.col("_range"))
        sums = inside.groupBy("_source", finer.alias("_wide"), _leading(f"least(_bits, _wide + {LEVEL})").alias("_range")).agg(F.sum("_size").alias("_rsize"), F.first("_left").alias("_left"))
        upto = F.sum("_rsize").over(Window.partitionBy("_source").orderBy("_range"))
        passed = sums.withColumn("_upto", upto).filter("_upto > _left").groupBy("_source").agg(F.min_by(F.struct("_range", "_wide", (F.col("_left") - F.col("_upto") + F.col("_rsize")).alias("_left")), "_range").alias("_now"))
        pick = lambda c: F.coalesce(F.col("_now")[c], F.col(c)).alias(c)
        found = written(found.join(passed, "_source", "left").select("_source", "_ssize", "_target", "_passes", "_bits", *map(pick, ("_range", "_wide", "_left"))), "mix-sources")
    found = found.withColumnRenamed("_range", "_first")
    block = _leading("_bits")
    inside = sizes.join(_known(found.filter("_first is not null")), "_source").filter((block >= F.col("_first")) & (block < F.col("_first") + OPEN))
    units = inside.groupBy("_source", "_hash").agg(F.sum("_size").alias("_usize"), F.first("_left").alias("_left"))
    ones = filled(units, "_usize", "_hash", "_one").filter("_one").groupBy("_source").agg(F.sort_array(F.collect_list("_hash")).alias("_ones"))  # of OPEN blocks
    return found.drop("_wide").join(ones, "_source", "left").withColumn("_ones", F.coalesce("_ones", F.array().cast("array<long>")))


def _known(table: DataFrame, most: int = BROADCAST_SOURCES) -> DataFrame:
    return F.broadcast(table) if table.count() <= most else table


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once; lambdas would compute an expression at each use."""
    return F.transform(F.array(value), then)[0]


def hypergeometric(total: Column, good: Column, drawn: Column, u: Column) -> Column:
    """How many of ``good`` are among ``drawn`` out of ``total``, by inverting the distribution at ``u``.

    The weights follow each other by their exact ratio; values over nine deviations from the mean (below 1e-15) are left out.
    """
    d = lambda c: c.cast("double")
    rate = d(good) / F.greatest(d(total), F.lit(1.0))
    given = F.struct(total.alias("total"), good.alias("good"), drawn.alias("drawn"), u.alias("u"), (d(drawn) * rate).alias("mean"), (9 * F.sqrt(d(drawn) * rate * (1 - rate) + 1) + 1).alias("spread"))

    def bounds(g):
        low = F.greatest(F.lit(0).cast("long"), g["drawn"] + g["good"] - g["total"], F.floor(g["mean"] - g["spread"]))
        return F.struct(low.alias("low"), F.greatest(low, F.least(g["good"], g["drawn"], F.ceil(g["mean"] + g["spread"]))).alias("high"))

    def inverted(g, b):
        after = lambda w, k: F.when(k < b["high"], w * d(g["good"] - k) * d(g["drawn"] - k) / (d(k + 1) * d(g["total"] - g["good"] - g["drawn"] + k + 1))).otherwise(0.0)
        start = [F.lit(1.0).alias("w"), F.lit(0.0).alias("sum")]
        step = lambda a, k: [after(a["w"], k).alias("w"), (a["sum"] + a["w"]).alias("sum")]
        values = F.sequence(b["low"], b["high"])
        weight = F.aggregate(values, F.struct(*start), lambda a, k: F.struct(*step(a, k)))["sum"]
        found = lambda goal: F.aggregate(values, F.struct(*start, b["low"].alias("k")), lambda a, k: F.struct(*step(a, k), F.when(a["sum"] < goal, k).otherwise(a["k"]).alias("k")))["k"]
        return _let(g["u"] * weight, found)

    return _let(given, lambda g: _let(bounds(g), lambda b: inverted(g, b)))


def split(quotas: DataFrame, shards: int, seed: str) -> DataFrame:
    """Shares each source's ``_quota`` blocks among shards: rows (_source, shard, first, last) of permuted draw numbers, last exclusive."""
    entry = lambda s, q: F.struct(s.alias("s"), q.cast("long").alias("q"))
    nodes = quotas.agg(F.sort_array(F.collect_list(entry(F.col("_source"), F.col("_quota")))).alias("has")).select(F.lit(1).cast("long").alias("node"), F.lit(shards).alias("leaves"), "has")
    whole = F.aggregate("has", F.lit(0).cast("long"), lambda a, x: a + x["q"])
    left_leaves = F.floor(F.col("leaves") / 2).cast("int")

    def draw(acc, x):
        u = _number(F.md5(F.concat_ws("|", F.lit(seed), F.col("node"), x["s"])), 13) / float(1 << 52)
        return _let(hypergeometric(acc["total"], x["q"], acc["left"], u), lambda got: F.struct((acc["total"] - x["q"]).alias("total"), (acc["left"] - got).alias("left"), F.concat(acc["out"], F.array(entry(x["s"], got))).alias("out")))

    start = F.struct(F.col("whole").alias("total"), F.floor(F.col("whole") * left_leaves / F.col("leaves")).cast("long").alias("left"), F.slice("has", 1, 0).alias("out"))
    goes = F.aggregate("has", start, draw)["out"]
    left = F.struct((F.col("node") * 2).alias("node"), left_leaves.alias("leaves"), F.col("goes").alias("has"))
    right = F.struct((F.col("node") * 2 + 1).alias("node"), (F.col("leaves") - left_leaves).alias("leaves"), F.zip_with("has", "goes", lambda a, b: entry(a["s"], a["q"] - b["q"])).alias("has"))
    same = F.struct((F.col("node") * 2).alias("node"), F.col("leaves"), F.col("has"))
    below = F.explode(F.when(F.col("leaves") > 1, F.array(left, right)).otherwise(F.array(same))).alias("n")
    for _ in range(max(0, shards - 1).bit_length()):
        nodes = nodes.withColumn("whole", whole).withColumn("goes", goes).select(below).select("n.*")
    flat = nodes.select("node", F.explode("has").alias("h")).select("node", F.col("h.s").alias("_source"), F.col("h.q").alias("q"))
    leaf = Window.partitionBy("_source").orderBy("node")
    last = F.sum("q").over(leaf.rowsBetween(Window.unboundedPreceding, 0))
    return flat.select("_source", (F.row_number().over(leaf) - 1).alias("shard"), (last - F.col("q")).alias("first"), last.alias("last"))


def _cells(tree: DataFrame, quotas: DataFrame, shards: int) -> DataFrame:
    """The tree's ranges by cells of a source's draw numbers (``_cell``: number over ``_width``), so that draws find their shard by equality."""
    width = F.greatest(F.lit(1).cast("long"), F.floor(F.col("_quota") / shards))
    rows = tree.filter("last > first").join(quotas.select("_source", width.alias("_width")), "_source")
    cells = F.sequence(F.floor(F.col("first") / F.col("_width")), F.floor((F.col("last") - 1) / F.col("_width")))
    return rows.withColumn("_cell", F.explode(cells)).groupBy("_source", "_cell").agg(F.collect_list(F.struct("first", "last", "shard")).alias("_ranges"))


def draws(docs: DataFrame, sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS, shards: int | None = None, seed: str = "mix") -> tuple[DataFrame, int]:
    """``docs`` (with what sized() adds) with ``_draws``, an array of (pass, shard), one for each time the mix takes the document, and
    source columns; and the number of shards.

    sizes: the written columns _source, _hash, _size of the same documents.
    """
    sources = written(opened(sizes, targets(sizes, share, cap, weights)), "mix-quotas")
    if shards is None:
        shards = max(SHARDS, -(-int(sources.agg(F.sum("_target")).first()[0] or 0) // SHARD_WORDS))
    sources = sources.withColumn("_blocks", F.expr("shiftleft(1L, _bits)")).withColumn("_quota", F.col("_passes") * F.col("_blocks") + F.when(F.col("_first").isNull(), 0).otherwise(F.least(F.col("_first") + OPEN, F.col("_blocks"))))
    ranges = written(_cells(split(sources.select("_source", "_quota"), shards, seed), sources, shards), "mix-shards")
    ranges = _known(ranges, BROADCAST_RANGES)
    rows = docs.join(_known(sources), "_source").withColumn("_block", _leading("_bits"))
    width = F.greatest(F.lit(1).cast("long"), F.floor(F.col("_quota") / shards))
    last_pass = (F.col("_block") < F.col("_first")) | F.array_contains("_ones", F.col("_hash"))
    names = []
    for n in range(max(1, int(-(-cap // 1)))):
        number = n * F.col("_blocks") + F.col("_block")
        there = (F.col("_passes") > n) | ((F.col("_passes") == n) & F.coalesce(last_pass, F.lit(False)))
        rows = rows.withColumn("_number", F.when(there, number)).withColumn("_cell", F.floor(F.col("_number") / width))
        rows = rows.join(ranges, ["_source", "_cell"], "left")
        mine = F.filter("_ranges", lambda r: (r["first"] <= F.col("_number")) & (F.col("_number") < r["last"]))
        names.append(f"_draw{n}")
        rows = rows.withColumn(names[-1], F.when(F.col("_number").isNotNull(), F.struct(F.lit(n).alias("pass"), mine[0]["shard"].alias("shard")))).drop("_ranges", "_cell", "_number")
    return rows.withColumn("_draws", F.array_compact(F.array(*names))).drop(*names), shards


def _order(seed: str, draw: Column) -> Column:
    """Where a draw stands in its shard's order."""
    return F.md5(F.concat_ws("|", F.lit(seed), draw["shard"], draw["pass"], F.col("_hash")))


def mixed(docs: DataFrame, places: bool = True, **settings) -> DataFrame:
    """The mix itself: a row for each time a document is taken, with the columns of ``docs`` and, if asked for, its shard and place in the shard's order (``_shard``, ``_order``).

    Each shard is a partition of the result, in the shard's order.
    """
    seed = settings.get("seed", "mix")
    whole = sized(carried(docs, "doc_id", "text", "source"), seed)
    sizes = written(whole.select("_source", "_hash", "_size"), "mix-sizes")
    out, shards = draws(whole, sizes, **settings)
    out = out.select(F.explode("_draws").alias("_draw"), "_hash", "_row")
    out = out.select("_row", F.col("_draw.shard").alias("_shard"), _order(seed, F.col("_draw")).alias("_order"))
    out = out.repartitionById(shards, F.col("_shard")).sortWithinPartitions("_shard", "_order")
    return out.select(*restored(out, docs.columns), *(["_shard", "_order"] if places else []))


def digest(docs: DataFrame, **settings) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, the words the mix takes of it, and its draws: shard and place in the shard's order of each."""
    seed = settings.get("seed", "mix")
    few = written(sized(docs.select("doc_id", "text", "source"), seed).select("doc_id", "_source", "_hash", "_size"), "mix-sizes")
    out, _ = draws(few, few.select("_source", "_hash", "_size"), **settings)
    shown = F.array_join(F.transform("_draws", lambda d: F.concat_ws(":", d["shard"], F.substring(_order(seed, d), 1, 12))), ",")
    return out.select("doc_id", F.col("_size").alias("size"), F.col("_ssize").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.size("_draws")).cast("long").alias("taken"), shown.alias("draws"))


def _fill_sql(table: str, size: str, order: str, taken: str, out: str) -> str:
    """CTEs that mark rows as filled() does."""
    steps = [f"{out}0 AS (SELECT *, false AS {taken} FROM {table})"]
    for i in range(ROUNDS):
        fits = f"(NOT {taken} AND {size} > 0 AND {size} <= lft)"
        steps.append(f"{out}c{i} AS (SELECT *, CASE WHEN {fits} THEN sum(CASE WHEN {fits} THEN {size} END) OVER (PARTITION BY src ORDER BY {order} ROWS UNBOUNDED PRECEDING) END AS cum FROM {out}{i})")
        steps.append(f"{out}{i + 1} AS (SELECT * EXCLUDE (cum) REPLACE ({taken} OR coalesce(cum <= lft, false) AS {taken}, lft - coalesce(max(CASE WHEN cum <= lft THEN cum END) OVER (PARTITION BY src), 0) AS lft) FROM {out}c{i})")
    last = f"row_number() OVER (PARTITION BY src ORDER BY {taken} OR {size} <= 0, {size}, {order}) = 1 AND NOT {taken} AND {size} > 0 AND {size} < 2 * lft"
    return ",\n".join([*steps, f"{out} AS (SELECT * REPLACE ({taken} OR ({last}) AS {taken}) FROM {out}{ROUNDS})"])


def _hypergeometric_sql(total: str, good: str, drawn: str, u: str) -> str:
    """hypergeometric() for DuckDB."""
    let = lambda value, name, then: f"list_transform([{value}], lambda {name}: {then})[1]"
    after = "CASE WHEN k < b.high THEN a.w * (g.good - k)::DOUBLE * (g.drawn - k)::DOUBLE / ((k + 1)::DOUBLE * (g.total - g.good - g.drawn + k + 1)::DOUBLE) ELSE 0.0::DOUBLE END"
    values = "range(b.low, b.high + 1)"
    weight = f"list_reduce({values}, lambda a, k: {{'w': {after}, 'sum': a.sum + a.w}}, {{'w': 1.0::DOUBLE, 'sum': 0.0::DOUBLE}}).sum"
    found = f"list_reduce({values}, lambda a, k: {{'w': {after}, 'sum': a.sum + a.w, 'k': CASE WHEN a.sum < goal THEN k ELSE a.k END}}, {{'w': 1.0::DOUBLE, 'sum': 0.0::DOUBLE, 'k': b.low}}).k"
    low = "greatest(0, g.drawn + g.good - g.total, floor(g.mean - g.spread)::BIGINT)"
    bounds = let(low, "lo", "{'low': lo, 'high': greatest(lo, least(g.good, g.drawn, ceil(g.mean + g.spread)::BIGINT))}")
    rate = f"(({good})::DOUBLE / greatest(({total})::DOUBLE, 1.0::DOUBLE))"
    mean = f"({drawn})::DOUBLE * {rate}"
    given = f"{{'total': {total}, 'good': {good}, 'drawn': {drawn}, 'u': {u}, 'mean': {mean}, 'spread': 9 * sqrt({mean} * (1 - {rate}) + 1) + 1}}"
    return let(given, "g", let(bounds, "b", let(f"g.u * {weight}", "goal", found)))


def _sql(seed: str = "mix") -> str:
    got = _hypergeometric_sql("acc.total", "x.q", "acc.lft", f"('0x' || md5('{seed}|' || node || '|' || x.s)[1:13])::BIGINT / {float(1 << 52)}::DOUBLE")
    draw = f"list_transform([{got}], lambda got: {{'total': acc.total - x.q, 'lft': acc.lft - got, 'o': list_append(acc.o, {{'s': x.s, 'q': got}})}})[1]"
    shown = lambda n: f"CASE WHEN n{n} IS NOT NULL THEN f{n}.shard || ':' || md5('{seed}|' || f{n}.shard || '|{n}|' || h)[1:12] END"
    there = lambda n: f"CASE WHEN passes > {n} OR (passes = {n} AND coalesce(block < first OR ones.h IS NOT NULL, false)) THEN {n} * blocks + block END AS n{n}"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || source, '') AS src, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
  ('0x' || md5('{seed}|' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))))[1:{BITS // 4}])::BIGINT AS h FROM documents),
s0 AS (SELECT src, CAST(sum(size) AS BIGINT) AS ssize, count(*) AS many FROM d GROUP BY ALL),
s1 AS (SELECT *, CAST([3, 1, 2][((row_number() OVER (ORDER BY src = '', src)) - 1) % 3 + 1] AS DOUBLE) AS w, 2.0::DOUBLE * ssize AS cap, 1.5::DOUBLE * sum(ssize) OVER () AS goal FROM s0),
s2 AS (SELECT *, (goal - coalesce(sum(cap) OVER (ORDER BY cap / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM s1),
lv AS (SELECT lev FROM s2 WHERE cap > lev * w ORDER BY cap / w, src LIMIT 1),
s3 AS (SELECT src, ssize, many, coalesce(least(cap, (SELECT lev FROM lv) * w), cap) AS target FROM s2),
s4 AS (SELECT *, CASE WHEN ssize > 0 THEN CAST(round(target) AS BIGINT) // ssize ELSE 0 END AS passes FROM s3),
s AS (SELECT *, CAST(round(target) AS BIGINT) - passes * ssize AS lft, CASE WHEN many <= {BLOCK} THEN 0 ELSE length(bin((many + {BLOCK - 1}) // {BLOCK} - 1)) END AS bits FROM s4),
db AS (SELECT d.*, h >> ({BITS} - bits)::BIGINT AS block FROM d JOIN s USING (src)),
b AS (SELECT *, CAST(sum(bsize) OVER (PARTITION BY src ORDER BY block) AS BIGINT) AS upto FROM (SELECT src, block, CAST(sum(size) AS BIGINT) AS bsize FROM db GROUP BY ALL)),
op AS (SELECT src, min(block) AS first, arg_min(lft - upto + bsize, block) AS rest FROM b JOIN s USING (src) WHERE lft > 0 AND upto > lft GROUP BY ALL),
un AS (SELECT src, h, CAST(sum(size) AS BIGINT) AS usize, any_value(rest) AS lft FROM db JOIN op USING (src) WHERE block >= first AND block < first + {OPEN} GROUP BY ALL),
{_fill_sql("un", "usize", "h", "one", "g")},
ones AS (SELECT DISTINCT src, h FROM g WHERE one),
q AS (SELECT *, passes * blocks + CASE WHEN first IS NULL THEN 0 ELSE least(first + {OPEN}, blocks) END AS quota FROM (SELECT s.*, op.first, 1::BIGINT << bits AS blocks FROM s LEFT JOIN op USING (src))),
k AS (SELECT greatest({SHARDS}, coalesce(ceil(floor(sum(target)) / {SHARD_WORDS}), 0))::BIGINT AS shards FROM q),
tree AS (SELECT 0 AS level, 1::BIGINT AS node, shards AS leaves, (SELECT list({{'s': src, 'q': quota::BIGINT}} ORDER BY src) FROM q) AS has FROM k
  UNION ALL SELECT level + 1, c.node, c.leaves, c.has FROM (SELECT level, unnest(CASE WHEN leaves > 1 THEN [
    {{'node': node * 2, 'leaves': leaves // 2, 'has': goes}},
    {{'node': node * 2 + 1, 'leaves': leaves - leaves // 2, 'has': list_transform(range(1, len(has) + 1), lambda i: {{'s': has[i].s, 'q': has[i].q - goes[i].q}})}}]
    ELSE [{{'node': node * 2, 'leaves': leaves, 'has': has}}] END) AS c
  FROM (SELECT *, list_reduce(has, lambda acc, x: {draw},
      {{'total': whole, 'lft': floor(whole * (leaves // 2) / leaves)::BIGINT, 'o': [has[1]][:0]}}).o AS goes
    FROM (SELECT *, list_sum(list_transform(has, lambda x: x.q))::BIGINT AS whole FROM tree WHERE level < (SELECT length(bin(shards - 1)) FROM k))))),
leaf AS (SELECT node, unnest(has, recursive := true) FROM tree WHERE level = (SELECT length(bin(shards - 1)) FROM k)),
f AS (SELECT s AS src, row_number() OVER w - 1 AS shard, sum(q) OVER w - q AS a, sum(q) OVER w AS z FROM leaf WINDOW w AS (PARTITION BY s ORDER BY node ROWS UNBOUNDED PRECEDING)),
x AS (SELECT db.doc_id, db.src, db.size, db.h, q.ssize, q.target, {there(0)}, {there(1)} FROM db JOIN q ON db.src = q.src LEFT JOIN ones ON db.src = ones.src AND db.h = ones.h)
SELECT doc_id, size, ssize AS source_size, target, size * (CASE WHEN n0 IS NULL THEN 0 ELSE 1 END + CASE WHEN n1 IS NULL THEN 0 ELSE 1 END) AS taken,
  array_to_string(list_filter([{shown(0)}, {shown(1)}], lambda z: z IS NOT NULL), ',') AS draws
FROM x LEFT JOIN f AS f0 ON x.src = f0.src AND n0 >= f0.a AND n0 < f0.z LEFT JOIN f AS f1 ON x.src = f1.src AND n1 >= f1.a AND n1 < f1.z
"""


#: What digest() returns, as DuckDB SQL over a table or view ``documents``.
SQL = _sql()
