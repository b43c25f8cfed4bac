"""Secret scans through a trigram inverted index, with DataFrame functions only.

From each rule's regular expression a Boolean trigram query is derived (an OR of ANDs). A text's own trigrams are taken in one pass, and postings
(trigram, document key) are written for those that rules name. A rule's candidates come from intersecting the postings of each of its clauses, and
only candidates are verified by the regular expression. A rule without mandatory trigrams (long hex runs) scans every text.

A document key is a 64-bit hash of id and text. Documents that share a key share candidates, which costs a verification at
most, so results don't rest on keys being unique.

Defined results: null or empty text has no spans; repeated rows get equal rows; spans are code points, end exclusive;
an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, restored, text_of, written

#: Candidate tables of at most this many rows (under 100 bytes each) are broadcast to the texts; larger ones are joined by shuffle.
BROADCAST_ROWS = 100_000
#: Characters of a text whose trigrams are held at once; matches whose places are put together at once.
STRETCH, RUN = 1 << 20, 256


def _either(word: str) -> str:
    """The word with ASCII letters in either case, in a form that all regular expression engines read alike."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """pattern: leftmost non-overlapping matches count, if ``group`` has at least ``least`` characters. base: one of the three basic kinds."""

    kind: str
    pattern: str
    group: int
    least: int
    base: bool = True


_NAMES = "|".join(map(_either, ("password", "passwd", "secret", "token"))) + "|" + _either("api") + "_?" + _either("key")
#: In the order in which kinds are listed. ``[0-9a-f]{32,}`` finds the runs of ``[0-9a-f]+`` that have 32 characters.
RULES = (
    Rule("assign", rf"({_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, base=False),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15, base=False),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 29, base=False),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27, base=False),
)

ALWAYS = frozenset([frozenset()])
MOST_STRINGS, MOST_CLAUSES, MOST_IN_CLASS = 128, 48, 6


def _absorbed(clauses) -> frozenset:
    """An OR of ANDs without clauses that a smaller one implies."""
    kept: list[frozenset] = []
    for c in sorted(set(clauses), key=lambda c: (len(c), sorted(c))):
        if not any(k <= c for k in kept):
            kept.append(c)
    return frozenset(kept)


def _both(a: frozenset, b: frozenset) -> frozenset:
    """a AND b; the stricter of the two where their product would be large (a weaker query stays right)."""
    if len(a) * len(b) > MOST_CLAUSES:
        return min((x for x in (a, b) if x != ALWAYS), key=len, default=ALWAYS)
    return _absorbed(x | y for x in a for y in b)


def _grams(strings) -> frozenset:
    """One of the strings occurs: an OR over them of their trigrams."""
    return _absorbed(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def _item(op, arg) -> tuple[frozenset | None, frozenset]:
    """(all lower-cased strings an element matches, or None; the query that it implies)."""
    if op is C.LITERAL:
        return frozenset([chr(arg).lower()]), ALWAYS
    if op is C.IN and all(o is C.LITERAL for o, _ in arg) and len(chars := {chr(x).lower() for _, x in arg}) <= MOST_IN_CLASS:
        return frozenset(chars), ALWAYS
    if op is C.SUBPATTERN:
        return _sequence(arg[3])
    if op is C.BRANCH:
        found = [_sequence(x) for x in arg[1]]
        if all(e is not None for e, _ in found) and sum(len(e) for e, _ in found) <= MOST_STRINGS:
            return frozenset().union(*(e for e, _ in found)), ALWAYS
        return None, _absorbed(c for e, q in found for c in (_grams(e) if e is not None else q))
    if op in (C.MAX_REPEAT, C.MIN_REPEAT):
        low, high, inner = arg
        exact, query = _sequence(inner)
        if (low, high) == (0, 1) and exact is not None:
            return exact | {""}, ALWAYS
        return None, ALWAYS if low == 0 else _grams(exact) if exact is not None else query
    return (frozenset([""]), ALWAYS) if op is C.AT else (None, ALWAYS)


def _sequence(items) -> tuple[frozenset | None, frozenset]:
    strings, query, open_ended = frozenset([""]), ALWAYS, False
    for op, arg in items:
        exact, implied = _item(op, arg)
        if exact is not None and len(strings) * len(exact) <= MOST_STRINGS:
            strings = frozenset(a + b for a in strings for b in exact)
            continue
        query, open_ended = _both(_both(query, _grams(strings)), implied), True
        strings = exact if exact is not None else frozenset([""])
    return (None, _both(query, _grams(strings))) if open_ended else (strings, ALWAYS)


def trigram_query(pattern: str) -> list[list[str]]:
    """The regular expression's Boolean trigram query over ASCII-lower-cased text: any of the lists, all of a list; [] if it has none."""
    exact, query = _sequence(_parser.parse(pattern))
    query = _grams(exact) if exact is not None else query
    return [] if ALWAYS <= query else sorted(sorted(c) for c in query)


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_key", F.xxhash64(docs["doc_id"].cast("string"), text_of(docs)))


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The inverted index: (trigram, _key) for all trigrams of a text that a rule's query names."""
    wanted = F.array(*map(F.lit, sorted({t for r in rules for clause in trigram_query(r.pattern) for t in clause})))
    low = keyed(docs).select("_key", F.lower(text_of(docs)).alias("_low"))
    own = lambda part: F.array_intersect(F.regexp_extract_all(part, F.lit("(?s)(?=(...))"), F.lit(1)), wanted)
    stretches = F.sequence(F.lit(0), F.floor(F.char_length("_low") / STRETCH).cast("int"))
    every = F.when(F.char_length("_low") <= STRETCH, own(F.col("_low"))).otherwise(F.array_distinct(F.flatten(F.transform(stretches, lambda i: own(F.substring(F.col("_low"), i * STRETCH + 1, F.lit(STRETCH + 2)))))))
    return low.select(F.explode(every).alias("trigram"), "_key")


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Document keys with the kinds whose trigram query they satisfy: those that are in the postings of all trigrams of one of its clauses."""
    asked = []
    for r in rules:
        for n, clause in enumerate(trigram_query(r.pattern)):
            if len(clause) > 62:
                raise ValueError(f"{r.kind}: a clause names {len(clause)} trigrams")
            asked += [F.struct(F.lit(t).alias("trigram"), F.lit(r.kind).alias("kind"), F.lit(n).alias("clause"), F.lit(1 << i).cast("long").alias("bit"), F.lit((1 << len(clause)) - 1).cast("long").alias("all")) for i, t in enumerate(clause)]
    clauses = index.sparkSession.range(1).select(F.inline(F.array(*asked)))  # a row for each trigram of a clause
    met = index.join(F.broadcast(clauses), "trigram").groupBy("_key", "kind", "clause", "all").agg(F.bit_or("bit").alias("bits")).filter(F.col("bits") == F.col("all"))
    return met.groupBy("_key").agg(F.collect_set("kind").alias("_kinds"))  # at most as many as there are rules


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once."""
    return F.transform(F.array(value), then)[0]


def _found(text: Column, rule: Rule, place: int) -> Column:
    """Structs (start, place, end) of the rule's matches: what lies between them, and they, give their places.

    Places are summed up in runs of RUN matches, and over the runs, so that time grows with the matches and not with their square.
    """
    whole, part = (F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(g)) for g in (0, rule.group))
    between = F.split(text, rule.pattern, -1)
    span = lambda start, end: F.struct(start.cast("long").alias("start"), F.lit(place).alias("place"), end.cast("long").alias("end"))
    none = F.slice(F.array(span(F.lit(0), F.lit(0))), 1, 0)

    def step(acc, x):
        begin = acc["at"] + F.char_length(x["between"])
        end = begin + F.char_length(x["whole"])
        return F.struct(end.cast("long").alias("at"), F.when(F.char_length(x["part"]) >= rule.least, F.concat(acc["out"], F.array(span(begin, end)))).otherwise(acc["out"]).alias("out"))

    def placed(acc, run):
        moved = F.transform(run["out"], lambda s: span(acc["at"] + s["start"], acc["at"] + s["end"]))
        return F.struct((acc["at"] + run["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    def runs(matches):
        return F.transform(F.sequence(F.lit(0), F.floor(F.size(matches) / RUN).cast("int")), lambda i: F.aggregate(F.slice(matches, i * RUN + 1, F.lit(RUN)), F.struct(F.lit(0).cast("long").alias("at"), none.alias("out")), step))

    zipped = F.arrays_zip(whole.alias("whole"), part.alias("part"), F.slice(between, F.lit(1), F.size(whole)).alias("between"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.slice(F.array(none), 1, 0).alias("out"))
    return F.flatten(F.aggregate(_let(zipped, runs), start, placed)["out"])


def scanned(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with ``_spans``: all spans, structs (start, place, end) in order; place is the rule's place in ``rules``."""
    index = written(postings(docs, rules), "secret-postings")
    found = written(candidates(index, rules), "secret-candidates")
    few = found.count() <= BROADCAST_ROWS
    rows = keyed(docs).join(F.broadcast(found) if few else found, "_key", "left")
    text = text_of(rows)
    none = F.array().cast("array<struct<start:bigint,place:int,end:bigint>>")
    each = [F.when(F.array_contains("_kinds", r.kind) if trigram_query(r.pattern) else text.rlike(r.pattern), _found(text, r, i)).otherwise(none) for i, r in enumerate(rules)]
    return rows.withColumn("_spans", F.array_sort(F.concat(*each))).drop("_key", "_kinds")


def digest(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256 and all spans as text."""
    rows = scanned(docs.select("doc_id", "text"), rules).select("doc_id", "_spans")
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    base = [i for i, r in enumerate(rules) if r.base]
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["place"] + 1), s["start"], s["end"])), ",")
    count = lambda i: F.size(F.filter("_spans", lambda s: s["place"] == i)).cast("long").alias(f"n_{rules[i].kind}")
    return rows.select("doc_id", *map(count, base), F.sha2(shown(F.filter("_spans", lambda s: s["place"].isin(base))), 256).alias("base_sha256"), shown(F.col("_spans")).alias("spans"))


def redacted(docs: DataFrame, mask: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every span replaced by ``mask`` (overlapping spans by one) and n_chars counted anew where a text changed."""
    rows = scanned(carried(docs, "doc_id", "text"), rules)
    text = text_of(rows)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, s):
        before = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        new = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(new, F.concat(acc["out"], F.array(before, F.lit(mask)))).otherwise(acc["out"]).alias("out"))

    done = F.aggregate("_spans", start, step)
    rows = rows.withColumn("_done", F.when(F.size("_spans") > 0, done))
    rest = F.substring(text, (F.col("_done.at") + 1).cast("int"), F.char_length(text))
    new = F.concat(F.array_join("_done.out", ""), rest)
    was = lambda name, then: F.when(F.col("_done").isNull(), F.col("_row").getField(name)).otherwise(then)
    changed = {"text": was("text", new)} | ({"n_chars": was("n_chars", F.char_length(new).cast("long"))} if "n_chars" in docs.columns else {})
    return rows.select(*restored(rows, docs.columns, **changed))


def _sql_spans(i: int, rule: Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    size = "lambda x: length(x)"
    return f"""list_filter(list_transform(range(1, len(regexp_extract_all(t, '{pattern}')) + 1), lambda i: {{
  's': list_sum(list_transform(string_split_regex(t, '{pattern}')[1:i], {size})) + coalesce(list_sum(list_transform(regexp_extract_all(t, '{pattern}')[1:i - 1], {size})), 0),
  'p': {i}, 'n': length(regexp_extract_all(t, '{pattern}')[i]), 'g': length(regexp_extract_all(t, '{pattern}', {rule.group})[i])}}), lambda x: x.g >= {rule.least})"""


def _sql(rules: tuple[Rule, ...] = RULES) -> str:
    kinds = ", ".join(f"'{r.kind}'" for r in rules)
    shown = lambda spans: f"array_to_string(list_transform({spans}, lambda x: [{kinds}][x.p + 1] || ':' || CAST(CAST(x.s AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(x.s + x.n AS BIGINT) AS VARCHAR)), ',')"
    base = [i for i, r in enumerate(rules) if r.base]
    counts = ", ".join(f"CAST(len(list_filter(a, lambda x: x.p = {i})) AS BIGINT) AS n_{rules[i].kind}" for i in base)
    every = ", ".join(_sql_spans(i, r) for i, r in enumerate(rules))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, list_sort(flatten([{every}])) AS a FROM d)
SELECT doc_id, {counts}, sha256({shown(f"list_filter(a, lambda x: x.p <= {max(base)})")}) AS base_sha256, {shown("a")} AS spans FROM f"""


#: What digest() returns, as DuckDB SQL over a table or view ``documents``.
SQL = _sql()
