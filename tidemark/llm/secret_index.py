"""Secret scan with a trigram inverted index.

Each rule's regex yields a Boolean query over trigrams that every match must contain.
The index posts, for each trigram that some query names, the documents that have it;
intersecting postings gives candidates per rule, and only those are verified with the
regex. A rule without mandatory trigrams (runs of hex digits) scans every text.

The main path has built-in functions only.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import row_key, small, stored


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has ``least`` characters; ``base`` rules have counts of their own."""

    kind: str
    pattern: str
    group: int
    least: int
    base: bool = False


# The kinds and patterns of the contract, then token formats that their issuers publish.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, True),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 1),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}", 0, 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
)

#: Sets of strings beyond this size are no longer spelled out.
SPELLED = 64

Query = frozenset[frozenset[str]]  # any of these sets of trigrams, all of one set
ANYTHING: Query = frozenset([frozenset()])


@dataclass(frozen=True)
class Part:
    """What is known of the strings that a part of a regex matches.

    ``exact``: all of them, if they are few. Else ``head`` and ``tail``: their first and
    last characters (up to two), and ``query``: trigrams within.
    """

    exact: frozenset[str] | None
    head: frozenset[str] = frozenset([""])
    tail: frozenset[str] = frozenset([""])
    query: Query = ANYTHING

    def heads(self) -> frozenset[str]:
        return frozenset(x[:2] for x in self.exact) if self.exact is not None else self.head

    def tails(self) -> frozenset[str]:
        return frozenset(x[-2:] for x in self.exact) if self.exact is not None else self.tail

    def asked(self) -> Query:
        return trigram_query(self.exact) if self.exact is not None else self.query

    def opened(self) -> Part:
        return Part(None, self.heads(), self.tails(), self.asked())


def smallest(sets: set[frozenset[str]]) -> Query:
    """Without sets that hold another one."""
    return frozenset(x for x in sets if not any(y < x for y in sets))


def both(a: Query, b: Query) -> Query:
    return smallest({x | y for x, y in product(a, b)})


def trigram_query(strings: frozenset[str]) -> Query:
    return smallest({frozenset(x[i : i + 3] for i in range(len(x) - 2)) for x in strings})


def followed(a: Part, b: Part) -> Part:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= SPELLED:
        return Part(frozenset(x + y for x, y in product(a.exact, b.exact)))
    joints = {x + y for x, y in product(a.tails(), b.heads())}
    across = trigram_query(frozenset(joints)) if len(joints) <= SPELLED else ANYTHING
    head = frozenset(x[:2] for x in (x + y for x in a.exact for y in b.heads())) if a.exact is not None else a.head
    tail = frozenset(x[-2:] for x in (x + y for x in a.tails() for y in b.exact)) if b.exact is not None else b.tail
    return Part(None, head, tail, both(both(a.asked(), b.asked()), across))


def either(a: Part, b: Part) -> Part:
    if a.exact is not None and b.exact is not None and len(a.exact | b.exact) <= SPELLED:
        return Part(a.exact | b.exact)
    return Part(None, a.heads() | b.heads(), a.tails() | b.tails(), smallest(set(a.asked() | b.asked())))


EMPTY, UNKNOWN = Part(frozenset([""])), Part(None)


def known(nodes) -> Part:
    """What a sequence of parsed regex nodes must match, in lower case."""
    made = EMPTY
    for kind, value in nodes:
        made = followed(made, known_node(str(kind), value))
    return made


def known_node(kind: str, value) -> Part:
    if kind == "LITERAL":
        return Part(frozenset([chr(value).lower()]))
    if kind == "IN" and all(str(k) == "LITERAL" for k, _ in value):
        return Part(frozenset(chr(v).lower() for _, v in value))
    if kind == "SUBPATTERN":
        return known(value[-1])
    if kind == "BRANCH":
        parts = [known(x) for x in value[1]]
        made = parts[0]
        for part in parts[1:]:
            made = either(made, part)
        return made
    if kind == "MAX_REPEAT":
        least, most, inner = value
        part = known(inner)
        if (least, most) == (0, 1):
            return either(part, EMPTY)
        return part.opened() if least else UNKNOWN
    return UNKNOWN


def mandatory(pattern: str) -> Query:
    """Sets of lower-case trigrams, one of which every match of ``pattern`` contains whole; ``ANYTHING`` if none is sure."""
    return known(re._parser.parse(pattern)).asked()


def post(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index (trigram, doc_key): a row for each of ``trigrams`` in each text, case aside."""
    low = docs.select("doc_key", F.lower("text").alias("low"))
    present = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return low.select("doc_key", F.explode(present).alias("trigram")).distinct()


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame | None:
    """(doc_key, kinds): rules that may match there, from intersected postings. None if no rule has a query."""
    terms = [(r.kind, i, len(need), t) for r in rules for i, need in enumerate(mandatory(r.pattern)) for t in need if frozenset() not in mandatory(r.pattern)]
    if not terms:
        return None
    asked = docs.sparkSession.createDataFrame(terms, "kind string, part int, needed int, trigram string")
    postings = post(docs, sorted({t for *_, t in terms}))
    met = postings.join(F.broadcast(asked), "trigram").groupBy("doc_key", "kind", "part", "needed").agg(F.count(F.lit(1)).alias("n"))
    return met.where("n = needed").groupBy("doc_key").agg(F.collect_set("kind").alias("kinds"))


def spans_of(text: Column, rule: Rule, turn: int) -> Column:
    """array<struct<a, turn, b>>: code points of the matches that count, from the lengths of what lies between matches."""
    whole, own, between = (
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), F.split(text, rule.pattern, -1),
    )
    lengths = F.transform(
        F.arrays_zip(between.alias("gap"), whole.alias("whole"), own.alias("own")),
        lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["whole"]).alias("whole"), F.length(x["own"]).alias("own")),
    )
    found = "array<struct<a:int,turn:int,b:int>>"
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast(found).alias("found"))

    def step(done: Column, x: Column) -> Column:
        a = done["at"] + x["gap"]
        b = a + F.coalesce(x["whole"], F.lit(0))
        span = F.array(F.struct(a.alias("a"), F.lit(turn).alias("turn"), b.alias("b")))
        kept = F.when(x["own"] >= rule.least, F.concat(F.coalesce(done["found"], F.array().cast(found)), span)).otherwise(done["found"])
        return F.struct(b.alias("at"), kept.alias("found"))

    return F.coalesce(F.aggregate(lengths, start, step)["found"], F.array().cast(found))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Spans of all rules in every whole text.

    Returns doc_id, doc_key and, per rule, an array of spans (a, turn, b): start, number
    of the rule and end in code points, leftmost and without overlap within the rule,
    together in ``found`` in order of (a, turn). A null or empty text has none. Rows that
    repeat id and text get the same spans; null ids are kept. An empty table gives an
    empty result. Other columns of ``docs`` play no part.
    """
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), row_key(F.col("doc_id"), F.col("text")).alias("doc_key"))
    posted = candidates(keyed, rules)
    if posted is None:
        chosen = keyed.withColumn("kinds", F.array().cast("array<string>"))
    else:
        chosen = keyed.join(small(stored(posted), 200_000), "doc_key", "left")
    spans = []
    for turn, rule in enumerate(rules):
        free = frozenset() in mandatory(rule.pattern)
        # a scan in full still looks once before it takes matches apart
        looks = F.col("text").rlike(rule.pattern) if free else F.array_contains("kinds", rule.kind)
        spans.append(F.when(looks, spans_of(F.col("text"), rule, turn)).otherwise(F.array().cast("array<struct<a:int,turn:int,b:int>>")).alias(f"s{turn}"))
    each = chosen.select("doc_id", "doc_key", *spans)
    return each.select("doc_id", "doc_key", F.array_sort(F.concat(*[F.col(f"s{i}") for i in range(len(rules))])).alias("found"))


def of_rule(turn: int) -> Callable[[Column], Column]:
    return lambda x: x["turn"] == turn


def secret_table(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_<base kind>, base_sha256, spans: the spans as text, kind:start:end by start and then rule."""
    base = [i for i, r in enumerate(rules) if r.base]
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    told = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["turn"] + 1), x["a"], x["b"])), ",")
    of_base = F.filter("found", lambda x: x["turn"].isin(base))
    counts = [F.size(F.filter("found", of_rule(i))).cast("long").alias(f"n_{rules[i].kind}") for i in base]
    return scan(docs, rules).select("doc_id", *counts, F.sha2(told(of_base), 256).alias("base_sha256"), told(F.col("found")).alias("spans"))
