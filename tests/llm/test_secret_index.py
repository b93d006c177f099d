"""Secret spans beside plain Python regexes, and the trigram queries."""

import hashlib
import re

from tidemark.llm import secret_index as si

SCHEMA = "doc_id long, text string, found string, kinds string"
TEXTS = [
    None, "", "nothing here", 'password = "abcdefgh12" and Token:zzzzzzzzz', "token=secret:abcdefghij", "TOKEN=short api_key: 'ABCDEF12+/'", "AKIA1234567890AB AKIA12 xAKIAAKIAAKIAAKIA",
    "é€😀 apikey=0123456789 " + "deadbeef" * 5 + "g" + "a" * 31, "0" * 64 + "\n" + "passwd:" + "x" * 5000, "ghp_" + "a1B2" * 9 + " xoxb-1234567890-abc", "password=password=password=abc",
    "-----BEGIN RSA PRIVATE KEY-----", ("secret: aaaaaaaa " * 50),
]


def brute(text):
    spans = []
    for turn, rule in enumerate(si.RULES):
        for m in re.finditer(rule.pattern, text or ""):
            if len(m.group(rule.group)) >= rule.least:
                spans.append((m.start(), turn, m.end(), rule))
    spans.sort(key=lambda x: x[:2])
    tell = lambda part: ",".join(f"{r.kind}:{a}:{b}" for a, _, b, r in part)
    base = [x for x in spans if x[3].base]
    counts = [sum(x[3].kind == k for x in spans) for k in ("assign", "access", "hex")]
    return (*counts, hashlib.sha256(tell(base).encode()).hexdigest(), tell(spans))


def test_against_regexes(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(TEXTS)] + [(None, TEXTS[3], None, None), (3, TEXTS[3], "x", "y")]
    made = si.secret_table(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(repr, made)) and len(made) == len(rows)
    expected = sorted(repr((r[0], *brute(r[1]))) for r in rows)
    assert sorted(repr(tuple(r)) for r in made) == expected


def test_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    made = {r[0]: tuple(r)[1:] for r in si.secret_table(docs).collect()}
    assert made == {r["doc_id"]: brute(r["text"]) for r in docs.collect()}
    assert sum(x[0] + x[1] for x in made.values()) > 0


def test_empty(spark):
    assert si.secret_table(spark.createDataFrame([], SCHEMA)).count() == 0


def test_queries_of_rules():
    words = {r.kind: si.mandatory(r.pattern) for r in si.RULES}
    assert words["hex"] == si.ANYTHING
    assert words["access"] == frozenset([frozenset(["aki", "kia"])])
    assert frozenset(["pas", "ass", "ssw", "swd"]) in words["assign"] and frozenset(["tok", "oke", "ken"]) in words["assign"]
    assert len(words["assign"]) == 6
    assert si.mandatory("ab.cd") == si.ANYTHING and si.mandatory("(abc)?x*") == si.ANYTHING
    assert si.mandatory("abc[de]f|xyz+") == frozenset([frozenset(["abc", "bcd", "cdf"]), frozenset(["abc", "bce", "cef"]), frozenset(["xyz"])])
