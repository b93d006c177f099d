"""Line dedup beside plain loops."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from check import compare
from tidemark.llm import winnow_lines as wl

SCHEMA = "doc_id long, text string, doc_key string, n_removed string"
A = [f"Line {i} of a" for i in range(9)]
ROWS = [
    (1, "\n".join(A)), (2, "own\n" + "\n\n".join(x.upper() for x in A[2:8]) + "\nend"), (3, "\n".join(A[:2]) + "\nnew"), (4, "x\n" * 40 + "y"), (5, None), (6, ""), (7, " \n\t\n"),
    (8, "one\ntwo"), (9, "one\n two "), (10, "one"), (11, "\n".join(A)), (11, "\n".join(A)), (None, "\n".join(A[::-1]) + "\n" + "\n".join(A)), (12, "\n".join(f"long {i} {'z' * 50}" for i in range(3000))),
    (13, "\n".join(f"long {i} {'z' * 50}" for i in range(500, 2500)) + "\n" + "\n".join(f"long {i} {'z' * 50}" for i in range(40))), (14, "q\n" + "\n".join(A[1:4]) + "\nr\n" + "\n".join(A[4:9])),
]


def digest(x):
    return int(hashlib.md5(x.encode()).hexdigest()[:15], 16)


def brute(rows, words=None):
    """Fingerprints, their longer runs, passages of so many words and first places as the docstrings say."""
    key = lambda d, t: hashlib.md5(("null" if d is None else str(d)).encode() + (b"-" if t is None else b"+" + t.encode())).digest()
    docs = sorted({(d is None, d if d is not None else 0, key(d, t), t or "") for d, t in rows})
    seqs, runs, first = [], [], {}
    for n, (*_, text) in enumerate(docs):
        own = [(i, digest(re.sub(r"[ \t\x0b\f\r]+", " ", x.lower()).strip(" "))) for i, x in enumerate(text.split("\n")) if x.strip(" \t\x0b\f\r")]
        h = [x for _, x in own]
        seqs.append(own)
        if not h:
            continue
        grams = [hashlib.md5(" ".join(map(str, h[i : i + 3])).encode()).hexdigest() for i in range(max(1, len(h) - 2))]
        for i in range(max(1, len(grams) - 2)):
            p = min(range(i, min(i + 3, len(grams))), key=lambda j: (grams[j], -j))
            size = min(3, len(h))
            for a, b in [(p, p + size), (p - 1, p + size), (p - 2, p + size), (p, p + size + 1), (p, p + size + 2)]:
                if a >= 0 and b <= len(h):
                    runs.append((n, a, b))
                    first[tuple(h[a:b])] = min(first.get(tuple(h[a:b]), (n, a)), (n, a))
        many = [len(text.split("\n")[i].split()) for i, _ in own]
        for a, b in [(a, b) for a in range(len(h)) for b in range(a + 1, min(a + 4, len(h)) + 1)] if words else []:
            if sum(many[a:b]) >= words > min(sum(many[a + 1 : b]), sum(many[a : b - 1])):
                runs.append((n, a, b))
                first[tuple(h[a:b])] = min(first.get(tuple(h[a:b]), (n, a)), (n, a))
    gone = [set() for _ in docs]
    for n, a, b in runs:
        if first[tuple(x for _, x in seqs[n][a:b])] < (n, a):
            gone[n] |= {i for i, _ in seqs[n][a:b]}
    result = {d[2]: g for d, g in zip(docs, gone)}
    made = []
    for d, t in rows:
        g = result[key(d, t)]
        left = [x for i, x in enumerate((t or "").split("\n")) if i not in g]
        text = t if not g else "" if not "".join(left).strip(" \t\x0b\f\r") else "\n".join(left)
        made.append((d, 0 if t is None else len(text.split("\n")), len(g), text))
    return made


def test_against_loops(spark):
    docs = spark.createDataFrame([(*r, "x", "y") for r in ROWS], SCHEMA)
    made = wl.dedup_table(docs).collect()
    assert sorted(repr(tuple(r)) for r in made) == sorted(map(repr, brute(ROWS)))
    by = {r["doc_id"]: r["text"] for r in made}
    assert by[2] == "own\n\n\n\n\n\nend" and by[3] == ROWS[2][1] and by[4] == "x\ny" and by[9] == "" and by[11] == "" and by[13] == ""
    whole, many = wl.dedup(docs)
    assert many == "_n_removed" and whole.columns == [*docs.columns, many]


def test_white_space_in_lines(spark):
    """Lines compare by their words, whatever stands between and around them; plain texts skip the search for other white space."""
    own = ["One two  three", "F\u00fcnf\x0b sechs\r", "\t sieben\x0c\facht ", " \u00c4\u03a3 neun", "zehn"]
    same = ["one two three", "f\u00fcnf sechs", "sieben acht", "\u00e4\u03c2 neun", "zehn"]
    rows = [(1, "\n".join(same)), (2, "\n \t\r\n".join(own)), (3, "\r\n".join(x.upper() for x in same) + "\r\nnew"), (4, "onetwo three\n" + "\n".join(same[1:3])), (2, "\n \t\r\n".join(own))]
    made = sorted((r["doc_id"], r["n_lines_left"], r["n_removed"], r["text"]) for r in wl.dedup_table(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)).collect())
    assert made == [(1, 5, 0, rows[0][1]), (2, 1, 5, ""), (2, 1, 5, ""), (3, 1, 5, "new"), (4, 3, 0, rows[3][1])]


def test_lines_are_hashed_where_they_are_read(spark):
    """No sort and no shuffle before the lines are stored, and every line is hashed once."""
    plan = wl.line_sequences(spark.createDataFrame([(1, "a\nb", "", "")], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    assert plan.count("conv(") == 1
    docs = spark.createDataFrame([(1, "\n".join(A), "", "")] * 3, SCHEMA)
    assert wl.cuts(docs.unionByName(docs.withColumn("doc_id", F.lit(2))), 3, 3).groupBy("doc_key").count().where("count > 1").count() == 0


def test_guarantee(spark):
    """Whatever surrounds it, a repeated run of five lines goes whole."""
    rows = [(i, "\n".join([f"b{i}{j}" for j in range(i % 7)] + A[i % 4 : i % 4 + 5] + [f"e{i}{j}" for j in range(i % 5)])) for i in range(40)]
    for r in wl.dedup_table(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)).collect():
        assert r["doc_id"] < 4 or r["n_removed"] == 5


def test_isolated_passages(spark):
    """A repeated passage of 40 words or more goes whole, be it one line or up to four, whatever surrounds it; shorter ones stay."""
    words = lambda a, n: " ".join(f"{a}{i}" for i in range(n))
    cases = {"one": [words("p", 51)], "two": [words("q", 25), words("r", 26)], "four": [words("s", 5), words("t", 20), words("u", 10), words("v", 6)], "uneven": [words("x", 3), words("y", 45), words("z", 2)], "short": [words("k", 15), words("l", 15)]}
    rows = []
    for n, lines in enumerate(cases.values()):
        rows += [(20 * n + i, "\n".join([f"b{n} {i} {j}" for j in range(1 + i % 4)] + [""] + lines + [f"e{n} {i} {j}" for j in range(1 + i % 3)])) for i in range(12)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    removed = {r["doc_id"]: r["n_removed"] for r in wl.dedup_table(docs, words=wl.PASSAGE_WORDS).collect()}
    for n, (name, lines) in enumerate(cases.items()):
        assert removed[20 * n] == 0, name
        assert {removed[20 * n + i] for i in range(1, 12)} == {len(lines)} if name != "short" else {removed[20 * n + i] for i in range(12)} == {0}, name
    assert any(r["n_removed"] == 0 for r in wl.dedup_table(docs).where("doc_id BETWEEN 1 AND 11").collect())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_passages_in_sql(spark, sf):
    assert compare(spark, "op10_winnow_passages", f"/root/testdata/{sf}").startswith("ok")


def test_empty(spark):
    assert wl.dedup_table(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql(spark, sf):
    assert compare(spark, "op10_winnow_lines", f"/root/testdata/{sf}").startswith("ok")
