"""The mix on skewed, tied and missing rows; SQL covers the test tables."""

import re
from collections import defaultdict

import pytest

from tidemark.llm import systematic_mix as sm

SCHEMA = "doc_id long, text string, source string, size string, copies string"


def targets(sizes):
    """By rounds: deal by weight, stop those above, deal the rest again."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, made = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 2 * sizes[s]]
        if not over:
            return made | {s: level * weight[s] for s in open_}
        for s in over:
            made[s] = 2 * sizes[s]
            left -= made[s]
            open_.remove(s)
    return made


def rows():
    made = [(i, "word " * (i % 7 + 1), "hot") for i in range(900)] + [(i, "same words here", "ties") for i in range(1000, 1300)]
    made += [(i, "a b c d e f g h i j", None) for i in range(2000, 2040)] + [(3000, None, "hot"), (3001, "", "none"), (None, "x y", "ties"), (None, None, None)]
    return made + [(4000, "w " * 40_000, "long"), (4001, "w " * 3, "long")] + [(1000, "same words here", "ties")] * 5


def test_mix(spark):
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows()], SCHEMA)
    made = sm.mix_table(docs).collect()
    sizes, taken, target, most = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    assert len(made) == len(rows())
    for (doc_id, text, source), r in zip(sorted(rows(), key=repr), sorted(made, key=lambda r: repr((r["doc_id"], None, r["source"])))):
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        most[r["source"]] = max(most[r["source"]], r["size"])
        assert r["taken"] == r["size"] * r["copies"] <= 2 * r["size"]
    own = defaultdict(int)
    for _, text, source in rows():
        own[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    assert dict(own) == dict(sizes) and all(r["source_size"] == own[r["source"]] for r in made)
    for s, t in targets(dict(own)).items():
        assert target[s] == pytest.approx(t) and abs(taken[s] - t) <= 2 * most[s] + 1e-9
    again = sm.mix_table(docs.repartition(13)).collect()
    assert sorted(map(repr, made)) == sorted(map(repr, again))


def test_emit(spark):
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows()], SCHEMA)
    mixed, names = sm.mix(docs)
    assert names == {"size": "_size", "source_size": "source_size", "target": "target", "copies": "_copies"}
    out = sm.emit(docs)
    assert out.columns == docs.columns and out.count() == sum(r["_copies"] for r in mixed.collect())
    assert sm.emit(docs.limit(0)).count() == 0 and sm.mix_table(docs.limit(0)).count() == 0
    clash = docs.withColumnsRenamed({"size": "mix_within_u", "copies": "MIX_START"})
    assert sm.emit(clash).columns == clash.columns and sm.emit(clash).count() == out.count()
    blank = spark.createDataFrame([(1, None, "a", "", ""), (2, " ", None, "", "")], SCHEMA)
    assert [(r["target"], r["copies"]) for r in sm.mix_table(blank).collect()] == [(0.0, 0)] * 2
