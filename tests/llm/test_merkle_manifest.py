"""Leaves, roots and proofs beside a plain tree over sorted lists."""

import hashlib
import zlib
from collections import Counter

from pyspark.sql import functions as F

from tidemark.llm import merkle_manifest as mm
from tidemark.llm.places import with_places

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(r, text):
    return digest("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (*r[:4], text)))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def path(levels, i):
    made = []
    for level in levels[:-1]:
        made.append((i % 16, level[i // 16 * 16 : i // 16 * 16 + 16]))
        i //= 16
    return made


def plain(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        group = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        trees[s] = group, tree([leaf(r, r[4]) for r in group])
    top = tree([trees[s][1][-1][0] for s in names])
    for k, s in enumerate(names):
        group, levels = trees[s]
        for i, r in enumerate(group):
            steps = path(levels, i) + path(top, k)
            proof = digest("".join(x for slot, run in steps for j, x in enumerate(run) if j != slot))
            node = leaf(r, r[4])
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                node = leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))
            for slot, run in steps:
                node = digest("".join(node if j == slot else x for j, x in enumerate(run)))
            yield r[0], leaf(r, r[4]), levels[-1][0], top[-1][0], proof, node, node == top[-1][0]


ROWS = [
    (None, "a", "en", 1, "X"), (None, "a", "en", 1, "Y"), (5, None, None, None, None), (-3, "a", "en", 2, "é"), (-3, "a", "en", 2, "é"), (7, "a", None, 1, ""), (7, "a", None, 1, "Z"),
    (2**62, "b", "e", 1, "t" * 50_000), (-(2**63), "a", "x", 0, "t"), (2**63 - 1, "a", "x", 0, "T"), (None, None, "", 3, "Q"),
] + [(i * 37 % 400, "c", "en", i, f"Text {i}") for i in range(300)] + [(3, "é", "en", 1, "A")] * 40


def test_manifest(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).withColumns({"path": F.lit(1), "index": F.lit(2), "g": F.lit("x")}).repartition(5)
    assert Counter(map(tuple, mm.manifest_table(docs).collect())) == Counter(plain(ROWS))


def test_small_tables(spark):
    assert mm.manifest_table(spark.createDataFrame([], SCHEMA)).count() == 0
    one = [(1, "a", "en", 1, "Abc")]
    assert list(map(tuple, mm.manifest_table(spark.createDataFrame(one, SCHEMA)).collect())) == list(plain(one))


def test_columns_stay(spark):
    leaves = spark.createDataFrame([(i, "s", f"{i}", "keep") for i in range(20)], "doc_id long, source string, leaf string, slot string")
    made = mm.manifest(leaves)
    assert made.columns == ["doc_id", "source", "leaf", "slot", "place", "subroot", "root", "path"]
    rows = made.orderBy("doc_id").collect()
    assert [r["place"] for r in rows] == list(range(20)) and all(r["slot"] == "keep" for r in rows)
    assert made.where(mm.folded(F.col("leaf")) != F.col("root")).count() == 0


def test_places_of_one_id(spark):
    """A third of all rows may have one id: places are still 0, 1, 2, ... by digest."""
    rows = [("g", 9 if i % 3 else i, str(i % 4), i) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, id long, digest string, row long")
    made = sorted(with_places(df).collect(), key=lambda r: r["index"])
    assert [r["index"] for r in made] == list(range(200)) and {r["total"] for r in made} == {200}
    keys = [(r["id"], r["digest"]) for r in made]
    assert keys == sorted(keys)
