"""SimHash groups beside plain loops."""

import random
import re

import numpy as np
import pytest
import xxhash

from tidemark.llm import covering_simhash as cs
from tidemark.llm.components import components

SCHEMA = "doc_id long, text string, fp string, component_id string"


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(values, radius=4):
    root = {v: v for v in values}

    def top(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= radius:
                root[top(a)] = top(b)
    return {v: top(v) for v in values}


def brute(rows):
    prints = [fingerprint(r[1]) for r in rows]
    root = roots(sorted(set(prints)))
    least = {}
    for r, f in zip(rows, prints):
        if r[0] is not None:
            least[root[f]] = min(least.get(root[f], r[0]), r[0])
    return [(r[0], f"{f:016x}", least.get(root[f])) for r, f in zip(rows, prints)]


def test_masks_cover():
    for family in range(cs.LEVELS):
        made = [m % (1 << 64) for m in cs.masks(family=family)]
        assert len(made) == 31 and all(28 <= m.bit_count() <= 36 for m in made)
        draw = random.Random(family)
        for _ in range(3000):
            apart = sum(1 << b for b in draw.sample(range(64), 4))
            assert any(m & apart == 0 for m in made)


def test_against_loops(spark):
    draw = random.Random(1)
    base = [[f"Word{draw.randrange(4000)}É" for _ in range(300)] for _ in range(6)]
    rows = [(None, None), (1, ""), (2, " \n"), (3, "one two"), (4, "ONE  two"), (None, "three of nothing"), (5, "x " * 30_000)]
    for i in range(60):
        words = list(base[i % 6])
        for _ in range(i // 12):
            words[draw.randrange(300)] = f"new{draw.randrange(99)}"
        rows.append((100 - i, " ".join(words)))
    rows += rows[-2:]
    made = cs.group_table(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)).collect()
    assert sorted(repr(tuple(r)) for r in made) == sorted(map(repr, brute(rows)))
    kept = cs.keep_one(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)).collect()
    groups = {(x[2], None if x[2] is not None else x[1]) for x in brute(rows)}
    assert len(kept) == len(groups) and {r["doc_id"] for r in kept if r["doc_id"] is not None} == {g for g, _ in groups if g is not None}


@pytest.mark.parametrize("bucket", [2_000, 3])
def test_links_in_large_buckets(spark, bucket):
    """A dense ball of fingerprints, and chains, keep their components also when buckets are dealt out again."""
    draw = random.Random(2)
    values = set()
    for _ in range(4):
        centre = draw.getrandbits(64)
        values |= {centre ^ sum(1 << b for b in draw.sample(range(64), draw.randrange(1, 4))) for _ in range(40)}
        chain = centre ^ draw.getrandbits(64)
        for _ in range(12):
            chain ^= sum(1 << b for b in draw.sample(range(64), 4))
            values.add(chain)
    signed = [int(np.uint64(v).astype(np.int64)) for v in values]
    links = cs.near_links(spark.createDataFrame([(v,) for v in signed], "fp long"), bucket=bucket).collect()
    assert all(((a ^ b) % (1 << 64)).bit_count() <= 4 for a, b in links)
    expected = roots([v % (1 << 64) for v in signed])
    joined = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    made = {v: joined.get(v, v) for v in expected}
    for a, b in [(a, b) for a in expected for b in expected]:
        assert (expected[a] == expected[b]) == (made[a] == made[b])


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 70)] + [(100, i) for i in range(101, 140)] + [(140, 100), (5, 5), (300, 299), (299, 300)]
    made = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert made == {i: 1 for i in range(1, 71)} | {i: 100 for i in range(100, 141)} | {299: 299, 300: 299}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty(spark):
    assert cs.group_table(spark.createDataFrame([], SCHEMA)).count() == 0
    assert cs.keep_one(spark.createDataFrame([], SCHEMA)).count() == 0
