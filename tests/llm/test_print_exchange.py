"""Exact dedup beside a dictionary, and Golomb codes there and back."""

import hashlib
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.llm import print_exchange as pe

SCHEMA = "doc_id long, text string, row string, print string, chunk string"


def rows():
    made = [(i, f"Text number {i % 40}") for i in range(300)] + [(1000 + i, "hot \t copy") for i in range(400)] + [(2000, "hot\ncopy \x0b longer"), (2001, "hotcopy   ")]
    made += [(3000, None), (3001, ""), (3002, " \r\n "), (3003, None), (4000, "é\u00a0x"), (4001, "éx"), (4002, "long " * 40_000), (4003, "long" * 40_000)]
    return made + [(5, "Text number 5")] * 3 + [(None, "Text number 7"), (None, "alone"), (None, None)]


def plain(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0d]", "", text or ""), []).append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    made = []
    for normal, group in groups.items():
        first = min(group)
        sha = hashlib.sha256(normal.encode()).hexdigest()
        kept = 1
        for g in sorted(group):
            made.append((g[3], first[3], len(group), bool(kept), sha))
            kept = 0
    return made


def same(made, want):
    return sorted(map(repr, map(tuple, made))) == sorted(map(repr, want))


@pytest.mark.parametrize("parts", [1, 7])
def test_dedup(spark, parts):
    docs = spark.createDataFrame([(*r, "a", "b", "c") for r in rows()], SCHEMA).repartition(parts)
    assert same(pe.dedup_table(docs).collect(), plain(rows()))


def test_columns_stay(spark):
    docs = spark.createDataFrame([(*r, "a", "b", "c") for r in rows()], SCHEMA).withColumns({"klass": F.lit(1), "Dedup": F.lit(2), "words": F.lit(3)})
    made, x = pe.dedup(docs)
    assert made.columns == [*docs.columns, x] and x not in docs.columns
    assert made.drop(x).exceptAll(docs).count() == 0 and made.count() == docs.count()


def test_small_tables(spark):
    assert pe.dedup_table(spark.createDataFrame([], SCHEMA)).count() == 0
    one = spark.createDataFrame([(1, "a", "", "", "")], SCHEMA)
    assert same(pe.dedup_table(one).collect(), plain([(1, "a")]))


def test_chunks_and_owners(spark, monkeypatch):
    """Many small chunks and owners find what one finds."""
    monkeypatch.setattr(pe, "CHUNK_BITS", 6)
    monkeypatch.setattr(pe, "OWNER_PRINTS", 50)
    docs = spark.createDataFrame([(*r, "a", "b", "c") for r in rows()], SCHEMA).coalesce(2)
    assert same(pe.dedup_table(docs).collect(), plain(rows()))


def test_collisions(spark, monkeypatch):
    """Texts that share a fingerprint are told apart by their bytes."""
    monkeypatch.setattr(F, "xxhash64", lambda c: F.length(c).cast("long"))
    docs = spark.createDataFrame([(*r, "a", "b", "c") for r in rows()], SCHEMA)
    assert same(pe.dedup_table(docs).collect(), plain(rows()))


@pytest.mark.parametrize("width", [1, 7, 40, 64])
def test_golomb(width):
    draw = np.random.default_rng(1)
    for n in (1, 2, 3, 100, 5000):
        values = np.unique(draw.integers(0, 2**width - 1, n, dtype=np.uint64, endpoint=True))
        coded = pe.golomb(values, width)
        assert (pe.golomb_decoded(coded, len(values)) == values).all()
        if n == 5000 and width == 64:
            assert len(coded) < 5000 * 7  # 64 bits less the logarithm of 5000, and about two


def test_answers():
    messages = [np.array([1, 5, 9], np.uint64), np.array([5], np.uint64), np.array([9, 11], np.uint64)]
    rows = pd.DataFrame({"owner": 0, "chunk": [0, 1, 2], "n": [len(m) for m in messages], "coded": [pe.golomb(m, 8) for m in messages]})
    assert [np.unpackbits(np.frombuffer(f, np.uint8))[:3].tolist() for f in pe.answers((0,), rows)["found"]] == [[0, 1, 1], [1, 0, 0], [1, 0, 0]]
