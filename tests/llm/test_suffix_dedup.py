"""Exact substring dedup beside a count of all 200-byte strings."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import suffix_dedup as sd

SCHEMA = "doc_id long, text string, text_key string, deduped string"
WORDS = [f"{a}{b}é{c}" for a in "bdfg" for b in "aeiou" for c in ("n", "rt", "st", "")]


def prose(draw, n):
    return " ".join(draw.choice(WORDS) + str(draw.randrange(50)) for _ in range(n))


def brute(rows):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[i : i + 200] for d in data for i in range(len(d) - 199))
    made = []
    for (doc_id, _), d in zip(rows, data):
        gone = np.zeros(len(d) + 1, dtype=np.int64)
        for i in range(len(d) - 199):
            if seen[d[i : i + 200]] > 1:
                gone[i] += 1
                gone[i + 200] -= 1
        flags = np.cumsum(gone)[:-1] > 0
        kept = bytes(np.frombuffer(d, dtype=np.uint8)[~flags])
        made.append((doc_id, len(d), int(flags.sum()), len(sd.spans(flags)), hashlib.sha256(kept).hexdigest()))
    return made


def rows():
    draw = random.Random(5)
    passages = [prose(draw, 60) for _ in range(4)]
    made = [(i, prose(draw, 80) + passages[i % 4][i:] + prose(draw, 30)) for i in range(24)]
    base = prose(draw, 300).split(" ")
    for i in range(16):
        words = list(base)
        for _ in range(i):
            words[draw.randrange(300)] = "edit%d" % draw.randrange(9)
        made.append((100 + i, " ".join(words)))
    made += [(200 + i, made[3][1]) for i in range(5)] + [(300, None), (301, ""), (302, "short"), (303, "short")]
    made += [(304, "ab" * 400), (305, "x" * 199), (306, "y" * 201), (307, prose(draw, 40) + "z" * 260 + prose(draw, 40)), (308, "é" * 100 + "q"), (309, "é" * 100)]
    made += [(None, passages[0] * 3), (None, made[5][1]), (400, made[7][1]), (400, made[7][1])]
    return made


def test_cover():
    assert {(a - b) % sd.PERIOD for a in sd.COVER for b in sd.COVER} == set(range(sd.PERIOD))
    a, b = np.ogrid[: sd.PERIOD, : sd.PERIOD]
    assert np.isin((a + sd.MEET) % sd.PERIOD, sd.COVER).all() and np.isin((b + sd.MEET) % sd.PERIOD, sd.COVER).all()


def test_bucket_order():
    draw = random.Random(3)
    text = "".join(draw.choice("ab") for _ in range(300)) * 5 + "a" * 700 + prose(draw, 200) * 2
    data = np.frombuffer(text.encode() + bytes(600), dtype=np.uint8)
    starts = np.arange(len(text.encode()))
    order, _ = sd.sorted_bucket(data, starts, sd.cover_ranks(data, len(starts)))
    raw = data.tobytes()
    told = [raw[p : p + 200] for p in order]
    assert told == sorted(raw[p : p + 200] for p in starts)


@pytest.mark.parametrize("hot, block", [(sd.HOT, sd.BLOCK), (1, 5_000)])
def test_against_counts(spark, monkeypatch, hot, block):
    monkeypatch.setattr(sd, "HOT", hot)
    monkeypatch.setattr(sd, "BLOCK", block)
    monkeypatch.setattr(sd, "PIECE", 1 << 20 if hot > 1 else 900)
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows()], SCHEMA)
    made = sd.dedup_table(docs).collect()
    assert sorted(repr(tuple(r)) for r in made) == sorted(map(repr, brute(rows())))
    if hot > 1:
        whole, name = sd.dedup(docs)
        assert name == "_deduped" and whole.columns == [*docs.columns, name]


def test_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    made = sd.dedup_table(docs).collect()
    expected = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted(repr(tuple(r)) for r in made) == sorted(map(repr, expected)) and sum(r[2] for r in expected)


def test_empty(spark):
    assert sd.dedup_table(spark.createDataFrame([], SCHEMA)).count() == 0
