"""Chunk dedup beside plain loops, and its resistance to shifts."""

import random

import numpy as np

from tidemark.llm import chunk_dedup as cd

SCHEMA = "doc_id long, text string, doc_key string, spans string"
WORDS = [f"{a}{b}é{c}" for a in "bdfg" for b in "aeiou" for c in ("n", "rt", "st", "")]


def prose(draw, n):
    return " ".join(draw.choice(WORDS) + str(draw.randrange(50)) for _ in range(n))


def chunks(data):
    h, last, made = 0, 0, []
    for i, b in enumerate(data):
        h = ((h << 1) + int(cd.GEAR[b])) % (1 << 32)
        if i + 1 - last == cd.MOST or (h >> 27 == 0 and i + 1 - last >= cd.LEAST) or i + 1 == len(data):
            made.append((last, i + 1))
            last = i + 1
    return made


def brute(rows):
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    seen, result = set(), {}
    for doc_id, text in order:
        data, spans = (text or "").encode(), []
        for a, b in chunks(data):
            if data[a:b] in seen:
                if spans and spans[-1][1] == a:
                    spans[-1][1] = b
                else:
                    spans.append([a, b])
            seen.add(data[a:b])
        spans = [(a, b) for a, b in spans if b - a >= cd.STRETCH]
        left, at = [], 0
        for a, b in [*spans, (len(data), len(data))]:
            left.append(data[at:a])
            at = b
        kept = None if text is None else b"".join(left).decode("utf-8", "ignore")
        result[doc_id, text] = (len(chunks(data)), len(spans), sum(b - a for a, b in spans), ",".join(f"{a}:{b}" for a, b in spans), kept)
    return [(r[0], *result[r]) for r in rows]


def rows():
    draw = random.Random(4)
    passage = prose(draw, 60)
    made = [(i, prose(draw, 50) + passage + prose(draw, 20 + i)) for i in range(20)]
    made += [(30, made[4][1]), (31, made[4][1]), (32, None), (33, ""), (34, "short"), (35, "short"), (36, "a" * 5000), (37, "ab" * 30_000)]
    made += [(None, passage), (None, None), (38, "x" + made[6][1]), (39, prose(draw, 4000)), (40, made[7][1]), (40, made[7][1])]
    return made


def test_gear_hash():
    data = np.frombuffer(prose(random.Random(1), 500).encode(), dtype=np.uint8)
    h = 0
    for b, x in zip(data, cd.gear_hash(data)):
        h = ((h << 1) + int(cd.GEAR[b])) % (1 << 32)
        assert h == x


def test_against_loops(spark, monkeypatch):
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows()], SCHEMA)
    for piece in (1 << 20, 1000):
        monkeypatch.setattr(cd, "PIECE", piece)
        made = cd.dedup_table(docs).collect()
        assert sorted(repr(tuple(r)) for r in made) == sorted(map(repr, brute(rows())))
    whole, names = cd.dedup(docs)
    assert names == {"doc_key": "_doc_key", "n_chunks": "n_chunks", "spans": "_spans"} and whole.columns == [*docs.columns, "n_chunks", "_spans"]


def test_passages_are_caught_wherever_they_stand(spark):
    draw = random.Random(9)
    passages = [prose(draw, 51) for _ in range(60)]
    made = [(i, prose(draw, draw.randrange(60)) + " " + passages[i % 60] + " " + prose(draw, draw.randrange(60))) for i in range(240)]
    found = {r["doc_id"]: r for r in cd.dedup_table(spark.createDataFrame([(*r, "x", "y") for r in made], SCHEMA)).collect()}
    caught = [found[i]["n_removed"] > 0 for i in range(60, 240)]
    assert sum(caught) / len(caught) > 0.97 and not any(found[i]["n_removed"] for i in range(60))
    share = sum(found[i]["n_removed"] for i in range(60, 240)) / sum(len(passages[i % 60].encode()) for i in range(60, 240))
    assert 0.6 < share <= 1


def test_empty(spark):
    assert cd.dedup_table(spark.createDataFrame([], SCHEMA)).count() == 0
