"""Decontamination beside plain loops; SQL covers the test tables."""

import hashlib
import pickle
from random import Random

import pytest

import __spark_entry__ as contract
from check import compare
from tidemark.llm import suffix_decontam as sd

DOCS = "doc_id long, text string, hits string, doc_key string"
PASSAGE = " ".join(f"w{i}" for i in range(30))
ROWS = [
    (0, None), (1, ""), (2, "..."), (3, PASSAGE.upper()), (4, "a b c " + " ".join(PASSAGE.split()[5:18]) + " d"), (5, " ".join(PASSAGE.split()[5:17])),
    (6, "x short item! y"), (7, ("é word " * 400) + PASSAGE), (3, PASSAGE.upper()), (None, PASSAGE + " " + PASSAGE), (8, "short item short item short item"),
]
ITEMS = [(1, PASSAGE), (10, "Short item"), (2, None), (3, "??"), (None, "w20 w21"), (1, PASSAGE), (4, " ".join(PASSAGE.split()[10:]))]


def brute(text, items):
    words = sd.split_words(text)
    hit, names = set(), set()
    for name, item in items:
        own = sd.split_words(item)
        n = min(13, len(own))
        for i in range(len(own) - n + 1 if own else 0):
            for at in range(len(words) - n + 1):
                if words[at : at + n] == own[i : i + n]:
                    hit |= set(range(at, at + n))
                    names.add("" if name is None else str(name))
    ids = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
    return len(words), len(hit), len(names), ids, bool(hit) and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("block_bytes", [1 << 20, 1])
def test_against_loops(spark, block_bytes, monkeypatch):
    monkeypatch.setattr(sd, "BLOCK_BYTES", block_bytes)
    docs = spark.createDataFrame([(*r, "x", "y") for r in ROWS], DOCS)
    found = sd.matches(docs, spark.createDataFrame(ITEMS, "item_id long, text string"), block_bytes=block_bytes).withColumn("n", sd.hit_words(sd.F.col("hits")))
    made = [(r["doc_id"], r["n_words"], r["n"], len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest()) for r in found.collect()]
    rows = ROWS if block_bytes > 1 else list(dict.fromkeys(ROWS))
    assert sorted(map(repr, made)) == sorted(repr((r[0], *brute(r[1], ITEMS)[:4])) for r in rows)
    longest = {r["doc_id"]: (r["longest"], r["longest_at"]) for r in found.collect()}
    assert (13, 3) == longest[4] and longest[0] == (0, -1)


def test_verdicts_and_removal(spark):
    docs, items = spark.createDataFrame([(*r, "x", "y") for r in ROWS], DOCS), spark.createDataFrame(ITEMS, "item_id long, text string")
    made = sd.contamination(docs, items).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert sorted(repr(tuple(r)) for r in made) == sorted(repr((r[0], *brute(r[1], ITEMS))) for r in ROWS)
    kept = sd.clean(docs, items)
    assert kept.columns == docs.columns
    assert sorted(repr(r[0]) for r in kept.collect()) == sorted(repr(r[0]) for r in ROWS if not brute(r[1], ITEMS)[4])


@pytest.mark.parametrize("block_bytes", [1 << 20, 1])
def test_every_row_in_any_block_size(spark, block_bytes):
    docs, items = spark.createDataFrame([(*r, "x", "y") for r in ROWS], DOCS), spark.createDataFrame(ITEMS, "item_id long, text string")
    made = sd.contamination(docs, items, block_bytes=block_bytes).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert sorted(repr(tuple(r)) for r in made) == sorted(repr((r[0], *brute(r[1], ITEMS))) for r in ROWS)


def test_empty(spark):
    docs, none = spark.createDataFrame([(*r, "x", "y") for r in ROWS], DOCS), spark.createDataFrame([], "item_id long, text string")
    assert sd.contamination(docs.limit(0), none).count() == 0
    assert sd.contamination(docs, none).where("n_hit > 0 OR contaminated").count() == 0


def test_shards_do_not_matter(monkeypatch):
    items = sd.Items([("1", PASSAGE), ("2", "short item")], 13)
    texts = [sd.split_words(t) for _, t in ROWS]
    alone = [sd.match_shard([t], items)[0][:3] for t in texts]
    assert [x[:3] for x in sd.match_shard(texts, items)] == alone


def longest_of(words, items, window):
    """The longest match of each hit followed word by word, and its first place."""
    best = (0, 1)
    for _, item in items:
        own = sd.split_words(item)
        n = min(window, len(own))
        for i in range(len(own) - n + 1 if own else 0):
            for at in range(len(words) - n + 1):
                if words[at : at + n] == own[i : i + n]:
                    size = n
                    while n == window and at + size < len(words) and i + size < len(own) and words[at + size] == own[i + size]:
                        size += 1
                    best = max(best, (size, -at))
    return best[0], -best[1]


def test_every_document_has_its_longest_match():
    texts = [sd.split_words(t) for _, t in ROWS] + [sd.split_words("a " + " ".join(PASSAGE.split()[3:20]) + " b")] * 3
    items = [("" if n is None else str(n), t) for n, t in ITEMS if t is not None]
    held = sd.Items(items, 13)
    found = sd.match_shard(texts, held)
    assert [x[3:] for x in found] == [longest_of(t, items, 13) for t in texts] and [x[3:] for x in found[-3:]] == [(17, 1)] * 3
    assert found == [sd.match_shard([t], held)[0] for t in texts]


def test_longest_match_on_few_words():
    random = Random(1)
    some = lambda n: " ".join(random.choice("abc") for _ in range(random.randrange(n)))
    for _ in range(100):
        items = [(str(i % 3), some(25)) for i in range(5)]
        texts = [sd.split_words(f"{some(30)} zz {some(30)}") for _ in range(4)]
        window = random.choice([1, 2, 4, 7])
        assert [x[3:] for x in sd.match_shard(texts, sd.Items(items, window))] == [longest_of(t, items, window) for t in texts]


@pytest.mark.parametrize("block_bytes", [1 << 20, 1])
def test_longest_match_in_any_block_size(spark, block_bytes):
    docs, items = spark.createDataFrame([(*r, "x", "y") for r in ROWS], DOCS), [("" if n is None else str(n), t) for n, t in ITEMS if t is not None]
    made = sd.row_matches(docs, spark.createDataFrame(ITEMS, "item_id long, text string"), block_bytes=block_bytes)
    assert sorted(repr((r["doc_id"], r["longest"], r["longest_at"])) for r in made.collect()) == sorted(repr((d, *longest_of(sd.split_words(t), items, 13))) for d, t in ROWS)


def test_memory_of_a_long_item():
    """What is held of an item grows with its words and not with their square: 3,000 different words had 36 MB of tails."""
    items = sd.Items([("1", " ".join(f"w{i}" for i in range(3000))), ("2", "short item")], 13)
    assert len(pickle.dumps(items)) < 100 * 3000
    text = sd.split_words(" ".join(f"w{i}" for i in range(100, 2900)))
    assert sd.match_shard([text], items) == [(2800, [0, 2800], ["1"], 2800, 0)]


@pytest.mark.parametrize("name", ["op6_systematic_mix", "op7_suffix_decontam"])
def test_sql(spark, folder, name):
    assert compare(spark, name, folder).startswith("ok") and name in contract.oracle_sql()
