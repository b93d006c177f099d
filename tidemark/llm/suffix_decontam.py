"""Benchmark decontamination with suffix arrays of the training text.

Documents are read in shards of about a million words. Each shard's words become
numbers, suffixes are sorted by prefix doubling, and the first 13 words of every suffix
of every test item are binary-searched in that order: the range of training suffixes that
start with them gives all places of that window. Each hit is then followed along all
items that have it, by an order of the hits and of the item suffixes with the same
windows, for the longest verbatim match of every document. Nothing is shuffled: a shard
answers for its documents.

Only training suffixes whose first words all occur in some test item can match, so the
array is built over those; a window cannot cross a word that no item has.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, row_key, small, stored, text_batches

#: Consecutive words that make a window; a shorter item is one window.
WINDOW = 13
#: Words of a shard.
SHARD_WORDS = 1_000_000
#: Test items travel to the tasks in blocks of so many bytes at most.
BLOCK_BYTES = 64 << 20
#: Windows that are searched at a time.
SEARCHED = 1 << 16
#: A document is contaminated if hit words are at least one in so many.
SHARE = 20

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

RESULT = "n_words long, hits array<int>, items array<string>, longest int, longest_at int"


def split_words(text: str | None) -> list[bytes]:
    return WORDS.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


class Items:
    """Test items as numbers, in memory that grows with their words only.

    ``flat`` has the words of all items, a zero after each. Different windows are
    numbered: ``heads`` has where each stands first in ``flat``, ``lengths`` its words,
    ``spots`` from ``spot_from[w]`` on all its places, ``owners`` from ``owner_from[w]``
    on the items that have it, as places in ``names``.
    """

    def __init__(self, items: list[tuple[str, str]], window: int) -> None:
        self.numbers: dict[bytes, int] = {}
        self.window = window
        names: dict[str, int] = {}
        flat, begins, sizes, item = array("i"), array("q"), array("q"), array("q")
        for name, text in items:
            begins.append(len(flat))
            flat.extend(self.numbers.setdefault(w, len(self.numbers) + 1) for w in split_words(text))
            sizes.append(len(flat) - begins[-1])
            item.append(names.setdefault(name, len(names)))
            flat.append(0)
        self.names = np.array(list(names), dtype=object)
        self.flat = np.array(flat, dtype=np.int32)
        size = np.array(sizes, dtype=np.int64)
        length = np.minimum(size, window)
        count = np.where(size > 0, size - length + 1, 0)
        at, length, item = ranges(np.array(begins, dtype=np.int64), count), np.repeat(length, count), np.repeat(np.array(item, dtype=np.int64), count)
        kind, heads, lengths = numbered(self.flat, at, length)
        self.heads, self.lengths = heads.astype(np.int32), lengths.astype(np.int32)
        by_kind = np.argsort(kind, kind="stable")
        edges = np.arange(len(self.heads) + 1)
        self.spots, self.spot_from = at[by_kind].astype(np.int32), np.searchsorted(kind[by_kind], edges).astype(np.int32)
        owned = np.unique(kind * max(len(names), 1) + item)
        self.owners, self.owner_from = (owned % max(len(names), 1)).astype(np.int32), np.searchsorted(owned // max(len(names), 1), edges).astype(np.int32)

    def held(self, windows: np.ndarray, values: str) -> np.ndarray:
        """The "spots" or "owners" of all ``windows``."""
        begin = getattr(self, f"{values[:-1]}_from")
        return getattr(self, values)[ranges(begin[windows], begin[windows + 1] - begin[windows])]


def ranges(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``counts[i]`` numbers from ``begins[i]`` on, for every i."""
    counts = counts.astype(np.int64)
    return np.repeat(begins - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def doubled(rank: np.ndarray, step: int) -> tuple[np.ndarray, int]:
    """Ranks of twice as many words from ranks of the first ``step``, and how many are different."""
    after = np.zeros_like(rank)
    after[:-step] = rank[step:] + 1
    different, rank = np.unique(rank * (int(rank.max()) + 2) + after, return_inverse=True)
    return rank, len(different)


def numbered(flat: np.ndarray, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The number of each window of ``length`` words at ``at``, equal windows having one; and per number its first place and its length.

    Two overlapping stretches of a power of two of words tell a window.
    """
    kind, heads, lengths = np.zeros(len(at), dtype=np.int64), [], []
    rank, step, made = flat.astype(np.int64), 1, 0
    for n in np.unique(length):
        while 2 * step <= n:
            rank, step = doubled(rank, step)[0], 2 * step
        own = np.flatnonzero(length == n)
        pair = rank[at[own]] * (int(rank.max()) + 1) + rank[at[own] + n - step]
        different, first, which = np.unique(pair, return_index=True, return_inverse=True)
        kind[own] = made + which
        heads.append(at[own[first]])
        lengths.append(np.full(len(different), n))
        made += len(different)
    return kind, np.concatenate([np.zeros(0, dtype=np.int64), *heads]), np.concatenate([np.zeros(0, dtype=np.int64), *lengths])


def sorted_suffixes(words: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``words`` in order of their suffixes, by the first ``depth`` words at least."""
    different, rank = np.unique(words, return_inverse=True)
    many, step = len(different), 1
    while step < depth and many < len(rank):
        (rank, many), step = doubled(rank, step), 2 * step
    return np.argsort(rank, kind="stable")


def search(words: np.ndarray, order: np.ndarray, items: Items, upper: bool) -> np.ndarray:
    """For each window of ``items`` the first place in ``order`` whose suffix is not under it (``upper``: is beyond it)."""
    found = [np.zeros(0, dtype=np.int64)]
    for begin in range(0, len(items.heads), SEARCHED):
        heads, lengths = items.heads[begin : begin + SEARCHED], items.lengths[begin : begin + SEARCHED]
        columns, rows = np.arange(lengths.max()), np.arange(len(heads))
        asked = items.flat[np.minimum(heads[:, None] + columns, len(items.flat) - 1)]
        low, high = np.zeros(len(heads), dtype=np.int64), np.full(len(heads), len(order), dtype=np.int64)
        while (open_ := low < high).any():
            middle = (low + high) // 2
            there = words[np.minimum(order[np.minimum(middle, len(order) - 1)][:, None] + columns, len(words) - 1)]
            unequal = (there != asked) & (columns < lengths[:, None])
            first = unequal.argmax(axis=1)
            under = np.where(unequal[rows, first], there[rows, first] < asked[rows, first], upper)
            low, high = np.where(open_ & under, middle + 1, low), np.where(open_ & ~under, middle, high)
        found.append(low)
    return np.concatenate(found)


def with_breaks(at: np.ndarray, window: np.ndarray, symbol: int) -> tuple[np.ndarray, np.ndarray]:
    """``window`` with a symbol of its own, from ``symbol`` on, after each run of consecutive places ``at``; and where each window went."""
    place = np.arange(len(at)) + np.concatenate(([0], np.cumsum(np.diff(at) != 1)))
    made = symbol + np.arange(place[-1] + 2)
    made[place] = window
    return made, place


def reach(at: np.ndarray, window: np.ndarray, items: Items) -> np.ndarray:
    """Words of the longest match with a test item that begins at each hit: of ``window`` at ``at``, in order of ``at``.

    A match of some words more than a window is so many windows more, one after the
    other, in the document and in the item. So the windows hit and the places of the
    same windows in the items are sorted as suffixes, and the longest match of a hit is
    that with the next item suffix on either side.
    """
    made = items.lengths[window].copy()
    whole = np.flatnonzero(made == items.window)
    if not len(whole):
        return made
    used = np.unique(window[whole])
    spots = items.held(used, "spots")
    kinds = np.repeat(used, items.spot_from[used + 1] - items.spot_from[used])
    by_spot = np.argsort(spots, kind="stable")
    mine, place = with_breaks(at[whole], window[whole], len(items.heads))
    theirs = with_breaks(spots[by_spot], kinds[by_spot], len(items.heads) + len(mine))[0]
    different, rank = np.unique(np.concatenate((mine, theirs)), return_inverse=True)
    levels, many, step = [], len(different), 1
    while many < len(rank):
        levels.append(rank.astype(np.int32))
        (rank, many), step = doubled(rank, step), 2 * step
    order = np.argsort(rank)
    spot = np.where(order >= len(mine), np.arange(len(order)), -1)
    before = np.maximum.accumulate(spot)
    after = np.minimum.accumulate(np.where(spot < 0, len(order), spot)[::-1])[::-1]
    longest = np.zeros(len(place), dtype=np.int64)
    for side in (before, after):
        near = side[rank[place]]
        usable = (near >= 0) & (near < len(order))
        a, b = place[usable], order[near[usable]]
        same = np.zeros(len(a), dtype=np.int64)
        for k in range(len(levels) - 1, -1, -1):
            same += (levels[k][a + same] == levels[k][b + same]).astype(np.int64) << k
        longest[usable] = np.maximum(longest[usable], same)
    made[whole] += longest - 1
    return made


def match_shard(texts: list[list[bytes]], items: Items) -> list[tuple[int, list[int], list[str], int, int]]:
    """Per document: number of words, hit ranges (start, end, start, end, ...), items found, longest match and its place."""
    found: list[tuple[int, list[int], list[str], int, int]] = [(len(x), [], [], 0, -1) for x in texts]
    if not len(items.lengths):
        return found
    get, flat, starts = items.numbers.get, [], []
    for x in texts:
        starts.append(len(flat))
        flat += [get(w, 0) for w in x]
        flat.append(0)
    stream, starts = np.array(flat, dtype=np.int32), np.array(starts, dtype=np.int64)
    # runs of known words that can hold the shortest window
    edges = np.flatnonzero(np.diff(np.concatenate(([0], (stream != 0).astype(np.int8), [0]))))
    begins, ends = edges[::2], edges[1::2]
    long_enough = ends - begins >= items.lengths.min()
    begins, ends = begins[long_enough], ends[long_enough]
    if not len(begins):
        return found
    sizes = ends - begins + 1  # each run with the zero after it
    places = ranges(begins, sizes)
    words = np.concatenate((stream[places], [0]))
    places = np.concatenate((places, [len(stream) - 1]))
    order = sorted_suffixes(words, int(items.lengths.max()))
    low, high = search(words, order, items, False), search(words, order, items, True)
    has = np.flatnonzero(high > low)
    if not len(has):
        return found
    count = high[has] - low[has]
    window = np.repeat(has, count)
    at = places[order[ranges(low[has], count)]]
    doc = np.searchsorted(starts, at, side="right") - 1
    by_doc = np.lexsort((at, doc))
    doc, at, window = doc[by_doc], at[by_doc], window[by_doc]
    longest = reach(at, window, items)
    cuts = np.flatnonzero(np.diff(doc)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(doc)]):
        d = int(doc[lo])
        first = at[lo:hi] - starts[d]
        last = np.maximum.accumulate(first + items.lengths[window[lo:hi]])
        opens = np.flatnonzero(np.concatenate(([True], first[1:] > last[:-1])))
        shut = np.concatenate((last[opens[1:] - 1], last[-1:]))
        names = sorted(items.names[np.unique(items.held(np.unique(window[lo:hi]), "owners"))])
        best = int(longest[lo:hi].argmax())
        found[d] = (len(texts[d]), np.column_stack((first[opens], shut)).ravel().tolist(), names, int(longest[lo + best]), int(first[best]))
    return found


def blocks_of(benchmark: DataFrame, window: int, block_bytes: int, sc) -> Iterator[Broadcast]:
    """The items, read partition by partition and broadcast in blocks of bounded size."""
    block: list[tuple[str, str]] = []
    held = 0
    for row in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), "text").where("text IS NOT NULL").toLocalIterator():
        block.append((row[0], row[1]))
        held += len(row[1])
        if held >= block_bytes:
            yield sc.broadcast(Items(block, window))
            block, held = [], 0
    if block:
        yield sc.broadcast(Items(block, window))


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Like ``row_matches``, but where the items fill several blocks, documents that repeat id and text are one row."""
    parts = block_matches(docs, benchmark, window, block_bytes)
    return parts[0] if len(parts) == 1 else merged(parts).drop("n_rows")


def row_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Hits of all test items in each document, one row per row of ``docs`` whatever the size of the items.

    Returns doc_id, doc_key (of id and text), n_words, hits (word ranges start, end, ...,
    merged and in order), items (ids as text, in order, each once), longest and
    longest_at (the longest verbatim match that a test suffix has here, in words, and
    its first word; -1 if none; the first of several). An item of fewer words than a window
    counts with all its words. Every document has its own longest match, whichever
    documents share its shard.

    A null text has no words. Null item ids count as the id "". Repeated items count
    once; repeated documents each get their own row. Without documents the result is
    empty, without items nothing is hit. Items are a stated query set: they go to the
    tasks in blocks of ``block_bytes``, and the blocks' results are merged per document.
    """
    parts = block_matches(docs, benchmark, window, block_bytes)
    if len(parts) == 1:
        return parts[0]
    return merged(parts).withColumn("n_rows", F.explode(F.sequence(F.lit(1).cast("long"), "n_rows"))).drop("n_rows")


def block_matches(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int) -> list[DataFrame]:
    """The hits of each block of items, one row per row of ``docs`` in every block."""
    text_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    own = docs.select("doc_id", "text", row_key(F.col("doc_id"), F.col("text")).alias("doc_key"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, doc_key binary, {RESULT}"
    blocks = list(blocks_of(benchmark, window, block_bytes, sc)) or [sc.broadcast(Items([], window))]
    return [own.mapInPandas(matcher(block), schema) for block in blocks]


def merged(parts: list[DataFrame]) -> DataFrame:
    """One row per different document from the results of several blocks of items, and in n_rows how many rows it has in ``docs``.

    Copies are counted per block first, so that their hits are gathered once and not once a copy.
    """
    united = parts[0].withColumn("block", F.lit(0))
    for i, part in enumerate(parts[1:], 1):
        united = united.unionByName(part.withColumn("block", F.lit(i)))
    best = F.max(F.struct("longest", (-F.col("longest_at")).alias("before"))).alias("best")
    single = united.groupBy("doc_key", "block").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.first("hits").alias("hits"), F.first("items").alias("items"), best, F.count(F.lit(1)).alias("n_rows"))
    gathered = single.groupBy("doc_key").agg(
        F.first("doc_id").alias("doc_id"),
        F.max("n_words").alias("n_words"),
        F.flatten(F.collect_list("hits")).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.max("best").alias("best"),
        F.max("n_rows").alias("n_rows"),
    )
    ranges = F.expr("array_sort(transform(sequence(0, cast(size(hits) / 2 as int) - 1), i -> struct(hits[2 * i] as a, hits[2 * i + 1] as b)))")
    folded = F.aggregate(
        F.when(F.size("hits") > 0, ranges).otherwise(F.expr("cast(array() as array<struct<a:int,b:int>>)")),
        F.expr("cast(array() as array<int>)"),
        lambda done, x: F.when((F.size(done) > 0) & (F.element_at(done, -1) >= x["a"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.greatest(F.element_at(done, -1), x["b"])))).otherwise(
            F.concat(done, F.array(x["a"], x["b"]))
        ),
    )
    return gathered.select("doc_id", "doc_key", "n_words", folded.alias("hits"), "items", F.col("best.longest").alias("longest"), (-F.col("best.before")).alias("longest_at"), "n_rows")


def matcher(held: Broadcast):
    """A function for mapInPandas that matches shard by shard."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = held.value
        for batch in batches:
            texts: list[list[bytes]] = []
            begin, held_words = 0, 0
            for i, text in enumerate(batch["text"]):
                texts.append(split_words(text))
                held_words += len(texts[-1])
                if held_words >= SHARD_WORDS or i == len(batch) - 1:
                    part = batch.iloc[begin : i + 1]
                    columns = pd.DataFrame(match_shard(texts, items), columns=["n_words", "hits", "items", "longest", "longest_at"])
                    yield pd.concat([part[["doc_id", "doc_key"]].reset_index(drop=True), columns], axis=1)
                    texts, begin, held_words = [], i + 1, 0

    return run


def hit_words(hits: Column) -> Column:
    """Number of words in merged ranges (start, end, start, end, ...)."""
    return F.aggregate(F.transform(hits, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)


def contamination(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, doc_key, n_words, n_hit, n_items, items_sha256, contaminated, hits, longest, longest_at, for every row of ``docs``."""
    found = row_matches(docs, benchmark, block_bytes=block_bytes).withColumn("n_hit", hit_words(F.col("hits")))
    return found.select(
        "doc_id", "doc_key", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * SHARE >= F.col("n_words"))).alias("contaminated"), "hits", "longest", "longest_at",
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without contaminated documents; columns and other rows as they are.

    Null and empty texts have no words and stay. Rows that repeat id and text all stay or
    all go; a null id is an id of its own. An empty benchmark, or one of null texts only,
    removes nothing; an empty table stays empty. Extra columns of any name are kept.
    """
    key = fresh(docs, "doc_key")[0]
    bad = stored(contamination(docs, benchmark).where("contaminated").select(F.col("doc_key").alias(key)).distinct())
    return docs.withColumn(key, row_key(F.col("doc_id"), F.col("text"))).join(small(bad), key, "left_anti").select(*docs.columns)


DECONTAM_SQL = r"""
WITH doc AS (
  SELECT doc_id, row_number() OVER () AS row_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []::VARCHAR[]) AS words
  FROM documents
), item AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark WHERE text IS NOT NULL
), cut AS (
  SELECT item_id, words, least(13, len(words)) AS size, unnest(range(1, len(words) - least(13, len(words)) + 2)) AS pos FROM item WHERE len(words) > 0
), windows AS (
  SELECT DISTINCT item_id, size, array_to_string(words[pos:pos + size - 1], ' ') AS gram FROM cut
), place AS (
  SELECT row_id, words, unnest(range(1, len(words) + 1)) AS pos FROM doc
), grams AS (
  SELECT row_id, pos, size, array_to_string(words[pos:pos + size - 1], ' ') AS gram
  FROM place, (SELECT DISTINCT size FROM windows) WHERE pos + size - 1 <= len(words)
), hit AS (
  SELECT row_id, pos, g.size, item_id FROM grams g JOIN windows w ON g.size = w.size AND g.gram = w.gram
), spots AS (
  SELECT DISTINCT row_id, unnest(range(pos, pos + size)) AS spot FROM hit
), counted AS (
  SELECT row_id, count(*) AS n_hit FROM spots GROUP BY row_id
), named AS (
  SELECT row_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT row_id, item_id::VARCHAR AS item_id FROM hit) GROUP BY row_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(words), false) AS contaminated
FROM doc LEFT JOIN counted USING (row_id) LEFT JOIN named USING (row_id)
"""
