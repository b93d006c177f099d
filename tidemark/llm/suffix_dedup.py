"""Exact substring dedup with suffixes sorted bucket by bucket, ties settled by a difference cover.

Wanted are the bytes covered by a string of 200 bytes that starts anywhere else too, that
is, suffixes that share 200 bytes with a neighbour in the suffix order. The suffixes of
all texts are dealt to buckets by content: the key of a suffix is the least hash of the
64-byte strings in its first 200 bytes. Equal strings have equal keys, and neighbouring
suffixes mostly share one, so a text is a sequence of runs of suffixes; about one run
per 70 bytes is what is shuffled. A key with one run holds no repetition. If all runs of
a key are the same bytes, they all repeat, and nothing is sorted. For the rest one copy of
each different run is sent to its bucket.

A task sorts one block of buckets at a time: ranks of the suffixes at positions of a
difference cover modulo 73 come first, by doubling; then the bucket's suffixes are sorted by
80 bytes, and ties are settled by the ranks at the distance where both suffixes meet the
cover. Memory is a constant times the block, however long the ties are. A key with more
different runs, or bytes in them, than fit a few blocks has its suffixes counted by digest instead, so no key has
to fit a task.

Texts that are exact copies are found first; one of them stands for all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidemark.llm.common import fresh, small, stored, text_batches, text_key

#: Bytes of a repeated string.
LENGTH = 200
#: Bytes of the strings whose least hash is a suffix's key.
GRAM = 64
GRAMS = LENGTH - GRAM + 1
#: Bytes of text that are hashed at once, and that a block of buckets has.
PIECE = 1 << 18
BLOCK = 1 << 19
#: A key with more different runs, or more bytes in them, is counted by digest, so a bucket is a few blocks at most.
HOT = 4_000
HOT_BYTES = 4 * BLOCK

# A perfect difference set; every residue modulo 73 is a difference of two of them.
PERIOD = 73
COVER = (1, 2, 4, 8, 16, 32, 37, 55, 64)

BASE = 0x9E3779B97F4A7C15
WRAP = (1 << 64) - 1


def powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, base, np.uint64))))


class Hashes:
    """Polynomial hashes of substrings of byte streams up to a length, modulo 2^64."""

    def __init__(self, length: int) -> None:
        self.up = powers(BASE, length + 1)
        self.down = powers(pow(BASE, -1, 1 << 64), length + 1)

    def sums(self, data: np.ndarray) -> np.ndarray:
        made = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=made[1:])
        return made

    def of(self, sums: np.ndarray, begin: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        x = (sums[end] - sums[begin]) * self.down[: len(sums)][begin]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, WRAP, dtype=np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def runs_of(data: np.ndarray, ends: np.ndarray, hashes: Hashes) -> tuple[np.ndarray, ...]:
    """Runs of suffixes with one key in a stream of texts that end at ``ends``: start, number, key, hash of their bytes, keys' places.

    Only suffixes of at least LENGTH bytes within their text count. The last array is 2
    where the key's string stands at two or more places of the run, else 1.
    """
    if len(data) < LENGTH:
        return tuple(np.zeros(0, dtype=d) for d in (np.int64, np.int64, np.uint64, np.uint64, np.int64))
    sums = hashes.sums(data)
    n = len(data) - GRAM + 1
    grams = hashes.of(sums, slice(0, n), slice(GRAM, n + GRAM))
    keys = window_minima(grams, GRAMS)
    inside = np.zeros(len(keys) + 1, dtype=np.int8)
    begins = np.concatenate(([0], ends[:-1]))
    long = ends - begins >= LENGTH
    inside[begins[long]] += 1
    inside[ends[long] - LENGTH + 1] -= 1
    valid = np.cumsum(inside[:-1]) > 0
    new = np.concatenate(([True], (keys[1:] != keys[:-1]) | ~valid[:-1]))
    new[begins[long]] = True
    start = np.flatnonzero(new & valid)
    close = np.flatnonzero(valid & np.concatenate((new[1:] | ~valid[1:], [True]))) + 1
    key = keys[start]
    windows = np.lib.stride_tricks.sliding_window_view(grams, GRAMS)
    first = start + (windows[start] == key[:, None]).argmax(axis=1)
    last = close - 1 + GRAMS - 1 - (windows[close - 1][:, ::-1] == key[:, None]).argmax(axis=1)
    return start, close - start, key, hashes.of(sums, start, close + LENGTH - 1), np.where(first == last, 1, 2)


RUNS = pa.schema([("text_key", pa.binary()), ("text_no", pa.int64()), ("key", pa.int64()), ("own", pa.int64()), ("start", pa.int64()), ("n", pa.int32()), ("places", pa.int32())])
RUNS_DDL = "text_key binary, text_no long, key long, own long, start long, n int, places int"


def pieces(sizes: np.ndarray) -> Iterator[list[tuple[int, int, int]]]:
    """Groups of (text, from, to) of about PIECE bytes; long texts are cut so that each suffix has its LENGTH bytes in one piece."""
    group, held = [], 0
    for i, size in enumerate(sizes.tolist()):
        at = 0
        while size - at >= LENGTH:
            to = min(size, at + PIECE)
            group.append((i, at, to))
            held += to - at
            at = to - LENGTH + 1 if to < size else size
            if held >= PIECE:
                yield group
                group, held = [], 0
    if group:
        yield group


def run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of the texts (text_key, bytes) of each Arrow batch."""
    hashes, part, number = Hashes(2 * PIECE + LENGTH), TaskContext.get().partitionId(), 0
    for batch in batches:
        texts, names = batch.column("bytes"), batch.column("text_key")
        sizes = np.array([len(x) for x in map(memoryview_of, texts)], dtype=np.int64)
        for group in pieces(sizes):
            data = np.concatenate([np.frombuffer(memoryview_of(texts[i]), dtype=np.uint8)[a:b] for i, a, b in group])
            ends = np.cumsum([b - a for _, a, b in group])
            start, n, key, own, places = runs_of(data, ends, hashes)
            which = np.searchsorted(ends, start, side="right")
            text = np.array([i for i, _, _ in group])[which]
            shift = np.array([a for _, a, _ in group]) - np.concatenate(([0], ends[:-1]))
            columns = [names.take(pa.array(text)), (part << 40) + number + text, key.view(np.int64), own.view(np.int64), start + shift[which], n.astype(np.int32), places.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], schema=RUNS)
        number += len(texts)


def memoryview_of(x: pa.Scalar) -> memoryview:
    return memoryview(x.as_buffer())


def meeting_table() -> np.ndarray:
    """For residues a, b the least distance at which both positions lie in the cover."""
    inside = np.isin(np.arange(PERIOD), COVER)
    a, b, d = np.ogrid[:PERIOD, :PERIOD, :PERIOD]
    return (inside[(a + d) % PERIOD] & inside[(b + d) % PERIOD]).argmax(axis=2)


MEET = meeting_table()


def words_at(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as a number, in the order of bytes."""
    return np.lib.stride_tricks.sliding_window_view(data, 8)[places].view(">u8").ravel().astype(np.uint64)


def ranked(data: np.ndarray, places: np.ndarray, n_words: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """``places`` in order of the bytes there, and for each in that order the number of its class of equal bytes."""
    words = [words_at(data, places + 8 * i) for i in range(n_words)]
    order = np.lexsort(words[::-1])
    new = np.zeros(len(places), dtype=bool)
    for w in words:
        new[1:] |= w[order[1:]] != w[order[:-1]]
    return places[order], np.cumsum(new)


def cover_ranks(data: np.ndarray, size: int) -> np.ndarray:
    """Rank of the suffix at each position of the cover, by LENGTH bytes and more; elsewhere 0. Ranks double over steps of the period."""
    places = np.flatnonzero(np.isin(np.arange(size) % PERIOD, COVER))
    ranks = np.zeros(size + 4 * PERIOD, dtype=np.int64)
    order, names = ranked(data, places)
    ranks[order] = names + 1
    step = PERIOD
    while step < LENGTH + PERIOD:
        pair = ranks[places] * (len(places) + 2) + ranks[np.minimum(places + step, size + 3 * PERIOD)]
        ranks[places] = np.unique(pair, return_inverse=True)[1] + 1
        step *= 2
    return ranks


def sorted_bucket(data: np.ndarray, starts: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``starts`` in suffix order, and classes of equal first 80 bytes.

    Ties go on by three-way partition: each member of a class is compared with the
    class's middle by the cover's ranks, all classes at once.
    """
    order, tied = ranked(data, starts)
    group, settled = tied.copy(), np.zeros(0, dtype=bool)
    settled = np.bincount(group) < 2
    while not settled.all():
        sizes = np.bincount(group)
        middle = np.concatenate(([0], np.cumsum(sizes)[:-1])) + sizes // 2
        open_ = np.flatnonzero(~settled[group])
        mine, pivot = order[open_], order[middle[group[open_]]]
        d = MEET[mine % PERIOD, pivot % PERIOD]
        side = np.ones(len(order), dtype=np.int64)
        side[open_] = np.sign(ranks[mine + d] - ranks[pivot + d]) + 1
        key = group * 3 + side
        by = np.argsort(key, kind="stable")
        order, key = order[by], key[by]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        group = np.cumsum(new) - 1
        # the middle's own class is equal as far as ranks tell; single members are done
        settled = (key[new] % 3 == 1) | (np.bincount(group) < 2)
    return order, tied


def repeated_starts(blobs: list[bytes], counts: list[int]) -> list[np.ndarray]:
    """For each blob, whose first ``count`` positions start a suffix, which of them share LENGTH bytes with another suffix."""
    sizes = np.array([len(b) for b in blobs], dtype=np.int64)
    base = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    size = int(sizes.sum())
    data = np.zeros(size + 3 * LENGTH, dtype=np.uint8)
    data[:size] = np.frombuffer(b"".join(blobs), dtype=np.uint8)
    number = np.array(counts, dtype=np.int64)
    starts = np.repeat(base - np.concatenate(([0], np.cumsum(number)[:-1])), number) + np.arange(number.sum())
    order, tied = sorted_bucket(data, starts, cover_ranks(data, size))
    same = np.flatnonzero(tied[1:] == tied[:-1])
    equal = np.ones(len(same), dtype=bool)
    for at in range(80, LENGTH, 8):
        equal &= words_at(data, order[same] + at) == words_at(data, order[same + 1] + at)
    found = np.zeros(size + 1, dtype=bool)
    found[order[same[equal]]] = True
    found[order[same[equal] + 1]] = True
    return [found[b : b + n] for b, n in zip(base, number)]


def spans(flags: np.ndarray) -> list[dict[str, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return [{"a": int(a), "b": int(b)} for a, b in zip(edges[::2], edges[1::2])]


SPANS = "array<struct<a:int,b:int>>"


def sort_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, own, spans) of rows (key, own, n, bytes) in order of keys, block by block; a bucket is never split."""
    held: list[pd.DataFrame] = []
    size = 0
    for batch in chain(batches, [None]):
        if batch is not None:
            held.append(batch)
            size += int(batch["bytes"].map(len).sum())
            if size < BLOCK:
                continue
        if not held:
            continue
        rows = pd.concat(held, ignore_index=True)
        cut = len(rows) if batch is None else int(np.searchsorted(rows["key"].to_numpy(), rows["key"].iloc[-1]))
        done, rest = rows.iloc[:cut], rows.iloc[cut:]
        keys, lengths = done["key"].to_numpy(), done["bytes"].map(len).to_numpy()
        begin = 0
        while begin < len(done):
            # as many whole buckets as fit, at least one
            end = begin + max(1, int(np.searchsorted(np.cumsum(lengths[begin:]), BLOCK)))
            end = len(done) if end >= len(done) else max(int(np.searchsorted(keys, keys[end])), int(np.searchsorted(keys, keys[begin], side="right")))
            part = done.iloc[begin:end]
            flags = repeated_starts(part["bytes"].tolist(), part["n"].tolist())
            yield part[["key", "own"]].assign(spans=[spans(f) for f in flags])
            begin = end
        held, size = [rest], int(rest["bytes"].map(len).sum())


def cut_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, own, n, hot, bytes) of each wanted run of the texts."""
    for batch in batches:
        for lo in range(0, len(batch), 200):
            rows = [
                (r["key"], r["own"], r["n"], r["hot"], data[r["start"] : r["start"] + r["n"] + LENGTH - 1])
                for data, wanted in zip(batch["bytes"].iloc[lo : lo + 200], batch["wanted"].iloc[lo : lo + 200])
                for r in wanted
            ]
            yield pd.DataFrame(rows, columns=["key", "own", "n", "hot", "bytes"])


def suffix_digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row per suffix of each run of a hot key: (key, own, at, digest)."""
    for batch in batches:
        for r in batch.itertuples(index=False):
            digests = [xxhash.xxh3_128_digest(r.bytes[i : i + LENGTH]) for i in range(r.n)]
            yield pd.DataFrame({"key": r.key, "own": r.own, "at": np.arange(r.n, dtype=np.int32), "digest": digests})


def merge_at(at: pd.Series) -> pd.Series:
    made = []
    for places in at:
        flags = np.zeros(max(places) + 1, dtype=bool)
        flags[np.asarray(places)] = True
        made.append(spans(flags))
    return pd.Series(made)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(text_key, spans): bytes to remove from each different text, as merged (begin, end) in order; texts without any are left out."""
    text_batches(docs.sparkSession)
    texts = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), F.coalesce("text", F.lit("")).cast("binary").alias("bytes")).where(F.length("bytes") >= LENGTH)
    counted = texts.groupBy("text_key").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("stands"), F.min(F.length("bytes")).alias("size")).where("copies > 1")
    copied = stored(counted)
    known = small(copied.select("text_key", F.col("stands"), F.lit(True).alias("copied")))
    # one copy stands for all; those without an id can't be told apart and all stay, which finds nothing else
    single = texts.join(known, "text_key", "left").where(F.col("copied").isNull() | F.col("doc_id").eqNullSafe(F.col("stands"))).select("text_key", "bytes")
    runs = stored(single.mapInArrow(run_batches, RUNS_DDL))
    keys = runs.groupBy("key").agg(F.sum("places").alias("total"), F.min("own").alias("least"), F.max("own").alias("most"), F.max("places").alias("places")).where("total > 1")
    several = ((F.col("least") != F.col("most")) | (F.col("p") > 1)).alias("several")
    kept = runs.join(keys.select("key", "least", "most", F.col("places").alias("p")), "key").select("key", "own", "text_no", "start", "n", several)
    kept = stored(kept)
    whole = kept.where(~F.col("several")).select("text_no", F.col("start").alias("a"), (F.col("start") + F.col("n") + LENGTH - 1).alias("b"))
    mixed = kept.where("several")
    texts_by_no = runs.select("text_no", "text_key").distinct()

    alike = stored(mixed.groupBy("key", "own").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("text_no", "start", "n")).alias("x")))
    hot = stored(alike.groupBy("key").agg(F.count(F.lit(1)).alias("n_runs"), F.sum(F.col("x.n") + LENGTH - 1).alias("n_bytes")).where((F.col("n_runs") > HOT) | (F.col("n_bytes") > HOT_BYTES)).select("key", F.lit(True).alias("hot")))
    marked = alike.select("key", "own", "x.*").join(small(hot), "key", "left").withColumn("hot", F.col("hot").isNotNull())
    wanted = marked.join(texts_by_no, "text_no").groupBy("text_key").agg(F.collect_list(F.struct("key", "own", "start", "n", "hot")).alias("wanted"))
    # any text with the key serves, also several copies of it
    cut = single.join(wanted, "text_key").select("bytes", "wanted").mapInPandas(cut_runs, "key long, own long, n int, hot boolean, bytes binary")
    by_key = cut.where("NOT hot").select("key", "own", "n", "bytes").repartition("key").sortWithinPartitions("key")
    sorted_ = by_key.mapInPandas(sort_blocks, f"key long, own long, spans {SPANS}")
    if not hot.isEmpty():
        each = stored(cut.where("hot").mapInPandas(suffix_digests, "key long, own long, at int, digest binary").distinct())
        again = each.groupBy("digest").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("digest")
        merged = F.pandas_udf(merge_at, "array<struct<a:int,b:int>>")
        sorted_ = sorted_.unionByName(each.join(again, "digest").groupBy("key", "own").agg(F.collect_list("at").alias("at")).select("key", "own", merged("at").alias("spans")))
    # runs of equal bytes in several places repeat whole; copies of one text count once
    alone = sorted_.join(alike.where("copies = 1").select("key", "own"), ["key", "own"]).select("key", "own", F.explode("spans").alias("s"))
    found = mixed.join(alone, ["key", "own"]).select("text_no", (F.col("start") + F.col("s.a")).alias("a"), (F.col("start") + F.col("s.b") + LENGTH - 1).alias("b"))
    twice = mixed.join(alike.where("copies > 1").select("key", "own"), ["key", "own"]).select("text_no", F.col("start").alias("a"), (F.col("start") + F.col("n") + LENGTH - 1).alias("b"))

    parts = whole.unionByName(found).unionByName(twice).join(texts_by_no, "text_no").select("text_key", "a", "b")
    copies = copied.select("text_key", F.lit(0).cast("long").alias("a"), F.col("size").cast("long").alias("b"))
    gathered = parts.unionByName(copies).groupBy("text_key").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("spans"))
    return stored(gathered)


@F.pandas_udf(
    StructType([StructField("n_bytes", LongType()), StructField("n_removed", LongType()), StructField("n_spans", LongType()), StructField("kept_sha256", StringType()), StructField("kept", StringType())])
)
def without(text: pd.Series, removed: pd.Series) -> pd.DataFrame:
    """What is left of each text; characters of which a byte is gone go in ``kept``, but not in the digest."""
    rows = []
    for t, pairs in zip(text, removed):
        data = (t or "").encode("utf-8", "surrogatepass")
        at, left, n_spans, gone = 0, [], 0, 0
        end = -1
        for s in [] if pairs is None else pairs:
            if s["a"] > end:
                left.append(data[max(at, 0) : s["a"]])
                n_spans += 1
                end = s["b"]
            end = max(end, s["b"])
            at = end
        left.append(data[at:])
        kept = b"".join(left)
        gone = len(data) - len(kept)
        rows.append((len(data), gone, n_spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
    return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def dedup(docs: DataFrame) -> tuple[DataFrame, str]:
    """Every row of ``docs`` and a new column, a struct: n_bytes, n_removed, n_spans, kept_sha256, kept.

    Removed is each byte covered by a 200-byte string that also starts anywhere else,
    judged on the input; all copies go, also the first. A null text counts as empty;
    shorter texts lose nothing. Rows that repeat a text have it removed whole, if it has
    200 bytes. An empty table stays empty; other columns stay as they are.
    """
    key, gone, made = fresh(docs, "text_key", "gone_spans", "deduped")
    # spans grow with the texts, so they are joined by a shuffle at any size and never sent to every task
    found = repeated_spans(docs).select(F.col("text_key").alias(key), F.col("spans").alias(gone))
    joined = docs.withColumn(key, text_key(F.col("text"))).join(found, key, "left")
    return joined.withColumn(made, without(F.col("text"), F.col(gone))).select(*docs.columns, made), made


def dedup_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    made, x = dedup(docs.select("doc_id", "text"))
    return made.select("doc_id", f"{x}.n_bytes", f"{x}.n_removed", f"{x}.n_spans", f"{x}.kept_sha256")
