"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes of a text: each step shifts the hash and adds a random
number of the new byte, so it depends on the last 32 bytes only. Where its top bits are
zero a chunk ends. Boundaries thus move with the content: after an insertion the next
boundaries fall where they fell before. Chunks are compared by digest; a chunk whose
digest occurred earlier is a repeat, and a stretch of repeats that is long enough is
removed. What is shuffled has a fixed size per chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark.llm.common import fresh, row_key, stored, text_batches

#: A chunk ends where these many top bits of the hash are zero: one byte in 32.
MASK_BITS = 5
#: Shortest and longest chunk in bytes.
LEAST, MOST = 24, 512
#: Repeats are removed in stretches of so many bytes at least.
STRETCH = 80
#: Seed of the gear table.
SEED = 1
#: Bytes that are hashed at once.
PIECE = 1 << 20

GEAR = np.random.RandomState(SEED).randint(0, 1 << 32, 256, dtype=np.uint32)


def gear_hash(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte, from the 32 bytes up to it (fewer at the beginning).

    h = (h << 1) + gear[byte] modulo 2^32 is a sum over the last 32 bytes; it is built by
    doubling the number of bytes summed.
    """
    made, span = GEAR[data], 1
    while span < 32:
        longer = made.copy()
        longer[span:] += made[:-span] << np.uint32(span)
        made, span = longer, span * 2
    return made


def boundaries(data: np.ndarray) -> list[int]:
    """Ends of the chunks of one text."""
    marks: list[int] = []
    for at in range(0, len(data), PIECE):
        back = min(at, 31)
        part = gear_hash(data[at - back : at + PIECE])[back:]
        marks += (np.flatnonzero(part >> np.uint32(32 - MASK_BITS) == 0) + at + 1).tolist()
    ends, last = [], 0
    for mark in chain(marks, [len(data)]):
        while mark - last > MOST:
            last += MOST
            ends.append(last)
        if mark - last >= LEAST or (mark == len(data) and mark > last):
            ends.append(mark)
            last = mark
    return ends


CHUNKS = pa.schema([("doc_no", pa.int64()), ("doc_key", pa.binary()), ("start", pa.int64()), ("size", pa.int32()), ("half", pa.int64()), ("rest", pa.int64())])
CHUNKS_DDL = "doc_no long, doc_key binary, start long, size int, half long, rest long"


def chunk_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunks of the texts (doc_key, bytes) of each Arrow batch, with their digests in two halves."""
    part, number = TaskContext.get().partitionId(), 0
    for batch in batches:
        which, start, size, digest = [], [], [], []
        for i, x in enumerate(batch.column("bytes")):
            raw = x.as_py()
            ends = boundaries(np.frombuffer(raw, dtype=np.uint8))
            begins = [0, *ends[:-1]]
            which += [i] * len(ends)
            start += begins
            size += [b - a for a, b in zip(begins, ends)]
            digest += [xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(begins, ends)]
            if len(start) > 50_000 or i == len(batch) - 1:
                text = np.array(which, dtype=np.int64)
                halves = np.frombuffer(b"".join(digest), dtype=np.int64).reshape(-1, 2)
                columns = [(part << 40) + number + text, batch.column("doc_key").take(pa.array(text)), np.array(start, np.int64), np.array(size, np.int32), halves[:, 0].copy(), halves[:, 1].copy()]
                yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], schema=CHUNKS)
                which, start, size, digest = [], [], [], []
        number += len(batch)


def repeats(docs: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """(doc_key, n_chunks, spans): chunks of each document and the stretches to remove, for documents with bytes.

    A chunk is a repeat if its digest occurs earlier: in a document before in the order
    of (doc_id, doc_key), null ids last, or earlier in the document itself. A stretch is
    a sequence of repeats without a gap. Rows that repeat id and text are one document.
    """
    text_batches(docs.sparkSession)
    own = docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("doc_key"), F.coalesce("text", F.lit("")).cast("binary").alias("bytes")).where(F.length("bytes") > 0)
    chunks = stored(own.select("doc_key", "bytes").mapInArrow(chunk_batches, CHUNKS_DDL))
    # half of a digest finds what may repeat, the whole decides
    likely = chunks.groupBy("half").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("half")
    texts = chunks.groupBy("doc_no").agg(F.first("doc_key").alias("doc_key"), F.count(F.lit(1)).alias("n_chunks"))
    known = stored(texts.join(own.select("doc_key", "doc_id").distinct(), "doc_key"))
    shared = stored(chunks.select("doc_no", "start", "size", "half", "rest").join(likely, "half").join(known.drop("n_chunks"), "doc_no"))
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "doc_key", "start")
    first = shared.groupBy("half", "rest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    later = shared.join(first, ["half", "rest"]).where(place > F.col("first"))
    pieces = later.groupBy("doc_key").agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("end")))).alias("pieces"))
    merged = F.pandas_udf(stretches, "array<struct<a:long,b:long>>")
    spans = pieces.select("doc_key", merged("pieces", F.lit(stretch)).alias("spans")).where(F.size("spans") > 0)
    return known.groupBy("doc_key").agg(F.max("n_chunks").alias("n_chunks")).join(spans, "doc_key", "left")


def stretches(pieces: pd.Series, least: pd.Series) -> pd.Series:
    """Pieces (start, end) in order joined where they touch; those of ``least`` bytes or more."""
    made = []
    for rows, size in zip(pieces, least):
        begin = np.array([r["start"] for r in rows])
        end = np.array([r["end"] for r in rows])
        new = np.concatenate(([True], begin[1:] != end[:-1]))
        a, b = begin[new], end[np.concatenate((new[1:], [True]))]
        made.append([{"a": int(x), "b": int(y)} for x, y in zip(a, b) if y - x >= size])
    return pd.Series(made)


@F.pandas_udf(StringType())
def without(text: pd.Series, spans: pd.Series) -> pd.Series:
    """Texts without byte spans; a character of which a byte is gone goes too."""
    made = []
    for t, gone in zip(text, spans):
        if t is None or gone is None:
            made.append(t)
            continue
        data, at, left = t.encode("utf-8", "surrogatepass"), 0, []
        for s in gone:
            left.append(data[at : s["a"]])
            at = s["b"]
        made.append(b"".join([*left, data[at:]]).decode("utf-8", "ignore"))
    return pd.Series(made)


def dedup(docs: DataFrame, stretch: int = STRETCH) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with repeated stretches cut from ``text``, and the names of two new columns: n_chunks and spans (bytes cut).

    The first place of each chunk stays. Null texts stay null and have no chunks; an
    empty text has none. A document that is an exact copy of an earlier one loses
    everything, if it has ``stretch`` bytes. Rows that repeat id and text get the same
    result. All rows and columns stay; an empty table stays empty.
    """
    names = dict(zip(("doc_key", "n_chunks", "spans"), fresh(docs, "doc_key", "n_chunks", "spans")))
    key = names["doc_key"]
    found = stored(repeats(docs, stretch)).select(F.col("doc_key").alias(key), F.col("n_chunks").alias(names["n_chunks"]), F.col("spans").alias(names["spans"]))
    joined = docs.withColumn(key, row_key(F.col("doc_id"), F.col("text"))).join(found, key, "left")
    cleaned = joined.withColumn("text", without(F.col("text"), F.col(names["spans"])))
    return cleaned.select(*docs.columns, names["n_chunks"], names["spans"]), names


def dedup_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_chunks, n_spans, n_removed (bytes), spans (begin:end, comma-joined), text (what is left)."""
    made, _ = dedup(docs.select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["b"] - x["a"])
    told = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["a"], x["b"])), ",")
    return made.select(
        "doc_id", F.coalesce("n_chunks", F.lit(0)).cast("long").alias("n_chunks"), F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"), F.coalesce(told, F.lit("")).alias("spans"), "text",
    )
