"""Exact dedup by an exchange of Golomb-coded fingerprints between chunks of rows and owners of hash ranges.

Rows are written once, bucketed by chunk, with a 64-bit fingerprint of their normalised
text. Each chunk sends every owner the leading bits of its different fingerprints in the
owner's range, sorted and Golomb-coded; the owner answers with a bitmap of those that
another chunk sent too. A chunk turns the answers into one bit per row. Only rows whose
bit is set are suspects: their texts, and no others, are shuffled and compared byte by
byte. The rest never move, as their bits are joined to the buckets they already lie in.

What a chunk sends and what an owner holds is bounded by ``CHUNK_BITS`` and
``OWNER_PRINTS``: a fingerprint leaves a chunk once, however many copies there are.
Groups of copies are folded by aggregates before they are shuffled.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import STORED, fresh, small, stored
from tidemark.session import checkpoint_dir

#: A chunk has 2^CHUNK_BITS consecutive rows of a partition at most.
CHUNK_BITS = 14
#: Fingerprints that an owner gets, about.
OWNER_PRINTS = 1 << 22
#: Bits of a sent fingerprint beyond the logarithm of the number of rows: one row in 2^SPARE_BITS is suspected for nothing.
SPARE_BITS = 12

SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """``text`` without ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def packed(values: np.ndarray, bits: int) -> bytes:
    """The last ``bits`` bits of each number, one after another."""
    each = np.unpackbits(values.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return np.packbits(each[:, 64 - bits :]).tobytes()


def unpacked(data: np.ndarray, n: int, bits: int) -> np.ndarray:
    each = np.zeros((n, 64), dtype=np.uint8)
    each[:, 64 - bits :] = np.unpackbits(data, count=n * bits).reshape(n, bits)
    return np.packbits(each, axis=1).view(">u8").ravel().astype(np.uint64)


def golomb(values: np.ndarray, width: int) -> bytes:
    """Sorted different numbers of ``width`` bits, as Golomb codes of their gaps with a power of two near the mean gap.

    First one byte with the parameter, then the quotients in unary, then the remainders.
    """
    gaps = np.diff(values, prepend=np.uint64(0))
    bits = max(0, width - max(1, len(values)).bit_length())
    quotients = (gaps >> np.uint64(bits)).astype(np.int64)
    unary = np.zeros(int(quotients.sum()) + len(values), dtype=np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 1
    return bytes([bits]) + np.packbits(unary).tobytes() + packed(gaps, bits)


def golomb_decoded(data: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers that ``golomb`` coded."""
    raw, bits = np.frombuffer(data, dtype=np.uint8), data[0]
    tail = -(-n * bits // 8)
    ones = np.flatnonzero(np.unpackbits(raw[1 : len(raw) - tail]))[:n]
    gaps = (np.diff(ones, prepend=-1) - 1).astype(np.uint64) << np.uint64(bits)
    return np.cumsum(gaps | unpacked(raw[len(raw) - tail :], n, bits), dtype=np.uint64)


def sent(prints: np.ndarray, owner_bits: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The different leading ``bits`` bits of ``prints`` in order, and the owner of each."""
    leading = np.unique(prints.view(np.uint64) >> np.uint64(64 - bits))
    return leading, (leading >> np.uint64(bits - owner_bits)).astype(np.int64)


def messages(owner_bits: int, bits: int):
    def of_chunk(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """(owner, chunk, n, coded): what a chunk sends to each owner."""
        leading, owners = sent(rows["print"].to_numpy(), owner_bits, bits)
        width = bits - owner_bits
        inside = leading & np.uint64((1 << width) - 1)
        made = []
        for owner in np.unique(owners):
            lo, hi = np.searchsorted(owners, [owner, owner + 1])
            made.append((owner, key[0], hi - lo, golomb(inside[lo:hi], width)))
        return pd.DataFrame(made, columns=["owner", "chunk", "n", "coded"])

    return of_chunk


def answers(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """(chunk, owner, found): for each message, in its order, which fingerprints another message has too."""
    each = [golomb_decoded(c, n) for c, n in zip(rows["coded"], rows["n"])]
    values, counts = np.unique(np.concatenate(each), return_counts=True)
    twice = values[counts > 1]
    found = [np.packbits(np.isin(x, twice, assume_unique=True)).tobytes() for x in each]
    return pd.DataFrame({"chunk": rows["chunk"], "owner": rows["owner"], "found": found})


def chunk_flags(owner_bits: int, bits: int):
    def of_chunk(rows: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        """(chunk, words): a bit per place in the chunk, set where the fingerprint stands in this chunk or another one again."""
        prints = rows["print"].to_numpy()
        leading, owners = sent(prints, owner_bits, bits)
        twice = np.zeros(len(leading), dtype=bool)
        for owner, found in zip(replies["owner"], replies["found"]):
            lo, hi = np.searchsorted(owners, [owner, owner + 1])
            twice[lo:hi] = np.unpackbits(np.frombuffer(found, dtype=np.uint8), count=hi - lo)
        mine = np.searchsorted(leading, prints.view(np.uint64) >> np.uint64(64 - bits))
        twice |= np.bincount(mine, minlength=len(leading)) > 1
        at = rows["place"].to_numpy()[twice[mine]]
        if not len(at):
            return pd.DataFrame({"chunk": rows["chunk"].iloc[:0], "words": pd.Series([], dtype=object)})
        flags = np.zeros(1 << CHUNK_BITS, dtype=np.uint8)
        flags[at] = 1
        return pd.DataFrame({"chunk": rows["chunk"].iloc[:1], "words": [np.packbits(flags, bitorder="little").view("<i8")]})

    return of_chunk


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """``df`` written to the shared checkpoint folder in buckets of ``key``, and read back; later joins on it leave the rows where they are."""
    spark = df.sparkSession
    name = f"tidemark_{uuid.uuid4().hex}"
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", path).format("parquet").saveAsTable(name)
    STORED.append(path)
    return spark.table(name)


def suspects(rows: DataFrame) -> DataFrame:
    """(chunk, words) of ``rows`` (chunk, place, print): a bit for each row whose fingerprint occurs again; chunks without any have no row."""
    n = rows.count()
    owner_bits = max(0, n // OWNER_PRINTS).bit_length()
    bits = min(64, max(1, n).bit_length() + SPARE_BITS)
    narrow = rows.select("chunk", "place", "print")
    sends = narrow.groupBy("chunk").applyInPandas(messages(owner_bits, bits), "owner long, chunk long, n int, coded binary")
    replies = sends.groupBy("owner").applyInPandas(answers, "chunk long, owner long, found binary")
    return narrow.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInPandas(chunk_flags(owner_bits, bits), "chunk long, words array<long>")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, str]:
    """Every row of ``docs`` and a new column, a struct: keep_id, group_size, kept.

    Texts are equal if they are identical without ASCII white space. Of equal texts the
    row with the most code points stays, then that with the smallest id (null last); of
    rows that repeat id and text one stays, and no more is said than which id. Null
    texts count as empty and equal all texts without anything but white space. An empty
    table stays empty; other columns stay as they are, whatever they are called.
    """
    row, chunk, place, print_, points, made = fresh(docs, "row", "chunk", "place", "print", "points", "dedup")
    numbered = docs.withColumns({row: F.monotonically_increasing_id(), print_: F.xxhash64(normalised(F.col(text))), points: F.coalesce(F.length(text), F.lit(0))})
    rows = bucketed(numbered.withColumns({chunk: F.shiftright(row, CHUNK_BITS), place: F.col(row).bitwiseAND((1 << CHUNK_BITS) - 1).cast("int")}), chunk)
    flags = stored(suspects(rows.select(F.col(chunk).alias("chunk"), F.col(place).alias("place"), F.col(print_).alias("print"))))
    words, = fresh(rows, "words")
    marked = rows.join(flags.select(F.col("chunk").alias(chunk), F.col("words").alias(words)).hint("shuffle_hash"), chunk, "left")
    hit = F.coalesce(F.bit_get(F.get(words, F.shiftright(place, 6)), F.col(place).bitwiseAND(63)) == 1, F.lit(False))
    alone = F.struct(F.col(doc_id).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    plain = marked.where(~hit).select(*docs.columns, alone.alias(made))

    # bytes are compared here: different texts with one fingerprint are kept apart by the text itself
    found = marked.where(hit).drop(words)
    text_of = fresh(found, "normal")[0]
    texts = found.select(print_, normalised(F.col(text)).alias(text_of)).distinct()
    collided = stored(texts.groupBy(print_).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(print_))
    klass, = fresh(found, "klass")
    found = with_class(found, collided, print_, klass, normalised(F.col(text)))
    best = F.min(F.struct((-F.col(points)).alias("points"), F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.col(row).alias("row")))
    size, first = fresh(found, "size", "first")
    groups = stored(found.groupBy(print_, klass).agg(F.count(F.lit(1)).alias(size), best.alias(first)))
    decided = F.struct(F.col(f"{first}.id").alias("keep_id"), F.col(size).alias("group_size"), (F.col(row) == F.col(f"{first}.row")).alias("kept"))
    return plain.unionByName(found.join(small(groups), [print_, klass]).select(*docs.columns, decided.alias(made))), made


def with_class(found: DataFrame, collided: DataFrame, print_: str, klass: str, normal: Column) -> DataFrame:
    """``found`` with what tells its texts apart within a fingerprint: the text where several have it, else nothing."""
    if collided.isEmpty():
        return found.withColumn(klass, F.lit(""))
    mark, = fresh(found, "several")
    return found.join(small(collided.withColumn(mark, F.lit(True))), print_, "left").withColumn(klass, F.when(F.col(mark), normal).otherwise("")).drop(mark)


def dedup_table(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of the normalised text."""
    made, x = dedup(docs.select("doc_id", "text", F.sha2(normalised(F.col("text")).cast("binary"), 256).alias("text_sha256")))
    return made.select("doc_id", f"{x}.keep_id", f"{x}.group_size", f"{x}.kept", "text_sha256")
