"""SimHash near-duplicates by covering locality-sensitive hashing.

A text's fingerprint has 64 bits, each the majority of that bit over the hashes of its
four-word shingles. For radius r every bit position gets a vector of r + 1 bits that is not
zero; table v (any non-zero vector of r + 1 bits) keeps the bits whose vector has an odd
product with v. Two fingerprints that differ in at most r bits differ in at most r
vectors, some v is orthogonal to all of them, and in that table they collide: no pair
within the radius is missed.

Documents fold to different fingerprints first, so copies meet nowhere. A bucket of a
table is searched in one task while it is small; a larger one is dealt out again by a
second family of masks, and by a third, after which a bucket has at most a few hundred
different fingerprints. A bucket yields a spanning forest of its links, not its pairs.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, row_key, small, stored, text_batches
from tidemark.llm.components import components

BITS = 64
#: Fingerprints link at so many differing bits or fewer.
RADIUS = 4
#: Words of a shingle.
SHINGLE = 4
#: Seed of the shingle hashes.
SEED = 42
#: A bucket with more different fingerprints is dealt out again by another family of masks.
BUCKET = 2_000
#: Families of masks; the product of three leaves about eight bits open.
LEVELS = 3
#: Words that are handled at once.
PART_WORDS = 200_000

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def masks(radius: int = RADIUS, family: int = 0) -> list[int]:
    """The masks of a covering family, as signed 64-bit numbers.

    Bit positions get the vectors 1 .. 2^(radius+1) - 1 in turn, in an order of positions
    that the family draws, so that each mask keeps about half of the bits.
    """
    vectors = 2 ** (radius + 1) - 1
    order = np.random.RandomState(family).permutation(BITS) if family else np.arange(BITS)
    made = []
    for v in range(1, vectors + 1):
        mask = sum(1 << int(bit) for i, bit in enumerate(order) if bin((i % vectors + 1) & v).count("1") % 2)
        made.append(mask - (1 << 64) if mask >> 63 else mask)
    return made


def fingerprints_of(texts: list[str | None]) -> np.ndarray:
    """One unsigned 64-bit fingerprint per text; zero without words."""
    hashes: list[int] = []
    sizes = np.zeros(len(texts), dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        words = WORDS.findall((text or "").encode("utf-8", "surrogatepass").translate(LOWER))
        if not words:
            continue
        joined = b" ".join(words)
        if len(words) <= SHINGLE:
            hashes.append(digest(joined, SEED))
            sizes[i] = 1
            continue
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
        starts = [0, *ends[: -SHINGLE].tolist()]
        hashes += [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist())]
        sizes[i] = len(starts)
    made = np.zeros(len(texts), dtype=np.uint64)
    if hashes:
        bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
        some = np.flatnonzero(sizes)
        set_ = np.add.reduceat(bits, np.concatenate(([0], np.cumsum(sizes[some])[:-1])), axis=0, dtype=np.int64)
        made[some] = np.packbits(set_ * 2 > sizes[some][:, None], axis=1).view(">u8").ravel()
    return made


def fingerprint_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rest, begin, held = batch.columns.drop("text"), 0, 0
        for i, text in enumerate(batch["text"]):
            held += len(text or "") // 6
            if held >= PART_WORDS or i == len(batch) - 1:
                part = batch.iloc[begin : i + 1]
                yield part[rest].assign(fp=fingerprints_of(part["text"].tolist()).view(np.int64))
                begin, held = i + 1, 0


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, doc_key and the fingerprint (as a signed long) of every row of ``docs``."""
    text_batches(docs.sparkSession)
    own = docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("doc_key"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return own.mapInPandas(fingerprint_batches, f"doc_id {kind}, doc_key binary, fp long")


def forest(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that join all different ``values`` within ``radius`` bits of each other, one fewer than each group has."""
    root, links = np.arange(len(values)), []
    words = np.array(values, dtype=np.int64).view(np.uint64)
    for i in range(1, len(values)):
        near = np.flatnonzero(np.bitwise_count(words[:i] ^ words[i]) <= radius)
        for k in np.unique(root[near]):
            links.append((values[near[root[near] == k][0]], values[i]))
            root[root == k] = i
    return links


def bucket_links(radius: int) -> Callable:
    """A function for mapInPandas over rows in order of (path, bits): links of the fingerprints of each bucket.

    A bucket may go on in the next batch; what is held back is never more than one bucket.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame({"path": [], "bits": [], "fp": []}, dtype=np.int64)
        for batch in chain(batches, [None]):
            rows = held if batch is None else pd.concat([held, batch])
            path, bits, fp = (rows[c].to_numpy() for c in ("path", "bits", "fp"))
            cuts = np.flatnonzero((path[1:] != path[:-1]) | (bits[1:] != bits[:-1])) + 1
            whole = len(rows) if batch is None else int(cuts[-1]) if len(cuts) else 0
            held, links = rows.iloc[whole:], []
            for lo, hi in zip([0, *cuts], [*cuts, len(rows)]):
                if hi <= whole:
                    links += forest(fp[lo:hi].tolist(), radius)
            yield pd.DataFrame(links, columns=["a", "b"], dtype=np.int64)

    return run


def dealt(values: DataFrame, radius: int, level: int) -> DataFrame:
    """Each fingerprint once per mask of the family: (path, bits, fp); path names the tables so far, bits what they keep."""
    deal = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m).alias("mask")) for i, m in enumerate(masks(radius, level))])
    kept = F.col("mask").bitwiseOR(F.col("x.mask"))
    return values.withColumn("x", F.explode(deal)).select((F.col("path") * 64 + F.col("x.i") + 1).alias("path"), kept.alias("mask"), F.col("fp").bitwiseAND(kept).alias("bits"), "fp")


def near_links(values: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that connect all of the different ``fp`` within ``radius`` bits of each other."""
    found = None
    now = values.select(F.lit(0).cast("long").alias("path"), F.lit(0).cast("long").alias("mask"), "fp")
    for level in range(LEVELS):
        rows = dealt(now, radius, level)
        last = level == LEVELS - 1
        sizes = rows.groupBy("path", "bits").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
        sizes = stored(sizes)
        links = sizes.where("n = 2").select("a", "b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
        several = rows.join(sizes.where("n > 2").select("path", "bits", "n"), ["path", "bits"])
        inside = several if last else several.where(F.col("n") <= bucket)
        in_order = inside.select("path", "bits", "fp").repartition("path", "bits").sortWithinPartitions("path", "bits")
        links = links.unionByName(in_order.mapInPandas(bucket_links(radius), "a long, b long"))
        found = links if found is None else found.unionByName(links)
        if last or sizes.where(F.col("n") > bucket).isEmpty():
            break
        now = stored(several.where(F.col("n") > bucket).select("path", "mask", "fp"))
    return found.distinct()


def grouped(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, doc_key, fp, component_id for every row of ``docs``.

    ``component_id`` is the smallest doc_id that links reach, the row's own included.
    Rows without words have fingerprint 0, linked like any other. Null ids are left out
    of the minimum (a group of null ids only has a null component). Repeated rows share
    everything. An empty table gives an empty result; other columns play no part.
    """
    rows = stored(fingerprints(docs))
    each = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    joined = components(near_links(each.select("fp"), radius))
    known = joined.join(each, joined["node"] == each["fp"])
    roots = known.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = known.select("fp", "root").join(roots, "root").select("fp", "component_id")
    of_fp = each.join(placed, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return rows.join(of_fp, "fp").select("doc_id", "doc_key", "fp", "component_id")


def group_table(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    return grouped(docs, radius).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each group: that with the smallest doc_id, then the smallest key.

    Rows without any word are no near-duplicates of each other for this purpose, but
    they share fingerprint 0, so one of them stays. Columns are as they were.
    """
    key = fresh(docs, "doc_key")[0]
    rows = stored(grouped(docs, radius))
    # a group of null ids only is named by its fingerprint
    group = F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("fp"), F.col("fp").cast("string")))
    first = rows.groupBy(group.alias("g")).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "doc_key"))["doc_key"].alias("doc_key"))
    gone = small(stored(rows.select(F.col("doc_key").alias(key)).distinct().join(first.select(F.col("doc_key").alias(key)), key, "left_anti")))
    twice = small(stored(rows.groupBy(F.col("doc_key").alias(key)).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key)))
    kept = docs.withColumn(key, row_key(F.col("doc_id"), F.col("text"))).join(gone, key, "left_anti")
    if twice.isEmpty():
        return kept.select(*docs.columns)
    once = kept.join(twice, key, "left_semi").dropDuplicates([key])
    return kept.join(twice, key, "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))
