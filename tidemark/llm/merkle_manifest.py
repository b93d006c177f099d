"""Merkle manifest of documents: leaf coordinates from ranks in bitmaps, levels reduced as arrays of sixteen slots.

The ids of each source are folded into a bitmap, kept as its non-zero 64-bit words, each
with the number of rows it stands for. Running counts over words, and over three more
levels of 2^15 children each, are the popcount directory: a document's place among its
source's documents is the directory's count before its word and a popcount within the
word. No list of ids is sorted, and no window is wider than a directory node.

A node's parent and slot follow from its place, so a level is one aggregate into arrays of
at most sixteen slots, a sixteenth as large as the one below. Paths are then handed down
from the root; a run of leaves takes its path once and unfolds it last, so paths of
single documents are never shuffled. All levels are stored, so a lost executor repeats
one level at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored
from tidemark.llm.places import with_places

#: Children of a node.
FANOUT = 16

LEAF_COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def field(column: str | Column) -> Column:
    """``-`` for null, else byte count, colon and value."""
    value = (F.col(column) if isinstance(column, str) else column).cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_digest(**instead: Column) -> Column:
    """Digest of a document's columns; ``instead`` gives other values for some of them."""
    return digest(*[field(instead.get(c, c)) for c in LEAF_COLUMNS])


def levels(leaves: DataFrame, payload: list[str]) -> list[DataFrame]:
    """Runs of sixteen nodes, level by level: g, index, total (of nodes in the level below), items, digest of each run.

    ``leaves`` are (g, index, total, digest) and the payload, which the items of the first
    level carry. A single node of a group is handed up as it is.
    """
    made: list[DataFrame] = []
    nodes, extra = leaves, payload
    while True:
        item = F.struct((F.col("index") % FANOUT).cast("int").alias("slot"), "digest", *extra)
        runs = nodes.groupBy("g", F.expr(f"index div {FANOUT}").alias("index")).agg(F.first("total").alias("total"), F.array_sort(F.collect_list(item), by_slot).alias("items"))
        joined = F.sha2(F.array_join(F.transform("items", lambda x: x["digest"]), "").cast("binary"), 256)
        runs = stored(runs.withColumn("digest", F.when(F.col("total") > 1, joined).otherwise(F.col("items")[0]["digest"])))
        made.append(runs)
        if (runs.agg(F.max("total")).first()[0] or 0) <= FANOUT:
            return made
        nodes, extra = runs.withColumn("total", F.expr(f"(total + {FANOUT - 1}) div {FANOUT}")), []


def by_slot(a: Column, b: Column) -> Column:
    return a["slot"] - b["slot"]


def paths(tree: list[DataFrame], above: DataFrame) -> DataFrame:
    """(g, index, item, path) of every leaf of a tree: on each level up to the root, the slot and the digests of the run's other nodes.

    ``above`` has (g, path) from each group's root on.
    """
    now = above.withColumn("index", F.lit(0).cast("long"))
    for runs in reversed(tree):
        each = runs.join(now, ["g", "index"]).select("g", "index", "total", "items", "path", F.explode("items").alias("item"))
        others = F.transform(F.filter("items", lambda x: x["slot"] != F.col("item.slot")), lambda x: x["digest"])
        step = F.array(F.struct(F.col("item.slot").alias("slot"), others.alias("others")))
        path = F.when(F.col("total") > 1, F.concat(step, F.col("path"))).otherwise(F.col("path"))
        now = each.select("g", (F.col("index") * FANOUT + F.col("item.slot")).alias("index"), "item", path.alias("path"))
        if runs is not tree[0]:
            now = now.drop("item")
    return now


PATH = "array<struct<slot:int,others:array<string>>>"


def ordered_groups(roots: DataFrame) -> DataFrame:
    """``roots`` (g, digest) as leaves of one tree, in the order of ``g``: ranges of groups are numbered side by side."""
    spark = roots.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(roots.repartitionByRange(ranges, "g").withColumn("part", F.spark_partition_id()))
    # one row a range
    counts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    first = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"), F.sum("n").over(Window.partitionBy()).alias("total"))
    number = F.row_number().over(Window.partitionBy("part").orderBy("g")) - 1
    return placed.withColumn("i", number).join(first, "part").select(F.lit("").alias("g"), (F.col("first") + F.col("i")).alias("index"), "total", "digest", F.col("g").alias("name"))


def manifest(leaves: DataFrame, group: str = "source", id_: str = "doc_id", leaf: str = "leaf") -> DataFrame:
    """Columns of ``leaves`` and: place, subroot, root, path.

    ``leaves`` are rows with a group, a 64-bit integer id and a digest, and may have other columns,
    which stay as they are; a column that has the name of a new one is replaced. Within
    a group leaves ascend by id (null first), rows of one id by digest; rows equal in all
    three take the places of their like in any order. Groups ascend bytewise, null first.
    ``path`` is the proof: on each level the slot of the node and the digests of the
    others of its run. An empty table gives an empty manifest.
    """
    columns = [c for c in leaves.columns if c.lower() not in ("place", "subroot", "root", "path")]
    g = F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit(""))
    rows = leaves.select(g.alias("g"), F.col(id_).cast("long").alias("id"), F.col(leaf).alias("digest"), F.struct(*columns).alias("payload"))
    # numbered once and stored, so that numbers stay
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()))
    tree = levels(with_places(rows), ["payload"])
    roots = tree[-1].select("g", "digest")
    top = levels(ordered_groups(roots), ["name"])
    root = top[-1].select("g", F.lit(None).cast(PATH).alias("path"), F.col("digest").alias("root"))
    above = paths(top, root.select("g", F.array().cast(PATH).alias("path")))
    above = stored(above.join(root.select("g", "root"), "g").select(F.col("item.name").alias("g"), F.col("item.digest").alias("subroot"), "root", "path"))
    made = paths(tree, above.select("g", "path")).join(above.select("g", "subroot", "root"), "g")
    return made.select("item.payload.*", F.col("index").alias("place"), "subroot", "root", "path")


def proof_digest(path: str = "path") -> Column:
    """Digest of a proof: the other nodes of the runs, from the leaf's up to the root's."""
    return F.sha2(F.array_join(F.flatten(F.transform(path, lambda e: e["others"])), "").cast("binary"), 256)


def folded(leaf: Column, path: str = "path") -> Column:
    """The root that a leaf and a proof give."""

    def up(node: Column, e: Column) -> Column:
        left = F.array_join(F.slice(e["others"], F.lit(1), e["slot"]), "")
        right = F.array_join(F.slice(e["others"], e["slot"] + 1, F.lit(FANOUT)), "")
        return F.sha2(F.concat(left, node, right).cast("binary"), 256)

    return F.aggregate(path, leaf, up)


def tampered(text: str = "text") -> Column:
    """``text`` with A-Z in lower case."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.col(text), upper, upper.lower())


def manifest_table(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each row; where 5 divides the id's crc32 the text is tampered with. Rows without an id are not."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    leaves = docs.select("doc_id", "source", leaf_digest().alias("leaf"), F.when(hit, leaf_digest(text=tampered())).alias("other"))
    made = manifest(leaves).withColumn("folded_root", folded(F.coalesce("other", "leaf")))
    return made.select("doc_id", "leaf", "subroot", "root", proof_digest().alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
