"""Places of rows within their group by a 64-bit id, from ranks in bitmaps: nothing is sorted, and no task gets a whole group.

The ids of a group are folded into a bitmap, kept as its non-zero 64-bit words, each with
the number of rows it stands for. Running counts over words, and over three more levels,
are the popcount directory: a row's place is the directory's count before its word and a
popcount within the word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored

#: Bits of an id within a word, of a word within a block, and of a block within each node of the directory above.
LOW, WORDS, NODE = 6, 9, 15


def before(part: list[str], order: str | list[str]) -> Column:
    """Sum of ``n`` over the earlier rows."""
    return F.coalesce(F.sum("n").over(Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def directory(words: DataFrame) -> DataFrame:
    """``words`` (g, high, word, bits, n) with ``base``: rows of the source before the word."""
    blocks = words.groupBy("g", "high").agg(F.sum("n").alias("n")).withColumn("h1", F.shiftright("high", NODE))
    nodes = blocks.groupBy("g", "h1").agg(F.sum("n").alias("n")).withColumn("h2", F.shiftright("h1", NODE))
    tops = nodes.groupBy("g", "h2").agg(F.sum("n").alias("n"))
    # at most 2^19 nodes below a source, and 2^15 below any other
    tops = tops.select("g", "h2", before(["g"], "h2").alias("b2"))
    nodes = nodes.withColumn("b1", before(["g", "h2"], "h1")).join(tops, ["g", "h2"]).select("g", "h1", (F.col("b1") + F.col("b2")).alias("b1"))
    blocks = blocks.withColumn("b0", before(["g", "h1"], "high")).join(nodes, ["g", "h1"]).select("g", "high", (F.col("b0") + F.col("b1")).alias("b0"))
    return words.withColumn("b", before(["g", "high"], "word")).join(blocks, ["g", "high"]).select("g", "high", "word", "bits", "n", (F.col("b") + F.col("b0")).alias("base"))


def tied_places(rows: DataFrame) -> DataFrame:
    """(row, within) of rows whose word has several rows of one id: their place in the word, by id, digest and row.

    Equal rows are counted per digest and per partition before they are numbered, so no window has all rows of an id.
    """
    key = ["g", "high", "word", "low", "digest"]
    rows = rows.withColumn("part", F.shiftright("row", 33))
    parts = rows.groupBy(*key, "part").agg(F.count(F.lit(1)).alias("n"))
    classes = parts.groupBy(*key).agg(F.sum("n").alias("n")).withColumn("c", before(["g", "high", "word"], ["low", "digest"])).drop("n")
    parts = parts.withColumn("p", before(key, "part")).join(classes, key).select(*key, "part", (F.col("c") + F.col("p")).alias("first"))
    number = F.row_number().over(Window.partitionBy(*key, "part").orderBy("row")) - 1
    return rows.withColumn("i", number).join(parts, [*key, "part"]).select("row", (F.col("first") + F.col("i")).alias("within"))


def with_places(rows: DataFrame) -> DataFrame:
    """``rows`` (g, id, digest, row, ...), which are stored, with ``index`` among the rows of ``g`` by id (null first), and their number ``total``."""
    id_ = F.col("id")
    rows = rows.withColumns({
        # null comes before the least id
        "high": F.coalesce(F.shiftright(id_, LOW + WORDS), F.lit(-(1 << 49))),
        "word": F.coalesce(F.shiftright(id_, LOW).bitwiseAND((1 << WORDS) - 1).cast("int"), F.lit(0)),
        "low": F.coalesce(id_.bitwiseAND((1 << LOW) - 1).cast("int"), F.lit(0)),
    })
    bit = F.expr("shiftleft(1L, low)")
    words = stored(rows.groupBy("g", "high", "word").agg(F.bit_or(bit).alias("bits"), F.count(F.lit(1)).alias("n")))
    ranks = directory(words)
    totals = words.groupBy("g").agg(F.sum("n").alias("total"))
    key = ["g", "high", "word"]
    found = rows.join(ranks, key)
    within = F.bit_count(F.col("bits").bitwiseAND(F.expr("~shiftleft(-1L, low)"))).cast("long")
    several = F.col("n") > F.bit_count("bits")
    if not words.where(several).isEmpty():
        ties = tied_places(rows.join(words.where(several).select(*key), key))
        found = found.join(ties, "row", "left")
        within = F.coalesce("within", within)
    return found.withColumn("index", F.col("base") + within).join(totals, "g")
