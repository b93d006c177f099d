"""Features of every walk-forward block from one pass, however many blocks there are.

The cuts between training windows divide the calendar into stretches. Rows are folded once
to moments per feature and stretch, map-side; a block's moments are the sum of those of its
stretches, so its correlations cost no further look at the rows. Medians come from
values folded per feature and stretch and sorted once, with a running count for each block.
Both read the rows once for all blocks; what is left after that has one row per feature
and block.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import sanitize
from tidemark.operators.ordered import ROWS_PER_SLICE, Running, running
from tidemark.session import materialize

#: Rows a correlation takes at least.
LEAST_ROWS = 20
#: Digits in which scores are compared: sums of doubles depend on the order of rows, equal features must not.
SCORE_DIGITS = 10


@dataclass(frozen=True)
class Span:
    """Training days of a block, as days since 1970: from ``begin`` (None: the first) to before ``end``."""

    block_id: int
    begin: float | None
    end: float


@dataclass(frozen=True)
class Stretches:
    """The calendar between all begins and ends of some spans."""

    spans: Sequence[Span]

    @property
    def cuts(self) -> list[float]:
        return sorted({float(d) for s in self.spans for d in (s.begin, s.end) if d is not None})

    def number(self, day: Column) -> Column:
        """How many cuts lie at or before the day."""
        return F.size(F.filter(F.array(*[F.lit(c) for c in self.cuts]), lambda c: c <= day))

    def bounds(self, span: Span) -> tuple[int, int]:
        """First and last stretch of a span."""
        return (0 if span.begin is None else self.cuts.index(float(span.begin)) + 1), self.cuts.index(float(span.end))

    def within(self, span: Span, stretch: Column) -> Column:
        return stretch.between(*self.bounds(span))

    def blocks(self, stretch: Column) -> Column:
        """Ids of the blocks that train on a stretch."""
        return F.array_compact(F.array(*[F.when(self.within(s, stretch), F.lit(s.block_id)) for s in self.spans]))


def values_by_stretch(rows: DataFrame, day: Column, label: str, stretches: Stretches) -> DataFrame:
    """(stretch, y, pos, value) of all rows that some block trains on and whose label is known."""
    used = rows.where(F.col(label).isNotNull() & (day < stretches.cuts[-1]))
    tall = used.select(stretches.number(day).alias("stretch"), F.col(label).cast("double").alias("y"), F.posexplode("x").alias("pos", "value"))
    return tall.withColumn("value", sanitize(F.col("value")))


def stretch_moments(tall: DataFrame) -> DataFrame:
    """Count, means, variances and covariance of value and label per feature and stretch, known and NULL values apart."""
    x, y = F.col("value"), F.col("y")
    return tall.groupBy("pos", "stretch", x.isNull().alias("gap")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mx"), F.coalesce(F.var_pop(x), F.lit(0.0)).alias("vx"), F.avg(y).alias("my"), F.var_pop(y).alias("vy"),
        F.coalesce(F.covar_pop(x, y), F.lit(0.0)).alias("cxy"), F.min(x).alias("lo"), F.max(x).alias("hi"),
    )


def block_medians(tall: DataFrame, known: DataFrame, stretches: Stretches, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """(block_id, pos, median), exact; ``known`` has block_id, pos and the count ``k`` of known values.

    One sort per feature serves all blocks: a value holds the ranks between a block's
    running count before and after it.
    """
    folded = tall.where(F.col("value").isNotNull()).groupBy("pos", "value", "stretch").agg(F.count(F.lit(1)).alias("n"))
    own = {s.block_id: F.when(stretches.within(s, F.col("stretch")), F.col("n")).otherwise(0) for s in stretches.spans}
    counted = running(materialize(folded), ["pos"], "value", {f"__r{b}": Running("total", n) for b, n in own.items()}, rows_per_slice, ties=["stretch"])
    sizes = known.groupBy("pos").agg(*[F.max(F.when(F.col("block_id") == b, F.col("k"))).alias(f"__k{b}") for b in own])

    def at(b: int, rank: Column) -> Column:
        upto = F.col(f"__r{b}")
        return F.max(F.when((rank >= upto - own[b]) & (rank < upto), F.col("value")))

    middle = lambda b: (F.col(f"__k{b}") - 1) / 2
    ends = [c for b in own for c in (at(b, F.floor(middle(b))).alias(f"__a{b}"), at(b, F.ceil(middle(b))).alias(f"__b{b}"))]
    found = counted.join(sizes, "pos").groupBy("pos").agg(*ends)
    each = F.explode(F.array(*[F.struct(F.lit(b).alias("block_id"), (F.col(f"__a{b}") + (F.col(f"__b{b}") - F.col(f"__a{b}")) * 0.5).alias("median")) for b in own]))
    return found.select("pos", each.alias("m")).select("m.block_id", "pos", "m.median").where(F.col("median").isNotNull())


def block_scores(rows: DataFrame, day: Column, label: str, spans: Sequence[Span], rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """(block_id, pos, n, lo, median, hi, score) for every feature and block.

    ``rows`` has the label and ``x``, the features as an array of one length. The score is
    the absolute correlation with the label over the block's training rows, NULL values
    standing for the block's median; it is 0 with fewer than twenty rows or where
    one side does not vary. Rows without a label are left out, and so are features
    that a block knows no value of. No rows and no spans give no scores.
    """
    if not spans:
        return rows.sparkSession.createDataFrame([], "block_id int, pos int, n long, lo double, median double, hi double, score double")
    stretches = Stretches(spans)
    tall = values_by_stretch(rows, day, label, stretches)
    stats = materialize(stretch_moments(tall))
    each = stats.withColumn("block_id", F.explode(stretches.blocks(F.col("stretch"))))
    known = each.where(~F.col("gap")).groupBy("block_id", "pos").agg(F.sum("n").alias("k"))
    filled = each.join(block_medians(tall, known, stretches, rows_per_slice), ["block_id", "pos"]).withColumn("mx", F.coalesce("mx", "median"))
    group = Window.partitionBy("block_id", "pos")
    mean = lambda c: F.sum(F.col("n") * F.col(c)).over(group) / F.sum("n").over(group)
    apart = filled.withColumns({"dx": F.col("mx") - mean("mx"), "dy": F.col("my") - mean("my")})
    n = F.col("n")
    summed = apart.groupBy("block_id", "pos").agg(
        F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("median").alias("median"), F.max("hi").alias("hi"), F.sum(n * (F.col("vx") + F.col("dx") ** 2)).alias("sxx"),
        F.sum(n * (F.col("vy") + F.col("dy") ** 2)).alias("syy"), F.sum(n * (F.col("cxy") + F.col("dx") * F.col("dy"))).alias("sxy"),
    )
    moves = (F.col("n") >= LEAST_ROWS) & (F.col("sxx") > 0) & (F.col("syy") > 0)
    score = F.when(moves, F.abs(F.col("sxy")) / (F.sqrt("sxx") * F.sqrt("syy"))).otherwise(0.0)
    return summed.select("block_id", "pos", "n", "lo", "median", "hi", score.alias("score"))


def block_inputs(rows: DataFrame, day: Column, label: str, spans: Sequence[Span], top: int, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """(block_id, rank, pos, score, median): the inputs of every block.

    Features that do not vary are left out. Where more than ``top`` are left, those with
    the largest scores are taken, ties (in ten digits) by position; else all in their order.
    """
    moving = block_scores(rows, day, label, spans, rows_per_slice).where(F.col("lo") < F.col("hi"))
    block = Window.partitionBy("block_id")
    order = F.when(F.count(F.lit(1)).over(block) > top, -F.round("score", SCORE_DIGITS)).otherwise(0.0)
    ranked = moving.withColumn("__order", order).withColumn("rank", F.row_number().over(block.orderBy("__order", "pos")))
    return ranked.where(F.col("rank") <= top).select("block_id", "rank", "pos", "score", "median")
