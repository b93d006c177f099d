"""Mixing sources to target weights by systematic sampling.

Every document of a source expects ``target / source size`` copies. The prefix sum of
that over the source's documents, in order of size, plus one random offset, crosses
integers; a document is emitted once per integer crossed at its turn. Order by size
makes the sample stratified, so the words taken stay within about one document of the
target.

The prefix sum is rank times rate, and ranks come from counts: per size within the
source, per hash bucket within the size, then by a window within one bucket. No task
gets a whole source, or a whole size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, fresh

#: Weights of the sources in order of code points, repeated.
WEIGHTS = (3, 1, 2)
#: All sources together get this multiple of all sizes.
SHARE = 1.5
#: No source gets more than this multiple of its own size.
MOST = 2


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Targets of a table (source, source_size) with one row per source.

    Returns source, source_size, target. Sources whose weighted part exceeds ``most``
    times their size stop there and the rest is dealt again by weight: in order of
    ``most * size / weight`` a source is capped while that ratio lies under the level
    (what is left per unit of weight) at its turn. The table has one row per source,
    so these windows over all of it stay small.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("turn", F.row_number().over(by_name)).withColumn(
        "weight", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("turn") - 1) % len(weights) + 1).cast("int"))
    )
    everything = Window.partitionBy()
    by_ratio = Window.orderBy("ratio", "turn")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    leveled = (
        ranked.withColumn("cap", F.col("source_size") * most)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("level", (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(rest))
    )
    capped = F.col("ratio") < F.col("level")
    return leveled.withColumn("final", F.max(F.when(~capped, F.col("level"))).over(everything)).select(
        "source", "source_size", F.when(capped, F.col("cap").cast("double")).otherwise(F.col("final") * F.col("weight")).alias("target")
    )


def offset(source: Column, seed: int) -> Column:
    """One number in [0, 1) per source, the same in every run."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 7) -> tuple[DataFrame, dict[str, str]]:
    """Every row of ``docs`` with size, source_size, target and copies.

    Needs doc_id, text and source; returns the frame and the names that the four new
    columns got (they differ where ``docs`` has such columns already). A null text has
    size 0; a null source is a source of its own, the last. Rows that repeat everything
    are dealt with one by one. A source without words has target 0 and no copies. An
    empty table gives an empty result.
    """
    names = dict(zip(("size", "source_size", "target", "copies"), fresh(docs, "size", "source_size", "target", "copies")))
    size = names["size"]
    key, digest, bucket, within, ahead, start = fresh(docs, "mix_key", "mix_digest", "mix_bucket", "mix_within", "mix_ahead", "mix_start")
    identity = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("text"), F.lit("")))
    keyed = (
        docs.withColumn(size, words(F.col("text")))
        .withColumn(key, F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
        .withColumn(digest, F.md5(identity))
        .withColumn(bucket, F.substring(F.col(digest), 1, 3))
    )
    cells = keyed.groupBy(F.col(key).alias("k"), F.col(size).alias("s"), F.col(bucket).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    by_size = cells.groupBy("k", "s").agg(F.sum("n").alias("n"))
    up_to = by_size.select("k", "s", (F.sum("n").over(Window.partitionBy("k").orderBy("s")) - F.col("n")).alias("smaller"))
    sources = by_size.groupBy("k").agg(F.sum(F.col("s") * F.col("n")).alias("source_size"))
    named = sources.select(F.when(F.col("k") != "", F.substring(F.col("k"), 2, 1 << 30)).alias("source"), "source_size")
    rates = source_targets(named, weights, share, most).select(
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("k"), "source_size", "target", offset(F.col("source"), seed).alias("u")
    )
    in_size = Window.partitionBy("k", "s").orderBy("b")
    ranks = (
        cells.withColumn("n", F.sum("n").over(in_size) - F.col("n"))
        .join(up_to, ["k", "s"])
        .join(rates, "k")
        .select(
            F.col("k").alias(key), F.col("s").alias(size), F.col("b").alias(bucket), (F.col("n") + F.col("smaller")).alias(ahead),
            F.col("source_size").alias(names["source_size"]), F.col("target").alias(names["target"]), F.col("u").alias(start),
        )
    )
    rank = F.col(ahead) + F.col(within)
    rate = F.when(F.col(names["source_size"]) > 0, F.col(names["target"]) / F.col(names["source_size"])).otherwise(F.lit(0.0))
    crossed = F.floor(rank * rate + F.col(start)) - F.floor((rank - 1) * rate + F.col(start))
    mixed = (
        keyed.withColumn(within, F.row_number().over(Window.partitionBy(key, size, bucket).orderBy(digest)))
        .join(ranks, [key, size, bucket])
        .withColumn(names["copies"], crossed.cast("long"))
        .select(*docs.columns, *names.values())
    )
    return mixed, names


def emit(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with its columns.

    Rows are told by place, not by id: repeated rows and those without id are dealt one by
    one. Null and empty texts have size 0 and come first in their source; they are taken
    like others, as the rate says. A null source is a source of its own, and equal sizes
    are ordered by the digest of id and text. Extra columns of any name are kept; an
    empty table gives an empty result.
    """
    mixed, names = mix(docs, **settings)
    turn = fresh(mixed, "mix_turn")[0]
    often = mixed.where(F.col(names["copies"]) > 0)
    return often.withColumn(turn, F.explode(F.sequence(F.lit(1).cast("long"), F.col(names["copies"])))).select(*docs.columns)


def mix_table(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken (size times copies)."""
    mixed, _ = mix(docs.select("doc_id", "text", "source"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS digest
  FROM documents
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, digest) AS rank FROM sized
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS turn FROM sized GROUP BY source
), weighted AS (
  SELECT *, [3, 1, 2][(turn - 1) % 3 + 1] AS weight, source_size * 2 AS cap FROM sources
), leveled AS (
  SELECT *, cap::DOUBLE / weight AS ratio,
         (sum(source_size) OVER ()::DOUBLE * 1.5
          - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
         / sum(weight) OVER (ORDER BY cap::DOUBLE / weight, turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level
  FROM weighted
), aimed AS (
  SELECT *, CASE WHEN ratio < level THEN cap::DOUBLE ELSE max(CASE WHEN ratio >= level THEN level END) OVER () * weight END AS target,
         ('0x' || substr(md5('7:' || coalesce(source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM leveled
), taken AS (
  SELECT r.doc_id, r.source, r.size, a.source_size, a.target,
         (floor(rank * CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END + u)
          - floor((rank - 1) * CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END + u))::BIGINT AS copies
  FROM ranked r JOIN aimed a ON r.source IS NOT DISTINCT FROM a.source
)
SELECT *, size * copies AS taken FROM taken
"""
