"""Backtests that go on: predictions arrive in batches, and only the state of each key is read again."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.backtest import advance
from tidemark.sources.files import NOTHING_THERE, replace_partitions, write_table


def _slot(path: str, batch_id: int) -> str:
    return f"{path}/state/slot_{batch_id % 2}"


def read_state(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """The state after a batch; None where no batch up to it had rows.

    The last two states are kept, so the newest batch can be repeated; an older one is refused.
    """
    if batch_id < 0:
        return None
    try:
        kept = spark.read.parquet(_slot(path, batch_id))
    except AnalysisException as error:
        if error.getCondition() not in NOTHING_THERE:
            raise
        raise ValueError(f"no state of batch {batch_id} below {path}") from error
    first = kept.select("batch_id").first()
    if first is None:
        return None
    if first["batch_id"] != batch_id:
        raise ValueError(f"state of batch {batch_id} is gone, batch {first['batch_id']} has taken its place")
    return kept.drop("batch_id")


def keep_books(path: str, keys: Sequence[str], **costs) -> Callable[[DataFrame, int], None]:
    """What ``foreachBatch`` calls: writes ``series`` and ``late`` of the batch, then the state.

    Batches are numbered from 0 without gaps, as Structured Streaming does. A batch that
    failed is run again from the state before it and replaces what it left behind.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        before = read_state(batch.sparkSession, path, batch_id - 1)
        series, after, late = advance(before, batch, keys, **costs)
        number = F.lit(batch_id).cast("long").alias("batch_id")
        replace_partitions(series.select("*", number), f"{path}/series", ["batch_id"])
        replace_partitions(late.select("*", number), f"{path}/late", ["batch_id"])
        write_table(after.select("*", number), _slot(path, batch_id))

    return step
