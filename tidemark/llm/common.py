"""Names, keys and size checks that several text operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import checkpoint_dir

#: Rows of a few fixed-width columns that may be broadcast (tens of MB), once they are counted.
BROADCAST_ROWS = 500_000

#: Rows and list items that may be broadcast, once they are counted; an item has 16 bytes at most.
BROADCAST_ITEMS = 1_500_000

#: Bytes of the Arrow batches in which texts travel to Python.
BATCH_BYTES = 8 << 20

#: Folders that this process has stored tables in.
STORED: list[str] = []

#: Words of the contracts: anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have yet, in any case."""
    taken = {c.lower() for c in df.columns}
    made = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        made.append(name)
    return made


def row_key(doc_id: Column, text: Column) -> Column:
    """16 bytes that stand for a document: its id and its text. Rows that repeat both are one document.

    The id goes with its length, and null with a mark of its own, so no other id and text give the same string.
    """
    id_ = doc_id.cast("string")
    marked = F.concat(F.coalesce(F.concat(F.lit("+"), F.length(id_).cast("string"), F.lit(":"), id_), F.lit("-")), F.coalesce(F.concat(F.lit("+"), text), F.lit("-")))
    return F.unhex(F.md5(marked))


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def text_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Have texts travel to Python in Arrow batches of ``most`` bytes at most, as rows may be long; a smaller setting, given in bytes, stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).removesuffix("b")
    if not (now.isdigit() and 0 < int(now) <= most):
        spark.conf.set(name, f"{most}b")


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and read it back.

    Lineage ends here and a lost executor costs nothing. Unlike ``checkpoint()`` the
    columns are encoded and compressed, and Spark knows the size of what it reads. The
    files stay until ``forget`` is called, as results that are read later need them.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tidemark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    STORED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> int:
    """Delete what ``stored`` wrote in this process, and say how many tables. Results that need it must be written before."""
    paths = [spark._jvm.org.apache.hadoop.fs.Path(p) for p in STORED]
    gone = [p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True) for p in paths]
    STORED.clear()
    return sum(gone)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` narrow rows, else as it is.

    ``df`` should be stored or checkpointed, as it is counted.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def small_lists(df: DataFrame, column: str, items: int = BROADCAST_ITEMS) -> DataFrame:
    """Like ``small``, for rows with a list: rows and list items together are at most ``items``."""
    rows, held = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(column)), F.lit(0))).first()
    return F.broadcast(df) if rows + held <= items else df
