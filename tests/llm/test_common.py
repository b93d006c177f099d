"""Keys, names and stored tables."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark.llm import chunk_dedup, common, winnow_lines


def test_keys(spark):
    rows = [(1, "a"), (1, "a"), (11, ""), (1, "1"), (1, None), (None, None), (None, ""), (None, "a")]
    keys = [bytes(r[0]) for r in spark.createDataFrame(rows, "d long, t string").select(common.row_key(F.col("d"), F.col("t"))).collect()]
    assert keys[0] == keys[1] and len(set(keys)) == 7 and all(len(k) == 16 for k in keys)


def test_keys_of_string_ids(spark):
    """Ids with the marks of the key, and an id that reads ``null``."""
    rows = [("a", "x+T"), ("a+x", "T"), (None, "T"), ("null", "T"), ("-", "T"), ("", "T"), ("1:a", "T"), ("a", None), ("a-", ""), ("a", "-"), ("4", ":a+T"), ("+", "T")]
    keys = [bytes(r[0]) for r in spark.createDataFrame(rows, "d string, t string").select(common.row_key(F.col("d"), F.col("t"))).collect()]
    assert len(set(keys)) == len(rows)


def test_users_of_the_key_keep_such_rows_apart(spark):
    """Rows whose id and text used to share a key: each keeps its own decision."""
    line = "one two three four five six seven eight nine ten"
    body = "\n".join(f"{line} {i}" for i in range(12))
    rows = [("a", "x+" + body), ("a+x", body), ("null", body + "\nend"), (None, body + "\nend")]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id string, text string, lang string, source string, n_chars long")
    made, x = chunk_dedup.dedup(docs)
    assert made.count() == 4 and made.where(F.col(x["n_chunks"]).isNull()).count() == 0 and made.where(F.size(x["spans"]) > 0).count() == 3
    lines = winnow_lines.dedup(docs)[0].select("doc_id", "text").collect()
    assert len(lines) == 4 and 1 <= sum(line in r["text"] for r in lines) <= 2


def test_fresh_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, _A int, B int")
    assert common.fresh(df, "a", "b", "c", "c") == ["__a", "_b", "c", "_c"]


def test_stored_and_forgotten(spark):
    common.forget(spark)
    kept = common.stored(spark.range(100).withColumn("x", F.lit(None).cast("string")))
    assert kept.count() == 100 and kept.columns == ["id", "x"]
    folder = common.STORED[0].removeprefix("file:")
    assert os.path.isdir(folder) and common.forget(spark) == 1 and not os.path.exists(folder)


@pytest.mark.parametrize("rows", [9, 10])
def test_small(spark, rows):
    hinted = common.small(spark.range(10), rows)._jdf.queryExecution().analyzed().toString()
    assert ("broadcast" in hinted) == (rows == 10)
