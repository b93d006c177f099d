"""Quality rules from the frequency of lines across documents.

Lines are normalised and hashed; per host (``source``) the number of different texts that
hold a line is counted. Lines above the limit are boilerplate of that host: they are
removed, and a document that keeps too little is rejected. Rules on words, symbols and
repetition within the document come first.

The texts are read once, in Arrow batches, into a profile: counts and line hashes. All
that is shuffled after that is hashes and counts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark.llm.common import WORD, fresh, row_key, small, stored, text_batches

#: A line is boilerplate if more texts of its host hold it than both of these allow.
MOST_TEXTS = 20
MOST_SHARE = 0.01
#: A document is depleted if less than this share of its words is left.
LEAST_LEFT = 0.5
#: Words in which repetition is sought.
REPEAT = 8
#: Words that are handled at once.
PART_WORDS = 300_000

WORDS = re.compile(WORD)
SPACES = re.compile(r"[\x20\x09-\x0D]+")
DIGITS = re.compile(r"[0-9]+")
PUNCTUATION = re.compile(r"[!-/:-@\[-`{-~]+")
SYMBOLS = "#*$%&|<>"

PROFILE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, text_hash long, lines array<struct<line:long,words:int>>"


def normal_line(line: str) -> str:
    """Lower case, digits as one 0, no ASCII punctuation, single spaces."""
    return SPACES.sub(" ", PUNCTUATION.sub("", DIGITS.sub("0", line.lower()))).strip(" ")


def line_hash(line: str) -> int:
    return xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63)


def repeated(words: list[list[str]], length: int = REPEAT) -> np.ndarray:
    """Per text, how many words lie in windows of ``length`` that the text holds twice or more.

    Exact: windows get numbers by doubling (pairs of numbers are numbered again), for
    all texts of a batch at once.
    """
    sizes = np.array([len(x) for x in words], dtype=np.int64)
    made = np.zeros(len(words), dtype=np.int64)
    flat = [w for x in words for w in x]
    if len(flat) < length:
        return made
    doc = np.repeat(np.arange(len(words)), sizes)
    name = pd.factorize(np.array(flat, dtype=object))[0].astype(np.int64)
    step, named = 1, 1
    while named < length:
        step = min(step, length - named)
        pair = name[:-step] * (name.max() + 1) + name[step:]
        name = pd.factorize(pair)[0].astype(np.int64)
        named, step = named + step, named + step
    inside = doc[: len(name)] == doc[length - 1 :]
    starts = np.flatnonzero(inside)
    key = pd.factorize(name[starts] * len(words) + doc[starts])[0]
    twice = starts[np.bincount(key)[key] > 1]
    marks = np.zeros(len(flat) + 1, dtype=np.int64)
    np.add.at(marks, twice, 1)
    np.add.at(marks, twice + length, -1)
    covered = np.cumsum(marks[:-1]) > 0
    return np.bincount(doc[covered], minlength=len(words))


def profile_text(text: str) -> tuple[int, int, int, list[dict[str, int]]]:
    """word characters, symbols, repeated lines, and the different normalised lines with all their words."""
    spaces = sum(map(text.count, "\x20\t\n\x0b\x0c\r"))
    seen: set[str] = set()
    n_dup, lines = 0, {}
    for line in text.split("\n"):
        size = len(WORDS.findall(line))
        if not size:
            continue
        n_dup += line in seen
        seen.add(line)
        if plain := normal_line(line):
            key = line_hash(plain)
            lines[key] = lines.get(key, 0) + size
    return len(text) - spaces, sum(map(text.count, SYMBOLS)), n_dup, [{"line": k, "words": n} for k, n in lines.items()]


def profiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        begin, words, rows, held = 0, [], [], 0
        for i, text in enumerate(batch["text"]):
            text = text or ""
            words.append(WORDS.findall(text))
            held += len(words[-1])
            digest = int.from_bytes(hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()[:8], "big", signed=True)
            rows.append((len(words[-1]), *profile_text(text), digest))
            if held >= PART_WORDS or i == len(batch) - 1:
                part = batch.iloc[begin : i + 1][["doc_id", "doc_key", "host"]].reset_index(drop=True)
                n, chars, symbols, dup, lines, digests = zip(*rows)
                yield part.assign(n_words=n, word_chars=chars, n_symbols=symbols, n_dup_lines=dup, n_repeat_words=repeated(words), text_hash=digests, lines=list(lines))
                begin, words, rows, held = i + 1, [], [], 0


def profile(docs: DataFrame, host: str) -> DataFrame:
    """One row per document: row_id, doc_id, doc_key, host, the counts, and its lines."""
    text_batches(docs.sparkSession)
    named = docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("doc_key"), F.col(host).cast("string").alias("host"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = named.mapInPandas(profiles, f"doc_id {kind}, doc_key binary, host string, {PROFILE}")
    return stored(made.withColumn("row_id", F.monotonically_increasing_id()))


def frequent_lines(made: DataFrame, most_texts: int = MOST_TEXTS, most_share: float = MOST_SHARE) -> DataFrame:
    """(host, line, n_texts): lines that more different texts of the host hold than the limits allow.

    Texts and not rows are counted, so exact copies of a document do not make its lines
    boilerplate. Counting goes through (host, line, text) first, so no task gets a
    common line whole.
    """
    each = made.select("host", "text_hash", F.explode("lines.line").alias("line")).distinct()
    counted = each.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_texts")).where(F.col("n_texts") > most_texts)
    hosts = made.select("host", "text_hash").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("of_host"))
    h = hosts.select(F.col("host").alias("h"), "of_host")
    return counted.join(h, F.col("host").eqNullSafe(F.col("h"))).where(F.col("n_texts") > F.col("of_host") * most_share).select("host", "line", "n_texts")


def boilerplate(made: DataFrame, most_texts: int, most_share: float) -> DataFrame:
    """(row_id, doc_key, line, words): the lines of each document that are frequent in its host."""
    common = small(stored(frequent_lines(made, most_texts, most_share)).select(F.col("host").alias("h"), F.col("line").alias("l")))
    lines = made.select("row_id", "doc_key", "host", F.explode("lines").alias("x")).select("row_id", "doc_key", "host", "x.line", "x.words")
    return lines.join(common, F.col("host").eqNullSafe(F.col("h")) & (F.col("line") == F.col("l"))).select("row_id", "doc_key", "line", "words")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


def quality(docs: DataFrame, host: str = "source", most_texts: int = MOST_TEXTS, most_share: float = MOST_SHARE, least_left: float = LEAST_LEFT) -> DataFrame:
    """Counts, words in boilerplate lines, and the verdict for every document.

    Returns doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_boilerplate_words, base_failed, kept. A null text counts as empty and fails for
    lack of words; a null host is a host of its own. Every row is judged, also repeated
    ones; lines of equal text count once. An empty table gives an empty result. ``docs``
    needs doc_id, text and ``host``; other columns play no part.
    """
    made = profile(docs, host)
    lost = boilerplate(made, most_texts, most_share).groupBy("row_id").agg(F.sum("words").alias("gone"))
    judged = made.drop("lines", "text_hash", "doc_key").join(lost, "row_id", "left").withColumn("n_boilerplate_words", F.coalesce("gone", F.lit(0)).cast("long"))
    left = F.col("n_words") - F.col("n_boilerplate_words")
    return judged.withColumn("base_failed", base_failed()).select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_boilerplate_words", "base_failed",
        (~F.col("base_failed") & (left >= F.col("n_words") * least_left)).alias("kept"),
    )


def without_lines(docs: DataFrame, host: str = "source", most_texts: int = MOST_TEXTS, most_share: float = MOST_SHARE) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``; all rows and columns stay, null texts stay null.

    Of a text of nothing but such lines only blank lines are left, if it has any. A null host is a host of its own;
    rows that repeat id and text get the same text. Extra columns of any name are kept;
    an empty table stays empty.
    """
    key, line = fresh(docs, "doc_key", "gone_lines")
    lost = boilerplate(profile(docs, host), most_texts, most_share).groupBy(F.col("doc_key").alias(key)).agg(F.collect_set("line").alias(line))
    joined = docs.withColumn(key, row_key(F.col("doc_id"), F.col("text"))).join(lost, key, "left")
    text = F.when(F.col(line).isNull(), F.col("text")).otherwise(drop_lines(F.col("text"), F.col(line)))
    return joined.withColumn("text", text).select(*docs.columns)


@F.pandas_udf(StringType())
def drop_lines(text: pd.Series, gone: pd.Series) -> pd.Series:
    """Texts without the lines whose hashes are in ``gone``, the list of each text itself."""
    made = []
    for t, g in zip(text, gone):
        banned = set() if g is None else set(map(int, g))
        made.append("\n".join(x for x in t.split("\n") if line_hash(normal_line(x)) not in banned) if banned else t)
    return pd.Series(made)
