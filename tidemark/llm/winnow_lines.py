"""Line dedup by winnowing over line hashes.

Each document is the sequence of hashes of its lines that are not blank. Every three
consecutive lines make a gram, and of every three consecutive grams the one with the
least hash is a fingerprint of the document: two documents that share five lines in a row
surely share a fingerprint. Fingerprints are joined by hash to the first place of each;
matches are extended both ways, and the later run is deleted.

Consecutive fingerprints lie at most three grams apart, so between two of them no line of
a repeated run is left out, and beyond the last one a match goes on for two lines at most.
So a fingerprint is also posted with one and two more lines on either side: each of these
longer grams finds its own first place, wherever that is, and a repeated run of five
lines or more goes whole. What is posted has a fixed size, no document is read again, and
a run that a third of all documents share is folded to its first place before the shuffle.

Lines have any length, so with ``words`` given there is a second family of prints, cut by
content: every run of one to four lines that reaches so many words, and would not without
its first or without its last line. Whether a run is one follows from its lines alone, so
no window is needed, and a repeated run of so many words goes whole, however few lines it
has.

The main path has built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, row_key, small_lists, stored

#: Lines of a gram: the shortest run that can be deleted.
GRAM = 3
#: Grams of which the least is a fingerprint.
WINDOW = 3
#: Words that make a passage of the second family.
PASSAGE_WORDS = 40
#: Lines of a passage at most; a repeated run of more lines always shares a fingerprint.
PASSAGE_LINES = GRAM + WINDOW - 2


def plain_text(text: Column) -> Column:
    """The text in lower case, white space within lines as single spaces; texts that have nothing else are not searched by the expression."""
    small = F.lower(text)
    other = F.contains(small, F.lit("  "))
    for c in "\t\x0b\f\r":
        other = other | F.contains(small, F.lit(c))
    return F.when(other, F.regexp_replace(small, r"[\t\x0B\f\r][ \t\x0B\f\r]*| [ \t\x0B\f\r]+", " ")).otherwise(small)


def line_hash(line: Column) -> Column:
    """60 bits of a line of ``plain_text`` without spaces at its ends."""
    return F.conv(F.substring(F.md5(line), 1, 15), 16, 10).cast("long")


def gram_hash(lines: Column) -> Column:
    return F.unhex(F.md5(F.array_join(lines.cast("array<string>"), " ")))


def line_sequences(docs: DataFrame, counted: bool = False) -> DataFrame:
    """(doc_id, doc_key, lines): number and hash (``counted``: and words) of every line that is not blank, one row per row that has some."""
    words = lambda x: [F.size(F.split(x, " ")).alias("w")] if counted else []
    lines = F.transform(F.split(plain_text(F.coalesce(F.col("text"), F.lit(""))), "\n", -1), lambda x, i: F.struct(i.alias("i"), F.trim(x).alias("x")))
    hashed = F.transform(F.filter(lines, lambda e: e["x"] != ""), lambda e: F.struct(e["i"].alias("i"), line_hash(e["x"]).alias("h"), *words(e["x"])))
    # a condition on the lines would be pushed below them, and hash them twice
    some = docs.where(F.col("text").rlike(r"[^ \t\n\x0B\f\r]"))
    return some.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("doc_key"), hashed.alias("lines"))


def fingerprints(sequences: DataFrame, gram: int, window: int) -> DataFrame:
    """(doc_id, doc_key, print, begin, end): the chosen grams of each document, alone and with up to window - 1 lines before or after.

    A document with fewer lines than a gram is one gram. Of equal hashes in a window the
    last is chosen, as a line that is repeated many times then has fewer fingerprints.
    """
    h = F.transform("lines", lambda x: x["h"])
    grams = F.when(
        F.size("h") >= gram, F.transform(F.sequence(F.lit(1), F.size("h") - (gram - 1)), lambda i: gram_hash(F.slice(F.col("h"), i, gram)))
    ).otherwise(F.array(gram_hash(F.col("h"))))
    chosen = F.array_distinct(
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.size("g") - (window - 1), F.lit(1))),
            lambda i: -F.array_min(F.transform(F.slice(F.col("g"), i, window), lambda x, k: F.struct(x.alias("x"), (-(i + k)).alias("p"))))["p"],
        )
    )
    around = [(0, 0)] + [(d, 0) for d in range(1, window)] + [(0, d) for d in range(1, window)]
    own = F.least(F.lit(gram), F.size("h"))
    runs = F.array(*[F.struct((F.col("p") - 1 - up).alias("begin"), (F.col("p") - 1 + own + down).alias("end")) for up, down in around])
    inside = F.filter(runs, lambda x: (x["begin"] >= 0) & (x["end"] <= F.size("h")))
    each = sequences.select("doc_id", "doc_key", h.alias("h")).withColumn("g", grams).withColumn("p", F.explode(chosen)).withColumn("x", F.explode(inside))
    return each.select("doc_id", "doc_key", gram_hash(F.slice("h", F.col("x.begin") + 1, F.col("x.end") - F.col("x.begin"))).alias("print"), "x.begin", "x.end")


def passages(sequences: DataFrame, words: int, most: int = PASSAGE_LINES) -> DataFrame:
    """(doc_id, doc_key, print, begin, end) from counted ``line_sequences``: runs of up to ``most`` lines that have ``words`` words, but not without the first or not without the last line."""

    def from_line(b: Column) -> Column:
        sizes = [F.coalesce(F.get("w", b + i), F.lit(0)) for i in range(most)]
        totals = [sum(sizes[1 : k + 1], sizes[0]) for k in range(most)]
        made = [F.when((b + k < F.size("w")) & (t >= words) & ((t - sizes[0] < words) | (t - sizes[k] < words)), b + (k + 1)) for k, t in enumerate(totals)]
        return F.transform(F.filter(F.array(*made), lambda e: e.isNotNull()), lambda e: F.struct(b.alias("begin"), e.alias("end")))

    each = sequences.select("doc_id", "doc_key", F.transform("lines", lambda x: x["h"]).alias("h"), F.transform("lines", lambda x: x["w"]).alias("w"))
    found = each.withColumn("x", F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.size("w") - 1), from_line))))
    return found.select("doc_id", "doc_key", gram_hash(F.slice("h", F.col("x.begin") + 1, F.col("x.end") - F.col("x.begin"))).alias("print"), "x.begin", "x.end")


def repeated_runs(sequences: DataFrame, gram: int = GRAM, window: int = WINDOW, words: int | None = None) -> DataFrame:
    """(doc_key, begin, end) from ``line_sequences``: runs of the document's non-blank lines, from begin to before end, that occur earlier.

    Earlier means a smaller (doc_id, doc_key, line), null ids last; the same document
    counts too. Runs of one document may overlap. Rows that repeat a document have
    the same places, none of them earlier, and give the same runs.
    """
    prints = fingerprints(sequences, gram, window)
    if words is not None:
        prints = prints.unionByName(passages(sequences, words, gram + window - 2))
    placed = prints.withColumn("place", F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "doc_key", "begin"))
    first = placed.groupBy("print").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("print", "first")
    return placed.join(first, "print").where(F.col("place") > F.col("first")).select("doc_key", "begin", "end")


def cuts(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, words: int | None = None) -> DataFrame:
    """(doc_key, gone): the numbers (from 0, blank lines counted) of the lines to delete, for documents that have some."""
    sequences = stored(line_sequences(docs, words is not None))
    runs = repeated_runs(sequences, gram, window, words)
    spots = runs.select("doc_key", F.explode(F.sequence("begin", F.col("end") - 1)).alias("spot")).groupBy("doc_key").agg(F.collect_set("spot").alias("spots"))
    numbers = sequences.select("doc_key", F.col("lines.i").alias("numbers"))
    made = spots.join(numbers, "doc_key").select("doc_key", F.transform("spots", lambda x: F.element_at("numbers", x + 1)).alias("gone"))
    # once per document, as rows may repeat one
    return made.dropDuplicates(["doc_key"])


def dedup(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, words: int | None = None) -> tuple[DataFrame, str]:
    """``docs`` with later repeated runs of lines deleted from ``text``, and the name of a new column with the count of lines deleted.

    Lines compare in lower case with single spaces; blank lines belong to no run and
    stay. The first place of a run stays whole. Runs of gram + window - 1 lines go
    wherever they stand, and with ``words`` also those of so many words. A document of fewer lines than a gram
    goes if it repeats another whole short document. If nothing is left but blank lines
    the text becomes empty; null texts stay null. Rows that repeat id and text are one
    document and get the same result. All rows and columns stay; an empty table stays
    empty.
    """
    key, gone, many = fresh(docs, "doc_key", "gone_lines", "n_removed")
    found = stored(cuts(docs, gram, window, words).select(F.col("doc_key").alias(key), F.col("gone").alias(gone)))
    joined = docs.withColumn(key, row_key(F.col("doc_id"), F.col("text"))).join(small_lists(found, gone), key, "left")
    lines = F.split(F.col("text"), "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    kept = F.array_join(F.transform(left, lambda i: F.element_at(lines, i + 1)), "\n")
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.element_at(F.transform(F.array(kept), lambda x: F.when(x.rlike(r"[^ \t\n\x0B\f\r]"), x).otherwise(F.lit(""))), 1))
    made = joined.withColumn("text", text).withColumn(many, F.coalesce(F.size(gone), F.lit(0)).cast("long"))
    return made.select(*docs.columns, many), many


def dedup_table(docs: DataFrame, words: int | None = None) -> DataFrame:
    """doc_id, n_lines_left, n_removed, text (what is left)."""
    made, many = dedup(docs.select("doc_id", "text"), words=words)
    ends = F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    return made.select("doc_id", F.coalesce(ends + 1, F.lit(0)).cast("long").alias("n_lines_left"), many, "text")


WINNOW_SQL = r"""
WITH doc AS (
  SELECT DISTINCT doc_id, text FROM documents
), line AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM doc
), plain AS (
  SELECT *, trim(regexp_replace(lower(line), '[ \t\x0B\f\r]+', ' ', 'g')) AS plain FROM line
), hashed AS (
  SELECT doc_id, text, i, ('0x' || substr(md5(plain), 1, 15))::BIGINT AS h, row_number() OVER (PARTITION BY doc_id, text ORDER BY i) - 1 AS spot
  FROM plain WHERE plain <> ''
), sequences AS (
  SELECT doc_id, text, list(h ORDER BY i) AS h, list(i ORDER BY i) AS numbers FROM hashed GROUP BY doc_id, text
), starts AS (
  SELECT *, unnest(range(1, greatest(len(h) - 2, 1) + 1)) AS p FROM sequences
), grams AS (
  SELECT doc_id, text, p, h, md5(array_to_string(h[p:p + 2], ' ')) AS g FROM starts
), windows AS (
  SELECT doc_id, text, least(greatest(max(p) OVER w - 2, 1), p) AS first_p, p,
         lead(p, 1) OVER o AS p2, lead(p, 2) OVER o AS p3, g, lead(g, 1) OVER o AS g2, lead(g, 2) OVER o AS g3, max(p) OVER w AS last_p
  FROM grams WINDOW w AS (PARTITION BY doc_id, text), o AS (PARTITION BY doc_id, text ORDER BY p)
), chosen AS (
  SELECT DISTINCT doc_id, text,
         CASE WHEN g3 IS NOT NULL AND g3 <= g AND g3 <= g2 THEN p3 WHEN g2 IS NOT NULL AND g2 <= g THEN p2 ELSE p END AS p
  FROM windows WHERE p <= greatest(last_p - 2, 1)
), prints AS (
  SELECT doc_id, text, p - 1 - up AS b, p - 1 + least(3, len(h)) + down AS e, md5(array_to_string(h[p - up:p - 1 + least(3, len(h)) + down], ' ')) AS print
  FROM chosen c JOIN grams g USING (p, doc_id, text), (VALUES (0, 0), (1, 0), (2, 0), (0, 1), (0, 2)) around(up, down)
  WHERE p - 1 - up >= 0 AND p - 1 + least(3, len(h)) + down <= len(h)
), later AS (
  SELECT * FROM prints QUALIFY dense_rank() OVER (PARTITION BY print ORDER BY doc_id NULLS LAST, b) > 1
), spots AS (
  SELECT DISTINCT doc_id, text, unnest(range(b, e)) AS spot FROM later
), kept AS (
  SELECT l.doc_id, l.text, count(s.spot) AS n_removed,
         string_agg(CASE WHEN s.spot IS NULL THEN line END, chr(10) ORDER BY l.i) FILTER (WHERE s.spot IS NULL) AS left_text
  FROM plain l LEFT JOIN hashed h ON l.doc_id = h.doc_id AND l.text = h.text AND l.i = h.i
  LEFT JOIN spots s ON h.doc_id = s.doc_id AND h.text = s.text AND h.spot = s.spot
  GROUP BY l.doc_id, l.text
), cleaned AS (
  SELECT doc_id, text, n_removed,
         CASE WHEN n_removed = 0 THEN text WHEN trim(translate(coalesce(left_text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     ')) = '' THEN '' ELSE left_text END AS left_text
  FROM kept
)
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(string_split(left_text, chr(10))) END AS n_lines_left, coalesce(n_removed, 0)::BIGINT AS n_removed, left_text AS text
FROM documents LEFT JOIN cleaned USING (doc_id, text)
"""

#: The same with the passages of 40 words besides.
PASSAGE_SQL = WINNOW_SQL.replace(
    "), later AS (\n  SELECT * FROM prints",
    r"""), counts AS (
  SELECT doc_id, text, list(len(string_split(plain, ' ')) ORDER BY i) AS w, list(('0x' || substr(md5(plain), 1, 15))::BIGINT ORDER BY i) AS h FROM plain WHERE plain <> '' GROUP BY doc_id, text
), spans AS (
  SELECT *, b + size AS e FROM (SELECT *, unnest(range(0, len(w))) AS b FROM counts), (VALUES (1), (2), (3), (4)) sizes(size) WHERE b + size <= len(w)
), passages AS (
  SELECT doc_id, text, b, e, md5(array_to_string(h[b + 1:e], ' ')) AS print FROM spans
  WHERE list_sum(w[b + 1:e]) >= 40 AND (list_sum(w[b + 1:e]) - w[b + 1] < 40 OR list_sum(w[b + 1:e]) - w[e] < 40)
), later AS (
  SELECT * FROM (SELECT doc_id, text, b, e, print FROM prints UNION SELECT doc_id, text, b, e, print FROM passages)""",
)
