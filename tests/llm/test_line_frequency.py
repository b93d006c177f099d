"""Quality rules beside plain loops."""

import re
from collections import Counter, defaultdict

from tidemark.llm import line_frequency as lf

SCHEMA = "doc_id long, text string, source string, host string, lines int"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
LONG = " ".join(a + b for a in "xyz" for b in LETTERS[:10])


def loops(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def brute(rows, most_texts, most_share, left):
    texts, holders = defaultdict(set), defaultdict(set)
    for _, text, source, *_ in rows:
        texts[source].add(text or "")
        for line in (text or "").split("\n"):
            if lf.normal_line(line):
                holders[source, lf.normal_line(line)].add(text or "")
    made = []
    for doc_id, text, source, *_ in rows:
        n, chars, symbols, dup, rep, failed = loops(text)
        gone = 0
        for line in (text or "").split("\n"):
            n_texts = len(holders.get((source, lf.normal_line(line)), ()))
            if n_texts > most_texts and n_texts > most_share * len(texts[source]):
                gone += len(re.findall(r"[^\x20\x09-\x0D]+", line))
        made.append((doc_id, source, n, chars, symbols, dup, rep, gone, failed, not failed and n - gone >= n * left))
    return made


def rows():
    made = [(i, f"Read  more, {i} times!\n{LONG} {LETTERS[i % 26] * (1 + i // 26)}", "a", "x", 1) for i in range(30)]
    made += [(100 + i, f"READ MORE 7 times\n#boiler {LONG}\nown {LETTERS[i % 26] * (1 + i // 26)}", "b", None, None) for i in range(30)]
    made += [(200, None, None, None, None), (201, "", "a", "", 0), (None, LONG, "a", "", 0), (202, (LONG + "\n") * 3, None, "", 0), (202, (LONG + "\n") * 3, None, "", 0)]
    made += [(300 + i, LONG + "\ncopy\ncopy", "c", "", 0) for i in range(40)] + [(400, "\x0b\x1f  é\n\n \n", "c", "", 0), (401, "word " * 50_000 + LONG * 9, "c", "", 0)]
    return made


def test_against_loops(spark):
    made = lf.quality(spark.createDataFrame(rows(), SCHEMA)).collect()
    expected = brute(rows(), lf.MOST_TEXTS, lf.MOST_SHARE, lf.LEAST_LEFT)
    assert sorted(repr(tuple(r)) for r in made) == sorted(map(repr, expected))
    by = {r["doc_id"]: r["kept"] for r in made}
    assert by[5] and not by[105] and by[301]  # lines of copies are no boilerplate


def test_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    made = lf.quality(docs, most_texts=2).collect()
    own = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    assert sorted(repr(tuple(r)) for r in made) == sorted(map(repr, brute(own, 2, lf.MOST_SHARE, lf.LEAST_LEFT)))
    assert any(r["n_boilerplate_words"] for r in made)


def test_lines_removed(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    made = {r["doc_id"]: r["text"] for r in lf.without_lines(docs).collect()}
    assert made[105] == "own f" and made[3] == f"{LONG} d" and made[200] is None and made[301] == LONG + "\ncopy\ncopy"
    assert lf.without_lines(docs).count() == len(rows())


def test_empty(spark):
    assert lf.quality(spark.createDataFrame([], SCHEMA)).count() == 0
