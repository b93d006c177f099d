"""Language of words and documents by a linear-chain conditional random field.

Every word is labelled: features of its spelling (affixes, character n-grams, the word,
lexicons of the languages) score each label, learned transitions tie neighbours, and
forward-backward gives the probability of each label for each word, also where a text
switches language. A document's language has the largest mean probability.

The field is fitted on a bounded sample of labelled documents. Its training sequences join
pieces of several documents, so that it learns how often the language changes between
words and how it does not within a sentence. Prediction reads every whole text once, in
Arrow batches, and shuffles nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, row_key, small, stored, text_batches

#: About so many labelled documents of each language are sampled, and so many characters of each, from anywhere in it.
SAMPLE_DOCS = 300
SAMPLE_CHARS = 2_000
#: A lexicon has so many of a language's words at most, each seen so often at least and mostly in that language.
LEXICON = 400
LEXICON_SEEN = 5
LEXICON_SHARE = 0.8
#: A feature counts if so many different words of the sample have it.
FEATURE_WORDS = 2
#: Words of a training sequence, and of a piece in it.
SEQUENCE = 48
PIECE = 16
ROUNDS = 60
#: Words that are handled at once, and words whose scores are remembered.
PART_WORDS = 200_000
REMEMBERED = 300_000
#: No language.
NONE = "und"
#: A document below this score is rejected as of no clear language.
LEAST_SCORE = 0.4

LETTERS = re.compile(r"[^\W\d_]+")


def split_words(text: str | None) -> list[str]:
    """Runs of letters in lower case. The pattern also takes numerals that are no digits; ``has_letter`` drops these."""
    return [w for w in LETTERS.findall(text.lower()) if w.isalpha() or has_letter(w)] if text else []


def has_letter(word: str) -> bool:
    return any(map(str.isalpha, word))


def spelling(word: str) -> list[str]:
    """Features of a word: itself, affixes of up to three characters, bigrams and trigrams with its borders."""
    edged = f"^{word}$"
    made = ["b", f"w{word}"]
    made += [f"p{word[:n]}" for n in (1, 2, 3)] + [f"s{word[-n:]}" for n in (1, 2, 3)]
    made += [edged[i : i + 2] for i in range(len(edged) - 1)]
    made += [edged[i : i + 3] for i in range(len(edged) - 2)]
    return made


@dataclass
class Field:
    """A fitted field. ``weights``: a row of label scores per feature; ``lexicons``: labels whose lexicon has a word."""

    labels: list[str]
    features: dict[str, int]
    lexicons: dict[str, list[int]]
    weights: np.ndarray
    moves: np.ndarray
    first: np.ndarray

    def rows_of(self, word: str) -> list[int]:
        get = self.features.get
        return [i for f in spelling(word) if (i := get(f)) is not None] + self.lexicons.get(word, [])

    def scores(self, words: list[str]) -> np.ndarray:
        """A row of label scores per word; every word has the constant feature."""
        rows = [self.rows_of(w) for w in words]
        starts = np.concatenate(([0], np.cumsum([len(r) for r in rows])[:-1])).astype(np.int64)
        return np.add.reduceat(self.weights[np.array([i for r in rows for i in r], dtype=np.int64)], starts, axis=0)


def sums(values: np.ndarray) -> np.ndarray:
    return values / values.sum(axis=-1, keepdims=True)


def posteriors(scores: np.ndarray, opens: np.ndarray, moves: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Label probabilities of each word of a stream of texts; ``opens`` marks the first word of each text.

    Forward-backward, exact. The stream is cut into about sqrt(n) chunks that advance side
    by side: first as matrices from any entry to the chunk's end, which are then chained,
    then as vectors. The start of a text forgets what was before.
    """
    n, k = scores.shape
    lanes = max(1, int(np.sqrt(n)))
    steps = -(-n // lanes)
    pad = lanes * steps - n
    power = np.exp(scores - scores.max(axis=1, keepdims=True))
    power = np.concatenate((power, np.ones((pad, k)))).reshape(lanes, steps, k).transpose(1, 0, 2)
    opened = np.concatenate((opens, np.ones(pad, dtype=bool))).reshape(lanes, steps).T[:, :, None]
    a, start = np.exp(moves - moves.max()), sums(np.exp(first - first.max()))
    chunk = np.broadcast_to(np.eye(k), (lanes, k, k)).copy()
    for t in range(steps):
        ahead = np.where(opened[t][:, None], chunk.sum(axis=2, keepdims=True) * start, (chunk.reshape(-1, k) @ a).reshape(lanes, k, k))
        chunk = ahead * power[t][:, None]
        chunk /= chunk.sum(axis=(1, 2), keepdims=True)
    enter, leave = np.empty((lanes, k)), np.empty((lanes, k))
    enter[0], leave[-1] = 1 / k, 1 / k
    for i in range(1, lanes):
        enter[i] = sums(enter[i - 1] @ chunk[i - 1])
        leave[-i - 1] = sums(chunk[-i] @ leave[-i])
    alpha = np.empty((steps, lanes, k))
    now = enter
    for t in range(steps):
        now = alpha[t] = sums(np.where(opened[t], start, now @ a) * power[t])
    now = leave
    for t in range(steps - 1, -1, -1):
        alpha[t] = sums(alpha[t] * now)
        # what the word before sees; at the first word of a text it sees nothing
        now = np.where(opened[t], 1 / k, sums((power[t] * now) @ a.T))
    return alpha.transpose(1, 0, 2).reshape(-1, k)[:n]


def sequences(texts: list[list[str]], marks: list[int]) -> tuple[list[str], np.ndarray]:
    """Words and labels of training sequences (rows of SEQUENCE words) of pieces in a mixed order."""
    pieces = [(w[i : i + PIECE], m) for w, m in zip(texts, marks) for i in range(0, len(w) - PIECE // 2, PIECE)]
    order = np.random.RandomState(7).permutation(len(pieces))
    words = [w for i in order for w in pieces[i][0]]
    labels = np.array([pieces[i][1] for i in order for _ in pieces[i][0]], dtype=np.int64)
    rows = max(1, len(words) // SEQUENCE)
    while len(words) < SEQUENCE:
        words, labels = words * 2, np.tile(labels, 2)
    return words[: rows * SEQUENCE], labels[: rows * SEQUENCE].reshape(rows, SEQUENCE)


def lexicons_of(texts: list[list[str]], marks: list[int], k: int) -> dict[str, list[int]]:
    seen = [Counter() for _ in range(k)]
    for words, m in zip(texts, marks):
        seen[m].update(words)
    made: dict[str, list[int]] = {}
    for m in range(k):
        total = sum(seen[m].values())
        share = {w: c / total / sum(s[w] / max(1, sum(s.values())) for s in seen) for w, c in seen[m].most_common(4 * LEXICON) if c >= LEXICON_SEEN}
        for w in [w for w, s in share.items() if s >= LEXICON_SHARE][:LEXICON]:
            made.setdefault(w, []).append(m)
    return made


def fit_field(texts: list[list[str]], langs: list[str]) -> Field | None:
    """A field from texts (as words) and their languages, by gradient steps on the likelihood of all sequences. None without words."""
    labels = sorted(set(langs))
    marks = [labels.index(x) for x in langs]
    if not any(len(t) > PIECE // 2 for t in texts):
        texts = [t * PIECE for t in texts]
    if not any(texts):
        return None
    words, y = sequences(texts, marks)
    k = len(labels)
    types, index = np.unique(np.array(words, dtype=object), return_inverse=True)
    index = index.reshape(y.shape)
    counts = Counter(f for w in types for f in set(spelling(w)))
    features = {f: i for i, f in enumerate(f for f, c in counts.items() if c >= FEATURE_WORDS or f == "b")}
    lexicons = {w: [len(features) + m for m in ms] for w, ms in lexicons_of(texts, marks, k).items()}
    field = Field(labels, features, lexicons, np.zeros((len(features) + k, k)), np.zeros((k, k)), np.zeros(k))
    rows = [field.rows_of(w) for w in types]
    flat = np.array([i for r in rows for i in r], dtype=np.int64)
    type_of = np.repeat(np.arange(len(types)), [len(r) for r in rows])
    starts = np.concatenate(([0], np.cumsum([len(r) for r in rows])[:-1]))
    by_feature = np.argsort(flat, kind="stable")
    used, feature_starts = np.unique(flat[by_feature], return_index=True)
    type_by_feature = type_of[by_feature]
    n, length = y.shape
    truth = np.eye(k)[y]
    true_moves = np.einsum("nti,ntj->ij", truth[:, :-1], truth[:, 1:])
    state = [np.zeros_like(x) for x in (field.weights, field.moves, field.first) for _ in range(2)]
    for step in range(1, ROUNDS + 1):
        power = np.exp(s := (lambda e: e - e.max(axis=2, keepdims=True))(np.add.reduceat(field.weights[flat], starts, axis=0)[index]))
        a, start = np.exp(field.moves - field.moves.max()), sums(np.exp(field.first - field.first.max()))
        alpha, beta, moved = np.empty_like(s), np.empty_like(s), np.zeros((k, k))
        alpha[:, 0] = sums(start * power[:, 0])
        for t in range(1, length):
            alpha[:, t] = sums((alpha[:, t - 1] @ a) * power[:, t])
        beta[:, -1] = 1
        for t in range(length - 2, -1, -1):
            ahead = power[:, t + 1] * beta[:, t + 1]
            beta[:, t] = sums(ahead @ a.T)
            scale = np.einsum("ni,ij,nj->n", alpha[:, t], a, ahead)
            moved += np.einsum("ni,nj->ij", alpha[:, t] / scale[:, None], ahead) * a
        gamma = sums(alpha * beta)
        wrong = np.zeros((len(types), k))
        np.add.at(wrong, index.ravel(), (truth - gamma).reshape(-1, k))
        gradient = np.zeros_like(field.weights)
        gradient[used] = np.add.reduceat(wrong[type_by_feature], feature_starts, axis=0)
        for x, g, m, v in zip((field.weights, field.moves, field.first), (gradient, true_moves - moved, (truth - gamma)[:, 0].sum(axis=0)), state[::2], state[1::2]):
            g = g / n - 1e-4 * x
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    field.weights = field.weights.astype(np.float32)
    return field


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from. A null id counts as empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "utf-8")) % 3 == 1


def sample(docs: DataFrame, docs_of_each: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> list[tuple[str, str]]:
    """(text, lang) of about ``docs_of_each`` labelled documents per language, ``chars`` characters of each.

    Rows are drawn by a hash of id and text against a threshold that follows from the
    language's row count, so nothing is sorted and reruns draw the same rows.
    """
    known = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    drawn = F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))
    start = F.pmod("h", F.greatest(F.length("text") - chars, F.lit(0)) + 1).cast("int") + 1
    part = known.join(counts, "lang").where(drawn * F.col("n") < docs_of_each)
    rows = part.select(F.substring("text", start, F.lit(chars)).alias("text"), "lang", "h").collect()
    return [(r["text"], r["lang"]) for r in sorted(rows, key=lambda r: (r["lang"], r["h"], r["text"]))]


def fit(docs: DataFrame) -> Field | None:
    """A field fitted on a sample of the labelled documents that are not held out; None if there is none with a letter."""
    rows = sample(docs)
    return fit_field([split_words(t) for t, _ in rows], [x for _, x in rows])


def labeller(held: Broadcast):
    """A function for mapInPandas that labels whole texts, part by part."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        field, numbers, table = held.value, {}, None
        for batch in batches:
            rest, texts, begin, held_words = batch.columns.drop("text"), [], 0, 0
            for i, text in enumerate(batch["text"]):
                texts.append(split_words(text))
                held_words += len(texts[-1])
                if held_words >= PART_WORDS or i == len(batch) - 1:
                    if len(numbers) > REMEMBERED:
                        numbers, table = {}, None
                    if field is not None and held_words:
                        new = list(dict.fromkeys(w for x in texts for w in x if w not in numbers))
                        if new:
                            numbers.update(zip(new, range(len(numbers), len(numbers) + len(new))))
                            table = field.scores(new) if table is None else np.concatenate((table, field.scores(new)))
                    made = pd.DataFrame(judge(field, texts, numbers, table), columns=["lang_pred", "score", "runs"])
                    yield pd.concat([batch.iloc[begin : i + 1][rest].reset_index(drop=True), made], axis=1)
                    texts, begin, held_words = [], i + 1, 0

    return run


def judge(field: Field | None, texts: list[list[str]], numbers: dict[str, int], table: np.ndarray | None) -> list[tuple[str, float, list[dict]]]:
    """Per text: its language, the mean probability of that language over its words, and runs of equally labelled words."""
    made: list[tuple[str, float, list[dict]]] = [(NONE, 0.0, []) for _ in texts]
    some = [i for i, x in enumerate(texts) if x]
    if field is None or not some:
        return made
    index = np.array([numbers[w] for i in some for w in texts[i]], dtype=np.int64)
    starts = np.concatenate(([0], np.cumsum([len(texts[i]) for i in some])))
    opens = np.zeros(len(index), dtype=bool)
    opens[starts[:-1]] = True
    chance = posteriors(table[index], opens, field.moves, field.first)
    means = np.add.reduceat(chance, starts[:-1], axis=0) / np.diff(starts)[:, None]
    best = chance.argmax(axis=1)
    cuts = np.flatnonzero(opens | np.concatenate(([True], best[1:] != best[:-1])))
    first_cut = np.searchsorted(cuts, starts)
    lengths = np.diff(np.concatenate((cuts, [len(index)])))
    for row, i in enumerate(some):
        own = range(first_cut[row], first_cut[row + 1])
        runs = [{"lang": field.labels[best[cuts[c]]], "first_word": int(cuts[c] - starts[row]), "n_words": int(lengths[c])} for c in own]
        top = int(means[row].argmax())
        made[i] = (field.labels[top], float(min(1.0, means[row, top])), runs)
    return made


def label(docs: DataFrame, field: Field | None) -> DataFrame:
    """doc_id, doc_key, lang_pred, score and runs (lang, first_word, n_words) of every row.

    Words are runs of letters. A text that is null or has no letter is ``und`` with score
    0 and no runs; so is every text if there was nothing to learn from. Only the text
    matters, so repeated rows and copies get the same. Ties go to the first label in
    order. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    text_batches(spark)
    own = docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("doc_key"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, doc_key binary, lang_pred string, score double, runs array<struct<lang:string,first_word:int,n_words:int>>"
    return own.mapInPandas(labeller(spark.sparkContext.broadcast(field)), schema)


def language_table(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_runs (stretches of words of one language)."""
    made = label(docs, fit(docs))
    return made.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.size("runs").cast("long").alias("n_runs"))


def keep_known(docs: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """``docs`` without documents of no language or of none that is clear; columns as they were.

    Null texts, empty ones and those without a letter have no language and go. Rows that
    repeat id and text share one label and all stay or all go; a null id is an id of its
    own. A score of exactly ``least_score`` stays. Without a single labelled text there is
    no language to learn and every row goes; an empty table stays empty. Extra columns of
    any name are kept.
    """
    key = fresh(docs, "doc_key")[0]
    made = label(docs, fit(docs))
    bad = stored(made.where((F.col("lang_pred") == NONE) | (F.col("score") < least_score)).select(F.col("doc_key").alias(key)).distinct())
    return docs.withColumn(key, row_key(F.col("doc_id"), F.col("text"))).join(small(bad), key, "left_anti").select(*docs.columns)
