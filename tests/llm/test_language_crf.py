"""The field's inference beside plain loops, and held-out accuracy."""

import zlib

import numpy as np

from tidemark.llm import language_crf as lc

SCHEMA = "doc_id long, text string, lang string, score string, doc_key string"


def loops(scores, opens, moves, first):
    out = []
    cuts = [*np.flatnonzero(opens), len(scores)]
    for lo, hi in zip(cuts, cuts[1:]):
        p, a = np.exp(scores[lo:hi]), np.exp(moves)
        alpha = [np.exp(first) * p[0]]
        for x in p[1:]:
            alpha.append((alpha[-1] @ a) * x)
        beta = [np.ones(len(first))]
        for x in p[:0:-1]:
            beta.insert(0, a @ (x * beta[0]))
        g = np.array(alpha) * np.array(beta)
        out.append(g / g.sum(axis=1, keepdims=True))
    return np.concatenate(out)


def test_posteriors():
    draw = np.random.RandomState(3)
    for n in (1, 2, 7, 50, 211):
        scores, moves, first = draw.randn(n, 3), draw.randn(3, 3), draw.randn(3)
        opens = draw.rand(n) < 0.1
        opens[0] = True
        assert np.allclose(lc.posteriors(scores, opens, moves, first), loops(scores, opens, moves, first))


def test_code_switching(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    field = lc.fit(docs)
    assert field.labels == ["de", "en", "es", "fr"]
    stay = np.diag(field.moves).mean() - field.moves.mean()
    assert stay > 0.5  # neighbours tend to share their language
    texts = [(r["lang"], lc.split_words(r["text"])) for r in docs.where("n_chars BETWEEN 800 AND 1500 AND lang IN ('fr', 'de')").collect()]
    fr, de = (next(w for x, w in texts if x == lang)[:60] for lang in ("fr", "de"))
    made = lc.label(spark.createDataFrame([(1, " ".join(fr + de), None, None, None)], SCHEMA), field).first()
    words = [r["lang"] for r in made["runs"] for _ in range(r["n_words"])]
    right = sum(w == ("fr" if i < 60 else "de") for i, w in enumerate(words))
    assert len(words) == 120 and right > 110 and len(made["runs"]) < 10


def test_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r["doc_id"]: (r["lang"], r["text"]) for r in docs.collect()}
    made = lc.language_table(docs).collect()
    assert len(made) == len(truth)
    for r in made:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
    out = [r for r in made if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]][0] for r in out) / len(out) > 0.98
    kept = lc.keep_known(docs)
    assert kept.columns == docs.columns and kept.count() >= 0.97 * len(truth)


def test_edges(spark):
    rows = [(1, None, "en", "x", "y"), (2, "", "en", "x", "y"), (3, "123 -- ½²", None, None, None), (None, "the house and the garden " * 9, "en", "", ""), (4, "la maison et le jardin " * 9, "fr", "", "")]
    rows += [(i, "the house and the garden " * 9, "en", "", "") for i in range(10, 30)] + [(i, "la maison et le jardin " * 9, "fr", "", "") for i in range(30, 50)]
    rows += [(60, "the house " * 40_000, "en", "", ""), (60, "the house " * 40_000, "en", "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    made = lc.language_table(docs).collect()
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in made}
    assert len(made) == len(rows) and got[1] == got[2] == got[3] == ("und", 0.0)
    assert got[None][0] == "en" and got[4][0] == "fr" and got[60][0] == "en" and got[60][1] > 0.9
    assert lc.keep_known(docs).count() == len(rows) - 3
    empty = docs.limit(0)
    assert lc.language_table(empty).count() == 0
    unlabelled = docs.where("doc_id < 4")
    assert {r["lang_pred"] for r in lc.language_table(unlabelled).collect()} == {"und"}
