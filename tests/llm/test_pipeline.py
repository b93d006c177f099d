"""Each stage of the pipeline beside the brute-force version of its operator, on what the stage before kept."""

import importlib.util
import sys
from collections import Counter
from pathlib import Path

import corpus_pipeline as cp
from tidemark.llm import language_crf, systematic_mix, winnow_lines

FOLDER = "/root/testdata/sf0.01"


def helper(name):
    spec = importlib.util.spec_from_file_location(name, Path(__file__).parent / f"{name}.py")
    module = importlib.util.module_from_spec(spec)
    sys.modules[name] = module
    spec.loader.exec_module(module)
    return module


def rows_of(df):
    return [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    seen, names = [rows_of(docs)], [n for n, _ in cp.STAGES]
    for i, (_, stage) in enumerate(cp.STAGES):
        made = stage(spark, docs, FOLDER)
        assert made.columns == docs.columns
        made.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.schema(made.schema).parquet(str(tmp_path / str(i)))
        seen.append(rows_of(docs))
    assert len(names) == 5
    start, known, cleaned, single, safe, mixed = seen
    raw = spark.read.parquet(f"{FOLDER}/documents.parquet")
    judged = {r["doc_id"]: r["lang_pred"] != "und" and r["score"] >= language_crf.LEAST_SCORE for r in language_crf.label(raw, language_crf.fit(raw)).collect()}
    assert Counter(known) == Counter(r for r in start if judged[r[0]])
    lines = {r[0]: r[3] for r in helper("test_winnow_lines").brute([r[:2] for r in known], winnow_lines.PASSAGE_WORDS)}
    assert Counter(cleaned) == Counter((d, lines[d], s) for d, _, s in known) and any(lines[d] != t for d, t, _ in known)
    group = {r[0]: r[2] for r in helper("test_covering_simhash").brute([r[:2] for r in cleaned])}
    assert Counter(single) == Counter(r for r in cleaned if group[r[0]] == r[0]) and len(single) < len(cleaned)
    bad = helper("test_suffix_decontam").brute
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    removed = [r for r in single if r not in set(safe)]
    assert Counter(safe) + Counter(removed) == Counter(single) and 0 < len(removed) < len(single) / 4
    assert all(bad(r[1], items)[4] for r in removed) and not any(bad(r[1], items)[4] for r in safe[:60])
    copies = {r["doc_id"]: r["copies"] for r in systematic_mix.mix_table(spark.createDataFrame(safe, "doc_id long, text string, source string")).collect()}
    assert Counter(r[0] for r in mixed) == Counter({d: c for d, c in copies.items() if c}) and set(mixed) <= set(safe)


def test_run_agrees_with_itself(spark):
    first, second = (Counter(rows_of(cp.run(spark, "/root/testdata/sf0.001"))) for _ in range(2))
    assert first == second and first
