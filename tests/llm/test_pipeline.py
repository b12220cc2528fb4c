"""The pipeline over the smallest tables, each stage against a plain version on its own input."""

import re

import corpus_pipeline
from lodestrata.llm import quality, scratch
from tests.llm.test_text_operators import fold, plain_components, plain_lines, words_of

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "packing"]
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(scratch.keep(stage(spark, out[-1], SF), "stage"))
    for df in out[:5]:
        assert df.columns == columns
    tables = [[(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()] for df in out[:5]]
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = {r.doc_id for r in quality.judge(docs, model).where("_quality_kept").collect()}
    assert kept == {i for i, _ in tables[1]} and all(len(words_of(t)) >= 50 for _, t in tables[1])
    assert sorted(tables[2]) == sorted((i, t) for i, t, _, gone in plain_lines(tables[1], 3, 50) if not gone or words_of(t))
    assert sorted(i for i, _ in tables[3]) == sorted({c for _, _, c in plain_components(tables[2], 5, 80, 100)})
    keys = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = fold(r.text)
        keys |= {" ".join(w[a : a + 10]) for a in range(max(len(w) - 10, 0) + 1 if w else 0)}
    spaced = lambda t: f" {' '.join(fold(t))} "
    assert sorted(i for i, _ in tables[4]) == sorted(i for i, t in tables[3] if not any(f" {k} " in spaced(t) for k in keys))
    packed = out[5].groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert {r["doc_id"] for r in packed} == {i for i, _ in tables[4]} and all(r["sum(length)"] == r["max(doc_tokens)"] for r in packed)
    assert all(re.fullmatch("[a-z_0-9]+", c) for c in out[5].columns)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
