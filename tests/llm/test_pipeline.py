"""The pipeline against a brute-force run of its stages, and its stages on odd tables."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import brute_pairs
from vexel.llm import crf

SF = "/root/testdata/sf0.001"


def test_pipeline_is_its_stages_by_brute_force(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = crf.train(docs, labels)
    rows = {r["doc_id"]: r["text"] for r in docs.orderBy("doc_id").collect()}
    kept = {i: t for i, t in rows.items() if crf.document_quality(model, [t])[0] >= model.cut}
    first = {}
    for i in sorted(kept):
        first.setdefault(kept[i], i)
    root = {i: i for i in first.values()}
    pairs = brute_pairs([(i, kept[i]) for i in root])
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    want = set(root.values())
    got = corpus_pipeline.run(spark, SF).collect()
    tokens = {i: len(re.findall(r"[^ \t\n\r\f\v]+", rows[i])) for i in want}
    held = {}
    for r in got:
        assert sum(r["lengths"]) == r["n_tokens"] <= 2048
        for d, n in zip(r["doc_ids"], r["lengths"], strict=True):
            held[d] = held.get(d, 0) + n
    assert set(held) == {i for i, n in tokens.items() if n}
    assert all(n % tokens[d] == 0 for d, n in held.items())


def test_stages_on_odd_and_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "words that are the same", "en", "a", 9), (1, "words that are the same", "en", "a", 9), (2, "", None, None, None), (3, None, None, None, None), (None, "no id", "en", "b", 5), (6, "A sentence that goes on and on. " * 20_000, "en", "b", 5), (7, "x" * 300_000, "en", "b", 5)]
    for k, data in enumerate((rows, [])):
        docs = spark.createDataFrame(data, schema).withColumns({c: F.lit(1) for c in ("id", "key", "shard", "H")})
        for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
            docs_in = docs.columns
            out = stage(spark, docs, SF)
            at = f"{tmp_path}/{k}-{n}"
            out.write.parquet(at)
            docs = spark.read.parquet(at)
            if n < len(corpus_pipeline.STAGES) - 1:
                assert docs.columns == docs_in, name
        assert data or not docs.count()
