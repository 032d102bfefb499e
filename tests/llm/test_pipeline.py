"""The corpus pipeline on the smallest tables."""

import random

import corpus_pipeline
from covenant.llm import simhash


def test_stages_take_effect(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        assert 0.5 * n < out.count() <= n
    classes = simhash.near_duplicates(docs).select("component_id").distinct().count()
    assert corpus_pipeline.near_dedup(spark, docs, sf).count() == classes
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "decontaminate", "pii_pseudonyms", "mix_sources"]
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_language_stage_keeps_mixed_and_short_texts(spark, docs):
    words = {"en": "the of and that with from this which there these", "de": "der die und nicht für schön ein eine zwischen über",
             "fr": "le la les des une dans pour avec être était"}
    rows = [(i, " ".join(random.Random(i).choices(words[k].split(), k=30)), k) for i, k in enumerate([*words] * 30)]
    mixed = " ".join(" ".join(words[k].split()) for k in words)
    rows += [(200, mixed, None), (201, "Zug", None), (202, "x", None), (203, "the", None), (204, None, None), (205, "12 !", None)]
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs(rows), "").collect()}
    assert kept == set(range(90)) | {200, 201, 202, 203}
