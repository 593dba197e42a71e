"""The pipeline's stages against plain versions of each, one on the output of the other."""

import re

import corpus_pipeline
from firnline.llm import neardup, quality, secrets

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality", "near_duplicates", "decontamination", "secrets", "packing"]
    kept = steps["quality"](spark, docs, sf)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    alone = steps["near_duplicates"](spark, kept, sf)
    ids = {r.doc_id for r in neardup.near_duplicates(kept).where("kept").collect()}
    assert {r.doc_id for r in alone.collect()} == ids
    clean = steps["decontamination"](spark, alone, sf)
    items = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r.text.lower()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 10]) for w in items for i in range(len(w) - 9)}
    left = {r.doc_id: r.text for r in clean.collect()}
    for r in alone.collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r.text.lower())
        assert (r.doc_id in left) == (not any(tuple(w[i : i + 10]) in windows for i in range(len(w) - 9)))
    safe = steps["secrets"](spark, clean, sf)
    assert safe.columns == docs.columns and all(r.n == 0 for r in secrets.scan_secrets(safe).selectExpr("size(secret_spans) n").collect())
    packed = steps["packing"](spark, safe, sf).collect()
    assert {r.doc_id for r in packed} == set(left)


def test_run(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert got.count() > 0 and "ids_crc32" in got.columns


def test_quality_stage_uses_the_labels(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    assert quality.train_and_classify(spark, docs, labels).where("not accepted").count() > 0
