from __future__ import annotations

import corpus_pipeline
from stridelab.llm import decontam, pii, simhash

SMALL = "/root/testdata/sf0.01"


def test_stages_act_on_all_that_is_left(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before = docs.columns, {r.doc_id for r in docs.collect()}
    toxic = {r.doc_id for r in spark.read.parquet(f"{SMALL}/labels.parquet").filter("toxic = 1").collect()}
    clean = {r.doc_id for r in spark.read.parquet(f"{SMALL}/labels.parquet").filter("toxic = 0").collect()}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL).cache()
        assert docs.columns == columns
        rows = {r.doc_id: r for r in docs.collect()}
        assert set(rows) <= before
        if name == "toxicity":
            # Some forty toxic rows to learn from: the commonest words are learned, those of rarer languages are not.
            assert len(toxic & set(rows)) <= 0.45 * len(toxic & before)
            assert len((clean & before) - set(rows)) <= 0.02 * len(clean & before)
        elif name.startswith("simhash"):
            groups = simhash.near_duplicate_groups(docs)
            assert groups.select("component_id").distinct().count() == len(rows)
        elif name.startswith("benchmark"):
            index = decontam.Index(bench, decontam.Bounds())
            assert before - set(rows) and not any(index.matches([r.text for r in rows.values()]))
        elif name == "pii":
            assert set(rows) == before and not any(pii.base_spans(r.text) for r in rows.values())
            assert all(r.n_chars == len(r.text) for r in rows.values())
        before = set(rows)
    name, stage = corpus_pipeline.STAGES[-1]
    mixed = stage(spark, docs, SMALL).collect()
    assert {r.doc_id for r in mixed} == before and all(0 <= r.epoch <= 1 for r in mixed)


def test_run_is_the_stages_in_turn(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    key = lambda df: sorted((r.doc_id, r.epoch, r.mix_block, r.text) for r in df.collect())
    assert key(corpus_pipeline.run(spark, sf)) == key(docs)


def test_empty_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    assert docs.count() == 0
