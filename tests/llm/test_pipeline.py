import hashlib

from pyspark.sql import functions as F

import corpus_pipeline
from tagbill.llm import packing, quality_rules, secrets, simhash, toxicity
from tagbill.llm.common import held_out, load


def digest(rows):
    return sorted((str(r.doc_id), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in rows)


def test_each_stage_on_its_own_input(spark, sf, tmp_path):
    docs = load(spark, sf, "documents")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "simhash_near_dedup", "secret_scan", "packing"]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{i}")
        after = spark.read.parquet(f"{tmp_path}/{i}")
        before = docs.collect()
        if i < 4:
            assert after.columns == columns
        rows = after.collect()
        if name == "quality_rules":
            kept = {r.doc_id for r in quality_rules.judge(docs).collect() if r.kept}
            assert digest(rows) == digest(r for r in before if r.doc_id in kept) and 0 < len(rows) < len(before)
        elif name == "toxicity":
            scores = toxicity.toxicity(docs, load(spark, sf, "labels"), held_out(F.col("doc_id"), 5, 0)).collect()
            low = {r.doc_id for r in scores if r.score < 0.5}
            assert digest(rows) == digest(r for r in before if r.doc_id in low)
        elif name == "simhash_near_dedup":
            names = {r.component_id for r in simhash.near_duplicates(docs).collect()}
            assert digest(rows) == digest(r for r in before if r.doc_id in names)
        elif name == "secret_scan":
            assert {r.doc_id for r in rows} == {r.doc_id for r in before}
            spans = {r.doc_id: [*r.base, *r.added] for r in secrets.scan(docs).collect()}
            texts = {r.doc_id: r.text for r in before}
            for r in rows:
                assert (r.text == texts[r.doc_id]) == (not spans[r.doc_id])
                assert all(texts[r.doc_id][s.start:s.end] not in r.text for s in spans[r.doc_id])
        else:
            assert len(rows) == packing.pack(docs).count() and {r.doc_id for r in rows} == {r.doc_id for r in before}
        docs = after


def test_run_packs_what_the_stages_keep(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows and set(corpus_pipeline.run(spark, sf).columns) == {"doc_id", "piece", "start", "n_tokens", "bucket", "batch", "slot"}
    assert {r.doc_id for r in rows} < {r.doc_id for r in load(spark, sf, "documents").collect()}
