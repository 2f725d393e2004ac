"""The pipeline against its stages done plainly, and its stages on odd rows."""

from __future__ import annotations

import corpus_pipeline
from tests.llm import brute
from trialbraid.llm import line_dedup, quality_lm
from trialbraid.llm.shared import stored


def test_stages_follow_their_plain_versions(spark, sf_dir, documents):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stored(stage(spark, docs, sf_dir))
        assert docs.columns == documents.columns
        after = {r.doc_id: r for r in docs.collect()}
        source = spark.createDataFrame(list(before.values()), documents.schema)
        if name == "quality_classifier":
            kept = quality_lm.classify_documents(source, labels).where("kept").collect()
            assert set(after) == {r.doc_id for r in kept}
        elif name == "line_dedup":
            cut = {r.doc_id: r.text for r in line_dedup.dedup_lines(source).where("NOT emptied").collect()}
            assert {d: r.text for d, r in after.items()} == cut
        elif name == "ngram_join":
            found = brute.components([(d, r.text) for d, r in before.items()])
            assert set(after) == {d for d, _, c in found if d == c}
        else:
            found = brute.contamination([(d, r.text) for d, r in before.items()], items)
            assert set(after) == {d for d, _, _, _, bad in found if not bad}
        if name != "line_dedup":
            assert all(before[d] == r for d, r in after.items())
    whole = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(whole) == set(after)


def test_stages_take_odd_rows(spark, sf_dir, odd, nothing, documents):
    for docs in (odd, nothing):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            if name != "sentencepiece":
                assert out.columns == docs.columns
            rows = out.collect()
            assert len(rows) <= docs.count()


def test_one_of_repeated_rows_stays(spark, sf_dir, odd):
    kept = dict(corpus_pipeline.STAGES)["ngram_join"](spark, odd, sf_dir)
    assert kept.where("doc_id = 1").count() == 1 and kept.where("doc_id = 2").count() == 0
    assert kept.where("doc_id IN (3, 4, 5)").count() == 3
