"""Empty side tables, null labels and null languages."""

from __future__ import annotations

from trialbraid.llm import decontaminate, language_id, quality_lm


def test_an_empty_benchmark_hits_nothing(spark, odd):
    empty = spark.createDataFrame([], "item_id bigint, text string")
    rows = decontaminate.decontaminate(odd, empty).collect()
    assert len(rows) == odd.count()
    assert all(r.n_hit == 0 and r.n_items == 0 and not r.contaminated for r in rows)
    assert decontaminate.drop_contaminated(odd, empty).count() == odd.count()


def test_a_passage_that_a_third_of_the_documents_share(spark):
    passage = " ".join(f"p{i}" for i in range(15))
    data = [(i, f"{i} a b {passage} c d" if i % 3 == 0 else f"own words of {i} " * 9) for i in range(90)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    items = spark.createDataFrame([(1, f"x y {passage}"), (None, passage)], "item_id bigint, text string")
    rows = {r.doc_id: r for r in decontaminate.decontaminate(docs, items).collect()}
    assert {d for d, r in rows.items() if r.contaminated} == {i for i in range(90) if i % 3 == 0}
    assert {(r.n_hit, tuple(r.item_ids)) for r in rows.values()} == {(15, ("1",)), (0, ())}


def test_labels_with_null_quality_trust_nothing(spark, odd):
    labels = spark.createDataFrame([(1, None), (2, None)], "doc_id bigint, quality int")
    rows = quality_lm.classify_documents(odd, labels).collect()
    assert len(rows) == odd.count()
    assert all(r.kept == (r.n_chars > 0) for r in rows)


def test_without_a_language_all_is_undetermined(spark, odd):
    docs = odd.selectExpr("doc_id", "text", "cast(NULL AS string) AS lang")
    found = language_id.predict_language(docs, language_id.training_sample(docs)).collect()
    assert len(found) == odd.count() and {r.lang_pred for r in found} == {"und"}
