import corpus_pipeline
from edges import documents, nothing
from test_simhash import plain_classes

from refreshgate.llm import language_id, quality_rules

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    lettered = [r for r in rows if any(c.isalpha() for c in r["text"] or "")]
    first = corpus_pipeline.by_language(spark, docs, SF)
    assert first.columns == docs.columns
    kept = {r["doc_id"] for r in first.collect()}
    known = {r["doc_id"]: r["known"] for r in language_id.identify(docs, language_id.fit(docs)).collect()}
    assert kept == {r["doc_id"] for r in lettered if known[r["doc_id"]] >= 0.05 or len(r["text"]) < 20}

    second = corpus_pipeline.by_quality(spark, first, SF)
    assert second.columns == docs.columns
    crf = quality_rules.fit(first, spark.read.parquet(f"{SF}/labels.parquet"))
    want = set()
    for r in first.collect():
        counts = quality_rules.base_counts(r["text"])
        if not quality_rules.base_fails(counts[0], counts[4]) and quality_rules.content_shares(crf, [r["text"]])[0] >= 0.5:
            want.add(r["doc_id"])
    assert {r["doc_id"] for r in second.collect()} == want

    third = corpus_pipeline.near_dedup(spark, second, SF)
    assert third.columns == docs.columns
    ids = [r["doc_id"] for r in third.collect()]
    assert sorted(ids) == sorted({c for _, _, c in plain_classes([(r["doc_id"], r["text"]) for r in second.collect()])})
    assert {r["doc_id"] for r in corpus_pipeline.packed(spark, third, SF).collect()} == set(ids)


def test_whole_run(spark):
    found = corpus_pipeline.run(spark, SF).collect()
    assert found and {"doc_id", "sequence_id", "offset", "length"} <= set(found[0].asDict())


def test_clean_documents_stay(spark):
    """What the labels call good passes the filtering stages, but for what the base rules fail; labels that the CRF has not
    learnt from decide."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    crf = quality_rules.fit(docs, labels.where("doc_id % 2 = 0"))
    first = corpus_pipeline.by_language(spark, docs, SF)
    kept = {r["doc_id"] for r in quality_rules.keep_content(first, crf).collect()}
    good = docs.join(labels.where("quality = 1 AND doc_id % 2 = 1").select("doc_id"), "doc_id", "left_semi").collect()
    passing = [r for r in good if not quality_rules.base_fails(*(quality_rules.base_counts(r["text"] or "")[k] for k in (0, 4)))]
    assert len(passing) > 20 and sum(r["doc_id"] in kept for r in passing) >= 0.95 * len(passing)


def test_no_documents(spark):
    docs = nothing(spark)
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() == 0, name
    assert corpus_pipeline.packed(spark, docs, SF).count() == 0


def test_edge_rows_pass_through(spark):
    docs = documents(spark)
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        out.collect()
