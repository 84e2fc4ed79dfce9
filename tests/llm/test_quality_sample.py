"""The sample that the line CRF is trained on."""
from refreshgate.llm import quality_rules as rules

BAD, GOOD = "buy now | click # here !!", "a plain sentence stands here and goes on, number {}."


def test_repeated_rows_leave_both_labels(spark):
    rows = [(0, BAD)] * 60 + [(k, GOOD.format(k)) for k in range(1, 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k > 0)) for k in range(11)], "doc_id long, quality int")
    sample = rules.training_lines(docs, labels, 20, 1000)
    assert sorted(q for q, _ in sample) == [0] + [1] * 10
    kept = {r["doc_id"] for r in rules.judge(docs, rules.fit(docs, labels, max_docs=20)).collect() if r["content_share"] >= 0.5}
    assert kept == set(range(1, 11))


def test_one_id_with_many_texts(spark):
    rows = [(0, f"{BAD} {k}") for k in range(60)] + [(k, GOOD.format(k)) for k in range(1, 61)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k > 0)) for k in range(61)], "doc_id long, quality int")
    sample = [q for q, _ in rules.training_lines(docs, labels, 60 + 1, 1000)]
    assert len(sample) == 61 and 10 < sum(sample) < 50


def test_whole_texts(spark):
    docs = spark.createDataFrame([(k, "\n".join(GOOD.format(n) for n in range(90 + k))) for k in range(8)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(8)], "doc_id long, quality int")
    assert sorted(len(x) for _, x in rules.training_lines(docs, labels, 100, 10_000)) == list(range(90, 98))
    few = rules.training_lines(docs, labels, 100, 300)  # texts of either label until they have 150 lines
    assert sorted(q for q, _ in few) == [0, 0, 1, 1] and all(len(x) >= 90 for _, x in few)
