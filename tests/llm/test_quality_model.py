import numpy as np
from edges import TEXTS, documents, nothing
from pyspark.sql import functions as F

from refreshgate.llm import quality_model as model
from refreshgate.llm.batches import id_remainder

SF = "/root/testdata/sf0.01"


def test_fit_is_the_direct_solution_and_separates(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    statistics = model.document_statistics(docs)
    taught = labels.where(id_remainder(F.col("doc_id"), 5) != 0).select("doc_id", F.col("quality").alias("label"))
    fitted = model.fit(statistics, taught, partitions=3)
    x = {r["doc_id"]: r["x"] for r in statistics.collect()}
    rows = [(np.array(x[r["doc_id"]]), r["label"]) for r in taught.collect()]
    z = model._features(fitted, np.stack([a for a, _ in rows]))
    y = np.array([b for _, b in rows], float)
    direct = np.linalg.solve(z.T @ z + 1e-3 * len(y) * np.eye(z.shape[1]), z.T @ y)
    assert np.allclose(direct, fitted.weights, atol=1e-6)
    assert (np.diff(fitted.steps[1]) >= 0).all()
    scores = {r["doc_id"]: r["score"] for r in model.score(statistics, fitted).collect()}
    assert len(scores) == docs.count() and all(0 <= s <= 1 for s in scores.values())
    held = [(scores[r["doc_id"]] >= 0.3, r["quality"] == 1) for r in labels.where(id_remainder(F.col("doc_id"), 5) == 0).collect()]
    assert np.mean([a == b for a, b in held]) > 0.95


def test_isotonic_against_all_means():
    rng = np.random.default_rng(1)
    n = rng.integers(1, 9, 12).astype(float)
    ones = np.floor(rng.uniform(size=12) * (n + 1))
    at, value = model.isotonic(np.arange(12.0), ones, n)
    total = np.array([[ones[a:b + 1].sum() / n[a:b + 1].sum() if b >= a else 0 for b in range(12)] for a in range(12)])
    best = [max(min(total[a][b] for b in range(k, 12)) for a in range(k + 1)) for k in range(12)]
    assert np.allclose(sorted(set(np.round(best, 9))), np.round(value, 9))


def test_statistics_are_finite():
    made = np.array([model.statistics_of(t or "") for t in TEXTS])
    assert made.shape[1] == len(model.STATISTICS) and np.isfinite(made).all()


def test_edges(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(4, 1), (5, None), (None, 0), (6, 0), (6, 0), (99, 1), (7, 5)], "doc_id long, label int")
    statistics = model.document_statistics(docs)
    for own in (labels, labels.where("false"), labels.where("label = 1")):
        found = model.score(statistics, model.fit(statistics, own, partitions=2)).collect()
        assert len(found) == docs.count() and all(0 <= r["score"] <= 1 for r in found)
    empty = model.document_statistics(nothing(spark))
    assert model.score(empty, model.fit(empty, labels)).count() == 0
