import numpy as np
import pytest
from pyspark.sql import functions as F

from refreshgate.llm import top_k

SCHEMA = "vec_id long, embedding array<double>, score string, rank string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "s", "r") for i, v in rows], SCHEMA)


def brute(rows, asked, k):
    def whole(v):
        return v is not None and all(x is not None and np.isfinite(x) for x in v)

    ints = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if i is not None and whole(v)]
    out = []
    for q, v in sorted({i: min(w for j, w in ints if j == i) for i, _ in ints if i in asked}.items()):
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in ints if i != q))[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    return out


@pytest.mark.parametrize("case", ["random", "clusters", "ties", "few", "ragged", "large"])
def test_against_brute_force(spark, case):
    rng = np.random.default_rng(3)
    if case == "clusters":
        centres = rng.normal(size=(6, 8))
        rows = [(i, centres[i % 6] * rng.uniform(0.2, 3) + rng.normal(size=8) * 0.02) for i in range(500)]
    elif case == "ties":
        rows = [(i, [0.5, 0.25]) for i in range(300)] + [(300 + i, rng.normal(size=2)) for i in range(50)]
    elif case == "few":
        rows = [(20, [1, 2]), (21, [0, 0]), (22, [-1, 1]), (23, None), (24, [1, None]), (25, [float("nan"), 1]), (26, [float("inf"), 0]),
                (None, [1, 1]), (21, [3, 3]), (40, []), (60, None)]
    elif case == "ragged":
        rows = [(i, rng.normal(size=rng.integers(0, 6))) for i in range(120)]
    elif case == "large":
        rows = [(20, [1, 0]), (1, [1e8, 1]), (2, [3e7, .1]), (3, [3e7, .1]), (40, [1e7, -1e7]), (4, [1e7 + 1, 1e7]), (5, [2e7, 0]), (60, [0, 1e-3]),
                (6, [0, 1e7]), (80, [-3e8, 2e8, 1]), (7, [2e8, 3e8]), (8, [2e8, 3e8, 1e8]), (9, [1e9, 1e9 - 0.25, 0.5]), (100, [0, 0, 0])]
        rows += [(1000 + i, rng.normal(size=3) * 10.0 ** rng.integers(-1, 7)) for i in range(300)]
    else:
        rows = [(i, rng.normal(size=12)) for i in range(700)]
    vectors = frame(spark, [(i, None if v is None else list(v)) for i, v in rows])
    found = top_k.top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)
    assert dict(found.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
    asked = {i for i, _ in rows if i is not None and i % 20 == 0}
    assert sorted(tuple(r) for r in found.collect()) == brute(rows, asked, 20)


def test_empty(spark):
    vectors = frame(spark, [])
    assert top_k.top_k(vectors, vectors).count() == 0


def test_pruning_loses_nothing_and_prunes():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(8, 16))
    v = np.floor(64 * np.concatenate([c * rng.uniform(0.3, 2, (60, 1)) + rng.normal(size=(60, 16)) * 0.05 for c in centres]))
    lengths = np.sqrt((v * v).sum(1))
    order = np.argsort(-lengths)
    v, lengths = v[order], lengths[order]
    looked = 0
    for q in v[::7]:
        scores = v @ q
        for k in (1, 5, 20, 200):
            bound = np.sort(scores)[-k]
            rows = top_k.bucket_matches(q, float(bound), v, lengths, {})
            assert set(np.flatnonzero(scores >= bound)) <= set(rows)
            looked += len(rows)
    assert looked < 0.7 * len(v) * 4 * len(v[::7])


def test_scores_beyond_a_long(spark):
    vectors = frame(spark, [(0, [1, 0]), (1, [1e300, 5]), (2, [0, 1e300]), (3, [2, 2])])
    with pytest.raises(Exception, match="does not fit 64 bits"):
        top_k.top_k(vectors, vectors.where("vec_id = 0")).collect()
    # what does not come back may have any size
    found = top_k.top_k(frame(spark, [(0, [1, 0]), (1, [-1e300, 5]), (2, [0, 1e300]), (3, [2, 2])]), vectors.where("vec_id = 0"), k=2)
    assert sorted(map(tuple, found.collect())) == [(0, 1, 3, 8192), (0, 2, 2, 0)]
    with pytest.raises(Exception, match="beyond the range of a double"):
        top_k.top_k(frame(spark, [(0, [1, 0]), (1, [1e308, 5])]), vectors.where("vec_id = 0")).collect()
