import numpy as np
from pyspark.sql import functions as F

from tarnkappe.llm import forest


def exact(ids, x, queries, k):
    out = {}
    for q in queries:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        best = np.lexsort((ids, d))[:k]
        out[q] = [(int(ids[i]), float(d[i])) for i in best if np.isfinite(d[i])]
    return out


def table(spark, x, more=()):
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    return spark.createDataFrame([*rows, *more], "vec_id long, embedding array<float>").selectExpr("*", "1 as block", "2 as id")


def test_recall_without_structure(spark, monkeypatch):
    monkeypatch.setattr(forest, "SHARD", 1500)
    x = np.random.default_rng(0).normal(size=(4000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = forest.nearest(table(spark, x), F.col("vec_id") % 100 == 0).collect()
    want = exact(np.arange(4000), x.astype(np.float64), range(0, 4000, 100), 10)
    assert len(got) == 400 and sorted(r["rank"] for r in got) == sorted([*range(1, 11)] * 40)
    hits = sum((r.vec_id in {v for v, _ in want[r.query_id]}) for r in got)
    assert hits / 400 >= 0.9
    for r in got:
        assert abs(r.score - np.sqrt(((x[r.vec_id].astype(float) - x[r.query_id]) ** 2).sum())) < 1e-12


def test_a_small_shard_goes_through_the_trees():
    x = np.random.default_rng(4).normal(size=(500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    f = forest.Forest(x, forest.TREES, forest.BITS)
    want = exact(np.arange(500), x, range(0, 500, 5), 10)
    looked, hits = 0, 0
    for q, places in zip(want, f.candidates(x[::5], int(forest.PART * 500) + forest.TREES, 200)):
        looked += len(places)
        hits += sum(v in set(places.tolist()) for v, _ in want[q])
    assert looked < 0.9 * 500 * len(want) and hits / (10 * len(want)) >= 0.92


def test_odd_rows(spark):
    x = np.random.default_rng(1).normal(size=(30, 4)).astype(np.float32)
    more = [(100, None), (101, []), (102, [0.0] * 4), (103, [1.0, None, 0.0, 0.0]), (104, [1.0, float("nan"), 0.0, 0.0]), (105, [float("inf")] * 4), (None, [1.0] * 4), (200, [1.0, 2.0]), (201, [1.0, 3.0]), (7, [float(v) for v in x[7]]), (300, [float(v) for v in x[5]])]
    got = forest.nearest(table(spark, x, more), (F.col("vec_id") % 10 == 0) | (F.col("vec_id") > 99)).orderBy("query_id", "rank").collect()
    ids, all_x = np.append(np.arange(30), 300), np.vstack([x, x[5:6]]).astype(np.float64)
    want = exact(ids, all_x, [0, 10, 20, 300], 10)
    assert {q: [r.vec_id for r in got if r.query_id == q] for q in want} == {q: [v for v, _ in w] for q, w in want.items()}
    assert [(r.query_id, r.vec_id, r.score) for r in got if r.query_id in (200, 201)] == [(200, 201, 1.0), (201, 200, 1.0)]
    assert {r.query_id for r in got} == {0, 10, 20, 200, 201, 300}
    assert forest.nearest(table(spark, x).limit(0), F.lit(True)).count() == 0
