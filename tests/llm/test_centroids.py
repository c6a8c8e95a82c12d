import hashlib
import math

import numpy as np
import pytest

from tarnkappe.llm import centroids


def by_hand(rows, k=16, rounds=3, seed=1, dims=64, scale=64):
    """Plain integers, no arrays."""
    kept = []
    for vec_id, e in rows:
        if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e):
            kept.append((vec_id, [math.floor(scale * float(np.float32(x))) for x in e]))
    hashed = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    cs = [v for _, v in hashed[:k]]
    if not cs:
        return []
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def assign():
        return [min(range(len(cs)), key=lambda c: (square(v, cs[c]), c)) for _, v in kept]

    for _ in range(rounds):
        own = assign()
        for c in set(own):
            mine = [v for (_, v), o in zip(kept, own) if o == c]
            cs[c] = [sum(col) // len(mine) for col in zip(*mine)]
    own = assign()
    dist = [square(v, cs[o]) for (_, v), o in zip(kept, own)]
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return [(i, o, d, sum(x for x, p in zip(dist, own) if p == o), sum(dist), name[o]) for (i, _), o, d in zip(kept, own, dist)]


def vectors(n=300, seed=3):
    r = np.random.default_rng(seed)
    rows = [(int(i), [float(np.float32(x)) for x in v]) for i, v in enumerate(r.normal(0, 0.125, (n, 64)))]
    rows += [(i + 1000, rows[i % 7][1]) for i in range(60)]  # repeated vectors, so that starts and distances tie
    rows += [(5, rows[5][1]), (5, rows[9][1]), (None, rows[3][1]), (None, None), (2001, None), (2002, []), (2003, [0.5] * 63), (2004, [0.5] * 65)]
    rows += [(2005, [None] + [0.1] * 63), (2006, [float("nan")] + [0.1] * 63), (2007, [float("inf")] + [0.1] * 63), (2008, [-0.0] * 64), (2009, [0.0] * 64), (2010, [1000.5, -1000.5] * 32)]
    return rows


SCHEMA = "vec_id long, embedding array<float>"


def test_equals_plain_integers(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as cluster", "'x' as distance", "2 as rank").repartition(5)
    got = sorted(map(tuple, centroids.cluster_query(df).collect()), key=str)
    assert got == sorted(by_hand(rows), key=str)


def test_few_rows_and_none(spark):
    for rows in ([], [(1, None)], [(1, [0.25] * 64)], [(1, [0.25] * 64), (1, [0.25] * 64), (2, [-0.3] * 64)], [(None, [0.25] * 64)]):
        got = sorted(map(tuple, centroids.cluster_query(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
        assert got == sorted(by_hand(rows), key=str)


def test_parameters_and_doubles(spark):
    rows = [(i, [i / 3, -i / 7, (i % 4) / 9]) for i in range(40)]
    got, cs = centroids.clustered(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5, rounds=2, seed=9, dims=3, scale=100)
    exact = [(i, [math.floor(100 * x) for x in e]) for i, e in rows]
    hashed = sorted((hashlib.sha256(f"9:{i}".encode()).hexdigest(), v) for i, v in exact)
    want = [v for _, v in hashed[:5]]
    for _ in range(2):
        own = [min(range(5), key=lambda c: (sum((x - y) ** 2 for x, y in zip(v, want[c])), c)) for _, v in exact]
        want = [[sum(col) // own.count(c) for col in zip(*[v for (_, v), o in zip(exact, own) if o == c])] if c in own else want[c] for c in range(5)]
    assert cs.tolist() == want and got.count() == 40


@pytest.mark.parametrize("size", [9, 3_000, 2**23, 2**27 - 1])
def test_intervals_never_lose_the_nearest(size):
    """Near ties of vectors of any size: found as the integers say, and few distances are computed exactly."""
    r = np.random.default_rng(size)
    c = r.integers(-size, size, (16, 64))
    c[7] = c[3]
    c[9] = c[4] + 1
    middle = (c[r.integers(0, 16, 500)] + c[r.integers(0, 16, 500)]) // 2 + r.integers(-1, 2, (500, 64))
    x = np.clip(np.concatenate([r.integers(-size, size, (500, 64)), middle, c]), -size, size)
    got, exact = centroids.nearest(x, c)
    want = [min(range(16), key=lambda k: (sum((int(a) - int(b)) ** 2 for a, b in zip(v, c[k])), k)) for v in x]
    assert got.tolist() == want
    assert exact < len(x) * 16 / 2


def test_large_components_are_refused(spark):
    df = spark.createDataFrame([(1, [2.0**22] * 64)], SCHEMA)
    with pytest.raises(Exception, match="may not fit"):
        centroids.cluster_query(df).collect()
