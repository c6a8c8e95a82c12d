"""Centroid clustering of integer vectors, exact in every assignment (operator 12).

A fast float32 product of vectors and centroids gives each distance up to an error that has a proven bound, so it is an
interval. Centroids whose interval begins above the lowest end of any can't be nearest. Where one is left it is the
nearest; where intervals overlap, the distances of those that are left are computed in integers, and of equal ones the
lowest number wins. Partitions add up their vectors by cluster in integers, so means don't depend on order or split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnkappe.session import written

#: Integers of a component are below this, so that squared distances of up to 64 components fit a long.
MOST = 1 << 27
#: Distances held at once, in a piece of a batch.
PIECE = 1 << 22


def _integers(batch: pa.RecordBatch, dims: int, scale: int) -> tuple[pa.Array, np.ndarray]:
    """Ids and integer vectors (n, dims) of the rows with ``dims`` components, none of them null, NaN or infinite."""
    ids, column = batch.column(0), batch.column(1)
    right = pc.fill_null(pc.equal(pc.list_value_length(column), dims), False)
    ids, column = ids.filter(right), column.filter(right)
    x = pc.list_flatten(column).cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)  # nulls become NaN
    finite = np.isfinite(x).all(axis=1)
    if not finite.all():
        ids, x = ids.filter(pa.array(finite)), x[finite]
    with np.errstate(over="ignore"):
        x = np.floor(x * scale)
    if x.size and not np.abs(x).max() < MOST:
        raise ValueError(f"a component times {scale} isn't below {MOST}: its squared distances may not fit a long")
    return ids, x.astype(np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, int]:
    """Number of each vector's nearest centroid, the lowest of equal ones, and how many distances were computed exactly.

    With unit roundoff u = 2**-24, a float32 product of d components, whose two factors were rounded to float32 before,
    is off by at most g * |x| * |c| for g = (d + 2) * u / (1 - (d + 2) * u), in whatever order it is summed. Integers
    leave no room for underflow, and ``MOST`` none for overflow. A vector's own square is the same for all centroids and
    left out, those of the centroids are exact in integers.
    """
    d, k = x.shape[1], len(centroids)
    g = (d + 2) * 2.0**-24 / (1 - (d + 2) * 2.0**-24)
    up = 1 + 2.0**-40  # outweighs the rounding of the bounds themselves, which are sums of d doubles
    squares = (centroids * centroids).sum(axis=1).astype(np.float64)
    lengths = np.sqrt((centroids.astype(np.float64) ** 2).sum(axis=1)) * up
    turned = np.ascontiguousarray(centroids.astype(np.float32).T)
    out, exact = np.zeros(len(x), np.int64), 0
    for at in range(0, len(x), max(1, PIECE // k)):
        part = x[at : at + max(1, PIECE // k)]
        dot = (part.astype(np.float32) @ turned).astype(np.float64)
        score = squares - 2 * dot
        own = np.sqrt((part.astype(np.float64) ** 2).sum(axis=1)) * up
        error = (2 * g * own[:, None] * lengths + 2.0**-50 * (squares + 2 * np.abs(dot) + 1)) * up
        left = score - error <= (score + error).min(axis=1)[:, None]
        found = left.argmax(axis=1)
        several = np.flatnonzero(left.sum(axis=1) > 1)
        if len(several):
            row, number = np.nonzero(left[several])
            gap = part[several[row]] - centroids[number]
            distance = np.full((len(several), k), np.iinfo(np.int64).max)
            distance[row, number] = (gap * gap).sum(axis=1)
            found[several] = distance.argmin(axis=1)  # the first of equal ones
            exact += len(row)
        out[at : at + len(part)] = found
    return out, exact


def _starts(vectors: DataFrame, k: int, seed: int, dims: int, scale: int) -> np.ndarray:
    """The integer vectors of the k kept rows whose ids have the smallest hashes; of equal ids the smaller vector first."""
    inf = float("inf")
    embedding = F.col("embedding")
    kept = F.col("vec_id").isNotNull() & F.coalesce(F.size(embedding) == dims, F.lit(False))
    finite = F.forall(embedding, lambda x: F.coalesce(F.abs(x.cast("double")) < inf, F.lit(False)))
    rank: Column = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    whole = F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = vectors.filter(kept).filter(finite).select(rank.alias("rank"), whole.alias("whole")).orderBy("rank", "whole").limit(k).collect()
    return np.array([r.whole for r in rows], np.int64).reshape(-1, dims)


def _sums(vectors: DataFrame, centroids: np.ndarray, dims: int, scale: int) -> dict[int, tuple[int, list[int]]]:
    """How many vectors each centroid is nearest to, and their sum: at most a row for each centroid comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            _, x = _integers(batch, dims, scale)
            if not len(x):
                continue
            number, _ = nearest(x, centroids)
            order = np.argsort(number, kind="stable")
            first = np.flatnonzero(np.diff(number[order], prepend=-1))
            which = number[order][first]
            total[which] += np.add.reduceat(x[order], first, axis=0)
            count[which] += np.diff(first, append=len(x))
        some = np.flatnonzero(count)
        if len(some):
            sums = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * dims, pa.int32()), pa.array(total[some].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(count[some]), sums], ["cluster", "n", "sums"])

    parts = vectors.mapInArrow(run, "cluster int, n long, sums array<long>")
    exact = "decimal(38,0)"
    # a partition has at most k * dims sums, however many vectors it holds
    each = parts.select("cluster", F.col("n").cast(exact).alias("n"), F.posexplode("sums").alias("i", "sum")).withColumn("sum", F.col("sum").cast(exact))
    once = each.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"))
    found: dict[int, tuple[int, list[int]]] = {}
    for r in once.orderBy("cluster", "i").collect():
        found.setdefault(r.cluster, (int(r.n), []))[1].append(int(r.sum))
    return found


def clustered(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, dims: int = 64, scale: int = 64) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every kept row of ``vectors`` (vec_id, embedding), and the final centroids (k, dims).

    A component x counts as the integer floor(``scale`` * x). Kept are vectors of exactly ``dims`` components, none null,
    NaN or infinite. The k of them with the smallest sha256 of ``seed:vec_id`` are the first centroids, in that order (of
    equal ids the smaller vector comes first; rows without vec_id are no starts, but are clustered); where fewer are
    kept, there are fewer centroids. Each round assigns every vector to the nearest centroid, of equal ones to the lowest
    number, and moves every centroid that has some to the floor of their exact mean. Repeated rows count each; distances
    are squared; other columns are ignored; a table without kept rows gives no rows. Components of 2**27 and more after
    scaling are refused. ``vectors`` is read ``rounds`` + 2 times.
    """
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    centroids = _starts(vectors, k, seed, dims, scale)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), centroids
    for _ in range(rounds):
        centroids = centroids.copy()
        for c, (n, sums) in _sums(vectors, centroids, dims, scale).items():
            centroids[c] = [s // n for s in sums]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = _integers(batch, dims, scale)
            number, _ = nearest(x, centroids)
            gap = x - centroids[number]
            yield pa.RecordBatch.from_arrays([ids, pa.array(number, pa.int32()), pa.array((gap * gap).sum(axis=1))], ["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(run, "vec_id long, cluster int, distance long"), centroids


def cluster_query(vectors: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector; facts of 16 clusters are broadcast."""
    spark = vectors.sparkSession
    rows, centroids = clustered(vectors)
    rows = written(rows, "clusters")
    sums = {r.cluster: int(r.sum) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum")).collect()}
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    facts = spark.createDataFrame([(c, n, sum(sums.values()), names[c]) for c, n in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
