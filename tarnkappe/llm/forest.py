"""Approximate nearest neighbours by a hash-prefix forest (operator 1).

A tree is a sorted array of long hash strings, one bit for each random direction. A query goes down all trees to its
longest prefix matches, whose length varies with the data, and then up in all trees at once, one bit at a time, until
the entries that share the prefix are as many as a given part of the vectors. These candidates get exact distances.

The vectors are dealt out by a hash of their id into shards of bounded size. Each shard is one task, which builds its
forest once and lets the queries, a stated set that goes to every shard, stream past it in batches. A shard returns its
nearest for each query and the nearest of these are kept, so no task holds more than a shard and a batch, and no vector
is in a hot one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Trees, bits of a hash string, and how many entries to look at, as a part of the vectors. Vectors without any structure, as in high
#: dimensions at random, need this much for a recall above 0.9; in clustered ones the prefixes find it sooner.
TREES, BITS, PART = 48, 32, 1.0
SHARD = 8192


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite, not all zero."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~odd & F.exists(vector, lambda x: x != 0)


class Forest:
    """The trees of one shard."""

    def __init__(self, vectors: np.ndarray, trees: int, bits: int, seed: int = 1):
        self.vectors, self.trees, self.bits = vectors, trees, bits
        self.middle = vectors.mean(axis=0)
        self.directions = np.random.default_rng(seed).normal(size=(vectors.shape[1], trees * bits)).astype(np.float32)
        strings = self.strings(vectors)
        self.order = np.argsort(strings, axis=1, kind="stable")
        self.sorted = np.take_along_axis(strings, self.order, 1)

    def strings(self, vectors: np.ndarray) -> np.ndarray:
        """Hash strings as integers, a row for each tree; the first bit is the highest."""
        out = np.zeros((self.trees, len(vectors)), np.uint64)
        for i in range(0, len(vectors), 1024):
            above = ((vectors[i : i + 1024] - self.middle).astype(np.float32) @ self.directions > 0).reshape(-1, self.trees, self.bits)
            for b in range(self.bits):
                out[:, i : i + 1024] |= above[:, :, b].T.astype(np.uint64) << np.uint64(self.bits - 1 - b)
        return out

    def candidates(self, queries: np.ndarray, least: int, distinct: int):
        """For each query the places of its candidates: at the longest prefix that at least ``least`` entries of all trees
        share, or a shorter one until they are ``distinct`` different vectors, or all."""
        strings = self.strings(queries)
        n = len(queries)
        reached = np.zeros(n, np.int64)
        spans: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros((n, self.trees), np.int64), np.full((n, self.trees), len(self.vectors)))] * (self.bits + 1)
        open_ = np.ones(n, bool)
        for length in range(self.bits, 0, -1):  # up in all trees at once
            spans[length] = self._spans(strings, length)
            enough = open_ & ((spans[length][1] - spans[length][0]).sum(axis=1) >= least)
            reached[enough] = length
            open_ &= ~enough
            if not open_.any():
                break
        seen = np.zeros(len(self.vectors), bool)
        for q in range(n):
            seen[:] = False
            for length in range(reached[q], -1, -1):
                begin, end = spans[length] if length == 0 or length == reached[q] else self._spans(strings[:, q : q + 1], length)
                row = q if len(begin) == n else 0
                for t in range(self.trees):
                    seen[self.order[t, begin[row, t] : end[row, t]]] = True
                if np.count_nonzero(seen) >= distinct:
                    break
            yield np.flatnonzero(seen)

    def _spans(self, strings: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """In each tree, from where to where the entries share the first ``length`` bits of the strings."""
        rest = np.uint64(self.bits - length)
        first = (strings >> rest) << rest
        last = first + (np.uint64(1) << rest) - np.uint64(1)
        low = np.stack([np.searchsorted(t, f, "left") for t, f in zip(self.sorted, first)], 1)
        return low, np.stack([np.searchsorted(t, f, "right") for t, f in zip(self.sorted, last)], 1)


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of equal length as rows of doubles."""
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _search(k: int, trees: int, bits: int, part: float):
    """For mapInArrow: rows of a shard (dim, asks, id, vector), vectors of the index first, then queries."""
    names, types = ["query_id", "vec_id", "score"], [pa.int64(), pa.int64(), pa.float64()]

    def answers(forest: Forest, ids: np.ndarray, asked: np.ndarray, points: np.ndarray) -> pa.RecordBatch:
        least = math.ceil(part * len(ids)) + trees  # the query is in each tree
        found: list[list] = [[], [], []]
        for q, point, places in zip(asked, points, forest.candidates(points, least, min(len(ids), 20 * k))):
            places = places[ids[places] != q]
            away = forest.vectors[places] - point
            score = np.sqrt(np.einsum("nd,nd->n", away, away))
            best = np.lexsort((ids[places], score))[:k]
            found[0] += [q] * len(best)
            found[1] += ids[places[best]].tolist()
            found[2] += score[best].tolist()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, forest, at = [], None, None
        for batch in batches:
            dims, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            turns = np.flatnonzero((dims[1:] != dims[:-1]) | (asks[1:] != asks[:-1])) + 1
            for first, end in zip([0, *turns], [*turns, batch.num_rows]):
                if first == end:
                    continue
                rows = batch.slice(first, end - first)
                if dims[first] != at:
                    index, forest, at = [], None, dims[first]
                ids, vectors = rows.column(2).to_numpy(), _matrix(rows.column(3))
                if not asks[first]:
                    index.append((ids, vectors))
                    continue
                if index and forest is None:
                    held = np.concatenate([i for i, _ in index])
                    forest, index = Forest(np.concatenate([v for _, v in index]), trees, bits), []
                if forest is not None:
                    yield answers(forest, held, ids, vectors)

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = TREES, bits: int = BITS, part: float = PART) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each query among all vectors but those of its own id.

    Distances are Euclidean, of doubles; ties go to the smaller id; a query gets fewer if there are fewer candidates.
    Vectors that are null, empty, zero or hold null or non-finite components, and rows without id, take no part. Vectors
    meet only those of their own dimension. Rows that repeat an id count once, the first by its components, as query
    too. Other columns are ignored; an empty table gives no rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("raw"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("raw"))).select("id", F.col("raw").cast("array<double>").alias("vector"), F.size("raw").alias("dim"), "asks")
    index = rows.groupBy("dim", "id").agg(F.min("vector").alias("vector"))
    queries = rows.filter("asks").groupBy("dim", "id").agg(F.min("vector").alias("vector"))
    shards = max(1, -(-rows.count() // SHARD))
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    index = index.select("dim", F.lit(False).alias("asks"), "id", "vector", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"))
    both = index.unionByName(queries.select("dim", F.lit(True).alias("asks"), "id", "vector", every.alias("shard")))
    dealt = both.repartitionById(shards, F.col("shard")).sortWithinPartitions("dim", "asks", "id").drop("shard")
    found = dealt.mapInArrow(_search(k, trees, bits, part), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def forest_query(vectors: DataFrame) -> DataFrame:
    return nearest(vectors, F.col("vec_id") % 100 == 0)
