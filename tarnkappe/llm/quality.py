"""Quality classifier: a byte-level convolutional network in numpy (operator 9).

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. Bytes become small learned vectors, learned
filters run over them, each filter's largest answer in a chunk is kept (max pooling) and weighed into the chunk's logit.
The mean of the chunks' logits gives the document's probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnkappe.session import small_batches

CHUNK, STEP, STRIDE, WIDTH, DIM, FILTERS, PAD = 512, 448, 4, 8, 8, 24, 256
#: Chunks handled at once; their activations stay in cache.
BLOCK = 128


def chunks_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte chunks (padded by PAD) of all texts, and the text that each belongs to. An empty text is one chunk of padding."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    counts = np.maximum(1, -(-(sizes - (CHUNK - STEP)) // STEP))
    owner = np.repeat(np.arange(len(texts)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = (np.cumsum(sizes) - sizes)[owner] + nth * STEP
    left = sizes[owner] - nth * STEP
    data = np.concatenate([np.frombuffer(b"".join(texts), dtype=np.uint8).astype(np.int16), np.full(CHUNK, PAD, np.int16)])
    at = np.arange(CHUNK)
    out = data[np.minimum(begin[:, None] + at, len(data) - 1)]
    out[at >= left[:, None]] = PAD
    return out, owner


class Net:
    """Parameters and passes of the network."""

    NAMES = ("vectors", "filters", "bias", "weights", "offset")

    def __init__(self, seed: int = 9):
        r = np.random.default_rng(seed)
        self.vectors = r.normal(0, 0.5, (PAD + 1, DIM)).astype(np.float32)
        self.vectors[PAD] = 0
        self.filters = r.normal(0, (WIDTH * DIM) ** -0.5, (WIDTH * DIM, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.weights = r.normal(0, FILTERS**-0.5, FILTERS).astype(np.float32)
        self.offset = np.zeros(1, np.float32)

    def pooled(self, chunks: np.ndarray, places: bool = False):
        """Largest answer of each filter in each chunk, and where it is if asked for."""
        half = STRIDE * DIM
        v = self.vectors[chunks].reshape(len(chunks), CHUNK // STRIDE, half)
        answers = v[:, :-1] @ self.filters[:half]
        answers += v[:, 1:] @ self.filters[half:]
        if not places:
            return np.maximum(answers.max(axis=1) + self.bias, 0)
        where = answers.argmax(axis=1)
        return np.maximum(np.take_along_axis(answers, where[:, None], 1)[:, 0] + self.bias, 0), where

    def logits(self, chunks: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        each = np.concatenate([self.pooled(chunks[i : i + BLOCK]) @ self.weights for i in range(0, len(chunks), BLOCK)])
        return np.bincount(owner, each.astype(np.float64), n) / np.bincount(owner, minlength=n) + float(self.offset[0])

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        out, first = [], 0
        while first < len(texts):  # very long texts are taken by few at a time
            last, held = first + 1, len(texts[first])
            while last < len(texts) and held + len(texts[last]) < 2 << 20:
                held += len(texts[last])
                last += 1
            chunks, owner = chunks_of(texts[first:last])
            out.append(self.logits(chunks, owner, last - first))
            first = last
        return 1 / (1 + np.exp(-np.clip(np.concatenate(out), -500, 500)))

    def gradients(self, chunks: np.ndarray, owner: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        n = len(labels)
        pooled, where = zip(*[self.pooled(chunks[i : i + BLOCK], True) for i in range(0, len(chunks), BLOCK)])
        pooled, where = np.concatenate(pooled), np.concatenate(where)
        counts = np.bincount(owner, minlength=n)
        logit = np.bincount(owner, pooled @ self.weights, n) / counts + self.offset[0]
        error = ((1 / (1 + np.exp(-np.clip(logit, -500, 500))) - labels) / n).astype(np.float32)
        each = (error / counts)[owner].astype(np.float32)
        down = each[:, None] * self.weights * (pooled > 0)
        # only the windows that gave the largest answers matter
        window = chunks[np.arange(len(chunks))[:, None, None], (where * STRIDE)[:, :, None] + np.arange(WIDTH)]
        seen = self.vectors[window].reshape(len(chunks), FILTERS, WIDTH * DIM)
        back = (down[:, :, None] * self.filters.T).reshape(-1, DIM)
        flat = window.reshape(-1)
        vectors = np.stack([np.bincount(flat, back[:, d], PAD + 1) for d in range(DIM)], 1).astype(np.float32)
        vectors[PAD] = 0
        return {"vectors": vectors, "filters": np.einsum("cf,cfw->wf", down, seen), "bias": down.sum(0), "weights": each @ pooled, "offset": error.sum(keepdims=True)}


def train(texts: list[bytes], labels: list[int], epochs: int = 12, batch: int = 32, rate: float = 0.01, seed: int = 9) -> Net:
    """Fit by Adam; with one class only, or no rows, the net answers the smoothed share of label 1."""
    net, y, r = Net(seed), np.array(labels, dtype=np.float32), np.random.default_rng(seed)
    share = (y.sum() + 1) / (len(y) + 2)
    net.offset[0] = np.log(share / (1 - share))
    if len(set(labels)) < 2:
        net.weights[:] = 0
        return net
    moments = {k: [np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))] for k in Net.NAMES}
    steps, step = epochs * -(-len(texts) // batch), 0
    for _ in range(epochs):
        order = r.permutation(len(texts))
        for i in range(0, len(order), batch):
            pick = order[i : i + batch]
            chunks, owner = chunks_of([texts[j] for j in pick])
            step += 1
            for k, g in net.gradients(chunks, owner, y[pick]).items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                now = rate * (1 - step / (steps + 1))
                setattr(net, k, getattr(net, k) - (now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32))
    return net


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; the fold that rows are split by. Null ids have remainder 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(0))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 3000, longest: int = 200_000, held: int | None = 1, folds: int = 3, most: int = 64 << 20) -> Net:
    """Learn labels.quality from at most ``sample`` labelled rows of the folds other than ``held`` (of all, if None).

    The rows with the smallest hashes of ids are taken, whole texts of at most ``longest`` bytes each and as many as
    have ``most`` bytes together, so the driver holds a bounded part of the corpus. Labels of null are left out; of several labels of one document the larger counts.
    """
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    known = known if held is None else known.filter(remainder(F.col("doc_id"), folds) != held)
    known = known.groupBy(F.col("doc_id").alias("labelled")).agg(F.max("quality").cast("int").alias("label")).orderBy(F.xxhash64("labelled"), "labelled").limit(sample)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(F.octet_length("text") <= longest)
    taken = texts.join(F.broadcast(known), F.col("doc_id") == F.col("labelled")).orderBy("doc_id", "text").limit(sample)
    upto = F.sum(F.octet_length("text")).over(Window.orderBy("doc_id", "text").rowsBetween(Window.unboundedPreceding, 0))
    rows = taken.withColumn("upto", upto).filter(F.col("upto") <= most).select("text", "label").collect()
    return train([r.text.encode() for r in rows], [r.label for r in rows])


def score(net: Net):
    """A function of a text column: its probability of label 1. Null is the empty text; texts are scored whole."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(net.scores([(t or "").encode() for t in texts]))

    return run


def quality_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, repeated rows too; an empty table gives none."""
    small_batches(docs.sparkSession)
    net = fit(docs, labels)
    rows = docs.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), score(net)("text").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
