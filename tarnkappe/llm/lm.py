"""LM scoring with a log-bilinear neural model in numpy (operator 10).

Words are counted over all training documents. The model predicts the next of ``CLASSES`` classes from the two classes
before it: the most frequent words are classes of their own, all others fall into classes by their last letters, and the
end is one. Each of the two is looked up in a table of vectors and multiplied by a matrix of its own, the sum is
compared with a vector for every class. It learns by noise-contrastive estimation: every partition of the training
documents is one pass of its own, and the parameters are averaged by tokens. Scoring normalises: matrix products over
blocks of contexts give the log of the sum over all classes. A word in a class of several gets that class's probability
times its smoothed share in it, from its count; so every word of the corpus, however many there are, has its own
probability, and the probabilities of all words, known and unknown, sum up to one.

The counts of at most ``HEAD`` most frequent words go to the workers (a fixed number of pairs of integers). All rarer
words are looked up by a join on their hash, so nothing that grows with the corpus is broadcast or sent to the driver.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnkappe.session import new_folder, small_batches, written

CLASSES, DIM, NOISE, MINI, RATE, HEAD = 1024, 16, 24, 4096, 0.05, 32768
#: Classes of single words; then come classes by ending, the end, and as a context only the begin.
OWN = 640
END, BEGIN = CLASSES - 1, CLASSES


class _Codes(dict):
    """Numbers words in order of first sight."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _words(text: bytes | None) -> list[bytes]:
    """bytes.lower() turns A-Z only, bytes.split() cuts at the space and 9 to 13."""
    return (text or b"").lower().split()


def _hashes(words) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w, 42) for w in words], dtype=np.uint64).view(np.int64)


def _by_ending(words) -> np.ndarray:
    """The class of a word that has none of its own: by its last two bytes, and by being longer than these."""
    return np.array([OWN + zlib.crc32(w[-2:] + (b"+" if len(w) > 2 else b"")) % (END - OWN) for w in words], dtype=np.int64)


def count_words(texts: DataFrame, most: int = 400_000) -> DataFrame:
    """How often each word occurs in the binary column ``text``: h (hash of the word), k (its class by ending), c."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = _Codes(), np.zeros(0, np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(_hashes(codes)), pa.array(_by_ending(codes).astype(np.int32)), pa.array(counts)], ["h", "k", "c"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = np.fromiter(map(codes.__getitem__, _words(text)), np.int64)
                if len(found):
                    new = np.bincount(found, minlength=len(codes)) if len(found) * 8 > len(codes) else None
                    if len(counts) < len(codes):
                        counts = np.concatenate([counts, np.zeros(max(len(codes) - len(counts), len(counts)), np.int64)])
                    if new is not None:
                        counts[: len(new)] += new
                    else:
                        np.add.at(counts, found, 1)
                if len(codes) > most:
                    counts = counts[: len(codes)]
                    yield out()
                    codes, counts = _Codes(), np.zeros(0, np.int64)
        counts = counts[: len(codes)]
        yield out()

    return texts.mapInArrow(run, "h long, k int, c long").groupBy("h").agg(F.min("k").alias("k"), F.sum("c").alias("c"))


@dataclass
class Corpus:
    """What the workers know of the counts; of fixed size. Ends are tokens too."""

    head: np.ndarray  # hashes of the most frequent words, ascending
    head_counts: np.ndarray
    classes: np.ndarray  # of the head's words
    tokens: int
    distinct: int
    documents: int
    class_counts: np.ndarray
    class_sizes: np.ndarray  # different words in each class

    def class_logs(self) -> np.ndarray:
        """log10 of the smoothed size of the classes by ending: tokens, different words, one for all unseen; 0 for other classes."""
        logs = np.log10(self.class_counts + self.class_sizes + 1.0)
        logs[:OWN] = logs[END] = 0
        return logs


def gather(counts: DataFrame, documents: int) -> Corpus:
    # a histogram of the logarithms of counts, a few thousand bars at most, shows from which count on a word is in the head
    bar = F.floor(F.log2("c") * 64).cast("int")
    bars = {r.bar: r.n for r in counts.groupBy(bar.alias("bar")).agg(F.count("*").alias("n")).collect()}
    held, least = 0, None
    for b in sorted(bars, reverse=True):
        held += bars[b]
        if held > HEAD:
            break
        least = b
    top = sorted(counts.filter(bar >= least).collect(), key=lambda r: (-r.c, r.h)) if least is not None else []
    h, c = np.array([r.h for r in top], np.int64), np.array([r.c for r in top], np.int64)
    ending = np.array([r.k for r in top], np.int64)
    classes = np.where(np.arange(len(h)) < OWN, np.arange(len(h)), ending)
    by_class, sizes = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in counts.groupBy("k").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        by_class[r.k], sizes[r.k] = r.c, r.n
    words, distinct = int(by_class.sum()), int(sizes.sum())
    own = min(OWN, len(h))
    np.subtract.at(by_class, ending[:own], c[:own])
    np.subtract.at(sizes, ending[:own], 1)
    by_class[:own], sizes[:own] = c[:own], 1
    by_class[END] = documents
    order = np.argsort(h)
    return Corpus(h[order], c[order], classes[order], words + documents, distinct + min(1, documents), documents, by_class, sizes)


class _Batch:
    """The tokens of some texts: class and two classes before, for all in a row; ends included."""

    def __init__(self, corpus: Corpus, texts: list[bytes | None]):
        codes = _Codes()
        each = [np.fromiter(map(codes.__getitem__, _words(t)), np.int64) for t in texts]
        self.sizes = np.array([len(x) + 1 for x in each], np.int64)
        self.hashes = _hashes(codes)
        at = np.minimum(np.searchsorted(corpus.head, self.hashes), max(0, len(corpus.head) - 1))
        self.known = corpus.head[at] == self.hashes if len(corpus.head) else np.zeros(len(codes), bool)
        self.counts = np.where(self.known, corpus.head_counts[at] if len(corpus.head) else 0, 0)
        ending = _by_ending(codes)
        classes = np.append(np.where(self.known, corpus.classes[at], ending) if len(corpus.head) else ending, END)
        n = len(codes)
        self.words = np.concatenate([np.append(x, n) for x in each]) if each else np.zeros(0, np.int64)  # n is the end
        self.owner = np.repeat(np.arange(len(each)), self.sizes)
        self.now = classes[self.words]
        first = np.cumsum(self.sizes) - self.sizes
        self.one = np.concatenate([[BEGIN], self.now[:-1]])[: len(self.now)]
        self.one[first] = BEGIN
        self.two = np.concatenate([[BEGIN], self.one[:-1]])[: len(self.now)]
        self.two[first] = BEGIN

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, values, len(self.sizes))


class Model:
    """Parameters of the log-bilinear model, in one flat array so that they can be averaged."""

    SHAPES = {"seen": (CLASSES + 1, DIM), "one": (DIM, DIM), "two": (DIM, DIM), "out": (CLASSES, DIM), "bias": (CLASSES,)}

    def __init__(self, corpus: Corpus, flat: np.ndarray | None = None):
        share = (corpus.class_counts + 0.5) / (corpus.class_counts + 0.5).sum()
        self.log_noise = np.log(share).astype(np.float32)
        self.share = share
        if flat is None:
            r = np.random.default_rng(10)
            start = {"seen": r.normal(0, 0.3, self.SHAPES["seen"]), "one": np.eye(DIM), "two": np.eye(DIM) / 2, "out": r.normal(0, 0.05, self.SHAPES["out"]), "bias": np.log(share)}
            flat = np.concatenate([start[k].ravel() for k in self.SHAPES])
        self.flat = flat.astype(np.float32)
        at = 0
        for k, shape in self.SHAPES.items():
            n = math.prod(shape)
            setattr(self, k, self.flat[at : at + n].reshape(shape))
            at += n
        self.squares = np.full_like(self.flat, 1e-6)

    def context(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return self.seen[one] @ self.one + self.seen[two] @ self.two

    def learn(self, now: np.ndarray, one: np.ndarray, two: np.ndarray, r: np.random.Generator) -> None:
        """One step on a mini-batch, with noise words shared by all its tokens."""
        noise = np.searchsorted(np.cumsum(self.share), r.random(NOISE)).clip(0, CLASSES - 1)
        h, v1, v2 = self.context(one, two), self.seen[one], self.seen[two]
        shift = math.log(NOISE)
        good = np.einsum("nd,nd->n", h, self.out[now]) + self.bias[now] - self.log_noise[now] - shift
        bad = h @ self.out[noise].T + self.bias[noise] - self.log_noise[noise] - shift
        g = -1 / (1 + np.exp(np.clip(good, -60, 60)))
        b = 1 / (1 + np.exp(np.clip(-bad, -60, 60)))
        dh = g[:, None] * self.out[now] + b @ self.out[noise]
        scatter = lambda at, rows, n: np.stack([np.bincount(at, rows[:, d], n) for d in range(DIM)], 1)
        out, bias = scatter(now, g[:, None] * h, CLASSES), np.bincount(now, g, CLASSES)
        np.add.at(out, noise, b.T @ h)
        np.add.at(bias, noise, b.sum(0))
        seen = scatter(one, dh @ self.one.T, CLASSES + 1) + scatter(two, dh @ self.two.T, CLASSES + 1)
        parts = {"seen": seen, "one": v1.T @ dh, "two": v2.T @ dh, "out": out, "bias": bias}
        step = np.concatenate([parts[k].ravel() for k in self.SHAPES]).astype(np.float32) / len(now)
        self.squares += step * step
        self.flat -= RATE * step / np.sqrt(self.squares)

    def log_sum(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Natural log of the sum over all classes for each context."""
        out = np.empty(len(one), np.float32)
        for i in range(0, len(one), MINI):
            s = self.context(one[i : i + MINI], two[i : i + MINI]) @ self.out.T + self.bias
            top = s.max(axis=1)
            out[i : i + MINI] = np.log(np.exp(s - top[:, None]).sum(axis=1)) + top
        return out


def train(texts: DataFrame, corpus: Corpus) -> Model:
    """One pass of each partition over its texts, from the same start; the parameters averaged by tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, r, tokens = Model(corpus), np.random.default_rng(11), 0
        for batch in batches:
            b = _Batch(corpus, batch.column(0).to_pylist())
            order = r.permutation(len(b.now))
            for i in range(0, len(order), MINI):
                pick = order[i : i + MINI]
                model.learn(b.now[pick], b.one[pick], b.two[pick], r)
            tokens += len(order)
        if tokens:
            yield pa.RecordBatch.from_arrays([pa.array([model.flat.astype(np.float64) * tokens]), pa.array([tokens])], ["v", "n"])

    passes = texts.mapInArrow(run, "v array<double>, n long").select("n", F.posexplode("v").alias("i", "v"))
    sums = passes.groupBy("i").agg((F.sum("v") / F.sum("n")).alias("v")).collect()
    model = Model(corpus)
    return Model(corpus, np.array([r.v for r in sorted(sums)], np.float32)) if sums else model


SCALARS = "row long, doc_id long, held_out boolean, n_tokens long, known long, logs double, model double, other_logs double, hashes array<long>, counts array<int>"


def _score(corpus: Corpus, flat: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(corpus, flat)
        sums = np.full((CLASSES + 1) ** 2, np.nan, np.float32)
        end_log, class_logs = math.log10(corpus.documents + 1), corpus.class_logs()
        for batch in batches:
            b = _Batch(corpus, batch.column(3).to_pylist())
            context = b.one * (CLASSES + 1) + b.two
            new = np.unique(context)
            new = new[np.isnan(sums[new])]
            sums[new] = model.log_sum(new // (CLASSES + 1), new % (CLASSES + 1))
            at = np.empty(len(b.now), np.float32)
            for i in range(0, len(at), 1 << 16):
                s = slice(i, i + (1 << 16))
                at[s] = np.einsum("nd,nd->n", model.context(b.one[s], b.two[s]), model.out[b.now[s]])
            model_log = (at + model.bias[b.now] - sums[context]).astype(np.float64) / math.log(10)
            logs = np.append(np.log10(b.counts + 1.0), end_log)[b.words]
            known = np.append(b.known, corpus.documents > 0)[b.words]
            # words in classes of several: their share, as far as their counts are at hand
            shared = np.where((b.now >= OWN) & (b.now < END), logs, 0.0) - class_logs[b.now]
            # words that only the join knows: each once for each text, with its count
            rare = np.append(~b.known, False)[b.words]
            keys, n = np.unique(b.owner[rare] * (len(b.hashes) + 1) + b.words[rare], return_counts=True)
            of, word = keys // (len(b.hashes) + 1), keys % (len(b.hashes) + 1)
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(b.sizes)))]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(b.sizes)]
                + [pa.array(b.sums(known).astype(np.int64)), pa.array(b.sums(logs)), pa.array(b.sums(model_log)), pa.array(b.sums(shared))]
                + [pa.ListArray.from_arrays(ends, pa.array(b.hashes[word])), pa.ListArray.from_arrays(ends, pa.array(n.astype(np.int32)))],
                [x.split()[0] for x in SCALARS.split(", ")],
            )

    return run


def score(docs: DataFrame, held_out=None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    ``held_out`` is a condition on ``docs``; rows that meet it are scored but not learned from. Null texts are empty and
    have one token, the end; repeated rows are scored (and learned from) each; other columns are ignored; an empty table
    gives no rows; without a training row all words are unseen.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held_out = F.lit(False) if held_out is None else held_out
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    training = rows.filter(~F.col("held_out")).select("text")
    counts = written(count_words(training), "lm-counts")
    corpus = gather(counts, training.count())
    model = train(training, corpus)
    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")
    path = new_folder(spark, "lm-scores")
    numbered.mapInArrow(_score(corpus, model.flat), SCALARS).write.parquet(path)
    scored = spark.read.schema(SCALARS).parquet(path)
    rare = scored.select("row", F.explode(F.arrays_zip("hashes", "counts")).alias("x")).select("row", F.col("x.hashes").alias("h"), F.col("x.counts").alias("n"))
    found = rare.join(counts.drop("k"), "h").groupBy("row").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more_logs"))
    both = scored.drop("hashes", "counts").join(found, "row", "left").na.fill(0, ["more"]).na.fill(0.0, ["more_logs"])
    base = F.col("logs") + F.col("more_logs") - F.col("n_tokens") * F.lit(math.log10(corpus.tokens + corpus.distinct + 1))
    whole = F.col("model") + F.col("other_logs") + F.col("more_logs")
    return both.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.col("more")).alias("n_known"), F.lit(corpus.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), whole.alias("score"))


def lm_query(docs: DataFrame) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    return score(docs, fold == 2)
