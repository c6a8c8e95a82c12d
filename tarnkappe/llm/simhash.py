"""Near-duplicates by SimHash fingerprints and an index in Gray order (operator 11).

Two fingerprints that differ in at most D bits agree in E of any D + E blocks of bits. So for each choice of E blocks
their bits are a top node of the index, in which no difference is allowed, and a pair meets under at least one of them:
nothing is lost, and E only says how fine the top nodes are. Below a top node fingerprints are ordered by the Gray rank
of their other bits, by which neighbours tend to share bits, in one range sort of all choices. Runs of a bounded number of
them are indexed: a node of the tree holds the bits that all below it share and its own parent doesn't have yet, and a
search adds up the differences on its way down and leaves a node, with all below it, as soon as they are more than D.
A top node that needs several runs compares these pairwise, those pairs left out whose shared bits differ too much.
Only links that join what wasn't joined yet leave a task: fewer than there are fingerprints, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnkappe.llm.common import by_key
from tarnkappe.llm.components import components
from tarnkappe.session import arrow_batches, written

#: Fingerprints of a run at least (if it holds whole top nodes) and at most; children of a tree's node; queries at once.
RUN, FAN, CHUNK = (512, 4096), 8, 256
#: Words of a shingle, the hash's seed, and hashes whose bits are counted at once.
WIDTH, SEED, COUNTED = 4, 42, 1 << 16


def fingerprint(text: bytes | None, width: int = WIDTH, seed: int = SEED) -> int:
    """The majority of each bit over the XXH64 hashes of all runs of ``width`` words, repeats included; 0 without words.

    A-Z count as a-z; words are cut at the space and the controls 9 to 13, and joined by one space. A bit is 1 if more
    than half of the hashes have it. Fewer words are one run.
    """
    words = (text or b"").lower().split()  # of bytes: lower() turns A-Z only, split() cuts at these six
    n = len(words) - width + 1
    if n <= 1:
        return xxhash.xxh64_intdigest(b" ".join(words), seed) if words else 0
    joined, lengths = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[:n].tolist(), ends[width - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, n, COUNTED):
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[at : at + COUNTED], ends[at : at + COUNTED])], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the Gray sequence, in which neighbours differ in one bit."""
    for shift in (1, 2, 4, 8, 16, 32):
        codes = codes ^ (codes >> np.uint64(shift))
    return codes


class GrayIndex:
    """A tree over codes in Gray order. A node has the bits that all codes below it share beyond those of its parent."""

    def __init__(self, codes: np.ndarray):
        level, both = [codes], [(codes, codes)]
        while len(level[-1]) > FAN:
            cuts = np.arange(0, len(level[-1]), FAN)
            every, some = np.bitwise_and.reduceat(both[-1][0], cuts), np.bitwise_or.reduceat(both[-1][1], cuts)
            both.append((every, some))
            level.append(every)
        shared = [~(every ^ some) for every, some in both]
        self.size = len(codes)
        #: From the top: patterns and masks of each level; the last level's are the codes.
        self.levels = []
        for i in reversed(range(len(level))):
            mask = shared[i] if i + 1 == len(level) else shared[i] & ~np.repeat(shared[i + 1], FAN)[: len(level[i])]
            self.levels.append((level[i], mask))

    def search(self, queries: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(number of the query, number of the code) of all pairs that differ in at most ``most`` bits."""
        top = len(self.levels[0][0])
        query, node = np.repeat(np.arange(len(queries)), top), np.tile(np.arange(top), len(queries))
        gone = np.zeros(len(query), np.uint8)
        for depth, (pattern, mask) in enumerate(self.levels):
            if depth:
                child = node[:, None] * FAN + np.arange(FAN)
                inside = child < len(pattern)
                query, gone, node = (np.broadcast_to(x[:, None], child.shape)[inside] for x in (query, gone, node))
                node = child[inside]
            gone = gone + np.bitwise_count((queries[query] ^ pattern[node]) & mask[node])
            near = gone <= most
            query, node, gone = query[near], node[near], gone[near]
        return query, node


def spanning(one: np.ndarray, other: np.ndarray | None, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) between codes of ``one`` (in Gray order), or of it and ``other``, enough to join all that are linked."""
    codes = one if other is None else np.concatenate([one, other])
    index, label, found = GrayIndex(one), np.arange(len(codes)), []
    asks, shift = (one, 0) if other is None else (other, len(one))
    for at in range(0, len(asks), CHUNK):
        a, b = index.search(asks[at : at + CHUNK], most)
        a = a + at + shift
        while True:
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            high, first = np.unique(np.maximum(x, y), return_index=True)
            found.append((codes[a[first]], codes[b[first]]))
            to = np.arange(len(codes))
            to[high] = np.minimum(x, y)[first]  # always to a smaller label, so this ends
            while (to[to] != to).any():
                to = to[to]
            label = to[label]
    none = np.zeros(0, np.uint64)
    return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (none, none)


def choices(count: int, most: int, run: int = RUN[1]) -> list[tuple[np.uint64, int]]:
    """(mask, number) of the top levels: all choices of E of ``most`` + E blocks.

    E is the least by which ``count`` even fingerprints leave a top node at most ``run``. Any E gives all pairs.
    """
    e = 1
    while e < 6 and count > run * 2 ** (64 * e // (most + e)):
        e += 1
    blocks = most + e
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [(np.uint64(sum(block[i] for i in some)), n) for n, some in enumerate(combinations(range(blocks), e))]


class _Runs:
    """Cuts rows in order of (choice, top, rank) into runs to search, and tells which top nodes may go on in other runs."""

    def __init__(self, least: int, most: int) -> None:
        self.least, self.most = least, most
        self.key, self.code = np.zeros((0, 2), np.int64), np.zeros(0, np.uint64)
        self.first: np.ndarray | None = None  # the partition's first top node, which may have begun in the one before
        self.cut: np.ndarray | None = None  # the top node that was cut last

    def add(self, key: np.ndarray, code: np.ndarray) -> None:
        self.key, self.code = np.concatenate([self.key, key]), np.concatenate([self.code, code])
        if self.first is None and len(key):
            self.first = key[0]

    def _length(self, done: bool) -> int:
        """Rows of the next run, 0 if more are needed to tell: whole top nodes, or ``most`` rows of a larger one."""
        n = len(self.key)
        ends = np.flatnonzero((self.key[1:] != self.key[:-1]).any(axis=1)) + 1
        ends = np.append(ends, n) if done else ends
        if not len(ends):
            return self.most if n >= self.most else 0
        if ends[0] > self.most:
            return self.most
        fit = ends[ends <= self.most]
        enough = fit[fit >= self.least]
        if len(enough):
            return int(enough[0])
        return int(fit[-1]) if done or n > self.most else 0

    def take(self, done: bool) -> Iterator[tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
        """(codes of a run, [(top node, its codes)] of the nodes in it that may have others elsewhere)."""
        while len(self.key) and (n := self._length(done)):
            key, code = self.key[:n], self.code[:n]
            whole = done if n == len(self.key) else bool((self.key[n] != key[-1]).any())
            self.key, self.code = self.key[n:], self.code[n:]
            split = [k for k in (self.first, self.cut) if k is not None]
            if not whole or (done and not len(self.key)):
                split.append(key[-1])
            self.cut = None if whole else key[-1]
            open_ = {tuple(k) for k in split}
            yield code, [(np.array(k), code[same]) for k in open_ if (same := (key == np.array(k)).all(axis=1)).any()]


def links(nodes: DataFrame, count: int, most: int = 4, run: tuple[int, int] = RUN) -> DataFrame:
    """(a, b): links between the ``count`` distinct fingerprints ``nodes`` (fp long), enough to join all that are linked.

    ``run`` says how many fingerprints are searched at once, at least (where these are whole top nodes) and at most.
    """
    spark, tops = nodes.sparkSession, choices(count, most, run[1])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = batch.column(0).to_numpy().view(np.uint64)
            for mask, number in tops:
                top, rank = (code & mask).view(np.int64), gray_rank(code & ~mask)
                ordered = (rank ^ np.uint64(1 << 63)).view(np.int64)  # longs in the order of unsigned numbers
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), number, np.int32)), pa.array(top), pa.array(ordered), batch.column(0)], ["choice", "top", "rank", "fp"])

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, rows, size = _Runs(*run), [], 0
        for batch in chain(batches, [None]):
            if batch is not None:
                runs.add(np.stack([batch.column(0).to_numpy().astype(np.int64), batch.column(1).to_numpy()], axis=1), batch.column(3).to_numpy().view(np.uint64))
            for codes, members in runs.take(batch is None):
                a, b = (x.view(np.int64) for x in spanning(codes, None, most))
                none = pa.nulls(len(a), pa.int64())
                rows.append(pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), none.cast(pa.int32()), none, none], NAMES))
                for key, own in members:
                    own, m = own.view(np.int64), len(own)
                    rows.append(pa.RecordBatch.from_arrays([pa.array(own), pa.nulls(m, pa.int64()), pa.array(np.full(m, key[0], np.int32)), pa.array(np.full(m, key[1])), pa.array(np.full(m, own[0]))], NAMES))
                size += sum(r.num_rows for r in rows[-1 - len(members) :])
                if size > 1 << 16:
                    yield from rows
                    rows, size = [], 0
        yield from rows

    total = count * len(tops)
    parts = max(-(-total // 2_000_000), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // 50_000)), 1)
    order = nodes.select("fp").mapInArrow(placed, "choice int, top long, rank long, fp long").repartitionByRange(parts, "choice", "top", "rank").sortWithinPartitions("choice", "top", "rank")
    found = written(order.mapInArrow(searched, "a long, b long, choice int, top long, run long"), "simhash-runs")
    inside = found.filter("choice is null").select("a", "b")

    # top nodes in several runs: a run to a row, and the bits that these share
    top = ["choice", "top"]
    runs = found.filter("choice is not null").groupBy(*top, "run").agg(F.collect_list("a").alias("codes"), F.bit_and("a").alias("every"), F.bit_or("a").alias("some"))
    runs = runs.withColumn("shared", F.bitwise_not(F.col("every").bitwiseXOR(F.col("some")))).drop("some")
    several = found.filter("choice is not null").groupBy(*top).agg(F.approx_count_distinct("run").alias("about"), (F.min("run") < F.max("run")).alias("more")).filter("more")
    # runs of a node that has many are dealt over as many places as the root of their number
    several = several.select(*top, F.ceil(F.sqrt("about")).cast("int").alias("places"))
    runs = written(runs.join(several, top), "simhash-open")
    one = runs.withColumn("place", F.pmod(F.xxhash64("run"), F.col("places")).cast("int"))
    two = runs.withColumn("place", F.explode(F.sequence(F.lit(0), F.col("places") - 1))).select(*top, "place", F.col("run").alias("r"), F.col("codes").alias("others"), F.col("every").alias("e"), F.col("shared").alias("s"))
    differ = F.bit_count(F.col("every").bitwiseXOR(F.col("e")).bitwiseAND(F.col("shared")).bitwiseAND(F.col("s")))
    pairs = one.join(two, [*top, "place"]).filter((F.col("run") < F.col("r")) & (differ <= most)).select("codes", "others")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for codes, others in zip(batch.column(0), batch.column(1)):
                one = codes.values.to_numpy().view(np.uint64)
                a, b = spanning(one[np.argsort(gray_rank(one))], others.values.to_numpy().view(np.uint64), most)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    with arrow_batches(spark, 64):
        return inside.unionByName(written(pairs.mapInArrow(across, "a long, b long"), "simhash-across"))


NAMES = ["a", "b", "choice", "top", "run"]


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.fromiter((fingerprint(t) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    with arrow_batches(docs.sparkSession, 512):
        return written(rows.mapInArrow(run, "doc_id long, fp long"), "simhash")


def near_duplicates(docs: DataFrame, most: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id of every row.

    Rows are linked if their fingerprints differ in at most ``most`` bits; component_id is the smallest doc_id that can be
    reached, its own included. Null texts and white space have the fingerprint zero and are linked like any other. Rows of
    one doc_id are judged each by its own text. Rows without doc_id have a fingerprint, are linked with nothing and have
    no component. Other columns are ignored; an empty table gives no rows.
    """
    rows = fingerprints(docs)
    nodes = written(rows.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "simhash-nodes")
    count, total = nodes.count(), rows.count()
    roots = components(links(nodes, count, most))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", "copies", F.coalesce("root", "fp").alias("root"))
    # components of more than one of 4096 fingerprints are few, and so are fingerprints of more than one of 4096 rows: these are broadcast
    sized = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    named = written(by_key(rooted, sized, "root", F.col("members") * 4096 > count).select("fp", "component_id", "copies"), "simhash-named")
    out = by_key(rows.filter("doc_id is not null"), named, "fp", F.col("copies") * 4096 > total).select("doc_id", "fp", "component_id")
    alone = rows.filter("doc_id is null").select("doc_id", "fp", F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(alone).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
