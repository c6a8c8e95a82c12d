"""Near-duplicates by bottom-k sketches of one hash function (operator 2).

A document's sketch is the ``K`` smallest hashes of its shingles. Inverted lists of retained values give the overlaps:
two documents that are alike share at least ``_least_overlap`` retained values, so with values ordered from rare to
frequent they meet in a list of one of the first ``size - overlap + 1`` of each (the prefix), and frequent values are
left to the tail. A list's members are gathered under the member that shares most with others, so that the many lists of
one group of copies become one. Gatherings are compared in blocks of bounded size, each with that member in it, and only
what wasn't joined with it meets the other blocks. In a block the share of equal sketch values bounds the estimate from
the union's sketch and filters; 16 bits of each value do for that, since values that differ can only seem equal. The rest
is verified on full sets, made from the texts where they meet, and only links that join what wasn't joined yet leave the
task: fewer than there are members, never all pairs. Copies of one text are one row from the start.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnkappe.llm.common import WORD, by_key
from tarnkappe.llm.components import components
from tarnkappe.session import arrow_batches, dealt, deleted, released, written

K = 48
#: Members of a block, of those with sketches (of fixed size) and of those with full sets, and bytes of these at most.
SKETCHES, BLOCK, BLOCK_BYTES = 4096, 1024, 64 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _Hash(dict):
    """64-bit hash of a word, kept for the words of a batch."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Ascending distinct hashes of all runs of ``width`` words; of the whole sequence if it is shorter."""
    if not len(words):
        return words
    run = np.zeros(max(1, len(words) - width + 1), np.uint64)
    for i in range(min(width, len(words))):
        run = _mix(run * np.uint64(31) + words[i : i + len(run)] + np.uint64(i + 1))
    run.sort()
    keep = np.ones(len(run), bool)
    np.not_equal(run[1:], run[:-1], out=keep[1:])
    return run[keep]


def _sets(texts: list[bytes | None], width: int, hashes: _Hash) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word hashes and shingle set of each text; bytes.lower() turns A-Z only, bytes.split() cuts at the space and 9 to 13."""
    for text in texts:
        words = np.fromiter(map(hashes.__getitem__, (text or b"").lower().split()), np.uint64)
        yield words, shingles(words, width)


def least_equal(percent: int, k: int = K, loss: float = 1e-6) -> list[int]:
    """For 0 to ``k`` retained values, how many of them are shared by documents that are alike, but for the chance ``loss``.

    Of the smallest values of the union each is in both documents with a chance of at least ``percent``. Drawing is
    without return, so a binomial count is the worse case: the bound is its quantile.
    """
    p, out = percent / 100, []
    for m in range(k + 1):
        below, t = 0.0, 0
        while t < m and (below := below + math.comb(m, t) * p**t * (1 - p) ** (m - t)) <= loss:
            t += 1
        out.append(t)
    return out


def _least_overlap(n: Column, percent: int, k: int) -> Column:
    """Retained values that a document of ``n`` shingles shares with any that is alike.

    With at most k * percent / 100 shingles the partner's set is retained whole as well, and the bound is exact.
    """
    return F.when(n <= k * percent // 100, F.ceil(n * percent / 100)).otherwise(least_equal(percent, k)[k]).cast("int")


def sketched(docs: DataFrame, width: int, k: int = K, passing: list[str] | None = None) -> DataFrame:
    """row, doc_id, tie, h (hash of the words, the class of equal texts), n (shingles), bytes (of the text), sketch of every document, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hash()
        for batch in batches:
            h, n, ends, parts = [], [], [0], []
            for words, whole in _sets(batch.column(3).to_pylist(), width, hashes):
                h.append(xxhash.xxh3_64_intdigest(words.tobytes()))
                n.append(len(whole))
                parts.append(whole[:k])
                ends.append(ends[-1] + len(parts[-1]))
            flat = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
            sketch = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.array(h, np.uint64).view(np.int64)), pa.array(n, pa.int64()), pc.binary_length(batch.column(3)).cast(pa.int64()), sketch], ["row", "doc_id", "tie", "h", "n", "bytes", "sketch"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return written(rows.mapInArrow(run, "row long, doc_id long, tie long, h long, n long, bytes long, sketch array<long>"), "minhash", passing)


def classes(rows: DataFrame, passing: list[str] | None = None) -> DataFrame:
    """One row for each class of equal texts: h, c, n, sketch, the smallest (doc_id, tie), its bytes and how many rows there are; written.

    ``c`` numbers the classes. Numbers that lie side by side take up less than hashes do where rows are shuffled.
    """
    one = F.min(F.struct("doc_id", "tie", "n", "bytes", "sketch")).alias("one")
    found = rows.filter("n > 0").groupBy("h").agg(one, F.count("*").alias("copies"))
    return written(found.select("h", F.monotonically_increasing_id().alias("c"), "one.*", "copies"), "minhash-classes", passing)


def gatherings(found: DataFrame, percent: int, k: int = K) -> DataFrame:
    """(pivot, h): classes (c) that meet in lists, gathered under one of them; pivots are members of their own gatherings."""
    total, passing = found.count(), []
    # the number of retained values says all about n that is needed here, and takes up less than n where rows are shuffled
    values = found.select(F.col("c").alias("h"), F.size("sketch").cast("byte").alias("size"), F.explode("sketch").alias("v"))
    common = written(values.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1"), "minhash-values", passing)
    released(found.sparkSession)
    # at most 4096 * k values are in more than one of 4096 classes, so are at most 4096 * k lists
    shared = by_key(values, common, "v", F.col("df") * 4096 > total)
    mine = Window.partitionBy("h")
    size = F.col("size").cast("int")
    rare = size - F.count("*").over(mine)  # values of this document alone stand first
    place = rare + F.row_number().over(mine.orderBy("df", "v"))
    shared = shared.withColumn("place", place).withColumn("hub", F.sum(F.log("df")).over(mine))
    prefix = shared.filter(F.col("place") <= size - _least_overlap(size, percent, k) + 1).select("v", "h", "hub")
    lists = written(prefix, "minhash-lists", passing)
    released(found.sparkSession)
    best = F.max(F.struct("hub", "h"))
    pivots = written(lists.groupBy("v").agg(best["h"].alias("pivot"), F.count("*").alias("members")).filter("members > 1"), "minhash-pivots", passing)
    met = by_key(lists.select("v", "h"), pivots, "v", F.col("members") * 4096 > total)
    met = written(met.select("pivot", "h").distinct(), "minhash-gatherings")
    deleted(found.sparkSession, passing)
    return met


def _link(sets: list[np.ndarray], names: list[int], first: np.ndarray, percent: int, k: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links that join the members, and the group that each is in by these; pairs are verified unless both are joined already.

    ``first`` marks the members of one side; if there are two sides, pairs across count only. A member may be on both.
    """
    ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    sizes = np.diff(ends)
    kept = np.minimum(sizes, k)
    least = np.array(least_equal(percent, k))
    heads = np.concatenate([codes[a : a + m] for a, m in zip(ends, kept)])
    head_ends = np.concatenate([[0], np.cumsum(kept)])[:-1]
    group, mark, links = np.unique(names, return_inverse=True)[1], np.zeros(int(codes.max()) + 1, bool), []
    across = first.any() and not first.all()
    for i in range(len(sets)):
        others = (group != group[i]) & (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i]))
        if across:
            others &= first != first[i]
        others[: i + 1] = False
        if not others.any():
            continue
        own = codes[ends[i] : ends[i + 1]]
        mark[own[:k]] = True
        equal = np.add.reduceat(mark[heads], head_ends)
        mark[own[:k]] = False
        others &= equal >= least[np.minimum(kept, kept[i])]
        mark[own] = True
        for j in np.flatnonzero(others):
            if group[j] == group[i]:
                continue
            both = int(np.count_nonzero(mark[codes[ends[j] : ends[j + 1]]]))
            if 100 * both >= percent * (sizes[i] + sizes[j] - both):
                links.append((names[i], names[j]))
                group[group == group[j]] = group[i]
        mark[own] = False
    return links, group


def _partnered(sketches: list[np.ndarray], sizes: np.ndarray, names: np.ndarray, first: np.ndarray, percent: int, k: int) -> np.ndarray:
    """Which members have a partner, other than themselves, that they may be alike with, by size and equal sketch values."""
    kept = np.array([len(s) for s in sketches])
    codes = np.unique(np.concatenate(sketches), return_inverse=True)[1]
    ends = np.concatenate([[0], np.cumsum(kept)])
    least = np.array(least_equal(percent, k))
    mark, found = np.zeros(int(codes.max()) + 1, bool), np.zeros(len(sketches), bool)
    across = first.any() and not first.all()
    for i in range(len(sketches)):
        if found[i]:
            continue
        own = codes[ends[i] : ends[i + 1]]
        mark[own] = True
        equal = np.add.reduceat(mark[codes], ends[:-1])
        mark[own] = False
        partner = (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i])) & (equal >= least[np.minimum(kept, kept[i])])
        if across:
            partner &= first != first[i]
        partner &= names != names[i]
        found[i] = partner.any()
        found |= partner
    return found


def _placed(met: DataFrame, block: int, total: int) -> DataFrame:
    """(pivot, h, lead, block, blocks) of the members (pivot, h, bytes) of gatherings of two and more; lead is the pivot if it is among them, else the smallest.

    A gathering has as many blocks as its members need, by number and by bytes.
    """
    counts = met.groupBy("pivot").agg(F.count("*").alias("m"), F.sum("bytes").alias("all"), F.max(F.when(F.col("h") == F.col("pivot"), F.col("h"))).alias("own"), F.min("h").alias("least"))
    need = F.greatest(F.ceil(F.col("m") / block), F.ceil(F.col("all") / BLOCK_BYTES)).cast("int")
    counts = counts.filter("m > 1").select("pivot", F.coalesce("own", "least").alias("lead"), need.alias("blocks"), "m")
    placed = by_key(met.select("pivot", "h"), counts, "pivot", F.col("m") * 4096 > total)
    return placed.select("pivot", "h", "lead", "blocks", F.pmod(F.xxhash64("h", "pivot"), F.col("blocks")).cast("int").alias("block"))


def _compared(met: DataFrame, facts: Callable[[DataFrame], DataFrame], block: int, look, schema: str, name: str, passing: list[str]) -> DataFrame:
    """What ``look`` finds among the members (pivot, h, bytes) of each gathering, in two rounds; its rows with ``rest`` name those left over.

    In the first round every block of members is looked at, with the gathering's lead in each. So the work is in
    proportion to the members, and in a group of copies few are left over that weren't joined with the lead. In the
    second these meet all other blocks; without any there is none. ``facts`` gives a row for each h of the members.
    Blocks take long for few bytes, so the size in bytes doesn't say to how many tasks they are dealt out.
    """
    total = met.count()
    placed = written(_placed(met, block, total), f"{name}-placed", passing)
    seats = F.when(F.col("h") == F.col("lead"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    one = placed.withColumn("i", F.explode(seats)).select("pivot", "h", "lead", "i", F.lit(0).alias("j"), F.lit(True).alias("first"), (F.col("blocks") > 1).alias("more"))
    found = written(dealt(one.join(facts(placed), "h"), "pivot", "i").groupBy("pivot", "i", "j").applyInArrow(look, schema), name, passing)
    released(found.sparkSession)
    left = found.filter("rest").select("pivot", "h").distinct()
    if left.isEmpty():
        return found
    counts = left.groupBy("pivot").agg(F.count("*").alias("m")).withColumn("sides", F.ceil(F.col("m") / block).cast("int"))
    blocks = placed.select("pivot", "h", "block", "blocks")
    hot = F.col("m") * 4096 > total
    asks = by_key(left.join(blocks, ["pivot", "h"]), counts, "pivot", hot).withColumn("i", F.pmod(F.xxhash64("pivot", "h"), F.col("sides")).cast("int"))
    asks = asks.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    answers = by_key(blocks, counts, "pivot", hot).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    two = asks.select("pivot", "h", "i", "j", F.lit(True).alias("first")).unionByName(answers.select("pivot", "h", "i", F.col("block").alias("j"), F.lit(False).alias("first")))
    two = two.withColumn("lead", F.lit(0).cast("long")).withColumn("more", F.lit(False))
    again = dealt(two.join(facts(two), "h"), "pivot", "i", "j").groupBy("pivot", "i", "j").applyInArrow(look, schema)
    return found.unionByName(again)


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    column = column.combine_chunks()
    flat, ends = pc.list_flatten(column).to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))])
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


def alike(found: DataFrame, met: DataFrame, percent: int, k: int = K) -> DataFrame:
    """The rows of gatherings whose sketches leave them a partner. Of each value 16 bits are compared."""
    passing: list[str] = []

    def look(table: pa.Table) -> pa.Table:
        first = table["first"].to_numpy()
        good = _partnered(_lists(table["sketch"]), table["n"].to_numpy(), table["h"].to_numpy(), first, percent, k)
        out = pa.table({"pivot": table["pivot"], "h": table["h"], "rest": pa.array(~good)})
        # without a partner yet, but other blocks are there; in the second round nobody is left over
        return out.filter(pa.array(good | table["more"].to_numpy(zero_copy_only=False)))

    sized = met.withColumn("bytes", F.lit(8 * k).cast("long"))
    short = found.select(F.col("c").alias("h"), "n", F.transform("sketch", lambda v: v.bitwiseAND(0xFFFF) - 0x8000).cast("array<smallint>").alias("sketch"))
    looked = _compared(sized, lambda _: short, SKETCHES, look, "pivot long, h long, rest boolean", "minhash-partners", passing)
    out = written(looked.filter("not rest").select("pivot", "h").distinct(), "minhash-alike")
    deleted(found.sparkSession, passing)
    return out


def _with_text(texts: DataFrame, one: DataFrame, most: int) -> DataFrame:
    """(h, text) of the rows that ``one`` (h, doc_id, tie) names. Up to ``most`` names are broadcast, so that the other
    texts needn't be shuffled; beyond that it is a join of both sides."""
    rows = texts.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    small = F.broadcast(one) if one.count() <= most else one
    return rows.join(small, ["doc_id", "tie"]).select("h", "text").dropDuplicates(["h"])


def links(found: DataFrame, met: DataFrame, texts: DataFrame, width: int, percent: int, k: int = K, most: int = 2_000_000) -> DataFrame:
    """(a, b): verified links between the numbers of classes, enough to join all that are linked.

    ``met`` has the gatherings (pivot, h). Texts are dealt out to these, as they take up less than their sets.
    """
    passing: list[str] = []
    found = found.select(F.col("c").alias("h"), "n", "bytes", "doc_id", "tie")
    hashes = _Hash()  # of each task its own

    def facts(members: DataFrame) -> DataFrame:
        one = found.join(members.select("h").distinct(), "h").select("h", "doc_id", "tie")
        return _with_text(texts, written(one, "minhash-names", passing), most)

    def join(table: pa.Table) -> pa.Table:
        names, first = table["h"].to_pylist(), table["first"].to_numpy()
        whole = [s for _, s in _sets(table["text"].to_pylist(), width, hashes)]
        lead = table["lead"][0].as_py()
        order = sorted(range(len(names)), key=lambda p: (names[p] != lead, not first[p], names[p]))
        linked, group = _link([whole[p] for p in order], [names[p] for p in order], first[order], percent, k)
        rest = [names[p] for p, g in zip(order, group) if g != group[0]] if table["more"][0].as_py() else []
        rows = [(x, y, False) for x, y in linked] + [(x, None, True) for x in rest]
        pivot = table["pivot"][0].as_py()
        return pa.table({"pivot": pa.array([pivot] * len(rows), pa.int64()), "h": pa.array([r[0] for r in rows], pa.int64()), "b": pa.array([r[1] for r in rows], pa.int64()), "rest": pa.array([r[2] for r in rows], pa.bool_())})

    sized = met.join(found.select("h", (F.col("n") * 8 + F.col("bytes")).alias("bytes")), "h")
    looked = _compared(sized, facts, BLOCK, join, "pivot long, h long, b long, rest boolean", "minhash-links", passing)
    out = written(looked.filter("not rest").select(F.col("h").alias("a"), "b"), "minhash-joined")
    deleted(found.sparkSession, passing)
    return out


def _judged(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, tie (hash of the text), n_shingles, component_id and root (what the row's text is linked with) of every row.

    Rows of one doc_id with unlike texts have that doc_id as component all of them, but roots of their own.
    """
    passing: list[str] = []
    with arrow_batches(docs.sparkSession, 512):
        rows = sketched(docs, width, passing=passing)
        sketches: list[str] = []
        whole = classes(rows.filter(F.col("doc_id").isNotNull()), sketches)
        # sketches are kept once for each class from here on
        bare = written(rows.select("doc_id", "tie", "h", F.col("n").alias("n_shingles")), "minhash-rows")
        deleted(docs.sparkSession, passing)
        met = alike(whole, gatherings(whole, percent), percent)
        # and not at all once it is known which classes may be alike
        found = written(whole.drop("sketch"), "minhash-found")
        deleted(docs.sparkSession, sketches)
        roots = components(links(found, met, docs.filter(F.col("doc_id").isNotNull()), width, percent))
    rooted = found.select("h", "c", "doc_id", "copies").join(roots, found["c"] == roots["node"], "left").select("h", "doc_id", "copies", F.coalesce("root", "c").alias("root"))
    # roots of large groups are few: a group of more than one of 4096 rows is looked up by broadcast, and so is a large class
    total = bare.count()
    sized = rooted.groupBy("root").agg(F.min("doc_id").alias("component"), F.count("*").alias("members"))
    named = written(by_key(rooted, sized, "root", F.col("members") * 4096 > total).select("h", "root", "component", "copies"), "minhash-named")
    out = by_key(bare.filter("doc_id is not null and n_shingles > 0"), named, "h", F.col("copies") * 4096 > total).drop("copies")
    out = out.unionByName(bare.filter("doc_id is null or n_shingles = 0"), allowMissingColumns=True)
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "tie", "n_shingles", component.alias("component_id"), "root")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    Words are lower-cased by A-Z; a document's set holds its distinct runs of ``width`` words, or the whole sequence if
    it has fewer. Documents are linked if 100 * common >= ``percent`` * united shingles; component_id is the smallest
    doc_id that can be reached. Null and white space have no shingles and are linked with nothing. Rows of one doc_id
    are judged each by its own text. Rows without doc_id are linked with nothing, have no component and are kept. Other
    columns are ignored; an empty table gives no rows.
    """
    rows = _judged(docs, width, percent)
    return rows.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, one for each group of texts that are linked: that of the smallest doc_id.

    Texts are linked, not ids: of rows of one doc_id with unlike texts each counts in its own text's group. Where the
    smallest doc_id has several texts of the group, the smallest hash of the text stays, and of equal rows one. Texts
    without shingles are linked with nothing: all their rows stay, and so do all rows without doc_id. Columns may have any
    names and types; an empty table gives no rows.
    """
    judged = _judged(docs, width, percent).filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    stays = judged.groupBy("root").agg(F.min(F.struct("doc_id", "tie")).alias("one")).select("one.doc_id", "one.tie")
    # a row as one column, so that no name of its columns meets one of these
    row = F.struct(*[F.col(f"`{n}`") for n in docs.columns])
    alone = F.col("doc_id").isNull() | ~F.coalesce(F.col("text"), F.lit("")).rlike(WORD)
    rows = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), alone.alias("alone"))
    named = rows.filter("not alone").join(stays, ["doc_id", "tie"])
    nth = F.row_number().over(Window.partitionBy("doc_id", "tie").orderBy("alone"))
    once = named.withColumn("nth", nth).filter("nth = 1").select("row")
    return once.unionByName(rows.filter("alone").select("row")).select("row.*")
