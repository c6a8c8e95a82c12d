import os
import re
from itertools import combinations

import numpy as np
import pytest

from tarnkappe.llm import minhash
from tarnkappe.llm.components import components

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def by_hand(rows, width, percent=80):
    ids = [r[0] for r in rows if r[0] is not None]
    sets = {d: shingles(t, width) for d, t in rows if d is not None}
    parent = {d: d for d in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return sorted((d, len(sets[d]), find(d), find(d) == d) for d in sets)


def texts(n=160, seed=1):
    r = np.random.default_rng(seed)
    frequent = [f"w{i}" for i in range(30)]
    rows = []
    for i in range(n):
        base = [str(x) for x in r.choice(frequent if i % 3 else [f"v{j}" for j in range(3000)], r.integers(1, 120))]
        rows.append(base)
        for _ in range(r.integers(0, 4)):
            copy = list(base)
            for j in range(len(copy)):
                if r.random() < r.choice([0.02, 0.05, 0.1]):
                    copy[j] = f"e{r.integers(0, 10_000)}"
            rows.append(copy)
    hot = [str(x) for x in r.choice(3000, 90)]
    for _ in range(320):  # one large group, larger than a block
        copy, rate = list(hot), r.choice([0.01, 0.03, 0.06, 0.12])
        rows.append([f"h{r.integers(0, 10**6)}" if r.random() < rate else w for w in copy])
    rows += [list(hot)] * 50
    out = [(int(i * 7 % 10_007), " ".join(w).upper() if i % 5 == 0 else "\n".join(w)) for i, w in enumerate(rows)]
    return [*out, (20_001, None), (20_002, " \t"), (20_003, None), (20_004, "One"), (20_005, "one"), (20_006, "a b"), (20_007, "A  B"), (20_008, "x " * 3000)]


@pytest.mark.parametrize("width", [2, 5])
def test_equals_brute_force(spark, width):
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as h", "'x' as row", "2 as n").repartition(5)
    got = sorted(tuple(r) for r in minhash.near_duplicates(df, width).collect())
    assert got == by_hand(rows, width)


def test_odd_tables(spark):
    schema = "doc_id long, text string"
    assert minhash.near_duplicates(spark.createDataFrame([], schema), 2).count() == 0
    rows = [(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, "A b c"), (3, None)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, schema), 2).collect()
    assert sorted(map(str, ((r.doc_id, r.component_id, r.kept) for r in got))) == sorted(map(str, [(1, 1, True), (1, 1, True), (None, None, True), (2, 1, False), (3, 3, True)]))


def test_one_of_each_goes_by_text_not_by_id(spark):
    one, two = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(5, one), (5, two), (12, two + " end"), (13, one), (7, one), (5, ""), (5, None), (8, " \t"), (None, two), (5, one)]
    got = minhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 5).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(5, one), (5, two), (5, ""), (5, None), (8, " \t"), (None, two)]))


def test_an_unrelated_leftover_is_filtered():
    """In a later round a member meets the block that it is in itself: that isn't a partner."""
    one, other = np.sort(np.arange(48, dtype=np.uint64) * 7), np.sort(np.arange(48, dtype=np.uint64) * 7 + 1)
    ask = minhash._partnered([one, one, other], np.array([48, 48, 48]), np.array([5, 5, 6]), np.array([True, False, False]), 80, 48)
    assert not ask.any()
    near = one.copy()
    near[-1] += 1
    assert minhash._partnered([one, one, near], np.array([48, 48, 48]), np.array([5, 5, 6]), np.array([True, False, False]), 80, 48).tolist() == [True, False, True]
    links, _ = minhash._link([one, one, near], [5, 5, 6], np.array([True, False, False]), 80, 48)
    assert links == [(5, 6)]


def test_little_is_kept_on_disk(spark, monkeypatch):
    """When texts are compared no sketch is there any more; sets are never written; without leftovers there is no second round."""
    names, sketches, left, plans = set(), [], [], {}

    def spy(df, name, passing=None):
        names.add(name)
        plans[name] = df._jdf.queryExecution().toString()
        assert "set" not in df.columns
        if name == "minhash-links":
            left.extend(f for f in sketches if os.path.exists(f))
        out = written(df, name, passing)
        if "sketch" in df.columns:
            sketches.extend(f.removeprefix("file://") for f in out.inputFiles())
        return out

    written = minhash.written
    monkeypatch.setattr(minhash, "written", spy)
    rows = texts(40, seed=2)
    got = sorted(tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect())
    assert got == by_hand(rows, 2)
    assert sketches and "minhash-links" in names and not left
    assert not any("FlatMapGroupsInArrow" in plans[name] for name in ("minhash-alike", "minhash-joined"))
    # blocks are dealt out once, to a number of tasks that is given
    for name in ("minhash-partners", "minhash-links"):
        physical = plans[name].split("== Physical Plan ==")[1].split("FlatMapGroupsInArrow")[1]
        assert "REPARTITION_BY_NUM" in re.search(r"Exchange[^\n]*", physical)[0]


def test_short_values_lose_no_partner():
    """16 bits of each value find every partner that all 64 find, and hardly any more."""
    r = np.random.default_rng(5)
    base = np.sort(r.integers(-(2**63), 2**63 - 1, 48))
    long = [np.sort(r.integers(-(2**63), 2**63 - 1, 48)) for _ in range(200)]
    for i in range(100):
        copy = base.copy()
        copy[: i % 48] = r.integers(-(2**63), 2**63 - 1, i % 48)
        long.append(copy)
    sizes, names, one = np.full(300, 400), np.arange(300), np.ones(300, bool)
    whole, short = (minhash._partnered(x, sizes, names, one, 80, 48) for x in (long, [((s & 0xFFFF) - 0x8000).astype(np.int16) for s in long]))
    assert whole.any() and not (whole & ~short).any() and short.sum() - whole.sum() < 5


def test_blocks_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 5000)
    monkeypatch.setattr(minhash, "BLOCK", 50)
    rows = texts(60, seed=4)
    got = sorted(tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 2).collect())
    assert got == by_hand(rows, 2)


def test_any_column_names(spark):
    names = ["__id", "__tie", "__nth", "row", "alone", "tie", "nth", "a.b", "one", "root"]
    text = " ".join(f"a{i}" for i in range(40))
    rows = [(d, t, *(f"{d}{n}" for n in names)) for d, t in ((1, text), (2, text), (2, text), (3, None), (None, text))]
    df = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *(f"`{n}` string" for n in names)]))
    got = minhash.one_of_each(df, 5)
    assert got.columns == df.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [rows[0], rows[3], rows[4]]))
    assert minhash.one_of_each(df.limit(0), 5).count() == 0


def test_components_of_a_long_chain(spark):
    chain = spark.range(0, 60).selectExpr("(id * 37) % 61 as a", "((id + 1) * 37) % 61 as b").union(spark.sql("select 100L, 101L union all select 101L, 100L union all select 7L, 7L"))
    got = {r.node: r.root for r in components(chain).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100}
