import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tarnkappe.llm import simhash

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def code_of(text):
    w = WORD.findall((text or "").translate(LOWER))
    runs = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(codes, most=4):
    """Number of each code's component, by all pairs."""
    codes = np.array(codes, np.uint64)
    label = np.arange(len(codes))
    while True:
        new = np.array([label[np.bitwise_count(codes ^ c) <= most].min() for c in codes])
        if (new == label).all():
            return label
        label = new


def by_hand(rows):
    codes = {}
    for d, t in rows:
        codes.setdefault(code_of(t), []).append(d)
    known = sorted(c for c, ids in codes.items() if any(i is not None for i in ids))
    label = grouped(known)
    least = {}
    for c, g in zip(known, label):
        least[g] = min([least.get(g, 2**63), *(i for i in codes[c] if i is not None)])
    of = {c: least[g] for c, g in zip(known, label)}
    return sorted(((d, f"{code_of(t):016x}", None if d is None else of[code_of(t)]) for d, t in rows), key=str)


def texts(seed=5):
    r = np.random.default_rng(seed)
    rows = []
    for _ in range(120):
        base = [f"w{x}" for x in r.integers(0, 4000, r.integers(1, 200))]
        rows.append(base)
        for _ in range(r.integers(0, 5)):
            copy = list(base)
            for j in r.integers(0, len(copy), r.integers(1, 4)):
                copy[j] = f"e{r.integers(0, 10_000)}"
            rows.append(copy)
    hot = [f"h{x}" for x in r.integers(0, 3000, 150)]
    for _ in range(300):
        copy = list(hot)
        for j in r.integers(0, len(copy), r.integers(0, 9)):
            copy[j] = f"e{r.integers(0, 10_000)}"
        rows.append(copy)
    rows += [list(hot)] * 40
    out = [(int(i * 7 % 10_007), " ".join(w).upper() if i % 5 == 0 else "\n\t".join(w)) for i, w in enumerate(rows)]
    return [*out, (20_001, None), (20_002, " \t"), (20_003, ""), (20_004, "One"), (20_005, "one"), (20_006, "a b c"), (20_007, "A  B\x0bc"), (20_008, "x y " * 40_000), (20_009, "ä ö É"), (None, "One"), (None, None), (3, "One"), (3, "One")]


def test_equals_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "'x' as least", "2 as copies").repartition(5)
    got = sorted(map(tuple, simhash.near_duplicates(df).collect()), key=str)
    assert got == by_hand(rows)
    assert len({r[2] for r in got}) < len({r[1] for r in got})


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def dense(n, seed, spread=6):
    """Codes around a few centres, none twice."""
    r = np.random.default_rng(seed)
    centres = r.integers(0, 2**64, 3, dtype=np.uint64)
    bits = r.integers(0, 64, (n, spread))
    flips = np.bitwise_xor.reduce(np.uint64(1) << bits.astype(np.uint64), axis=1)
    return np.unique(centres[r.integers(0, 3, n)] ^ flips)


@pytest.mark.parametrize("n,fan_free", [(1, False), (7, False), (8, True), (700, True), (2000, True)])
def test_index_finds_all_pairs(n, fan_free):
    codes = np.concatenate([dense(n, 1), np.random.default_rng(2).integers(0, 2**64, n, dtype=np.uint64), np.array([0, 2**64 - 1, 1 << 63], np.uint64)])
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    asks = codes[:: max(1, n // 50)] ^ np.uint64(5)
    got = set(zip(*(x.tolist() for x in simhash.GrayIndex(codes).search(asks, 4))))
    assert got == {(i, int(j)) for i, q in enumerate(asks) for j in np.flatnonzero(np.bitwise_count(codes ^ q) <= 4)}


def test_index_prunes():
    """Groups that lie apart aren't looked into: on the last level a query meets few of the others' codes."""
    codes = dense(4000, 9, spread=3)
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    index = simhash.GrayIndex(codes)
    pattern, mask = index.levels[0]
    apart = np.bitwise_count((codes[0] ^ pattern) & mask) > 4
    assert apart.any() and all(len(p) == len(m) for p, m in index.levels)


def test_gray_neighbours_differ_in_one_bit():
    rank = np.arange(1000, dtype=np.uint64)
    codes = rank ^ (rank >> np.uint64(1))
    assert (simhash.gray_rank(codes) == rank).all() and (np.bitwise_count(codes[1:] ^ codes[:-1]) == 1).all()


@pytest.mark.parametrize("count", [10, 10**8, 10**11])
def test_any_choice_of_top_levels_meets_every_pair(count):
    r = np.random.default_rng(1)
    a = r.integers(0, 2**64, 3000, dtype=np.uint64)
    b = a ^ np.bitwise_xor.reduce(np.uint64(1) << r.integers(0, 64, (3000, 4)).astype(np.uint64), axis=1)
    assert np.any([(a ^ b) & mask == 0 for mask, _ in simhash.choices(count, 4)], axis=0).all()


@pytest.mark.parametrize("least,most,partitions", [(8, 32, 3), (2, 4, 7), (512, 4096, 2)])
def test_links_join_what_is_linked_in_large_top_nodes(spark, least, most, partitions):
    """Small runs, so that top nodes go over runs and partitions."""
    codes = np.unique(np.concatenate([dense(400, 3), np.random.default_rng(4).integers(0, 2**64, 150, dtype=np.uint64)]))
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        nodes = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fp long")
        got = simhash.links(nodes, len(codes), run=(least, most)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    at = {int(c): i for i, c in enumerate(codes.view(np.int64))}
    label = np.arange(len(codes))
    for r in got:
        assert int(codes[at[r.a]] ^ codes[at[r.b]]).bit_count() <= 4
        x, y = sorted((label[at[r.a]], label[at[r.b]]))
        label[label == y] = x
    assert (label == grouped(codes)).all()


def test_runs_hold_every_row_once_and_name_open_nodes():
    r = np.random.default_rng(8)
    key = np.sort(np.repeat(np.arange(40), r.integers(1, 60, 40)))
    key[100:600] = key[100]
    key = np.sort(key)
    code = np.arange(len(key), dtype=np.uint64)
    runs, out = simhash._Runs(16, 64), []
    for at in [*range(0, len(key), 64), None]:
        if at is not None:
            runs.add(np.stack([np.zeros(len(key[at : at + 64]), np.int64), key[at : at + 64]], axis=1), code[at : at + 64])
        out += list(runs.take(at is None))
    assert np.concatenate([c for c, _ in out]).tolist() == code.tolist()
    assert max(len(c) for c, _ in out) <= 64
    where = {}
    for i, (c, _) in enumerate(out):
        for k in set(key[c.astype(int)].tolist()):
            where.setdefault(k, []).append(i)
    named = {(int(k[1]), i) for i, (_, members) in enumerate(out) for k, _ in members}
    for k, runs_ in where.items():
        if len(runs_) > 1 or k in (key[0], key[-1]):
            assert {(k, i) for i in runs_} <= named
    for c, members in out:
        for k, own in members:
            assert own.tolist() == [x for x in c.tolist() if key[x] == k[1]]


def test_fingerprint_of_many_shingles(monkeypatch):
    text = " ".join(f"a{i * i % 977}" for i in range(5000))
    want = code_of(text)
    monkeypatch.setattr(simhash, "COUNTED", 100)
    assert simhash.fingerprint(text.encode()) == want and simhash.fingerprint(None) == 0
    assert pa.array([1]).type == pa.int64()
