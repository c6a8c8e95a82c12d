import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tarnkappe.llm import lm

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*WORD.findall((text or "").translate(LOWER)), None]


def table(spark, n=400):
    r = np.random.default_rng(3)
    rows = []
    for i in range(n):
        kind = i % 2
        words = [f"{'ab'[kind]}{int(x)}" for x in r.zipf(1.5, r.integers(1, 200)) if x < 10_000]
        rows.append((i, " ".join(words)))
    rows += [(n, None), (n + 1, ""), (n + 2, "Ünique WORD \x0b X"), (5, "again Again"), (5, "again Again"), (None, "no id")]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "2L as row", "3 as h").repartition(4), rows


def test_base_score_by_hand(spark):
    df, rows = table(spark)
    got = lm.lm_query(df).collect()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    counts = Counter(t for d, x in rows if not held(d) for t in tokens(x))
    total, v = sum(counts.values()), len(counts)
    want = []
    for d, x in rows:
        t = tokens(x)
        want.append((d, held(d), len(t), sum(counts[w] > 0 for w in t), total, round(sum(math.log10((counts[w] + 1) / (total + v + 1)) for w in t), 6)))
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == sorted(want, key=str)
    long = [r for r in got if r.held_out and r.n_tokens > 20]
    assert sum(r.score for r in long) > sum(r.base_score for r in long)


def test_rare_words_come_by_the_join(spark, monkeypatch):
    df, _ = table(spark, 120)
    key = lambda rows: sorted(((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in rows))
    whole = key(lm.lm_query(df).collect())
    monkeypatch.setattr(lm, "HEAD", 8)
    assert key(lm.lm_query(df).collect()) == whole


def test_probabilities_sum_to_one():
    counts, sizes = np.zeros(lm.CLASSES, np.int64), np.zeros(lm.CLASSES, np.int64)
    counts[:5], counts[lm.OWN], counts[lm.END], sizes[lm.OWN] = [50, 40, 30, 20, 10], 25, 7, 14
    corpus = lm.Corpus(np.arange(5), counts[:5], np.arange(5), 182, 20, 7, counts, sizes)
    model, r = lm.Model(corpus), np.random.default_rng(0)
    now = r.integers(0, 5, 512)
    for _ in range(20):
        model.learn(now, np.full(512, lm.BEGIN), now, r)
    for one, two in ((lm.BEGIN, lm.BEGIN), (1, 4)):
        s = model.context(np.array([one]), np.array([two])) @ model.out.T + model.bias
        assert np.exp(s - model.log_sum(np.array([one]), np.array([two]))[:, None]).sum() == pytest.approx(1, abs=1e-4)
    assert 10 ** corpus.class_logs()[lm.OWN] == pytest.approx(25 + 14 + 1)


@pytest.mark.parametrize("head", [32768, 40, 4])
def test_score_is_the_models_by_hand(spark, monkeypatch, head):
    """An independent pass, token by token, over the parameters that the workers are given."""
    monkeypatch.setattr(lm, "HEAD", head)
    kept = {}
    made = lm.train
    monkeypatch.setattr(lm, "train", lambda texts, corpus: kept.setdefault("m", (made(texts, corpus), corpus))[0])
    df, rows = table(spark, 60)
    got = lm.lm_query(df.coalesce(1)).collect()
    model, corpus = kept["m"]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    counts = Counter(t for d, x in rows if not held(d) for t in tokens(x) if t)
    hashed = {int(lm._hashes([w.encode()])[0]): w for w in counts}
    single = {hashed[int(h)]: int(k) for h, k in zip(corpus.head, corpus.classes) if k < lm.OWN}
    ending = lambda w: int(lm._by_ending([w.encode()])[0])
    size = Counter()
    for w, n in counts.items():
        if w not in single:
            size[ending(w)] += n + 1

    def by_hand(text):
        one = two = lm.BEGIN
        total = 0.0
        for t in tokens(text):
            k = lm.END if t is None else single.get(t, None)
            k = ending(t) if k is None else k
            s = (model.seen[one] @ model.one + model.seen[two] @ model.two) @ model.out.T + model.bias
            total += (s[k] - s.max() - np.log(np.exp(s - s.max()).sum())) / math.log(10)
            if t is not None and t not in single:
                total += math.log10((counts[t] + 1) / (size[k] + 1))
            one, two = k, one
        return total

    want = sorted((str(d), len(tokens(x)), by_hand(x)) for d, x in rows)
    for (d, n, s), r in zip(want, sorted(got, key=lambda r: (str(r.doc_id), r.n_tokens, r.score))):
        assert (d, n) == (str(r.doc_id), r.n_tokens) and r.score == pytest.approx(s, rel=1e-4, abs=1e-3)


def test_odd_tables(spark):
    schema = "doc_id long, text string"
    assert lm.lm_query(spark.createDataFrame([], schema)).count() == 0
    only_held = lm.score(spark.createDataFrame([(1, "a b")], schema), held_out=lm.F.lit(True)).first()
    assert (only_held.n_known, only_held.train_tokens, only_held.base_score) == (0, 0, 0.0)
