import numpy as np
import pytest

from tarnkappe.llm import quality


def test_chunks_cover_all_bytes():
    texts = [bytes(np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8)) for n in (0, 1, 64, 448, 512, 513, 5000)]
    chunks, owner = quality.chunks_of(texts)
    for i, t in enumerate(texts):
        own = chunks[owner == i]
        whole = b"".join(bytes(c[(quality.CHUNK - quality.STEP if j else 0) :][c[(quality.CHUNK - quality.STEP if j else 0) :] != quality.PAD].astype(np.uint8)) for j, c in enumerate(own))
        assert whole == t


def test_gradients_match_differences():
    r = np.random.default_rng(0)
    texts, labels = [bytes(r.integers(65, 91, n, dtype=np.uint8)) for n in (900, 30, 0)], np.array([1, 0, 1], np.float32)
    chunks, owner = quality.chunks_of(texts)
    net = quality.Net()
    net.bias[:] = 0.1  # away from the kink, where an empty text stands

    def loss():
        z = net.logits(chunks, owner, 3)
        return np.mean(np.log1p(np.exp(-z)) * labels + np.log1p(np.exp(z)) * (1 - labels))

    got = net.gradients(chunks, owner, labels)
    for name, at in (("weights", 3), ("offset", 0), ("bias", 2), ("filters", (5, 1)), ("vectors", (70, 2))):
        p = getattr(net, name)
        old, eps = p[at], 1e-3
        p[at] = old + eps
        up = loss()
        p[at] = old - eps
        down = loss()
        p[at] = old
        assert got[name][at] == pytest.approx((up - down) / (2 * eps), abs=2e-3)


def rows(spark, n=600):
    r = np.random.default_rng(5)
    texts = []
    for i in range(n):
        words = ["".join(r.choice(list("etaoins"), r.integers(2, 8))) for _ in range(r.integers(20, 300))]
        texts.append((i, " ".join(w + "$$$" for w in words) if i % 4 == 0 else " ".join(words)))
    return spark.createDataFrame([*texts, (n, None), (n + 1, ""), (None, "x"), (n + 2, "word " * 40_000), (0, texts[0][1])], "doc_id long, text string").selectExpr("*", "1 as score", "2 as label"), texts


def test_held_out_accuracy(spark):
    docs, texts = rows(spark)
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i, _ in texts] + [(3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_query(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < len(texts)]
    assert len(held) > 100 and np.mean([r.predicted == int(r.doc_id % 4 > 0) for r in held]) > 0.97


def test_no_labels(spark):
    docs, _ = rows(spark, 8)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.quality_query(docs, none).collect()} == {0.5}
    assert quality.quality_query(docs.limit(0), none).count() == 0


def test_logits_by_hand():
    """An independent forward pass: windows, answers, maxima and means in plain loops."""
    r = np.random.default_rng(2)
    net = quality.Net(5)
    net.bias, net.offset = r.normal(size=quality.FILTERS).astype(np.float32), np.array([0.3], np.float32)
    for text in (b"", b"short", bytes(r.integers(0, 256, 700, dtype=np.uint8)), b"ab " * 400):
        chunks = []
        for at in range(0, max(1, len(text) - (quality.CHUNK - quality.STEP)), quality.STEP):
            piece = list(text[at : at + quality.CHUNK])
            piece += [quality.PAD] * (quality.CHUNK - len(piece))
            answers = [np.concatenate([net.vectors[b] for b in piece[i : i + quality.WIDTH]]) @ net.filters for i in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE)]
            chunks.append(float(np.maximum(np.max(answers, axis=0) + net.bias, 0) @ net.weights))
        want = 1 / (1 + np.exp(-(np.mean(chunks) + 0.3)))
        assert abs(net.scores([text])[0] - want) < 1e-4
