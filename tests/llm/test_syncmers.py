import hashlib
import re

from tarnkappe.llm import syncmers

#: Han, Hiragana, Katakana.
SPACELESS = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff"


UNIT = re.compile(f"[{SPACELESS}]|[^\x20\x09-\x0d{SPACELESS}]{{1,3}}")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_anchors_are_closed_syncmers(spark):
    texts = [" ".join(f"W{(i * i + j) % 37}" for i in range(n)) for j, n in enumerate([0, 1, 2, 5, 6, 7, 30, 400])]
    texts += [None, " \n ", "x" * 5000, "漢字かな混じり文 and some latin words", "Wörter von mehr als drei Zeichen"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in syncmers.fingerprint(rows).collect()}
    units = [UNIT.findall((t or "").translate(LOWER)) for t in texts]
    pairs = {tuple(u[i : i + 2]) for u in units for i in range(len(u) - 1)}
    hashes = {(r.a, r.b): r.h for r in spark.createDataFrame(sorted(pairs), "a string, b string").selectExpr("a", "b", "xxhash64(xxhash64(a), xxhash64(b)) as h").collect()}
    for i, u in enumerate(units):
        inner = [hashes[u[j], u[j + 1]] for j in range(len(u) - 1)]
        want = [j + 1 for j in range(len(u) - 3) if min(inner[j : j + 3]) in (inner[j], inner[j + 2])]
        assert [a.position for a in got[i].anchors] == (want or [1] * bool(u)), i
        assert len(got[i].fingerprint.split()) == len(got[i].anchors)


def near(a, b):
    a, b = set(a.fingerprint.split()), set(b.fingerprint.split())
    return len(a & b) / len(a | b)


def test_likeness_does_not_jump_with_length(spark):
    """A few characters more at the end change little, at any length and in any script."""
    base = " ".join(f"w{i * i % 89}" for i in range(400))
    kinds = [base, "中文字符" + "".join(chr(0x4E00 + i * i % 977) for i in range(1500)), "".join(chr(97 + i * i % 23) for i in range(1500))]
    sizes = [255, 256, 257, 511, 512, 513, 514, 520, 1023, 1024, 1025]
    rows = [(k * 100 + i, text[:n]) for k, text in enumerate(kinds) for i, n in enumerate(sizes)]
    got = {r.doc_id: r for r in syncmers.fingerprint(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k in range(len(kinds)):
        for a, b in [(0, 1), (1, 2), (3, 4), (4, 5), (5, 6), (8, 9), (9, 10)]:
            assert near(got[k * 100 + a], got[k * 100 + b]) > 0.9, (k, sizes[a])


def test_short_texts_keep_something_of_themselves(spark):
    texts = [" ".join(f"{w}{j}" for w in ("Dieses", "Gedicht", "handelt", "immer", "wieder", "davon", "dass")[:n]) for j, n in enumerate([5, 6, 7] * 10)]
    rows = [(2 * i, t) for i, t in enumerate(texts)] + [(2 * i + 1, t[: len(t) - len(t) // 3] + "ganz etwas anderes als vorher") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in syncmers.fingerprint(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(near(got[2 * i], got[2 * i + 1]) > 0 for i in range(len(texts))) > 0.8 * len(texts)


def test_query_by_hand(spark):
    texts = {i: " ".join(f"w{i}x{j * j % 101}" for j in range(i * 13 % 300)) + ("é" * (i % 5)) for i in range(0, 400, 3)} | {1000: "", 1001: "short text"}
    rows = [(i, t) for i, t in texts.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as chunk", "'a' as anchors").repartition(3)
    by_id = sorted(texts, reverse=True)
    for bytes_ in (16 << 20, 3000):
        got = {r.doc_id: r for r in syncmers.with_next(df, bytes_).collect()}
        assert len(got) == len(texts)
        for a, b in zip(by_id, by_id[1:] + by_id[:1]):
            assert got[a].next_text == texts[b]
    out = {r.doc_id: r for r in syncmers.fingerprint_query(df).collect()}
    for a, b in zip(by_id, by_id[1:] + by_id[:1]):
        n = len(texts[a])
        edited = texts[a][: n - n // 3] + texts[b][: n // 3]
        assert out[a].n_chars == n and out[a].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        one, other, after = (set(x.split()) for x in (out[a].fingerprint, out[a].edited_fingerprint, out[b].fingerprint))
        close = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        assert abs(out[a].near_edited - close(one, other)) < 1e-12 and abs(out[a].near_next - close(one, after)) < 1e-12
    long = [r for r in out.values() if r.n_chars > 900]
    assert sum(r.near_edited > r.near_next for r in long) > 0.95 * len(long)


def test_a_passage_matches_wherever_it_is(spark):
    passage = " ".join(f"p{i * i % 911}" for i in range(200))
    moved = " ".join(passage.split()[100:] + passage.split()[:100])
    rows = [(1, passage), (2, "two words " + passage + " and more"), (3, moved), (4, "kurz und gut gesagt"), (5, "kurz und gut gesägt"), (6, "中" * 700 + "一二三四五六七八九十" * 9), (7, "中" * 700 + "一二三四五六七八九十" * 8 + "abc")]
    got = {r.doc_id: set(r.fingerprint.split()) for r in syncmers.fingerprint(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    share = lambda a, b: len(got[a] & got[b]) / len(got[a] | got[b])
    assert share(1, 2) > 0.9 and 0.8 < share(1, 3) < 1 and 0 < share(4, 5) < 1 and 0 < share(6, 7)


def test_odd_tables(spark):
    schema = "doc_id long, text string"
    assert syncmers.fingerprint_query(spark.createDataFrame([], schema)).count() == 0
    assert syncmers.fingerprint_query(spark.createDataFrame([(1, "a b c")], schema)).first().near_next == 1
    rows = [(1, "same text"), (1, "same text"), (None, "x"), (None, None), (2, None)]
    got = syncmers.fingerprint_query(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 5 and len({r.fingerprint for r in got if r.doc_id == 1}) == 1
