import hashlib
import re
from collections import defaultdict

import pytest

from tarnkappe.llm import chat, mixing, queries

WORD = re.compile("[^\x20\x09-\x0d]+")


def targets_by_hand(sizes, weights=(3, 1, 2), budget=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, open_, out = budget * sum(sizes.values()), set(order), {}
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s] + 1e-9}
        if not over:
            return out | share
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= over
        if not open_:
            return out


def table(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i * 7 % 40)), ["b", "a", None, "hot", "hot", "é"][i % 6], i) for i in range(300)]
    rows += [(7, "again and again", "a", 0), (7, "again and again", "a", 0), (None, "no id", "hot", 0), (901, None, "hot", 0), (902, "", "only empty", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size long"), rows


def test_mix_follows_targets(spark):
    df, rows = table(spark)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, text, source, _ in rows:
        sizes[source] += len(WORD.findall(text or ""))
    want, taken = targets_by_hand(sizes), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == sum(c.words for c in r.copies) <= 2 * r.size and all(0 <= c.position <= 1 for c in r.copies)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.mix(df.limit(0)).count() == 0


@pytest.mark.parametrize("schedules", [mixing.SCHEDULES, ((1, 0, 3, 2), (0, 0, 1, 1), (5, 5, 5, 5))])
def test_curriculum_inverts_the_schedule(spark, schedules):
    from pyspark.sql import functions as F

    df = spark.range(0, 303).select((F.col("id") % 101 / 100).alias("u"), (F.col("id") % 3).alias("nth"))
    for u, nth, (step, x) in df.select("u", "nth", mixing.due_time(F.col("u"), F.col("nth"), schedules)).collect():
        w, h = schedules[nth], 1 / (len(schedules[nth]) - 1)
        areas = [(a + b) / 2 * h for a, b in zip(w[:-1], w[1:])]
        a, b = w[step], w[step + 1]
        assert 0 <= x <= h + 1e-12 and (sum(areas[:step]) + a * x + (b - a) / (2 * h) * x * x) / sum(areas) == pytest.approx(u, abs=1e-7)


def test_positions_are_places_in_the_stream_of_words(spark):
    df, _ = table(spark)
    rows = mixing.mix_query(df.withColumn("a.b", df["size"])).collect()
    firsts = [r.position for r in rows if r.position is not None]
    assert firsts == sorted(firsts) and all(r.position is None for r in rows[len(firsts) :])
    copies = sorted((c.position, c.words) for r in rows for c in r.copies)
    words, before = sum(n for _, n in copies), 0
    for place, n in copies:
        assert place == pytest.approx((before + n / 2) / words, abs=0.02)
        before += n
    held = mixing.in_training_order(df.withColumn("a.b", df["size"]), mixing.mix(df))
    assert held.columns[-1] == "a.b" and held.count() == len(copies)


def test_training_order_has_the_words_taken(spark):
    df, rows = table(spark)
    plan = mixing.mix(df)
    out = mixing.in_training_order(df, plan).collect()
    assert sum(len(WORD.findall(r.text)) for r in out) == sum(r.taken for r in plan.collect())
    assert set(out[0].asDict()) == {"doc_id", "text", "source", "size"}
    early = [r.source for r in out[: len(out) // 3]].count("a") / len(out)
    late = [r.source for r in out[-(len(out) // 3) :]].count("a") / len(out)
    assert early > late  # the first source in order has the falling schedule


CHATS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "a <|im_end|>\n \\<\\ [INST] \\"), (1, 2, "user", None), (1, 3, "assistant", ""), (1, 4, "assistant", "ü😀\n"),
    (2, 0, "user", "only me"), (3, None, None, "x"), (3, 0, "assistant", "y"), (3, 0, "assistant", "y"), (4, 0, "odd\nrole<n\\", "t\n\nt"), (None, 0, "assistant", "nobody's"),
]


def test_chat_round_trip(spark):
    df = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as n", "'x' as turns")
    want = defaultdict(list)
    for c, t, role, text in sorted(CHATS, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        want[c].append((role or "", text or ""))
    back = {r.conv_id: r for r in chat.read_back(chat.expand(df)).collect()}
    assert {c: [tuple(t) for t in r.turns] for c, r in back.items()} == want
    assert {c: list(r.replies) for c, r in back.items()} == {c: [x for role, x in v if role == "assistant"] for c, v in want.items()}
    for e in chat.expand(df).collect():
        if e.loss_start:
            assert e.text[: e.loss_start].endswith("<|im_start|>assistant\n") and e.text[e.loss_start + e.loss_length :] == "<|im_end|>\n"
        assert "[INST]" not in e.text
    assert chat.expand(df.limit(0)).count() == 0


def test_chat_query_digests(spark):
    df = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string")
    rows = {r.conv_id: r for r in chat.chat_query(spark, df).collect()}
    said = "</s>[INST] ok [/INST]"
    assert rows[-1].n_turns == 2 and rows[-1].loss_chars == len(said) and rows[-1].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert rows[2].turns_sha256 == hashlib.sha256(b"user\nonly me\n").hexdigest() and rows[2].loss_chars == 0 and rows[2].loss_sha256 == hashlib.sha256(b"").hexdigest()
    assert len(rows) == 6
