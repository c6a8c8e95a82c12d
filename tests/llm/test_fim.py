import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnkappe.llm import fim

UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def by_hand(doc_id, text, seed=42, rate=50, spm=80):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    if doc_id is None:
        return n, "plain", None, None, text
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def held(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as n", "1 as form", "text as output", "2 as units", "3 as h").repartition(3)
    got = sorted(map(str, map(tuple, fim.fim_query(df).collect())))
    want = []
    for doc_id, text in rows:
        n, form, p, m, out = by_hand(doc_id, text)
        want.append((doc_id, n, form, p, m, digest(out), digest(text or "")))
    assert got == sorted(map(str, want))
    return want


def test_equals_brute_force_on_odd_texts(spark):
    texts = [None, "", " ", " \t\n", "one", " one", "one ", "a b  c\r\nd", "ä ö 𝒳𝒴 z", "<P> is held", "<<S>>", "< P>", "ends in <", "P> begins", "< <P", "x " * 40_000, "y" * 300_000, " " * 50_000 + "z", "<M"]
    rows = [(i * 31 + j, t) for j in range(12) for i, t in enumerate(texts)] + [(None, "no id"), (None, None), (7, "same row"), (7, "same row"), (7, "another text"), (-5, "below zero too"), (2**62, "a large id")]
    forms = {w[2] for w in held(spark, rows)}
    assert forms == {"plain", "psm", "spm"}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab<PSM> \t\n é𝒳", max_size=30), min_size=1, max_size=40))
def test_any_text_comes_back(spark, texts):
    held(spark, list(enumerate(texts)))


@pytest.mark.parametrize("rate,spm", [(0, 80), (100, 0), (100, 100)])
def test_parameters(spark, rate, spm):
    rows = [(i, f"some {i} words to cut {i}") for i in range(50)]
    got = fim.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), seed=1, rate=rate, spm=spm).collect()
    assert sorted((r.doc_id, r.n, r.form, r.output) for r in got) == sorted((d, *(w := by_hand(d, t, 1, rate, spm))[:2], w[4]) for d, t in rows)


def test_empty_table_and_plan(spark):
    rows = fim.fim_query(spark.createDataFrame([], "doc_id long, text string"))
    assert rows.count() == 0
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
