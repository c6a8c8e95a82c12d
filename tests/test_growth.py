"""What keeps the work of large tables in proportion: read from plans, and held against plain results."""

import contextlib
import io
import random
import re

import pytest
from pyspark.sql import functions as F

from tarnkappe.functions.lexicon import seed_names
from tarnkappe.functions.text import running, spans
from tarnkappe.operators import contacts, linking, organisations, reversible
from tarnkappe.operators.tokens import as_lines, flagged, stems, tokens, words_of
from tarnkappe.plans import catalog, computed
from tarnkappe.session import written

SF = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("extended")
    return out.getvalue()


def test_running_sums_in_a_row(spark):
    rng = random.Random(3)
    rows = [[rng.randrange(9) for _ in range(n)] for n in (0, 1, 63, 64, 65, 128, 129, 700)]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x array<int>").select("i", running(F.col("x")).alias("s")).collect()
    assert {r.i: r.s for r in got} == {i: [sum(x[: k + 1]) for k in range(len(x))] for i, x in enumerate(rows)}


def test_tokens_need_no_window(spark):
    """Only whole texts are shuffled, and tokens aren't sorted to find their places."""
    texts = ["", None, "  ", "Anna-Lena's  Haus,\t3 Äpfel!", " ".join(f"Wort{i} x" for i in range(150))]
    units = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id long, unit_id int, text string")
    df = tokens(units)
    said = plan(df)
    assert "Window" not in said and said.count("Exchange ") == 1
    for r in df.collect():
        text = texts[r.unit_id]
        assert text[r.start : r.end] == r.text and (text[r.start - len(r.gap) : r.start] == r.gap)
    rows = df.collect()
    assert [sum(r.unit_id == i for r in rows) for i in range(len(texts))] == [0, 0, 0, 6, 450]


def test_arrays_are_made_once(spark):
    """No filter by an array's size before it is made row by row, which would make it a second time."""
    units = spark.createDataFrame([(1, 0, "x")], "doc_id long, unit_id int, text string")
    for df in (contacts.contact_rows(units, ["doc_id"]), tokens(units)):
        optimized = plan(df).split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
        assert not re.search(r"Filter .*size\(", optimized)


@pytest.mark.parametrize("query", [computed.contact_places, computed.salutation_cells, catalog.name_columns])
def test_few_bytes_are_dealt_out(spark, query):
    assert "REPARTITION_BY_NUM" in plan(query(spark, SF)) or query is computed.salutation_cells
    assert "REPARTITION_BY_NUM" in plan(computed._cells(spark, SF))


def test_terms_of_one_letter_with_endings(spark):
    terms = spark.createDataFrame([("B",), ("Haus B",), ("ΟΔΟΣ",)], "term string")
    units = spark.createDataFrame([(1, 0, "Bs Hut"), (1, 1, "Haus B's Tor"), (1, 2, "Be, BN"), (1, 3, "ΟΔΟΣs")], "doc_id long, unit_id int, text string")
    got = {(r.unit_id, r.start, r.end, r.term, r.suffix) for r in organisations.find(tokens(units), terms).collect()}
    assert (0, 0, 2, "B", "s") in got and (1, 0, 8, "Haus B", "'s") in got and any(x[0] == 3 for x in got)


def test_spans_compile_no_split_pattern(spark):
    """Places as Python's search finds them, also beside NULs, which the matches are put between; a split by the pattern is
    left to texts that hold one."""
    pattern = "(?<![a-z])[ab]+[0-9]"
    texts = ["", "a1", "xa1 b2", "\U0001f600 ab3b4", "none", "a1\0b2 \0", "\0", "$0 a1 \\1", " ".join(f"a{i % 10}" for i in range(200))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", spans(F.col("t"), pattern).alias("s"))
    assert {r.i: [tuple(x) for x in r.s] for r in df.collect()} == {i: [(m.start(), m.end(), m.group()) for m in re.finditer(pattern, t)] for i, t in enumerate(texts)}
    assert spark.createDataFrame([(None,)], "t string").select(spans(F.col("t"), pattern).alias("s")).first().s == []
    said = plan(df).split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert "regexp_replace(t" in said


def test_words_are_found_without_tokens(spark):
    units = spark.createDataFrame([(1, 0, "Anna-Lena's  Haus, 3 Äpfel! Haus"), (1, 1, None), (2, 0, " ")], "doc_id long, unit_id int, text string")
    df = words_of(units)
    assert sorted(r.text for r in df.collect()) == sorted(r.text for r in tokens(units).filter("word").select("text").distinct().collect())
    assert "aggregate(" not in plan(df)


def test_stems_of_words_without_an_ending(spark):
    words = ["", "s", "Haus", "Anna", "WEBERS", "Müllers", "n", "X’", "Peter’s", "Bo", "NS"]
    got = {r.w: [(x.stem, x.suffix) for x in r.s] for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", stems(F.col("w")).alias("s")).collect()}
    assert got["Anna"] == [("Anna", "")] and got["Bo"] == [("Bo", "")] and got[""] == []
    assert got["Haus"] == [("Haus", ""), ("Hau", "s")] and got["WEBERS"] == [("WEBERS", ""), ("WEBER", "S")] and got["s"] == [("s", "")]
    assert got["Peter’s"] == [("Peter’s", ""), ("Peter", "’s"), ("Peter’", "s")]


def test_lines_of_tokens_are_not_shuffled_for_parts(spark):
    """Parts of names are looked up by their keys; only places that fit meet the hits of their unit."""
    units = spark.createDataFrame([(1, 0, "Anna Müller kam"), (1, 1, "dort Müllers Haus, Frau Weber"), (2, 0, "Müller")], "doc_id long, unit_id int, text string")
    lines = written(as_lines(flagged(tokens(units), seed_names(spark))), "test-lines")
    owned = spark.createDataFrame([(1, "muller", "N|anna|muller"), (1, "weber", "S|weber")], "doc_id long, key string, entity string")
    taken = spark.createDataFrame([(1, 0, 0, 11)], "doc_id long, unit_id int, start int, end int")
    df = linking.propagate(lines, owned, taken)
    assert sorted((r.doc_id, r.unit_id, r.start, r.end, r.suffix) for r in df.collect()) == [(1, 1, 5, 12, "s"), (1, 1, 24, 29, "")]
    for line in plan(df).split("== Physical Plan ==")[1].splitlines():
        assert not re.search(r"Exchange .*tokens", line)
    assert "tokens" not in "".join(x for x in plan(df).split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0].splitlines() if "Join " in x)


def test_changed_placeholders_need_no_join_of_places(spark):
    """Exact places are taken out inside the row, and all kinds of issues look into the key in one join."""
    units = spark.createDataFrame([(1, 0, "Nachname A, nachname a [email 3 und [E-MAIL-3] Nachname Q"), (1, 1, "Vorname"), (1, 2, "B")], "doc_id long, unit_id int, text string")
    key = spark.createDataFrame([(1, "Nachname A"), (1, "Vorname B"), (1, "[E-MAIL-3]")], "doc_id long, placeholder string")
    df = reversible.restore_issues(units, key)
    got = sorted((r.unit_id, r.start, r.kind, r.text, r.guess or "") for r in df.collect())
    assert got == [(0, 12, "changed", "nachname a", "Nachname A"), (0, 23, "changed", "[email 3", "[E-MAIL-3]"), (0, 47, "unknown", "Nachname Q", ""), (1, 0, "split", "Vorname | B", "Vorname B")]
    said = plan(df).split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert said.count("Join ") == 2 and said.count("Aggregate ") == 1
    assert "Broadcast" not in plan(df).split("== Physical Plan ==")[1]
