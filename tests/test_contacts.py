import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tarnkappe.functions import text as T
from tarnkappe.operators import contacts as C
from tarnkappe.plans import catalog

CASES = [
    ("Mail an anna.b@schule-x.de, bitte", [("email", "anna.b@schule-x.de", "certain")]),
    ("IBAN DE89 3704 0044 0532 0130 00 danke", [("iban", "DE89 3704 0044 0532 0130 00", "certain")]),
    ("IBAN DE89 3704 0044 0532 0130 01.", [("iban", "DE89 3704 0044 0532 0130 01", "uncertain")]),
    ("Lindenstraße 12a, 04109 Leipzig", [("address", "Lindenstraße 12a", "certain"), ("address", "04109 Leipzig", "certain")]),
    ("wohnt Am Markt 5 und 221B Baker Street", [("address", "Am Markt 5", "certain"), ("address", "221B Baker Street", "certain")]),
    ("Tel. 0341 / 123-4567 oder (030) 1234567", [("phone", "0341 / 123-4567", "certain"), ("phone", "(030) 1234567", "certain")]),
    ("2019 – 2021 und 12345678 sind nichts", []),
    ("CH-8001 Zürich", [("address", "CH-8001 Zürich", "certain")]),
    (None, []),
    ("", []),
]


def test_contacts(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "id int, text string")
    for r in rows.select("id", "text", C.contacts(F.col("text")).alias("c")).collect():
        assert [(x.kind, x.text, x.certainty) for x in (r.c or [])] == CASES[r.id][1], r
        for x in r.c or []:
            assert r.text[x.start : x.end] == x.text


def test_masking_and_switches(spark):
    df = spark.createDataFrame([("😀 a@b.de und 0341 1234567!",), (None,)], "text string")
    out = C.with_masked(df).collect()
    assert out[0].masked == "😀 [E-MAIL] und [TELEFON]!" and out[1].masked is None
    only = C.with_masked(df, options=C.ContactOptions(phone=False)).first()
    assert only.masked == "😀 [E-MAIL] und 0341 1234567!"


def test_mask_contacts_by_hand(spark, tmp_path):
    rows = [(i, t) for i, (t, _) in enumerate(CASES)] + [(100, " | ".join(t for t, _ in CASES if t))]
    want = {}
    for i, text in rows:
        spans = [s for _, found in CASES for s in found] if i == 100 else CASES[i][1]
        masked = text
        for kind, part, _ in spans:
            masked = masked.replace(part, {"email": "[E-MAIL]", "phone": "[TELEFON]", "iban": "[IBAN]", "address": "[ADRESSE]"}[kind], 1)
        want[i] = (*[sum(s[0] == kind for s in spans) for kind in ("email", "phone", "iban", "address")], masked)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = catalog.QUERIES["mask_contacts"](spark, f"file://{tmp_path}").collect()
    assert {r.doc_id: (r.n_email, r.n_phone, r.n_iban, r.n_address, r.masked) for r in got} == want and len(got) == len(rows)
    assert {"n_email", "n_phone", "n_iban", "n_address", "masked"} < set(entry.entry(spark).columns)


@pytest.mark.parametrize("word,key", [("Müller", "muller"), ("Yılmaz", "yilmaz"), ("Łukasz", "lukasz"), ("Groß", "gross"), ("D’Angelo", "d'angelo"), ("Nguyễn", "nguyen"), ("abc-d'e", "abc-d'e"), ("Ὀδυσσεύς", "οδυσσευς")])
def test_fold(spark, word, key):
    assert spark.createDataFrame([(word,)], "w string").select(T.fold(F.col("w"))).first()[0] == key


def test_letters(spark):
    ns = [0, 25, 26, 44, 51, 701, 702, 18277]
    got = spark.createDataFrame([(n,) for n in ns], "n long").select(T.letter_for(F.col("n"))).collect()
    assert [r[0] for r in got] == ["A", "Z", "AA", "AS", "AZ", "ZZ", "AAA", "ZZZ"]


def test_letters_of_all_longs(spark):
    def by_hand(n):
        out = ""
        while n >= 0:
            out, n = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"[n % 26] + out, n // 26 - 1
        return out

    ns = [*range(0, 1_000_000, 9973), 18_278, 475_253, 475_254, 475_255, 12_356_630, 2**53 + 1, 2**63 - 2, 2**63 - 1]
    got = spark.createDataFrame([(n,) for n in ns], "n long").select("n", T.letter_for(F.col("n")).alias("l")).collect()
    assert {r.n: r.l for r in got} == {n: by_hand(n) for n in ns}
    assert len({r.l for r in got}) == len(set(ns))


def test_apply_spans_drops_overlaps(spark):
    df = spark.sql("select 'abcdef' as t, array(named_struct('start',3,'end',5,'text','X'), named_struct('start',1,'end',4,'text','Y')) as r")
    assert df.select(T.apply_spans(F.col("t"), F.col("r"))).first()[0] == "aYef"
    assert spark.createDataFrame([("Jäger",), ("Meier",)], "w string").select(T.umlaut_variant(F.col("w"))).collect()[0][0] == "Jaeger"


def test_phone_query_with_letters_behind(spark, tmp_path):
    """The query counts what its SQL counts; masking leaves digits of longer words alone."""
    texts = ['token = "0641917ea4e9feb9"', "0341 1234567 12abc 030 7654321", "0341 1234567x, 0341 1234567", "a0341 1234567", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()["contact_phone"]).fetchall()
    got = [tuple(r) for r in catalog.contact_phone(spark, str(tmp_path)).select("doc_id", "phone", "n").collect()]
    assert sorted(got) == sorted(want) and (0, "0641917", 1) in got
    assert C.with_masked(spark.createDataFrame([(texts[0],)], "text string")).first().masked == texts[0]
