"""Free strings of a document, names in its properties, and what the final check says of them."""

from pyspark.sql import functions as F

from tarnkappe.functions.lexicon import seed_names
from tarnkappe.operators import checks, strings
from tarnkappe.plans.pseudonymise import Options, pseudonymise

UNIT = "doc_id long, unit_id int, text string"
LINES = ["Anna Müller kam, Rose Weber auch.", "Im Lindenauer Verein; Tel. 0341 1234567"]
LABELS = ["Müllers Liste", "MUELLER, weber", "rosen Rose", "Verein, Lindenauer Vereins", "an x@y.de 0341 1234567", "Müller2 Annas", "", None, "Blatt 1"]


def plan(spark, mode, **more):
    units = spark.createDataFrame([(d, i, t) for d in (1, 2) for i, t in enumerate(LINES)], UNIT)
    labels = spark.createDataFrame([(1, 100 + i, t) for i, t in enumerate(LABELS)], UNIT)
    return pseudonymise(units, seed_names(spark), Options(mode=mode), org_terms=spark.createDataFrame([("Lindenauer Verein",)], "term string"), strings=labels, **more)


def shown(result):
    return [r.masked for r in result.strings.orderBy("unit_id").collect()]


def test_strings_get_what_the_units_give(spark):
    meta = spark.createDataFrame([(1, "Blatt, Anna", "person"), (1, "Microsoft Office User", "person"), (2, "Kurt.Blank@x.de", "person")], "doc_id long, name string, kind string")
    r = plan(spark, "person", meta_names=meta)
    assert shown(r) == ["Person As Liste", "Person A, Person B", "rosen Person B", "Verein, Einrichtung As", "an [E-MAIL] [TELEFON]", "Person A2 Person As", "", None, "Blatt 1"]
    # the author's word stands in a label only; what is left of a name in a label is found too
    got = sorted((x.unit_id, x.kind, x.word) for x in r.findings.filter("doc_id = 1").collect())
    assert ("108", "string", "Blatt") in [(str(a), b, c) for a, b, c in got] and not [x for x in got if x[2] == "Microsoft"]
    text = strings.labelled_text(r.output, r.strings.filter("unit_id = 100").withColumn("unit_id", F.lit(1)).union(r.strings.filter("unit_id = 108").withColumn("unit_id", F.lit(0)).withColumn("text", F.lit("Text"))))
    assert text.filter("doc_id = 1").first().text == "Person A kam, Person B auch.\n[Person As Liste] Im Einrichtung A; Tel. [TELEFON]"


def test_strings_by_exact_spelling(spark):
    r = plan(spark, "reversible")
    out = shown(r)
    assert out[0] == "Nachname As Liste"
    # spellings that no placeholder stands for, and digits glued to a name, can't be restored and say so
    assert out[1] == "Name A, Name B" and out[5] == "Name A Vorname As"
    assert out[3] == "Verein, Einrichtung As" and out[4] == "an [E-MAIL] [TELEFON-1]"


def test_names_of_properties(spark):
    meta = spark.createDataFrame([(1, "Dr. Jana Größe-Weiß", "person"), (1, r"SCHULE\k.quandt", "person"), (1, "eva_maria.berg@x.de", "person"), (1, "Admin", "person"), (1, "Haus am See", "org"), (1, "Office", "org"), (1, "-", "org")], "doc_id long, name string, kind string")
    assert {x.form for x in checks.meta_forms(meta).collect()} == {"jana", "grosse-weiss", "groesse-weiss", "quandt", "eva", "maria", "berg"}
    assert [x.term for x in checks.meta_terms(meta).collect()] == ["Haus am See"]
    units = spark.createDataFrame([(1, 0, "Am Haus  am Sees Ufer"), (2, 0, "Haus am See")], UNIT)
    assert [(x.doc_id, x.start, x.word) for x in checks.phrase_leaks(units, checks.meta_terms(meta)).collect()] == [(1, 3, "Haus am See")]


def test_difference_of_multisets(spark):
    row = "doc_id long, unit_id int, start int, word string, entity string, form string"
    known = spark.createDataFrame([(1, 0, 0, "Weber", "e", "weber"), (1, 0, 9, "WEBER", "e", "weber"), (2, 0, 0, "Kaya", "e", "kaya")], row)
    found = spark.createDataFrame([(1, 5, 0, "weber", "e", "weber"), (1, 5, 9, "Weber", "e", "weber"), (1, 6, 0, "Weber", "e", "weber"), (1, 6, 7, "Kaya", "e", "kaya")], row)
    assert sorted((x.unit_id, x.start, x.word) for x in checks.beyond(found, known).collect()) == [(6, 0, "Weber"), (6, 7, "Kaya")]
    assert checks.beyond(found, known.limit(0)).count() == 4 and checks.beyond(found.limit(0), known).count() == 0


def test_words_around_an_address_in_a_name(spark):
    rows = [(1, "quandt.58@mail8.x.de Jana, Berg", "person"), (2, "kaya.1@mail8.x.de", "text"), (3, "kaya.1@mail8.x.de", "person"), (4, r"SCHULE\Jana Berg", "person"), (5, r"von C:\Berg", "text"), (6, None, "person")]
    forms = checks.meta_forms(spark.createDataFrame(rows, "doc_id long, name string, kind string"))
    got = {k: {x.form for x in forms.collect() if x.doc_id == k} for k in range(1, 7)}
    assert {"quandt", "jana", "berg"} <= got[1] and {"kaya", "mail"} <= got[2]
    assert got[3] == {"kaya"} and got[4] == {"jana", "berg"} and got[5] == {"berg"} and got[6] == set()
