from pyspark.sql import functions as F

from tarnkappe.functions import ids
from tarnkappe.functions.lexicon import seed_names
from tarnkappe.functions.text import neutral_path
from tarnkappe.operators import checks, columns, organisations, reversible, review
from tarnkappe.operators.tokens import tokens
from tarnkappe.plans.pseudonymise import Options, pseudonymise
from tarnkappe.sources.text import encoded, sniff

UNIT = "doc_id long, unit_id int, text string"


def test_organisations_over_a_line_break(spark):
    terms = spark.createDataFrame([("Lindenauer Bürgerverein",), ("Haus am See",), ("See",)], "term string")
    lines = ["Der Lindenauer ", "  Bürgervereins Hof, Haus", "am See", "Lindenauer", "", "Bürgerverein", "Haus am", "See am Haus am See"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)] + [(2, 0, "Haus")], UNIT)
    tok = tokens(df)
    inside = organisations.find(tok, terms)
    across = organisations.find_across(tok, terms, inside)
    assert sorted((r.unit_id, r.start, r.end, r.term, r.suffix, r.rest) for r in across.collect()) == [
        (0, 4, 14, "Lindenauer Bürgerverein", "", False), (1, 2, 15, "Lindenauer Bürgerverein", "s", True), (1, 21, 25, "Haus am See", "", False),
        (2, 0, 6, "Haus am See", "", True), (6, 0, 7, "Haus am See", "", False), (7, 0, 3, "Haus am See", "", True),
    ]
    both = organisations.without_overlaps(inside, across)
    assert sorted((r.unit_id, r.start) for r in both.filter("not rest").collect()) == [(0, 4), (1, 21), (6, 0), (7, 7)]
    r = pseudonymise(df, seed_names(spark), Options(across_lines=True), org_terms=terms)
    assert [x.masked for x in r.output.filter("doc_id = 1").orderBy("unit_id").collect()][:3] == ["Der Einrichtung A ", "  s Hof, Einrichtung B", ""]
    assert r.findings.count() == 0
    r = pseudonymise(df, seed_names(spark), Options(mode="reversible", across_lines=True), org_terms=terms)
    back = reversible.restore(r.output.select("doc_id", "unit_id", F.col("masked").alias("text")), r.key)
    assert {(x.doc_id, x.unit_id): x.restored for x in back.collect()} == {(x.doc_id, x.unit_id): x.text for x in df.collect()}


def test_final_check(spark):
    found = spark.createDataFrame([(1, 0, 0, "Weber", "e", "weber"), (1, 0, 9, "Webers", "e", "weber"), (1, 1, 0, "Weber", "e", "weber")], "doc_id long, unit_id int, start int, word string, entity string, form string")
    off = spark.createDataFrame([(1, 0, "weber"), (1, 2, "weber")], "doc_id long, unit_id int, form string")
    places = spark.createDataFrame([(1, 3, 0, 4, "Haus", "")], "doc_id long, unit_id int, start int, end int, term string, suffix string")
    left = spark.createDataFrame([(1, 3, 0, 4, "Haus", ""), (1, 4, 2, 6, "Haus", "")], "doc_id long, unit_id int, start int, end int, term string, suffix string")
    points = checks.final_check(found, off, places, left).cache()
    assert sorted((r.unit_id, r.kind, r.start, r.word) for r in points.collect()) == [(0, "name", 9, "Webers"), (1, "name", 0, "Weber"), (3, "uncovered", 0, "Haus"), (4, "organisation", 2, "Haus")]
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    saved = lambda stamps: {(r.doc_id, r.points, r.saved) for r in checks.may_be_saved(docs, points, stamps).collect()}
    stamps = checks.state(points).select("doc_id", "stamp")
    assert saved(stamps.limit(0)) == {(1, 4, False), (2, 0, True)} and saved(stamps) == {(1, 4, True), (2, 0, True)}
    assert saved(checks.state(points.filter("unit_id > 0")).select("doc_id", "stamp")) == {(1, 4, False), (2, 0, True)}


def test_issues_of_a_restore(spark):
    key = spark.createDataFrame([(1, p, "x", 1) for p in ("Nachname A", "Vorname B2", "[E-MAIL-3]", "Einrichtung C")], "doc_id long, placeholder string, value string, count long")
    lines = ["Nachname A und Nachname Z, Name Q", "nachnamen a, Vorname\nB2, [email 3", "am Nachname  ", " A kam, Einrichtung", "C", "Vorname", "", "B2 telefon 3"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)] + [(1, 9, None)], UNIT)
    own = spark.createDataFrame([(1, "Name Q")], "doc_id long, word string")
    got = sorted((r.unit_id, r.start, r.kind, r.guess) for r in reversible.restore_issues(df, key, own).select("unit_id", "start", "kind", F.coalesce("guess", F.lit("")).alias("guess")).collect())
    assert got == [(0, 15, "unknown", ""), (1, 0, "inflected", "Nachname A"), (1, 13, "split", "Vorname B2"), (1, 25, "changed", "[E-MAIL-3]"), (2, 3, "split", "Nachname A"), (3, 8, "split", "Einrichtung C")]
    assert [(r.unit_id, r.placeholder) for r in reversible.leftovers(df, key).collect()] == [(0, "Nachname A")]


def test_tables_of_a_review(spark):
    df = spark.createDataFrame([(1, 0, "Da. Anna Müller ging! Ja"), (1, 1, "im Winter kam Rosen, Rose Weber"), (1, 2, "x" * 200 + " Weber " + "y" * 200)], UNIT)
    r = pseudonymise(df, seed_names(spark))
    shown = {(x.unit_id, x.word): (x.before, x.after) for x in review.contexts(r.hits.filter("kind = 'person'"), df).collect()}
    assert shown[0, "Anna Müller"] == ("", " ging!…") or shown[0, "Anna Müller"] == ("…", " ging!…")
    assert shown[2, "Weber"] == ("…" + "x" * 119 + " ", " " + "y" * 119 + "…")
    assert {(x.unit_id, x.start, x.context) for x in r.odd.collect()} == {(1, 3, "article"), (1, 14, "inflected")}
    rows = review.mapping(r.hits, df, F.concat(F.lit("Person "), "letter"))
    got = {x.label: (x.forms, x.active) for x in rows.collect()}
    assert got["Person A"] == ("Anna Müller", 1) and all(n > 0 for _, n in got.values())
    text = review.mapping_csv(rows).first().csv
    assert text.splitlines()[2] == '"Person A";"Anna Müller";"1"'
    asked = review.questions(r.hits)
    assert ("word", 1, 3) in {(x.kind, x.unit_id, x.start) for x in asked.collect()}
    assert review.questions(r.hits, asked.withColumn("yes", F.lit(False))).count() == 0


def test_moved_terms(spark):
    terms = spark.createDataFrame([(1, "person", "Anna  Berg"), (1, "org", "Haus"), (2, "org", "Haus")], "doc_id long, kind string, term string")
    edits = spark.createDataFrame([(0, 1, "org", "ANNA BERG"), (1, 1, "none", "haus"), (2, 2, "person", " "), (3, 2, "person", "Rose")], "nth long, doc_id long, kind string, term string")
    assert sorted(map(tuple, review.moved_terms(terms, edits).collect())) == [(1, "org", "ANNA BERG"), (2, "org", "Haus"), (2, "person", "Rose")]


def test_second_header(spark):
    grid = [["Nr", "Kontakt", "", "Kurs"], ["Nr", "Vorname", "Nachname", "Raum"], ["1", "Anna", "Berg", "Rot"], ["2", "Jo", "Kaya", "Blau"]]
    data = [["Name", "Kurs"], ["Anna", "Leitung"]]
    rows = [(1, "t", r, c, t) for r, row in enumerate(grid) for c, t in enumerate(row)] + [(2, "t", r, c, t) for r, row in enumerate(data) for c, t in enumerate(row)]
    cells = spark.createDataFrame(rows, "doc_id long, table_id string, r int, c int, text string")
    cols = columns.name_columns(cells)
    assert sorted((x.doc_id, x.c, x.role) for x in cols.collect()) == [(1, 1, "given"), (1, 2, "surname"), (2, 0, "name")]
    assert sorted((x.doc_id, x.r, x.text) for x in columns.name_cells(cells, cols).collect()) == [(1, 2, "Anna"), (1, 2, "Berg"), (1, 3, "Jo"), (1, 3, "Kaya"), (2, 1, "Anna")]


def test_ids(spark):
    names = ["x/anonymisiert_K7F3.docx", "anonymisiert_K7F3 (1).txt", "anonymisiert_AB23.txt", "brief_K7F3.txt", None]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert [r[0] for r in df.select(ids.id_of_name(F.col("name"))).collect()] == ["K7F3", "K7F3", None, None, None]
    states = spark.createDataFrame([(None, "K7F3", "K7F3"), ("A2B3", "K7F3", "K7F3"), (None, None, "K7F3"), ("A2B3", None, None)], "a string, b string, c string")
    assert [r[0] for r in states.select(ids.id_state(F.col("a"), F.col("b"), F.col("c"))).collect()] == ["ok", "other", "none", "old key"]
    drawn = spark.range(500).select(ids.is_id(ids.new_id(F.col("id"))).alias("fits"))
    assert drawn.filter("not fits").count() == 0


def test_labels_paths_and_bytes(spark):
    rows = spark.createDataFrame([("word/document.xml", r"C:\\Users\\anna\\x.txt"), ("word/comments.xml", "/home/anna/x"), ("xl/sharedStrings.xml", "file:///srv/x"), (None, None)], "part string, path string")
    got = rows.select(review.part_label(F.col("part")), neutral_path(F.col("path"))).collect()
    assert [tuple(r) for r in got] == [("text", r"C:\\Users\\benutzer\\x.txt"), ("comment", "/home/benutzer/x"), ("table", "file:///srv/x"), ("other", None)]
    data = spark.createDataFrame([("ä",)], "t string").select(encoded(F.col("t")), encoded(F.col("t"), mark=False)).first()
    assert (bytes(data[0]), bytes(data[1])) == ("ä".encode("utf-8-sig"), "ä".encode())
    assert sniff(b"a" * 5000 + b"\0", "a.txt") == "rejected: binary"
    forms = spark.createDataFrame([(1, "weber", "e", False)], "doc_id long, form string, entity string, ambiguous boolean")
    units = spark.createDataFrame([(1, 0, "Webers Hut, Weber"), (1, 1, "Hut"), (2, 0, "Weber"), (1, 2, None)], UNIT)
    assert [tuple(r) for r in review.holds_name(units, forms).collect()] == [(1, 0)]
