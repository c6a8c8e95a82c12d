from pyspark.sql import functions as F

from tarnkappe.functions.lexicon import seed_names
from tarnkappe.operators import checks, columns, linking, organisations, reversible
from tarnkappe.operators.tokens import tokens
from tarnkappe.plans.pseudonymise import Options, pseudonymise

LINES = ["Anna Müller traf Peter Weber. Frau Müllers Hund bellt.", "A. Müller, Tel. 0341 1234567, schrieb an weber@x.de.", "Herr Weber und Anna: Person A bleibt.", "Im Lindenauer Bürgerverein; des Lindenauer Bürgervereins", "MÜLLER ruft Müller2 an", ""]


def units(spark, lines=LINES):
    return spark.createDataFrame([(d, i, t) for d in (1, 2) for i, t in enumerate(lines)], "doc_id long, unit_id int, text string")


def masked(result, doc=1):
    return [r.masked for r in sorted(result.output.filter(F.col("doc_id") == doc).collect(), key=lambda r: r.unit_id)]


def test_person_mode(spark):
    orgs = spark.createDataFrame([("Lindenauer Bürgerverein",)], "term string")
    r = pseudonymise(units(spark), seed_names(spark), org_terms=orgs)
    out = masked(r)
    # "Person A" stands in the original, so letters start at B
    assert out[0] == "Person B traf Person C. Frau Person Bs Hund bellt."
    assert out[1] == "Person B, Tel. [TELEFON], schrieb an [E-MAIL]."
    assert out[2] == "Herr Person C und Person B: Person A bleibt."
    assert out[3] == "Im Einrichtung A; des Einrichtung As"
    assert out[5] == "" and masked(r, 2) == out
    assert {p.letter for p in r.persons.filter("doc_id = 1").collect()} == {"B", "C"}
    assert r.leaks.count() == 0


def test_reversible_round_trip(spark):
    r = pseudonymise(units(spark), seed_names(spark), Options(mode="reversible"))
    out = r.output.select("doc_id", "unit_id", F.col("masked").alias("text"))
    texts = masked(r)
    assert texts[0].startswith("Vorname A Nachname A traf Vorname B Nachname B.") and "[TELEFON-1]" in texts[1] and "Initiale A" in texts[1]
    back = reversible.restore(out, r.key).collect()
    original = {(x.doc_id, x.unit_id): x.text for x in units(spark).collect()}
    assert {(x.doc_id, x.unit_id): x.restored for x in back} == original
    assert {(x.doc_id, x.verdict) for x in reversible.verdict(reversible.restore_plan(out, r.key)).collect()} == {(1, "fitting"), (2, "fitting")}
    again = reversible.parse_key(reversible.key_json(r.key)).select("doc_id", "placeholder", "value", "count")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, r.key.select("doc_id", "placeholder", "value", "count").collect()))
    other = spark.createDataFrame([(1, 0, "nichts davon"), (2, 0, "Nachname Z9 und vorname a")], "doc_id long, unit_id int, text string")
    assert {x.doc_id: x.verdict for x in reversible.verdict(reversible.restore_plan(other, r.key)).collect()} == {1: "wrong", 2: "wrong"}
    assert [(x.doc_id, x.guess) for x in reversible.changed_placeholders(other, r.key).collect()] == [(2, "Vorname A")]


def test_long_letters_are_restored(spark):
    key = spark.createDataFrame([(1, "Nachname ABCD", "Weber", 1), (1, "Vorname AAAAA2", "Anna", 1)], "doc_id long, placeholder string, value string, count long")
    texts = spark.createDataFrame([(1, 0, "Vorname AAAAA2 Nachname ABCDs Hund")], "doc_id long, unit_id int, text string")
    assert reversible.restore(texts, key).first().restored == "Anna Webers Hund"
    edited = spark.createDataFrame([(1, 0, "Name Vorname aaaaa2, nachname_abcd")], "doc_id long, unit_id int, text string")
    assert sorted(x.guess for x in reversible.changed_placeholders(edited, key).collect()) == ["Nachname ABCD", "Vorname AAAAA2"]


def test_name_mode_and_overrides(spark):
    own = spark.createDataFrame([(1, 0, 0, 11, False)], "doc_id long, unit_id int, start int, end int, on boolean")
    r = pseudonymise(units(spark, LINES[:1]), seed_names(spark), Options(mode="name"), overrides=own)
    assert masked(r)[0] == "Anna Müller traf [NAME]. Frau [NAME]s Hund bellt." and masked(r, 2)[0].startswith("[NAME] traf")
    assert {(x.doc_id, x.word) for x in r.leaks.collect()} == {(1, "Müller")}


def test_answers_of_a_review(spark):
    lines = ["Anna Müller und A. Weber", "Müller kam, Peter Weber auch", "xaver quark, der Quarks", "Quark Xaver"]
    df = units(spark, lines)
    out = masked(pseudonymise(df, seed_names(spark), manual=spark.createDataFrame([(1, "Xaver  Quark")], "doc_id long, term string")))
    assert out[0] == "Person A und Person B" and out[1] == "Person A kam, Person C auch"
    assert out[2] == "Person D, der Person Ds" and out[3] == "Person D"
    one = spark.createDataFrame([(1, "N|a.|weber", "N|peter|weber")], "doc_id long, entity string, target string")
    apart = spark.createDataFrame([(1, "S|muller")], "doc_id long, own string")
    r = pseudonymise(df, seed_names(spark), merges=one, unlinks=apart)
    assert masked(r)[:2] == ["Person A und Person B", "Person C kam, Person B auch"]
    assert masked(r, 2)[:2] == ["Person A und Person B", "Person A kam, Person C auch"]


def test_name_columns_in_the_plan(spark):
    grid = [["Nr", "Vorname", "Nachname", "Notiz"], ["1", "Thi Lan", "Ngu", "Ngu fehlt"], ["2", "Jo", "N.N.", "-"]]
    rows = [(1, 10 * r + c, "t", r, c, t) for r, row in enumerate(grid) for c, t in enumerate(row)]
    table = spark.createDataFrame(rows, "doc_id long, unit_id int, table_id string, r int, c int, text string")
    r = pseudonymise(table, seed_names(spark), cells=table)
    out = {x.unit_id: x.masked for x in r.output.collect()}
    assert (out[11], out[12], out[13], out[21], out[22]) == ("Person A", "Person A", "Person A fehlt", "Person B", "N.N.")


def test_broken_keys(spark):
    rows = spark.createDataFrame([(1, ""), (2, "{"), (3, '{"version":9,"placeholders":[]}'), (4, '{"version":1,"placeholders":[]}'), (5, '{"version":1,"placeholders":[{"placeholder":"a","value":"b"},{"placeholder":"a","value":"c"}]}'), (6, '{"version":1,"placeholders":[{"placeholder":"a"}]}')], "doc_id long, key string")
    assert {x.doc_id: x.problem for x in reversible.parse_key(rows).collect()} == {1: "empty", 2: "not a key", 3: "unknown version", 4: "no placeholders", 5: "repeated placeholder", 6: "damaged entry"}


def test_merges_rings_and_islands(spark):
    hits = spark.createDataFrame([(1, c) for c in "abcdxyz"], "doc_id long, entity string")
    merges = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "c", "d"), (1, "x", "y"), (1, "y", "x"), (2, "z", "q")], "doc_id long, entity string, target string")
    assert sorted(r.entity for r in linking.resolve_merges(hits, merges).collect()) == list("ddddxxz")
    long = [(1, f"e{i:03d}", f"e{i + 1:03d}") for i in range(300)] + [(2, f"r{i:03d}", f"r{(i + 1) % 70:03d}") for i in range(70)] + [(2, "in", "r069")]
    hits = spark.createDataFrame([(1, "e000"), (1, "e299"), (2, "r050"), (2, "in")], "doc_id long, entity string")
    got = linking.resolve_merges(hits, spark.createDataFrame(long, "doc_id long, entity string, target string")).collect()
    assert sorted(r.entity for r in got) == ["e300", "e300", "r000", "r000"]
    rows = spark.createDataFrame([(1, 0, "e", 0, 3), (1, 0, "e", 4, 7), (1, 0, "f", 8, 9), (1, 0, "e", 10, 12)], "doc_id long, unit_id int, entity string, start int, end int")
    rows = rows.selectExpr("*", "'certain' as certainty", "'' as suffix", "false as titled", "false as off", "entity as single", "array(entity) as parts", "cast(null as string) as link")
    assert sorted((r.entity, r.start, r.end) for r in linking.joined_words(rows).collect()) == [("e", 0, 7), ("e", 10, 12), ("f", 8, 9)]


def test_organisations(spark):
    terms = spark.createDataFrame([("Haus",), ("Altes Haus am See",), ("St. Anna-Stift",)], "term string")
    df = units(spark, ["Das alte Haus; altes  HAUS am Sees Ufer", "im St. Anna-Stift", "Hausboot"])
    got = organisations.find(tokens(df), terms).filter("doc_id = 1").collect()
    assert sorted((r.unit_id, r.start, r.end, r.term, r.suffix) for r in got) == [(0, 9, 13, "Haus", ""), (0, 15, 34, "Altes Haus am See", "s"), (1, 3, 17, "St. Anna-Stift", "")]
    covered = spark.createDataFrame([(1, 0, 9, 13)], "doc_id long, unit_id int, start int, end int")
    assert organisations.uncovered(organisations.find(tokens(df), terms).filter("doc_id = 1"), covered).count() == 2


def test_name_columns(spark):
    grid = [["Liste 2024", "", "", ""], ["Nr", "Vorname", "Nachname", "Name der Schule"], ["1", "Thi Lan", "Ngu", "Hort"], ["2", "offen", "Berg", "x"], ["3", "Jo", "N.N.", "y"]]
    cells = spark.createDataFrame([(1, "t", r, c, t) for r, row in enumerate(grid) for c, t in enumerate(row)], "doc_id long, table_id string, r int, c int, text string")
    cols = columns.name_columns(cells)
    assert sorted((x.c, x.role) for x in cols.collect()) == [(1, "given"), (2, "surname")]
    found = columns.name_cells(cells, cols)
    assert sorted((x.r, x.text) for x in found.collect()) == [(2, "Ngu"), (2, "Thi Lan"), (3, "Berg"), (4, "Jo")]
    assert [(x.given, x.surname) for x in columns.row_persons(found).collect()] == [("Thi Lan", "Ngu")]


def test_table_without_a_header(spark):
    cells = spark.createDataFrame([(1, "t", r, c, t) for r, row in enumerate([["Anna", "Berg"], ["Jo", "Kaya"]]) for c, t in enumerate(row)], "doc_id long, table_id string, r int, c int, text string")
    assert columns.name_columns(cells).count() == 0
    own = spark.createDataFrame([(1, "t", 0, True)], "doc_id long, table_id string, c int, on boolean")
    assert sorted(x.text for x in columns.name_cells(cells, columns.name_columns(cells, own)).collect()) == ["Anna", "Jo"]


def test_leaks(spark):
    parts = spark.createDataFrame([(1, "P", "jager", "Jäger", False), (1, "Q", "rose", "Rose", True)], "doc_id long, entity string, key string, raw string, ambiguous boolean")
    texts = spark.createDataFrame([(1, 0, "JÄGERS Jaeger-Hof rose Rosen Rosenheim"), (2, 0, "Jäger")], "doc_id long, unit_id int, text string")
    got = checks.leaks(texts, checks.leak_forms(parts)).collect()
    assert sorted((r.doc_id, r.word, r.entity) for r in got) == [(1, "Jaeger-Hof", "P"), (1, "JÄGERS", "P"), (1, "Rosen", "Q")]
    before = spark.createDataFrame([(1, "JÄGERS")], "doc_id long, word string")
    assert sorted((r.word, r.n) for r in checks.new_leaks(checks.leaks(texts, checks.leak_forms(parts)), before).collect()) == [("Jaeger-Hof", 1), ("Rosen", 1)]
