"""Queries over strings, tables and logs that both engines compute alike from the given tables, with SQL for each.

What is looked for, and where it stands, differs from row to row, so a query whose operator does nothing gives other rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnkappe.functions import lexicon
from tarnkappe.functions.text import fold
from tarnkappe.operators import checks, columns, linking, reversible, review, strings, versions
from tarnkappe.operators.contacts import EMAIL, contact_rows
from tarnkappe.operators.mentions import person_mentions
from tarnkappe.operators.tokens import as_lines, flagged, tiles, tokens
from tarnkappe.plans.catalog import FOLDED, LETTER, ONLY_EMAIL, TILES_RE2, table
from tarnkappe.plans.pseudonymise import Options, pseudonymise
from tarnkappe.session import dealt


def _longs(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with columns cast to long, as SQL counts."""
    return df.select(*[F.col(c).cast("long").alias(c) if c in names else F.col(c) for c in df.columns])


def labels_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as free strings: words of six letters and more of the first turn are a dictionary of active forms."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("unit_id"), "text")
    words = turns.filter("unit_id = 0").select("doc_id", F.explode(tiles(F.coalesce("text", F.lit("")))).alias("word")).filter(F.col("word").rlike(r"^[\p{L}\p{M}]{6,}$"))
    forms = words.select("doc_id", fold(F.col("word")).alias("form")).distinct()
    forms = forms.select("doc_id", "form", (F.char_length("form") % 2 == 0).alias("ambiguous"), F.concat(F.lit("<"), "form", F.lit(">")).alias("label"))
    return strings.masked_strings(turns, forms, ONLY_EMAIL).select("doc_id", "unit_id", "masked")


#: Ends of names, and a word folded, in SQL over a column ``w``.
_ENDS = "(VALUES ('', false), ('''s', false), ('’s', false), ('''', false), ('’', false), ('s', false), ('es', false), ('n', false), ('ns', false), ('''S', true), ('’S', true), ('S', true), ('ES', true), ('N', true), ('NS', true)) AS ends(e, caps)"
_W = FOLDED.replace("token", "w")


def file_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's title names its authors: their words in title and address, beyond those that stand in its navigation."""
    pages = table(spark, sf_dir, "pages")
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    forms = checks.meta_forms(pages.select(F.col("page_id").alias("doc_id"), title.alias("name"), F.lit("text").alias("kind")))
    unit = lambda n, text: pages.select(F.col("page_id").alias("doc_id"), F.lit(n).alias("unit_id"), text.alias("text"))
    beside = checks.leaks(unit(1, title).unionByName(unit(2, F.col("url"))), forms)
    left = checks.leaks(unit(0, F.regexp_extract("html", r"(?s)<nav>(.*?)</nav>", 1)), forms)
    return checks.beyond(beside, left).groupBy("doc_id", fold(F.col("word")).alias("folded")).agg(F.count("*").alias("n"))


#: Three cells in each of three rows for each customer: a salutation or another word over one or two columns, sometimes over
#: the next row as well; a name, left out for some; and a word. k is the customer's key.
_CELLS = """
SELECT k AS doc_id, k * 10 + r * 3 + i AS unit_id, 't' AS table_id, r, CASE i WHEN 0 THEN 0 WHEN 1 THEN 1 + k % 2 ELSE 2 + k % 2 END AS c,
  CASE WHEN i = 0 AND r = 1 AND k % 3 = 0 THEN 2 ELSE r END AS r2, CASE i WHEN 0 THEN k % 2 WHEN 1 THEN 1 + k % 2 ELSE 2 + k % 2 END AS c2,
  CASE i WHEN 0 THEN CASE (k + r) % 4 WHEN 0 THEN 'Frau' WHEN 1 THEN 'Herr Dr.' WHEN 2 THEN 'Raum' ELSE 'Frau Prof.' END WHEN 1 THEN concat('Q', lower(seg), 'xyz') ELSE 'heute' END AS text
FROM (SELECT c_custkey AS k, c_mktsegment AS seg FROM customer) AS a CROSS JOIN (VALUES (0), (1), (2)) AS b(r) CROSS JOIN (VALUES (0), (1), (2)) AS d(i)
WHERE NOT (i = 1 AND k % 5 = 0) AND NOT (i = 0 AND r = 2 AND k % 3 = 0)"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.explode(F.expr("flatten(transform(sequence(0, 2), r -> transform(sequence(0, 2), i -> struct(r, i))))")).alias("g")
    base = dealt(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("seg"), rows).select("k", "seg", "g.*")
    body = _CELLS[_CELLS.index("SELECT") : _CELLS.index("FROM")] + "FROM {base} " + _CELLS[_CELLS.index("WHERE") :]
    return spark.sql(body, base=base)


def neighbour_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is to the left of each cell, with merged columns and rows."""
    return _longs(columns.left_neighbours(_cells(spark, sf_dir)), "unit_id", "left_unit")


def salutation_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of which only the cell to the left says that they are some; every fourth customer's are headings."""
    cells = _cells(spark, sf_dir)
    layout = cells.select("doc_id", "unit_id", F.lit(False).alias("follows"), (F.col("doc_id") % 4 == 0).alias("heading"))
    found = person_mentions(flagged(tokens(cells), lexicon.seed_names(spark)), lefts=columns.left_neighbours(cells), layout=layout)
    return _longs(found.select("doc_id", "unit_id", "start", "end", "certainty", "off", "grp"), "unit_id", "start", "end")


#: Lists of names in which a text stands in many rows: given names and surnames by the customer's place in a nation's list.
_LIST = "SELECT c_nationkey AS doc_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r, c_custkey AS k FROM customer"
_GIVEN_UNIT, _SURNAME_UNIT = "CASE WHEN r % 3 = 0 THEN 1000 + k % 7 ELSE 100000 + r % 50 END", "CASE WHEN r % 3 = 0 THEN 2000 + k % 5 ELSE 200000 + r % (50 + 50 * (r % 2)) END"


def shared_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose given name and surname stand beside each other wherever either stands; every eleventh row has no surname."""
    rows = spark.sql(_LIST.replace("FROM customer", "FROM {c}"), c=table(spark, sf_dir, "customer"))
    side = lambda unit, role, keep: rows.filter(keep).select("doc_id", F.lit("t").alias("table_id"), "r", F.lit(0).alias("c"), F.expr(unit).alias("unit_id"), F.concat(F.lit(role[0].upper()), F.expr(unit).cast("string")).alias("text"), F.lit(role).alias("role"))
    names = side(_GIVEN_UNIT, "given", "true").unionByName(side(_SURNAME_UNIT, "surname", "r % 11 <> 0"))
    return _longs(columns.row_persons(names).select("doc_id", "r", "given", "surname"), "r")


#: Hits, one for each order, and what a review says of them.
_HITS = """SELECT o_custkey AS doc_id, o_orderkey AS unit_id, o_orderkey % 9 AS start, o_orderkey % 9 + 5 AS "end", concat('S|', o_orderkey % 3) AS entity, 'person' AS kind,
 CASE WHEN o_orderkey % 2 = 0 THEN 'certain' ELSE 'uncertain' END AS certainty, o_orderkey % 5 <> 0 AS "on", CASE WHEN o_orderkey % 3 = 1 THEN 'a|x' END AS grp,
 CASE WHEN o_orderkey % 4 = 1 THEN 'article' END AS context, o_orderkey % 13 = 0 AS calendar, o_orderkey % 17 = 0 AS caps FROM orders"""


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_HITS.replace("FROM orders", "FROM {o}").replace('"', "`"), o=table(spark, sf_dir, "orders"))


def _answers(hits: DataFrame) -> DataFrame:
    places = hits.filter("unit_id % 7 = 0").select("doc_id", F.lit("place").alias("kind"), "entity", "unit_id", "start", (F.col("unit_id") % 2 == 0).alias("yes"))
    words = hits.select("doc_id", "entity").distinct().filter("doc_id % 3 <> 0").select("doc_id", F.lit("word").alias("kind"), "entity", F.lit(None).cast("long").alias("unit_id"), F.lit(None).cast("long").alias("start"), (F.col("doc_id") % 3 == 1).alias("yes"))
    return places.unionByName(words.filter("entity <> 'S|2'"))


def switched_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits switched by place, by answers about places and words, and by group, in this order of precedence."""
    hits = _hits(spark, sf_dir)
    overrides = hits.filter("unit_id % 11 = 0").select("doc_id", "unit_id", "start", "end", (F.col("unit_id") % 22 == 0).alias("on"))
    groups = hits.select("doc_id", "grp").filter("grp is not null and doc_id % 2 = 0").distinct().withColumn("on", F.col("doc_id") % 4 == 0)
    return review.switched(hits, overrides, _answers(hits), groups).select("doc_id", "unit_id", "on")


def open_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is still to be asked about the same hits after the same answers."""
    hits = _hits(spark, sf_dir)
    return review.questions(hits, _answers(hits))


def key_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as the log of a document: purchases save a key, clicks change the hits, all others open the file.

    Each opening gets the number of the id at that time, and the newest key that was saved until then for that id.
    """
    event = F.when(F.col("event_type") == "purchase", "saved").when(F.col("event_type") == "click", "changed").otherwise("opened")
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("ts").alias("stamp"), event.alias("event"), "event_id")
    log = versions.id_numbers(log)
    keys = log.filter("event = 'saved'").select("doc_id", "id_number", "stamp", F.col("event_id").alias("key"))
    files = log.filter("event = 'opened'").select("doc_id", "id_number", "stamp", "event_id")
    return versions.keys_as_of(files, keys, ["doc_id", "id_number"]).select("event_id", "id_number", "key")


#: Lines with a weekday or month that is a name too. A heading of the length of the order's key stands before.
_DATE_LINES = "CASE o_orderkey % 6 WHEN 0 THEN 'Am 3. Jan. war es kalt' WHEN 1 THEN 'Gestern kam Jan zu uns' WHEN 2 THEN 'Termin Do 13:30 im Haus' WHEN 3 THEN 'es war Do. und kalt' WHEN 4 THEN 'Termin Do 05.10. im Haus' ELSE 'Frau Do 13:30 im Haus' END"


def date_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short weekdays and months: off with a full stop, no name before a time or a date, names otherwise."""
    text = F.concat(F.lit("Akte "), F.col("o_orderkey").cast("string"), F.lit(": "), F.expr(_DATE_LINES))
    units = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(0).alias("unit_id"), text.alias("text"))
    names = lexicon.seed_names(spark).unionByName(spark.range(1).select(F.lit("do").alias("key"), F.lit(False).alias("first"), F.lit(True).alias("last"), F.lit(False).alias("ambiguous")))
    found = person_mentions(flagged(tokens(units), names))
    return _longs(found.select("doc_id", "start", "end", "certainty", "off", "calendar"), "start", "end")


def lexicon_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name table out of words with a capital, as given names and surnames by their length; words of the same documents in
    small letters are ordinary words, those of up to three letters stop words."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.split(F.coalesce("text", F.lit("")), "[ \\n\\t]+")).alias("word")).distinct().filter("word <> ''")
    capital = words.filter(F.col("word").rlike(r"^\p{Lu}"))
    n = F.char_length("word")
    sources = capital.select(F.col("word").alias("name"), F.when(n % 3 == 0, "first").when(n % 3 == 1, "last").otherwise("both").alias("kind"), (n % 2 == 0).alias("curated"))
    small = words.filter(F.col("word").rlike(r"^\p{Ll}+$"))
    return lexicon.name_table(sources, small.filter(F.char_length("word") <= 3), small)


#: A name marked by hand, out of the customer's segment, in five spellings.
_CAPS_LINES = "CASE o_orderkey % 5 WHEN 0 THEN concat('am ', seg, 'S') WHEN 1 THEN concat('am ', lower(seg), 's') WHEN 2 THEN concat('am ', initcap(seg)) WHEN 3 THEN concat('am ', seg) ELSE concat('am ', seg, 'EN') END"


def manual_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of a name marked by hand: on in any spelling, but off where an ending in capitals stands behind capitals."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("seg"))
    orders = table(spark, sf_dir, "orders").join(customers, "o_custkey")
    units = orders.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("unit_id"), F.expr(_CAPS_LINES).alias("text"))
    parts = linking.manual_parts(customers.select(F.col("o_custkey").alias("doc_id"), F.initcap("seg").alias("term")))
    nothing = units.limit(0).select("doc_id", "unit_id", F.lit(0).alias("start"), F.lit(0).alias("end"))
    found = linking.propagate(as_lines(flagged(tokens(units), lexicon.seed_names(spark))), parts, nothing, marked=True)
    return _longs(found.select("doc_id", "unit_id", "start", "end", "entity", "suffix", "certainty", "off", "caps"), "start", "end")


#: A text for each customer with contacts of all kinds; the account's check digits are computed.
_BBAN = "lpad(CAST(c_custkey * 7919 AS {text}), 18, '0')"
_CHECK = "lpad(CAST(98 - CAST(concat({bban}, '131400') AS {big}) % 97 AS {text}), 2, '0')"
_CONTACTS = {
    "iban": "concat('DE', {check}, {bban})", "wrong": "concat('AT', {wrong}, {bban})", "street": "concat(upper(substr(c_mktsegment, 1, 1)), lower(substr(c_mktsegment, 2)), CASE WHEN c_custkey % 3 = 0 THEN 'straße ' WHEN c_custkey % 3 = 1 THEN 'weg ' ELSE 'gasse ' END, c_custkey % 200 + 1)",
    "town": "concat(lpad(CAST(c_custkey % 100000 AS {text}), 5, '0'), ' ', upper(substr(c_mktsegment, 1, 1)), lower(substr(c_mktsegment, 2)))", "phone": "concat('0', 100 + c_custkey % 900, ' / ', 1000000 + c_custkey)", "mail": "concat('0341', 1000 + c_custkey, '@', lower(c_mktsegment), '.de')",
}
_PARTS = ["'Konto '", "iban", "', dann '", "wrong", "', wohnt '", "street", "', '", "town", "', Tel. '", "phone", "' oder '", "mail", "' gut'"]


def _contact_sql(text: str, big: str) -> dict[str, str]:
    bban = _BBAN.format(text=text)
    check = _CHECK.format(bban=bban, big=big, text=text)
    wrong = f"lpad(CAST((98 - CAST(concat({bban}, '102900') AS {big}) % 97) % 97 + 3 AS {text}), 2, '0')"
    return {k: v.format(check=check, bban=bban, wrong=wrong, text=text) for k, v in _CONTACTS.items()}


def contact_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts of all kinds at computed places: a mailbox that looks like a phone number is one contact, an account number
    with wrong check digits is uncertain."""
    parts = _contact_sql("string", "decimal(38,0)")
    rows = dealt(table(spark, sf_dir, "customer"), "c_custkey").select(F.col("c_custkey").alias("doc_id"), *[F.expr(v).alias(k) for k, v in parts.items()])
    found = contact_rows(rows.select("doc_id", F.expr(f"concat({', '.join(_PARTS)})").alias("text")), ["doc_id"])
    return _longs(found.select("doc_id", "kind", "start", "end", "certainty"), "start", "end")


_REVERSIBLE = ["Anna Müller", "Peter Weber", "Frau Müllers", "Herr Weber", "A. Müller", "MÜLLERS", "anna@x.de", "niemand"]


def reversible_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters made from orders with reversible placeholders, restored by their key, and how many placeholders the key has."""
    name = f"element_at(array({', '.join(repr(n) for n in _REVERSIBLE)}), cast(o_orderkey % 8 + 1 as int))"
    units = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("unit_id"), F.expr(f"concat('Gestern kam ', {name}, ' zu Besuch.')").alias("text"))
    result = pseudonymise(units, lexicon.seed_names(spark), Options(mode="reversible"))
    back = reversible.restore(result.output.select("doc_id", "unit_id", F.col("masked").alias("text")), result.key)
    entries = result.key.groupBy("doc_id").agg(F.count("*").alias("n_key"))
    return back.select("doc_id", "unit_id", F.col("text").alias("masked"), "restored").join(entries, "doc_id", "left").withColumn("n_key", F.coalesce("n_key", F.lit(0)))


QUERIES = {f.__name__: f for f in (labels_masked, file_check, neighbour_cells, salutation_cells, shared_names, switched_hits, open_questions, key_versions, date_words, lexicon_build, manual_caps, contact_places, reversible_letters)}

_SAID = f"""WITH h AS ({_HITS}),
 s AS (SELECT *, certainty = 'uncertain' AND NOT calendar AND NOT caps AS unsure, CASE WHEN unit_id % 11 = 0 THEN unit_id % 22 = 0 END AS own, CASE WHEN unit_id % 7 = 0 THEN unit_id % 2 = 0 END AS place,
  CASE WHEN doc_id % 3 <> 0 AND entity <> 'S|2' THEN doc_id % 3 = 1 END AS word, CASE WHEN grp IS NOT NULL AND doc_id % 2 = 0 THEN doc_id % 4 = 0 END AS team FROM h)"""
_AT = {k: f"length(concat({', '.join(_PARTS[:i])}))" for i, k in enumerate(_PARTS) if i % 2}
_KIND = {"iban": "iban", "wrong": "iban", "street": "address", "town": "address", "phone": "phone", "mail": "email"}
_CONTACT_DUCK = _contact_sql("VARCHAR", "HUGEINT")

ORACLE_SQL = {
    "labels_masked": rf"""WITH f AS (SELECT DISTINCT doc_id, {_W} AS form FROM (SELECT conv_id AS doc_id, unnest(regexp_extract_all(text, '{TILES_RE2}')) AS w FROM conversations WHERE turn = 0) WHERE regexp_matches(w, '^[\p{{L}}\p{{M}}]{{6,}}$')),
 t AS (SELECT conv_id AS doc_id, turn AS unit_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{EMAIL}|{TILES_RE2}') AS ts FROM conversations),
 x AS (SELECT doc_id, unit_id, i, ts[i] AS token, regexp_extract(ts[i], '(?:[''’]s|s)$') AS e FROM t, range(1, len(ts) + 1) AS r(i)),
 y AS (SELECT *, regexp_matches(token, '^[\p{{L}}\p{{M}}]') AND NOT contains(token, '@') AS word, {FOLDED} AS k, {FOLDED.replace('token', "left(token, length(token) - length(e))")} AS kk, upper(left(token, 1)) = left(token, 1) AND lower(left(token, 1)) <> left(token, 1) AS cap FROM x),
 z AS (SELECT y.*, a.form AS a, b.form AS b FROM y LEFT JOIN f a ON a.doc_id = y.doc_id AND a.form = y.k AND (length(a.form) % 2 = 1 OR cap) LEFT JOIN f b ON e <> '' AND b.doc_id = y.doc_id AND b.form = y.kk AND (length(b.form) % 2 = 1 OR cap))
 SELECT t.doc_id, t.unit_id, coalesce(string_agg(CASE WHEN contains(token, '@') AND length(token) > 1 THEN '[E-MAIL]' WHEN word AND a IS NOT NULL THEN '<' || a || '>' WHEN word AND b IS NOT NULL THEN '<' || b || '>' || e ELSE token END, '' ORDER BY i), '') AS masked
 FROM t LEFT JOIN z ON z.doc_id = t.doc_id AND z.unit_id = t.unit_id GROUP BY 1, 2""",
    "file_check": rf"""WITH p AS (SELECT page_id AS doc_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) AS body FROM pages),
 raw AS (SELECT doc_id, unnest(regexp_extract_all(title, '{TILES_RE2}')) AS w FROM p),
 f AS (SELECT DISTINCT doc_id, {_W} AS form FROM raw WHERE regexp_matches(w, '^[\p{{L}}\p{{M}}]') AND length({_W}) >= 2 AND {_W} NOT IN (SELECT unnest(string_split('{checks.NOBODY} {lexicon.STRONG_TITLES} {lexicon.WEAK_TITLES} {lexicon.PARTICLES} {lexicon.STOP}', ' ')))
  UNION SELECT DISTINCT doc_id, {FOLDED.replace('token', "replace(replace(replace(replace(replace(replace(w, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'Ä', 'Ae'), 'Ö', 'Oe'), 'Ü', 'Ue')")} FROM raw WHERE regexp_matches(w, '^[\p{{L}}\p{{M}}]') AND regexp_matches(w, '[äöüÄÖÜ]') AND length({_W}) >= 2 AND {_W} NOT IN (SELECT unnest(string_split('{checks.NOBODY} {lexicon.STRONG_TITLES} {lexicon.WEAK_TITLES} {lexicon.PARTICLES} {lexicon.STOP}', ' ')))),
 u AS (SELECT doc_id, 0 AS u, body AS text FROM p UNION ALL SELECT doc_id, 1, title FROM p UNION ALL SELECT doc_id, 2, url FROM p),
 t AS (SELECT doc_id, u, regexp_extract_all(text, '{TILES_RE2}') AS ts FROM u),
 x AS (SELECT doc_id, u, i, ts[i] AS word FROM t, range(1, len(ts) + 1) AS r(i) WHERE regexp_matches(ts[i], '^[\p{{L}}\p{{M}}]')),
 pieces AS (SELECT DISTINCT doc_id, u, i, word, piece FROM (SELECT doc_id, u, i, word, unnest(list_append(string_split(word, '-'), word)) AS piece FROM x)),
 cuts AS (SELECT doc_id, u, i, word, left(piece, length(piece) - length(e)) AS w, caps FROM pieces CROSS JOIN {_ENDS} WHERE (e = '' OR (ends_with(piece, e) AND length(piece) > length(e)))),
 good AS (SELECT DISTINCT c.doc_id, u, i, word FROM (SELECT *, {_W} AS k FROM cuts WHERE NOT caps OR (length(w) > 1 AND w = upper(w) AND w <> lower(w))) c JOIN f ON f.doc_id = c.doc_id AND f.form = c.k),
 n AS (SELECT doc_id, {FOLDED.replace('token', 'word')} AS folded, count(*) FILTER (u > 0) - count(*) FILTER (u = 0) AS n FROM good GROUP BY 1, 2)
 SELECT doc_id, folded, n FROM n WHERE n > 0""",
    "neighbour_cells": f"""WITH g AS ({_CELLS}) SELECT DISTINCT a.doc_id, CAST(a.unit_id AS BIGINT) AS unit_id, CAST(b.unit_id AS BIGINT) AS left_unit FROM g a JOIN g b ON a.doc_id = b.doc_id AND b.c2 = a.c - 1 AND b.r <= a.r2 AND b.r2 >= a.r""",
    "salutation_cells": f"""WITH g AS ({_CELLS}), l AS (SELECT DISTINCT a.doc_id, a.unit_id, a.text FROM g a JOIN g b ON a.doc_id = b.doc_id AND b.c2 = a.c - 1 AND b.r <= a.r2 AND b.r2 >= a.r WHERE b.text IN ('Frau', 'Herr Dr.', 'Frau Prof.'))
 SELECT doc_id, CAST(unit_id AS BIGINT) AS unit_id, CAST(0 AS BIGINT) AS start, CAST(length(text) AS BIGINT) AS "end", 'uncertain' AS certainty, false AS "off", 'a|' || lower(text) AS grp FROM l WHERE text <> 'heute' AND doc_id % 4 <> 0""",
    "shared_names": f"""WITH l AS ({_LIST}), n AS (SELECT doc_id, r, {_GIVEN_UNIT} AS g, CASE WHEN r % 11 <> 0 THEN {_SURNAME_UNIT} END AS s FROM l),
 a AS (SELECT doc_id, g FROM n GROUP BY 1, 2 HAVING count(DISTINCT s) = 1 AND count(s) = count(*)), b AS (SELECT doc_id, s FROM n WHERE s IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT g) = 1)
 SELECT n.doc_id, CAST(r AS BIGINT) AS r, 'G' || CAST(n.g AS VARCHAR) AS given, 'S' || CAST(n.s AS VARCHAR) AS surname FROM n JOIN a ON a.doc_id = n.doc_id AND a.g = n.g JOIN b ON b.doc_id = n.doc_id AND b.s = n.s""",
    "switched_hits": f"""{_SAID} SELECT doc_id, unit_id, coalesce(own, place, CASE WHEN unsure AND (NOT word OR context IS NULL) THEN word END, team, "on") AS "on" FROM s""",
    "open_questions": f"""{_SAID}, e AS (SELECT doc_id, entity, min(unit_id) FILTER (unsure AND context IS NULL) AS plain, min(unit_id) FILTER (unsure) AS least, count(*) FILTER (unsure AND context IS NULL) AS n_plain, count(*) FILTER (unsure) AS n_unsure,
  bool_or(certainty = 'certain' AND NOT caps) AS sure, any_value(CASE WHEN doc_id % 3 <> 0 AND entity <> 'S|2' THEN doc_id % 3 = 1 END) AS yes FROM s GROUP BY 1, 2)
 SELECT doc_id, 'word' AS kind, entity, coalesce(plain, least) AS unit_id, coalesce(plain, least) % 9 AS start, CASE WHEN plain IS NOT NULL THEN n_plain ELSE n_unsure END AS places FROM e WHERE yes IS NULL AND (plain IS NOT NULL OR (least IS NOT NULL AND NOT sure))
 UNION ALL SELECT s.doc_id, 'place', s.entity, unit_id, start, 1 FROM s JOIN e ON e.doc_id = s.doc_id AND e.entity = s.entity WHERE ((sure AND yes IS NULL) OR yes) AND ((context IS NOT NULL AND NOT calendar) OR caps) AND unit_id % 7 <> 0""",
    "key_versions": """WITH l AS (SELECT user_id AS doc_id, ts, event_id, CASE event_type WHEN 'purchase' THEN 'saved' WHEN 'click' THEN 'changed' ELSE 'opened' END AS event FROM events),
 k AS (SELECT doc_id, event_id, event = 'changed' AND lag(event) OVER (PARTITION BY doc_id ORDER BY ts) = 'saved' AS fresh FROM l WHERE event <> 'opened'),
 v AS (SELECT l.*, CAST(coalesce(sum(CAST(coalesce(fresh, false) AS INTEGER)) OVER (PARTITION BY l.doc_id ORDER BY ts ROWS UNBOUNDED PRECEDING), 0) AS BIGINT) AS id_number FROM l LEFT JOIN k ON k.event_id = l.event_id),
 s AS (SELECT doc_id, id_number, ts, event_id AS key FROM v WHERE event = 'saved')
 SELECT o.event_id, o.id_number, s.key FROM (SELECT * FROM v WHERE event = 'opened') o ASOF LEFT JOIN s ON o.doc_id = s.doc_id AND o.id_number = s.id_number AND o.ts >= s.ts""",
    "date_words": """WITH o AS (SELECT o_orderkey AS doc_id, length('Akte ' || CAST(o_orderkey AS VARCHAR) || ': ') AS n FROM orders),
 v(k, a, b, certainty, o, c) AS (VALUES (0, 6, 9, 'uncertain', true, true), (1, 12, 15, 'certain', false, false), (3, 7, 9, 'uncertain', true, true), (5, 5, 7, 'certain', false, false))
 SELECT doc_id, CAST(n + a AS BIGINT) AS start, CAST(n + b AS BIGINT) AS "end", certainty, v.o AS "off", c AS calendar FROM o JOIN v ON doc_id % 6 = k""",
    "lexicon_build": rf"""WITH words AS (SELECT DISTINCT word FROM (SELECT unnest(string_split_regex(coalesce(text, ''), '[ \n\t]+')) AS word FROM documents) WHERE word <> ''),
 small AS (SELECT {FOLDED.replace('token', 'word')} AS key, length(word) AS n FROM words WHERE regexp_matches(word, '^\p{{Ll}}+$')),
 parts AS (SELECT length(word) AS n, regexp_replace(regexp_replace(word, '^[-''’]+', ''), '[-''’.,]+$', '') AS part FROM words WHERE regexp_matches(word, '^\p{{Lu}}')),
 forms AS (SELECT n, part AS form FROM parts WHERE regexp_matches(part, '^[\p{{L}}\p{{M}}][\p{{L}}\p{{M}}''’-]*$') UNION ALL SELECT n, replace(replace(replace(replace(replace(replace(part, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'Ä', 'Ae'), 'Ö', 'Oe'), 'Ü', 'Ue') FROM parts WHERE regexp_matches(part, '^[\p{{L}}\p{{M}}][\p{{L}}\p{{M}}''’-]*$') AND regexp_matches(part, '[äöüÄÖÜ]')),
 keys AS (SELECT {FOLDED.replace('token', 'form')} AS key, bool_or(n % 3 <> 1) AS first, bool_or(n % 3 <> 0) AS last, bool_or(n % 2 = 0) AS curated FROM forms GROUP BY 1)
 SELECT key, first, last, key IN (SELECT key FROM small) AS ambiguous FROM keys WHERE (length(key) > 2 OR (length(key) = 2 AND curated)) AND key NOT IN (SELECT key FROM small WHERE n <= 3)""",
    "manual_caps": """WITH o AS (SELECT o_custkey AS doc_id, o_orderkey AS unit_id, o_orderkey % 5 AS k, c_mktsegment AS seg FROM orders JOIN customer ON c_custkey = o_custkey),
 v(k, suffix, caps) AS (VALUES (0, 'S', true), (1, 's', false), (2, '', false), (3, '', false))
 SELECT doc_id, unit_id, CAST(3 AS BIGINT) AS start, CAST(3 + length(seg) + length(suffix) AS BIGINT) AS "end", 'M|' || lower(seg) AS entity, suffix, 'certain' AS certainty, caps AS "off", caps FROM o JOIN v ON o.k = v.k""",
    # an account number with wrong digits may begin with a shorter one that is right: the longest of these counts
    "contact_places": f"""WITH c AS (SELECT c_custkey AS doc_id, {', '.join(f'{v} AS {k}' for k, v in _CONTACT_DUCK.items())} FROM customer),
 d AS (SELECT *, list_filter(range(22, 14, -1), lambda n: CAST(substr(wrong, 5, n - 4) || '1029' || substr(wrong, 3, 2) AS HUGEINT) % 97 = 1)[1] AS fits FROM c)
 {' UNION ALL '.join(f"SELECT doc_id, '{_KIND[k]}' AS kind, CAST({at} AS BIGINT) AS start, CAST({at} + {'coalesce(fits, length(wrong))' if k == 'wrong' else f'length({k})'} AS BIGINT) AS " + chr(34) + "end" + chr(34) + f", {'CASE WHEN fits IS NULL THEN ' + repr('uncertain') + ' ELSE ' + repr('certain') + ' END' if k == 'wrong' else repr('certain')} AS certainty FROM d" for k, at in _AT.items())}""",
    "reversible_letters": f"""WITH u AS (SELECT o_custkey AS doc_id, o_orderkey AS unit_id, o_orderkey % 8 AS k FROM orders),
 f AS (SELECT doc_id, bool_or(k = 0) AS anna, bool_or(k = 1) AS peter FROM u GROUP BY 1),
 e AS (SELECT u.*, CASE WHEN k = 0 OR (k IN (2, 4, 5) AND anna) THEN 'anna' WHEN k IN (2, 5) THEN 'muller' WHEN k = 4 THEN 'a' WHEN k IN (1, 3) THEN 'weber' END AS who FROM u JOIN f ON u.doc_id = f.doc_id),
 n AS (SELECT doc_id, who, row_number() OVER (PARTITION BY doc_id ORDER BY min(unit_id)) - 1 AS nth FROM e WHERE who IS NOT NULL GROUP BY 1, 2),
 w AS (SELECT e.doc_id, e.unit_id, k, {LETTER.format(n='nth')} AS letter FROM e LEFT JOIN n ON n.doc_id = e.doc_id AND n.who = e.who),
 parts AS (SELECT doc_id, unit_id, letter, role, value FROM w JOIN (VALUES (0, 'Vorname', 'Anna'), (0, 'Nachname', 'Müller'), (1, 'Vorname', 'Peter'), (1, 'Nachname', 'Weber'), (2, 'Nachname', 'Müller'), (3, 'Nachname', 'Weber'), (4, 'Initiale', 'A'), (4, 'Nachname', 'Müller'), (5, 'Nachname', 'MÜLLERS')) AS v(kk, role, value) ON k = kk),
 num AS (SELECT doc_id, letter, role, value, row_number() OVER (PARTITION BY doc_id, letter, role ORDER BY min(unit_id)) AS i FROM parts GROUP BY 1, 2, 3, 4),
 shown AS (SELECT p.doc_id, p.unit_id, p.role, p.role || ' ' || p.letter || CASE WHEN i > 1 THEN CAST(i AS VARCHAR) ELSE '' END AS ph FROM parts p JOIN num ON num.doc_id = p.doc_id AND num.letter = p.letter AND num.role = p.role AND num.value = p.value),
 per AS (SELECT doc_id, unit_id, max(ph) FILTER (role = 'Vorname') AS v, max(ph) FILTER (role = 'Nachname') AS s, max(ph) FILTER (role = 'Initiale') AS i FROM shown GROUP BY 1, 2),
 size AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, ph FROM shown UNION ALL SELECT DISTINCT doc_id, 'mail' FROM u WHERE k = 6) GROUP BY 1)
 SELECT w.doc_id, w.unit_id, 'Gestern kam ' || CASE k WHEN 0 THEN v || ' ' || s WHEN 1 THEN v || ' ' || s WHEN 2 THEN 'Frau ' || s || 's' WHEN 3 THEN 'Herr ' || s WHEN 4 THEN i || '. ' || s WHEN 5 THEN s WHEN 6 THEN '[E-MAIL-1]' ELSE 'niemand' END || ' zu Besuch.' AS masked,
  'Gestern kam ' || list_extract({_REVERSIBLE}, CAST(k + 1 AS INTEGER)) || ' zu Besuch.' AS restored, coalesce(size.n, 0) AS n_key FROM w LEFT JOIN per ON per.doc_id = w.doc_id AND per.unit_id = w.unit_id LEFT JOIN size ON size.doc_id = w.doc_id""",
}
