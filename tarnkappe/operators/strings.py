"""Free strings beside a document's units, such as labels, titles and names of sheets: replaced by what the document's own
texts gave, its active names, organisations and contacts. Nothing is detected in them but contacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnkappe.functions.text import apply_spans, fold
from tarnkappe.operators import organisations
from tarnkappe.operators.contacts import LABELS, ContactOptions, contact_rows
from tarnkappe.operators.tokens import tokens

#: Endings that a word in a free string may have: those of a genitive.
_GENITIVE = r"(?:['’]s|s)$"
_AT = ["doc_id", "unit_id", "start", "end"]


def _outside(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """``rows`` (doc_id, unit_id, start, end) that no span touches."""
    s = spans.groupBy("doc_id", "unit_id").agg(F.collect_list(F.struct("start", "end")).alias("spots"))
    joined = rows.join(s, ["doc_id", "unit_id"], "left")
    touched = F.exists("spots", lambda x: (F.col("start") < x["end"]) & (F.col("end") > x["start"]))
    return joined.filter(~F.coalesce(touched, F.lit(False))).drop("spots")


def replacements(
    strings: DataFrame, forms: DataFrame, options: ContactOptions = ContactOptions(), orgs: DataFrame | None = None, exact: DataFrame | None = None, numbered: DataFrame | None = None
) -> DataFrame:
    """(doc_id, unit_id, start, end, label): what is replaced in strings (doc_id, unit_id, text), without overlaps.

    Certain contacts come first, by their kind's label, or by the placeholder of the same contact in ``numbered`` (doc_id,
    kind, value, placeholder). Then the phrases of ``orgs`` (doc_id, term, label), longest first, with an ending in small
    letters behind the label. Then words: by the label of the form (doc_id, form, ambiguous, label) that they are, whole or
    without 's, ’s or s, which stays behind; ambiguous forms need a capital. With ``exact`` (doc_id, value, placeholder) a
    spelling that a restore knows gets its placeholder; a word with digits or letters glued to it is replaced as a whole,
    by its exact placeholder or by the form's label, so that a digit can't be read as a part of the placeholder. With
    ``exact`` an organisation's label is that of its exact spelling too, or else its own.
    """
    strings = strings.select("doc_id", "unit_id", F.coalesce("text", F.lit("")).alias("text"))
    plain = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    contacts = contact_rows(strings, ["doc_id", "unit_id"], options=options).filter("certainty = 'certain'")
    if numbered is not None:
        known = numbered.select("doc_id", "kind", F.col("value").alias("text"), "placeholder")
        contacts = contacts.join(known, ["doc_id", "kind", "text"], "left")
    else:
        contacts = contacts.withColumn("placeholder", F.lit(None).cast("string"))
    taken = contacts.select(*_AT, F.coalesce("placeholder", F.element_at(plain, F.col("kind"))).alias("label"))
    tok = tokens(strings)
    if orgs is not None:
        places = organisations.find(tok, orgs.select("term")).join(orgs.select("doc_id", "term", "label"), ["doc_id", "term"])
        if exact is not None:
            surface = F.substr("text", F.col("start") + 1, F.col("end") - F.char_length("suffix") - F.col("start"))
            places = places.join(strings, ["doc_id", "unit_id"]).withColumn("value", surface).drop("text").join(exact, ["doc_id", "value"], "left").withColumn("label", F.coalesce("placeholder", "label"))
        places = places.select(*_AT, F.concat("label", F.lower("suffix")).alias("label"))
        taken = taken.unionByName(_outside(places, taken))
    words = _outside(tok.filter("word").select(*_AT, "text", "cap"), taken)
    tail = F.lit("")
    if exact is not None:
        words = words.join(strings.withColumnRenamed("text", "whole"), ["doc_id", "unit_id"])
        tail = F.regexp_extract(F.substr("whole", F.col("end") + 1), r"^[\p{L}\p{N}]+", 0)
    words = words.withColumn("tail", tail)
    # in order: the spelling as it is, without an ending; then the form as it is, without an ending
    ending = F.regexp_extract("text", _GENITIVE, 0)
    bare = F.substr(F.col("text"), F.lit(1), F.char_length("text") - F.char_length("ending"))
    words = words.withColumn("ending", ending).withColumn("bare", bare)
    glued = F.col("tail") != ""
    tries = F.array(F.struct(F.lit(0).alias("nth"), F.col("text").alias("stem"), F.lit("").alias("suffix")), F.when((F.col("ending") != "") & ~glued, F.struct(F.lit(1).alias("nth"), F.col("bare").alias("stem"), F.col("ending").alias("suffix"))))
    tried = words.select(*_AT, "cap", "tail", F.explode(F.filter(tries, lambda x: x.isNotNull())).alias("t")).select(*_AT, "cap", "tail", "t.*")
    by_form = tried.withColumn("form", fold(F.col("stem"))).join(forms.select("doc_id", "form", "ambiguous", "label"), ["doc_id", "form"]).filter("cap or not ambiguous")
    found = by_form.select(*_AT, "tail", "suffix", "label", (F.col("nth") + 2).alias("nth"))
    if exact is not None:
        spelled = tried.withColumn("value", F.concat("stem", "tail")).join(exact.select("doc_id", "value", "placeholder"), ["doc_id", "value"])
        found = found.unionByName(spelled.select(*_AT, "tail", "suffix", F.col("placeholder").alias("label"), "nth"))
    best = F.row_number().over(Window.partitionBy(*_AT).orderBy("nth", "label"))
    found = found.withColumn("best", best).filter("best = 1")
    named = found.select("doc_id", "unit_id", "start", (F.col("end") + F.char_length("tail")).cast("int").alias("end"), F.concat("label", "suffix").alias("label"))
    return taken.unionByName(named)


def masked_strings(strings: DataFrame, forms: DataFrame, options: ContactOptions = ContactOptions(), orgs: DataFrame | None = None, exact: DataFrame | None = None, numbered: DataFrame | None = None) -> DataFrame:
    """``strings`` (doc_id, unit_id, text) with ``masked``, by ``replacements``; null stays null."""
    per = replacements(strings, forms, options, orgs, exact, numbered).groupBy("doc_id", "unit_id").agg(F.collect_list(F.struct("start", "end", F.col("label").alias("text"))).alias("swaps"))
    empty = F.array().cast("array<struct<start:int,end:int,text:string>>")
    return strings.join(per, ["doc_id", "unit_id"], "left").select("doc_id", "unit_id", "text", apply_spans(F.col("text"), F.coalesce("swaps", empty)).alias("masked"))


def labelled_text(output: DataFrame, labels: DataFrame, main: str = "^(?:Text|Tabelle|Textfeld)$") -> DataFrame:
    """(doc_id, text): a document's masked units (doc_id, unit_id, masked) as one plain text, a line for each, in order.

    Units that don't belong to the main text stand behind their label in brackets; ``labels`` (doc_id, unit_id, text,
    masked) are masked strings, and ``main`` says which labels, by their original text, are of the main text.
    """
    rows = output.select("doc_id", "unit_id", F.coalesce("masked", F.lit("")).alias("shown")).join(labels.select("doc_id", "unit_id", F.col("text").alias("of"), F.col("masked").alias("label")), ["doc_id", "unit_id"], "left")
    bare = F.coalesce(F.col("of").rlike(main), F.lit(True))
    line = F.when(bare, F.col("shown")).otherwise(F.concat(F.lit("["), "label", F.lit("] "), "shown"))
    lines = F.array_sort(F.collect_list(F.struct("unit_id", line.alias("line"))))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"))
