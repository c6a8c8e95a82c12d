"""The final check: are names or listed organisations still in an output?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnkappe.functions import lexicon
from tarnkappe.functions.text import fold, is_cap, umlaut_variant
from tarnkappe.operators import organisations
from tarnkappe.operators.tokens import one_of, stems, tiles, tokens


def leak_forms(parts: DataFrame) -> DataFrame:
    """(doc_id, form, entity, ambiguous): what to look for; ``parts`` has doc_id, entity, key, raw, ambiguous of active hits.

    A name part is looked for by its key, its folded form and its spelling without umlauts, from two letters on.
    """
    rank = F.col("rank") if "rank" in parts.columns else F.lit(0)
    rows = parts.select("doc_id", "entity", "ambiguous", rank.alias("rank"), F.explode(_spellings(F.col("key"), F.col("raw"))).alias("form"))
    return rows.groupBy("doc_id", "form").agg(F.min(F.struct("rank", "entity"))["entity"].alias("entity"), F.min("ambiguous").alias("ambiguous"))


def _spellings(key: Column, raw: Column) -> Column:
    """Different keys of two letters at least that a word may be looked for by."""
    return F.array_distinct(F.filter(F.array(key, fold(raw), fold(umlaut_variant(raw))), lambda x: x.isNotNull() & (F.char_length(x) >= 2)))


#: What programs put in a file's properties where they know no name, folded.
NOBODY = "author autor user benutzer owner besitzer admin administrator guest gast default standard unknown unbekannt office computer pc company firma"


def meta_forms(meta_names: DataFrame) -> DataFrame:
    """(doc_id, form, entity, ambiguous) of the persons in ``meta_names`` (doc_id, name, kind), which a file's properties name.

    Each word of a name counts by itself, so a turned name or one with an initial is found as well; of a name that is an
    e-mail address or a network's user and nothing else, what stands before the @ or behind the last stroke. Of the kind
    ``text``, such as a title with names in it, and where an address stands among other words, all words count. Words that
    programs put in, titles, particles, stop words and single letters don't count. The entity says where the name is from.
    """
    rows = meta_names.filter("kind <> 'org'").select("doc_id", "name", "kind")
    address = F.col("name").rlike(r"^\s*[^\s@]+@\S*\s*$")
    own = F.regexp_replace(F.regexp_replace("name", r"@\S*\s*$", ""), r"^.*\\", "")
    own = F.when(address, F.regexp_replace(own, "[._-]+", " ")).otherwise(F.regexp_replace("name", r"^\s*[^\s@]*\\", ""))
    own = F.when(F.col("kind") == "text", F.col("name")).otherwise(own)
    words = rows.select("doc_id", "name", F.explode(tiles(own)).alias("raw")).filter(F.col("raw").rlike(r"^[\p{L}\p{M}]")).withColumn("key", fold(F.col("raw")))
    listed = f"{NOBODY} {lexicon.STRONG_TITLES} {lexicon.WEAK_TITLES} {lexicon.PARTICLES} {lexicon.STOP}"
    words = words.filter((F.char_length("key") >= 2) & ~one_of(F.col("key"), listed))
    forms = words.select("doc_id", F.concat(F.lit("F|"), "name").alias("entity"), F.explode(_spellings(F.col("key"), F.col("raw"))).alias("form"))
    return forms.groupBy("doc_id", "form").agg(F.min("entity").alias("entity")).withColumn("ambiguous", F.lit(False))


def meta_terms(meta_names: DataFrame) -> DataFrame:
    """(doc_id, term) of the organisations in ``meta_names``, to be looked for as whole phrases; not those that programs put in."""
    words = F.filter(tiles(fold(F.col("name"))), lambda w: w.rlike(r"^[\p{L}\p{M}]"))
    real = F.col("name").rlike(r"[\p{L}\p{M}]{2}") & F.exists(words, lambda w: ~one_of(w, NOBODY))
    return meta_names.filter(F.col("kind") == "org").filter(real).select("doc_id", F.trim("name").alias("term")).distinct()


def phrase_leaks(units: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, unit_id, start, word, entity, form): places of a document's own phrases (doc_id, term) in its units."""
    found = organisations.find(tokens(units), terms.select("term")).join(terms.select("doc_id", "term").distinct(), ["doc_id", "term"])
    return found.select("doc_id", "unit_id", "start", F.col("term").alias("word"), F.concat(F.lit("F|"), "term").alias("entity"), fold(F.col("term")).alias("form"))


def both_forms(forms: DataFrame, more: DataFrame) -> DataFrame:
    """``forms`` and those of ``more`` that they don't have."""
    return forms.unionByName(more.join(forms.select("doc_id", "form"), ["doc_id", "form"], "left_anti"))


def beyond(found: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of ``found`` (doc_id, unit_id, start, word, entity, form) beyond those of ``known``: a difference of multisets.

    For each word of a document, by its fold, as many rows go as ``known`` has of it, the first ones in order of place. So a
    word that a file's strings repeat from its units isn't reported twice, and no word is reported less often than it stands
    there.
    """
    word = fold(F.col("word"))
    nth = F.row_number().over(Window.partitionBy("doc_id", "folded").orderBy("unit_id", "start", "entity"))
    numbers = known.groupBy("doc_id", word.alias("folded")).agg(F.count("*").alias("m"))
    rows = found.withColumn("folded", word).withColumn("nth", nth).join(numbers, ["doc_id", "folded"], "left")
    return rows.filter(F.col("nth") > F.coalesce("m", F.lit(0))).select(found.columns)


def leaks(units: DataFrame, forms: DataFrame) -> DataFrame:
    """(doc_id, unit_id, start, word, entity): words of the texts that are a form, also with an ending or as a part between
    hyphens; ambiguous forms only with a capital. One row for each word."""
    words = tokens(units).filter("word").select("doc_id", "unit_id", "start", "text")
    pieces = words.withColumn("piece", F.explode(F.array_distinct(F.concat(F.array("text"), F.split("text", "-")))))
    cuts = pieces.select("doc_id", "unit_id", "start", "text", is_cap(F.col("piece")).alias("cap"), F.explode_outer(stems(F.col("piece"))).alias("cut"))
    found = cuts.withColumn("form", fold(F.col("cut.stem"))).join(forms, ["doc_id", "form"]).filter("cap or not ambiguous")
    return found.groupBy("doc_id", "unit_id", "start").agg(F.first("text").alias("word"), F.min("entity").alias("entity"), F.min("form").alias("form"))


def without_decided(found: DataFrame, off: DataFrame) -> DataFrame:
    """``found`` (doc_id, unit_id, start, form) without what a review left standing: ``off`` (doc_id, unit_id, form).

    For each row of ``off`` one row of ``found`` with that form goes from the unit, the first ones first.
    """
    order = F.row_number().over(Window.partitionBy("doc_id", "unit_id", "form").orderBy("start"))
    numbers = off.groupBy("doc_id", "unit_id", "form").agg(F.count("*").alias("m"))
    rows = found.withColumn("nth", order).join(numbers, ["doc_id", "unit_id", "form"], "left")
    return rows.filter(F.col("nth") > F.coalesce("m", F.lit(0))).drop("nth", "m")


def final_check(found: DataFrame, off: DataFrame, places: DataFrame | None = None, left: DataFrame | None = None) -> DataFrame:
    """(doc_id, unit_id, kind, start, word, entity): everything that speaks against giving an output away.

    ``name``: words of active persons in the output (``found``, of ``leaks``) that no review left standing (``off``).
    ``uncovered``: ``places`` of organisations in the original that weren't replaced whole. ``organisation``: places of
    terms that stand in the output (``left``), if none of the same term was named as uncovered in that unit.
    """
    names = without_decided(found, off).select("doc_id", "unit_id", F.lit("name").alias("kind"), "start", "word", "entity")
    if places is None or left is None:
        return names
    columns = lambda kind: ["doc_id", "unit_id", F.lit(kind).alias("kind"), "start", F.col("term").alias("word"), F.col("term").alias("entity")]
    again = left.join(places.select("doc_id", "unit_id", "term").distinct(), ["doc_id", "unit_id", "term"], "left_anti")
    return names.unionByName(places.select(*columns("uncovered"))).unionByName(again.select(*columns("organisation")))


def state(findings: DataFrame) -> DataFrame:
    """(doc_id, points, stamp): how many findings a document has, and a stamp of exactly these."""
    point = F.sha2(F.to_json(F.struct("unit_id", "kind", "start", "word", "entity")), 256)
    return findings.groupBy("doc_id").agg(F.count("*").alias("points"), F.sha2(F.array_join(F.array_sort(F.collect_list(point)), ""), 256).alias("stamp"))


def may_be_saved(docs: DataFrame, findings: DataFrame, confirmed: DataFrame) -> DataFrame:
    """(doc_id, points, saved): a document may go if it has no findings, or if exactly these were confirmed (doc_id, stamp)."""
    now = docs.select("doc_id").distinct().join(state(findings), "doc_id", "left")
    known = confirmed.select("doc_id", "stamp", F.lit(True).alias("known")).distinct()
    return now.join(known, ["doc_id", "stamp"], "left").select("doc_id", F.coalesce("points", F.lit(0)).alias("points"), (F.col("points").isNull() | F.coalesce("known", F.lit(False))).alias("saved"))


def new_leaks(found: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of ``found`` (doc_id, word) beyond those of ``known``, with their numbers: a difference of multisets."""
    a = found.groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    b = known.groupBy("doc_id", "word").agg(F.count("*").alias("m"))
    left = F.col("n") - F.coalesce("m", F.lit(0))
    return a.join(b, ["doc_id", "word"], "left").select("doc_id", "word", left.alias("n")).filter("n > 0")
