"""What a review looks at: who was found, where, how sure, and what is left to ask. All are tables for each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnkappe.functions.text import fold
from tarnkappe.operators import checks, linking

#: The most characters shown before and behind a hit.
AROUND = 120


def contexts(hits: DataFrame, units: DataFrame, around: int = AROUND) -> DataFrame:
    """``hits`` with before, word, after: the sentence around a hit, at most ``around`` characters on either side.

    Sentences end at . ! ? and line breaks; the sign that ends one is shown. An ellipsis stands where a unit goes on.
    """
    rows = hits.join(units.select("doc_id", "unit_id", "text"), ["doc_id", "unit_id"])
    first = F.greatest(F.col("start") - around, F.lit(0))
    before = F.regexp_extract(F.substr("text", first + 1, F.col("start") - first), r"[^.!?\n]*\z", 0)
    ahead = F.substr("text", F.col("end") + 1, F.lit(around + 1))
    plain = F.substring(F.regexp_extract(ahead, r"\A[^.!?\n]*", 0), 1, around)
    after = F.concat(plain, F.regexp_extract(F.substr(ahead, F.char_length(plain) + 1, F.lit(1)), "[.!?]", 0))
    rows = rows.withColumn("before", before).withColumn("after", after)
    more = F.col("end") + F.char_length("after") < F.char_length("text")
    return rows.select(
        *hits.columns, F.concat(F.when(F.col("start") > F.char_length("before"), "…").otherwise(""), F.ltrim("before")).alias("before"),
        F.substr("text", F.col("start") + 1, F.col("end") - F.col("start")).alias("word"), F.concat(F.rtrim("after"), F.when(more, "…").otherwise("")).alias("after"),
    )


def mapping(hits: DataFrame, units: DataFrame, label: Column) -> DataFrame:
    """(doc_id, label, forms, active): what each label stands for; entities without an active hit have no row.

    ``label`` is an expression over the hits. Forms are all spellings without endings, in order of code points.
    """
    rows = hits.join(units.select("doc_id", "unit_id", "text"), ["doc_id", "unit_id"]).filter("entity is not null").withColumn("label", label)
    form = F.substr("text", F.col("start") + 1, F.col("end") - F.char_length("suffix") - F.col("start"))
    per = rows.groupBy("doc_id", "label", "entity").agg(F.array_join(F.array_sort(F.collect_set(form)), " / ").alias("forms"), F.sum(F.col("on").cast("long")).alias("active"))
    return per.filter("active > 0").select("doc_id", "label", "forms", "active")


def mapping_csv(rows: DataFrame) -> DataFrame:
    """(doc_id, csv): the mapping of each document as a table with a warning above it; all cells in quotes."""
    cell = lambda c: F.concat(F.lit('"'), F.replace(c.cast("string"), F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(";", *[cell(F.col(c)) for c in ("label", "forms", "active")])
    head = F.lit('CONFIDENTIAL: holds real names\r\n"label";"spellings";"active hits"')
    return rows.groupBy("doc_id").agg(F.concat_ws("\r\n", head, F.array_join(F.array_sort(F.collect_list(line)), "\r\n")).alias("csv"))


def common_words(mentions: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, unit_id, start, context) of single words that are ordinary words as well, where they may be no name.

    ``article`` if an article or preposition stands before them, ``inflected`` if they have an ending. A word counts as
    ordinary in a document if the lists say so of any mention's part with its key. ``lines`` have a unit's flagged tokens.
    """
    ordinary = mentions.select("doc_id", F.explode("parts").alias("p")).filter("p.ambiguous").select("doc_id", "p.key").distinct()
    lone = mentions.filter((F.size("parts") == 1) & ~F.coalesce("caps", F.lit(False))).select("doc_id", "unit_id", "start", "suffix", F.get("parts", 0)["key"].alias("key")).join(ordinary, ["doc_id", "key"], "left_semi")
    rows = lone.join(lines, ["doc_id", "unit_id"]).withColumn("i", F.array_position(F.transform("tokens", lambda t: t["start"]), F.col("start")).cast("int") - 1)
    context = F.when(linking.noun_before(F.col("i")), "article").when(F.col("suffix") != "", "inflected")
    return rows.filter("i >= 0").select("doc_id", "unit_id", "start", context.alias("context")).filter("context is not null")


def switched(hits: DataFrame, overrides: DataFrame | None = None, answers: DataFrame | None = None, groups: DataFrame | None = None) -> DataFrame:
    """``hits`` (doc_id, unit_id, start, end, entity, certainty, on, grp, context, calendar, caps) with what a review says of ``on``.

    What is said of a single place counts first (``overrides``: doc_id, unit_id, start, end, on), then the answer to a
    question about a place, then that to a question about a word, then the switch of a group (``groups``: doc_id, grp, on);
    without any of them a hit stays as the rules have it. ``answers`` (doc_id, kind, entity, unit_id, start, yes) are for
    places (kind place) or all places of an entity (kind word; unit_id and start don't count): no switches all its uncertain
    hits off, yes those on whose word isn't an ordinary one by its context. Dates and forms in capitals are asked by place.
    Of several answers to one question no counts.
    """
    said: list[Column] = []
    if overrides is not None:
        own = overrides.groupBy("doc_id", "unit_id", "start", "end").agg(F.min("on").alias("by_place"))
        hits = hits.join(own, ["doc_id", "unit_id", "start", "end"], "left")
        said.append(F.col("by_place"))
    if answers is not None:
        places = answers.filter("kind = 'place'").groupBy("doc_id", "unit_id", "start").agg(F.min("yes").alias("by_answer"))
        words = answers.filter("kind = 'word'").groupBy("doc_id", "entity").agg(F.min("yes").alias("by_word"))
        hits = hits.join(places, ["doc_id", "unit_id", "start"], "left").join(words, ["doc_id", "entity"], "left")
        unsure = F.coalesce((F.col("certainty") == "uncertain") & ~F.col("calendar") & ~F.col("caps"), F.lit(False))
        person = F.col("kind") == "person"
        said.append(F.when(person, F.col("by_answer")))
        said.append(F.when(person & unsure & (~F.col("by_word") | F.col("context").isNull()), F.col("by_word")))
    if groups is not None:
        own = groups.groupBy("doc_id", "grp").agg(F.min("on").alias("by_group"))
        hits = hits.join(own, ["doc_id", "grp"], "left")
        said.append(F.col("by_group"))
    return hits.withColumn("on", F.coalesce(*said, "on")).drop("by_place", "by_answer", "by_word", "by_group")


def questions(hits: DataFrame, answers: DataFrame | None = None, meta_names: DataFrame | None = None, terms: DataFrame | None = None) -> DataFrame:
    """(doc_id, kind, entity, unit_id, start, places): what a reader should decide.

    ``word``: an entity with uncertain hits in the context of a name, asked once, at the first of them; or with uncertain
    hits only. ``place``: a hit of an entity that is sure, by a certain hit, by a mark (M|) or by an answer, where the word
    may be no name by its context, or is a marked name's form in capitals. ``meta``: a name in the file's properties
    (``meta_names``: doc_id, name, kind) that isn't in the lists of marked ``terms`` (doc_id, term) yet. Dates aren't asked.
    Questions that ``answers`` have (doc_id, kind, entity, unit_id, start, yes) are gone, and so are the places of an entity
    that was answered with no.
    """
    people = hits.filter("kind = 'person'")
    unsure = (F.col("certainty") == "uncertain") & ~F.coalesce("calendar", F.lit(False)) & ~F.coalesce("caps", F.lit(False))
    plain = unsure & F.col("context").isNull()
    sure = (F.col("certainty") == "certain") & ~F.coalesce("caps", F.lit(False))
    at = lambda c: F.min(F.when(c, F.struct("unit_id", "start")))
    n = lambda c: F.sum(c.cast("long"))
    per = people.groupBy("doc_id", "entity").agg(at(plain).alias("plain"), at(unsure).alias("unsure"), n(plain).alias("n_plain"), n(unsure).alias("n_unsure"), F.max(sure).alias("sure"))
    per = per.withColumn("sure", F.col("sure") | F.startswith("entity", F.lit("M|"))).withColumn("yes", F.lit(None).cast("boolean"))
    if answers is not None:
        said = answers.filter("kind = 'word'").groupBy("doc_id", "entity").agg(F.min("yes").alias("yes"))
        per = per.drop("yes").join(said, ["doc_id", "entity"], "left")
    ask = per.filter(F.col("yes").isNull() & (F.col("plain").isNotNull() | (F.col("unsure").isNotNull() & ~F.col("sure"))))
    first = F.coalesce("plain", "unsure")
    words = ask.select("doc_id", F.lit("word").alias("kind"), "entity", first["unit_id"].alias("unit_id"), first["start"].alias("start"), F.when(F.col("plain").isNotNull(), F.col("n_plain")).otherwise(F.col("n_unsure")).alias("places"))
    known = per.filter((F.col("sure") & F.col("yes").isNull()) | F.col("yes")).select("doc_id", "entity")
    odd = people.filter((F.col("context").isNotNull() & ~F.coalesce("calendar", F.lit(False))) | F.coalesce("caps", F.lit(False))).join(known, ["doc_id", "entity"], "left_semi")
    if answers is not None:
        odd = odd.join(answers.filter("kind = 'place'").select("doc_id", "unit_id", "start").distinct(), ["doc_id", "unit_id", "start"], "left_anti")
    rows = words.unionByName(odd.select("doc_id", F.lit("place").alias("kind"), "entity", "unit_id", "start", F.lit(1).cast("long").alias("places")))
    if meta_names is None:
        return rows
    names = meta_names.select("doc_id", fold(F.trim("name")).alias("entity")).distinct()
    if terms is not None:
        names = names.join(terms.select("doc_id", fold(F.trim("term")).alias("entity")).distinct(), ["doc_id", "entity"], "left_anti")
    if answers is not None:
        names = names.join(answers.filter("kind = 'meta'").select("doc_id", "entity").distinct(), ["doc_id", "entity"], "left_anti")
    return rows.unionByName(names.select("doc_id", F.lit("meta").alias("kind"), "entity", F.lit(None).cast(rows.schema["unit_id"].dataType).alias("unit_id"), F.lit(None).cast(rows.schema["start"].dataType).alias("start"), F.lit(1).cast("long").alias("places")))


def moved_terms(terms: DataFrame, edits: DataFrame) -> DataFrame:
    """(doc_id, kind, term): a list of marked terms after ``edits`` (nth, doc_id, kind, term); kind is person, org or none.

    Terms are the same if they fold alike, and stand in one list at most: the last edit of a term decides, ``none`` takes
    it out.
    """
    rows = terms.select(F.lit(-1).cast("long").alias("nth"), "doc_id", "kind", "term").unionByName(edits.select(F.col("nth").cast("long").alias("nth"), "doc_id", "kind", "term"))
    clean = F.trim(F.regexp_replace("term", r"[\s\x{a0}]+", " "))
    rows = rows.withColumn("term", clean).filter("term <> ''").withColumn("key", fold(F.col("term")))
    last = F.row_number().over(Window.partitionBy("doc_id", "key").orderBy(F.col("nth").desc(), "kind", "term"))
    return rows.withColumn("last", last).filter("last = 1 and kind <> 'none'").select("doc_id", "kind", "term")


#: Names for the parts of office files, by what their paths look like; the first that fits counts.
PART_NAMES = {
    r"^word/document": "text", r"^word/header": "header", r"^word/footer": "footer", r"^word/(foot|end)notes": "note", r"comments?\d*\.xml$": "comment",
    r"/charts/": "chart", r"/diagrams/": "drawing", r"^word/glossary/": "building block", r"^xl/(worksheets|sharedStrings)": "table", r"^docProps/": "property", r"/media/": "picture",
}


def part_label(part: Column) -> Column:
    """What a part of an office file is, in a word; ``other`` if its path says nothing."""
    label = F.lit(None).cast("string")
    for pattern, name in reversed(PART_NAMES.items()):
        label = F.when(part.rlike(pattern), name).otherwise(label)
    return F.coalesce(label, F.lit("other"))


def holds_name(units: DataFrame, forms: DataFrame) -> DataFrame:
    """(doc_id, unit_id) of units with a word that is a form (doc_id, form, entity, ambiguous) of an active name."""
    return checks.leaks(units, forms).select("doc_id", "unit_id").distinct()
