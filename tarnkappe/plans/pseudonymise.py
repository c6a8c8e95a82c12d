"""The whole way of a table of units: contacts and names found, linked, replaced, checked."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnkappe.functions.text import apply_spans, fold
from tarnkappe.operators import checks, columns, linking, organisations, reversible, review
from tarnkappe.operators import strings as free
from tarnkappe.operators.contacts import LABELS, ContactOptions, contact_rows
from tarnkappe.operators.mentions import mentions_of_lines, with_taken
from tarnkappe.operators.tokens import TOKEN, as_lines, as_rows, flagged, tokens, words_of
from tarnkappe.session import written


@dataclass(frozen=True)
class Options:
    """``mode``: person (Person A), name ([NAME]) or reversible (Nachname A, with a key); ``across_lines``: units are lines
    of running text, numbered without gaps, and organisations may go on in the next one."""

    mode: str = "person"
    contacts: ContactOptions = field(default_factory=ContactOptions)
    unsure_on: bool = True
    across_lines: bool = False


@dataclass
class Result:
    hits: DataFrame  # doc_id, unit_id, start, end, kind, entity, certainty, on, suffix, letter, rest, grp, calendar, caps, context
    persons: DataFrame  # doc_id, entity, letter, display, forms
    output: DataFrame  # units with masked
    key: DataFrame | None  # doc_id, placeholder, value, count, category, role, owner
    leaks: DataFrame  # doc_id, unit_id, start, word, entity, form
    findings: DataFrame  # doc_id, unit_id, kind, start, word, entity: the final check
    swaps: DataFrame  # doc_id, unit_id, start, end, label: what was written where
    odd: DataFrame  # doc_id, unit_id, start, context: hits whose word may be no name
    strings: DataFrame | None  # free strings with masked


def _none() -> Column:
    return F.lit(None).cast("string")


def _words(rows: DataFrame, like: DataFrame) -> DataFrame:
    """Words found by their keys, with what they took in, as mentions of the columns of ``like``."""
    part = lambda start, end, stem_end, key: F.struct(F.lit("word").alias("kind"), start.alias("start"), end.alias("end"), stem_end.cast("int").alias("stem_end"), key.alias("key"), F.lit(False).alias("first"), F.lit(False).alias("last"), F.lit(False).alias("ambiguous"), F.lit(True).alias("known"), F.lit(False).alias("shaped"))
    own = part(F.col("start"), F.col("end"), F.col("end") - F.char_length("suffix"), F.col("key"))
    took = F.col("absorbed").isNotNull()
    before = part(F.col("absorbed.start"), F.col("absorbed.end"), F.col("absorbed.end"), F.col("absorbed.key"))
    parts = F.when(took, F.array(before, own)).otherwise(F.array(own))
    return rows.select(
        "doc_id", "unit_id", F.coalesce("absorbed.start", "start").alias("start"), "end", "certainty", "suffix", F.lit(False).alias("titled"), "off", F.when(took, F.col("absorbed.key")).alias("given"), F.when(took, F.col("key")).alias("surname"),
        F.when(~took, F.col("key")).alias("single"), parts.cast(like.schema["parts"].dataType).alias("parts"), "entity", _none().alias("link"), "calendar", "caps", "grp",
    )


def _spots(*tables: DataFrame | None) -> DataFrame:
    found = [t.select("doc_id", "unit_id", "start", "end") for t in tables if t is not None]
    return reduce(DataFrame.unionByName, found)


def pseudonymise(
    units: DataFrame,
    names: DataFrame,
    options: Options = Options(),
    exceptions: DataFrame | None = None,
    org_terms: DataFrame | None = None,
    overrides: DataFrame | None = None,
    cells: DataFrame | None = None,
    name_columns: DataFrame | None = None,
    manual: DataFrame | None = None,
    merges: DataFrame | None = None,
    unlinks: DataFrame | None = None,
    layout: DataFrame | None = None,
    answers: DataFrame | None = None,
    groups: DataFrame | None = None,
    strings: DataFrame | None = None,
    meta_names: DataFrame | None = None,
) -> Result:
    """Run all steps on units (doc_id, unit_id, text).

    Contacts come first, then listed organisations, name columns, names in texts, terms marked by hand, and parts of
    found names; later steps skip what earlier ones took. A unit's tokens are a row, written once; every other step is a
    join, window or aggregate of what was found, by doc_id. The answers of a review are tables: ``overrides`` (doc_id,
    unit_id, start, end, on) switches single hits, ``answers`` (doc_id, kind, entity, unit_id, start, yes) those that a
    question is about, ``groups`` (doc_id, grp, on) the hits of a group together, in this order. ``cells`` (doc_id,
    unit_id, table_id, r, c, and r2, c2 of merged ones) says where units stand in tables and ``name_columns`` (doc_id,
    table_id, c, on) which columns hold names, ``layout`` (doc_id, unit_id, follows, heading) which units are headings or
    don't follow the one before. ``manual`` (doc_id, term) adds names, ``merges`` (doc_id, entity, target) makes entities
    one, ``unlinks`` (doc_id, own) keeps short forms apart. ``strings`` (doc_id, unit_id, text) are free strings of a
    document, such as labels and titles, that get what its units give; ``meta_names`` (doc_id, name, kind) are the names in
    its properties, which the final check looks for too.
    """
    units = units.select("doc_id", "unit_id", "text")
    found = written(contact_rows(units, ["doc_id", "unit_id"], options=options.contacts), "contacts")
    # units are together here, so contacts are marked in them without another shuffle of all tokens
    lines = written(with_taken(as_lines(flagged(tokens(units), names, exceptions, own_words=words_of(units)).withColumn("covered", F.lit(False)), [*TOKEN, "covered"]), _spots(found)), "lines")
    orgs = listed = None
    if org_terms is not None:
        tok = as_rows(lines).drop("covered")
        orgs = organisations.find(tok, org_terms)
        orgs = organisations.without_overlaps(orgs, organisations.find_across(tok, org_terms, orgs)) if options.across_lines else orgs.withColumn("rest", F.lit(False))
        listed = orgs = written(orgs, "organisations")
        spots = found.select("doc_id", F.col("unit_id").alias("u"), F.col("start").alias("s"), F.col("end").alias("e"))
        orgs = orgs.join(spots, (orgs["doc_id"] == spots["doc_id"]) & (orgs["unit_id"] == F.col("u")) & (orgs["start"] < F.col("e")) & (orgs["end"] > F.col("s")), "left_anti")
    of_cells = lefts = None
    if cells is not None:
        placed = cells.drop("text").join(units, ["doc_id", "unit_id"])
        busy = _spots(found, orgs).select("doc_id", "unit_id").distinct()
        of_cells = written(columns.cell_mentions(as_rows(lines).drop("covered"), placed, name_columns).join(busy, ["doc_id", "unit_id"], "left_anti"), "cells")
        lefts = columns.left_neighbours(placed)
    taken = _spots(found, orgs)
    marked = lines if orgs is None and of_cells is None else with_taken(lines, _spots(orgs, of_cells))
    mentions = written(mentions_of_lines(marked, options.unsure_on, lefts, layout), "mentions")
    mentions = mentions if of_cells is None else mentions.unionByName(of_cells)
    linked = written(linking.link(mentions, unlinks).withColumn("caps", F.lit(False)), "linked")
    by_hand, joins = None, merges
    if manual is not None:
        parts = linking.manual_parts(manual)
        all_by_hand = written(_words(linking.propagate(lines, parts, _spots(taken, linked), marked=True), linked), "marked")
        by_hand = written(linking.joined_words(all_by_hand.filter("not caps")).withColumn("calendar", F.lit(False)).withColumn("caps", F.lit(False)).withColumn("grp", _none()).unionByName(all_by_hand.filter("caps")), "by-hand")
        own = linked.join(parts.withColumnRenamed("entity", "target"), "doc_id").filter("key = coalesce(single, surname)").select("doc_id", "entity", "target").distinct()
        joins = own if merges is None else own.unionByName(merges.select("doc_id", "entity", "target"))
    more = _words(linking.propagate(lines, linking.owned_parts(linked), _spots(taken, linked, by_hand)), linked)
    people = linked.drop("own").unionByName(more if by_hand is None else more.unionByName(by_hand))
    people = people if joins is None else linking.resolve_merges(people, joins)
    persons = written(people.join(units, ["doc_id", "unit_id"]), "persons")
    odd = review.common_words(persons, lines)
    words = linking.placeholder_words(units)
    blocked = written(linking.reserved(words), "reserved")
    # forms in capitals of marked names decide neither on letters nor on what is shown of a person
    whole = persons.filter("not caps")
    letters = written(linking.letters(whole.select("doc_id", "entity", "unit_id", "start"), blocked if options.mode == "person" else None), "letters")
    surface = F.substr("text", F.col("start") + 1, F.col("end") - F.char_length("suffix") - F.col("start"))
    shown = linking.display_forms(whole.withColumn("surface", surface)).join(letters, ["doc_id", "entity"])
    persons = persons.join(letters, ["doc_id", "entity"])
    no = F.lit(False)
    person_hits = persons.select("doc_id", "unit_id", "start", "end", F.lit("person").alias("kind"), "entity", "certainty", (~F.col("off")).alias("on"), "suffix", "letter", no.alias("rest"), "grp", "calendar", "caps")
    person_hits = person_hits.join(odd, ["doc_id", "unit_id", "start"], "left")
    hits = person_hits.unionByName(found.select("doc_id", "unit_id", "start", "end", "kind", _none().alias("entity"), "certainty", F.lit(True).alias("on"), F.lit("").alias("suffix"), _none().alias("letter"), no.alias("rest")), allowMissingColumns=True)
    if orgs is not None:
        org_letters = linking.letters(orgs.select("doc_id", F.col("term").alias("entity"), "unit_id", "start"), blocked if options.mode == "person" else None, "Einrichtung ")
        named = orgs.withColumnRenamed("term", "entity").join(org_letters, ["doc_id", "entity"])
        hits = hits.unionByName(named.select("doc_id", "unit_id", "start", "end", F.lit("org").alias("kind"), "entity", F.lit("certain").alias("certainty"), F.lit(True).alias("on"), "suffix", "letter", "rest"), allowMissingColumns=True)
    hits = written(review.switched(hits, overrides, answers, groups), "hits")
    active = hits.filter("on")
    key = placed = None
    on = active.filter("kind = 'person'").select("doc_id", "unit_id", "start", "end")
    active_persons = persons.join(on, ["doc_id", "unit_id", "start", "end"], "left_semi")
    if options.mode == "reversible":
        parts = reversible.name_parts(reversible.with_tails(active_persons)).withColumn("base", F.concat_ws(" ", "role", "letter"))
        base = F.create_map(*[F.lit(x) for k, v in reversible.CONTACT_BASE.items() for x in (k, f"[{v}]")])
        others = active.filter("kind <> 'person'").join(units, ["doc_id", "unit_id"])
        stem_end = F.col("end") - F.when(F.col("suffix").rlike(r"\p{Lu}"), 0).otherwise(F.char_length("suffix"))
        rest = others.select("doc_id", "unit_id", "start", stem_end.alias("end"), F.coalesce(F.element_at(base, F.col("kind")), F.concat_ws(" ", F.lit("Einrichtung"), "letter")).alias("base"), F.substr("text", F.col("start") + 1, stem_end - F.col("start")).alias("value"), "kind", _none().alias("role"), "letter")
        values = parts.select("doc_id", "unit_id", "start", "end", "base", "value", F.lit("person").alias("kind"), "role", "letter").unionByName(rest)
        placed = written(reversible.numbered(written(values, "values"), blocked), "placed")
        key = reversible.restore_key(placed)
        swaps = placed.select("doc_id", "unit_id", "start", "end", F.col("placeholder").alias("label"))
    else:
        plain = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
        person, org = _labels(options.mode)
        org = F.when(F.col("rest"), "").otherwise(org)
        # an ending stays behind the label, in lower case, so that it can't look like part of the letter
        label = F.when(F.col("kind") == "person", F.concat(person, F.lower("suffix"))).when(F.col("kind") == "org", F.concat(org, F.lower("suffix"))).otherwise(F.element_at(plain, F.col("kind")))
        swaps = active.select("doc_id", "unit_id", "start", "end", label.alias("label"))
    per = swaps.groupBy("doc_id", "unit_id").agg(F.collect_list(F.struct("start", "end", F.col("label").alias("text"))).alias("swaps"))
    empty = F.array().cast("array<struct<start:int,end:int,text:string>>")
    out = units.join(per, ["doc_id", "unit_id"], "left").select("doc_id", "unit_id", "text", apply_spans(F.col("text"), F.coalesce("swaps", empty)).alias("masked"))
    raw = active_persons.select("doc_id", "entity", "letter", "text", F.explode("parts").alias("p")).filter("p.kind = 'word'")
    forms = checks.leak_forms(raw.select("doc_id", "entity", "p.key", F.substr("text", F.col("p.start") + 1, F.col("p.stem_end") - F.col("p.start")).alias("raw"), F.coalesce("p.ambiguous", F.lit(False)).alias("ambiguous"), F.struct(F.char_length("letter"), "letter").alias("rank")))
    known = forms if meta_names is None else checks.both_forms(forms, checks.meta_forms(meta_names))
    shown_units = out.select("doc_id", "unit_id", F.col("masked").alias("text"))
    left = checks.leaks(shown_units, known)
    if meta_names is not None:
        phrases = checks.meta_terms(meta_names)
        left = left.unionByName(checks.phrase_leaks(shown_units, phrases))
    off = hits.filter("not on and kind = 'person'").join(units, ["doc_id", "unit_id"])
    off = off.select("doc_id", "unit_id", F.explode(F.split(fold(F.substr("text", F.col("start") + 1, F.col("end") - F.char_length("suffix") - F.col("start"))), r"[^\p{L}\p{M}'\-]+")).alias("form")).filter("form <> ''")
    if org_terms is None:
        findings = checks.final_check(left, off)
    else:
        again = organisations.find(tokens(shown_units), org_terms)
        findings = checks.final_check(left, off, organisations.uncovered(listed, active.filter("kind = 'org'")), again)
    labels = None
    if strings is not None:
        labels = written(_strings(strings, options, forms, letters, active.filter("kind = 'org' and not rest"), placed), "strings")
        shown_strings = labels.select("doc_id", "unit_id", F.col("masked").alias("text"))
        beside = checks.leaks(shown_strings, known)
        if meta_names is not None:
            beside = beside.unionByName(checks.phrase_leaks(shown_strings, phrases))
        findings = findings.unionByName(checks.beyond(beside, left).select("doc_id", "unit_id", F.lit("string").alias("kind"), "start", "word", "entity"))
    return Result(hits, shown, out, key, left, findings, swaps, odd, labels)


def _labels(mode: str) -> tuple[Column, Column]:
    """What persons and organisations are called, in the modes that can't be undone."""
    if mode == "name":
        return F.lit("[NAME]"), F.lit("[EINRICHTUNG]")
    return F.concat(F.lit("Person "), "letter"), F.concat(F.lit("Einrichtung "), "letter")


def _strings(strings: DataFrame, options: Options, forms: DataFrame, letters: DataFrame, orgs: DataFrame, placed: DataFrame | None) -> DataFrame:
    """Free strings by the forms, organisations and placeholders of their documents."""
    person, org = _labels(options.mode)
    if placed is not None:
        # a spelling that no placeholder stands for can't be restored, and says so
        person, org = F.concat(F.lit("Name "), "letter"), F.lit("[EINRICHTUNG]")
    labelled = forms.join(letters, ["doc_id", "entity"]).select("doc_id", "form", "ambiguous", person.alias("label"))
    terms = orgs.select("doc_id", F.col("entity").alias("term"), org.alias("label")).distinct()
    if placed is None:
        return free.masked_strings(strings, labelled, options.contacts, terms)
    exact = placed.filter("kind in ('person', 'org') and coalesce(role, '') <> 'Initiale' and char_length(value) > 1").groupBy("doc_id", "value").agg(F.min("placeholder").alias("placeholder"))
    numbered = placed.filter("kind not in ('person', 'org')").select("doc_id", "kind", "value", "placeholder").distinct()
    return free.masked_strings(strings, labelled, options.contacts, terms, exact, numbered)
