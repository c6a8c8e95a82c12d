"""Reversible placeholders, the key that restores them, and the check of a key against an edited text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnkappe.functions.text import apply_spans, let, spans

#: Placeholder words of name parts, of whole persons and organisations, of contacts, and endings of names.
NAME_WORDS = ("Vorname", "Nachname", "Initiale", "Name")
WHOLE_WORDS = ("Person", "Einrichtung")
CONTACT_BASE = {"email": "E-MAIL", "phone": "TELEFON", "iban": "IBAN", "address": "ADRESSE"}
BRACKET_WORDS = (*CONTACT_BASE.values(), "NAME", "EINRICHTUNG")
ENDINGS = ("'s", "’s", "'", "’", "s", "es", "ns", "n")

_FREE_BEFORE, _FREE_AFTER = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
_ENDING = f"(?:{'|'.join(ENDINGS)})?"
_NAMES = f"(?:{'|'.join(NAME_WORDS)})"
NAME_PLACEHOLDER = rf"{_FREE_BEFORE}(?:{'|'.join((*NAME_WORDS, 'Einrichtung'))}) [A-Z]+[0-9]*(?={_ENDING}{_FREE_AFTER})"
CONTACT_PLACEHOLDER = rf"\[(?:{'|'.join(CONTACT_BASE.values())})-[0-9]+\]"
LOOSE = rf"(?i){_FREE_BEFORE}{_NAMES}[sn]?[\s_-]*(?!{_NAMES}[sn]?[\s_-])[A-Z]+[0-9]*{_FREE_AFTER}"
_CONTACTS = "|".join(("E-MAIL", "EMAIL", *list(CONTACT_BASE.values())[1:]))
#: A contact's word and number with at least one bracket, in any case, with or without what stands between.
LOOSE_CONTACT = rf"(?i)\[\s*(?:{_CONTACTS})[\s_-]*[0-9]+(?:\s*\])?|{_FREE_BEFORE}(?:{_CONTACTS})[\s_-]*[0-9]+\s*\]"
#: What could be taken for a placeholder: any of the words with a letter behind, or one in brackets, and what is glued to it.
LIKE_NAME = rf"{_FREE_BEFORE}(?:{'|'.join((*NAME_WORDS, *WHOLE_WORDS))})[ \u00a0][A-Z][A-Z0-9]*{_ENDING}{_FREE_AFTER}"
LIKE_BRACKET = rf"\[(?:{'|'.join(BRACKET_WORDS)})(?:-[\p{{L}}\p{{N}}]*)?\][\p{{L}}\p{{N}}]*"


def name_parts(hits: DataFrame) -> DataFrame:
    """(doc_id, unit_id, start, end, role, letter, value) of linked persons' mentions; ``hits`` carries parts, letter, link, text.

    The surname with its particles is one part, what stands before it another; a single word takes its role from how it
    was linked, from a title, or from the lists.
    """
    words = F.filter("parts", lambda p: p["kind"] == "word")
    swapped = F.exists(F.transform("parts", lambda p: (p["key"] == F.col("surname")) & (p["start"] == F.get("parts", 0)["start"])), lambda x: x) & (F.size(words) > 1) & F.substr("text", F.get("parts", 0)["end"] + 1, F.lit(1)).eqNullSafe(",")
    lone = F.get(words, 0)
    role = F.when(F.col("link") == "given name only", "Vorname").when((F.col("link") == "surname only") | F.col("titled"), "Nachname").when(lone["last"], "Nachname").when(lone["first"], "Vorname").otherwise("Name")
    n = F.size("parts")
    # the place of the surname's first part: the last word and the particles right before it
    from_end = F.size(F.filter(F.sequence(F.lit(1), n - 1), lambda i: F.forall(F.slice("parts", i, n - i), lambda p: p["kind"] == "particle")))
    cut = n - 1 - from_end

    def whole(group: Column, name: Column) -> Column:
        return F.struct(F.get(group, 0)["start"].alias("start"), F.element_at(group, -1)["stem_end"].alias("end"), name.alias("role"))

    given, surname = F.slice("parts", 1, cut), F.slice("parts", cut + 1, n)
    initials = F.forall(given, lambda p: p["kind"] == "initial")
    two = F.when(cut > 0, F.array(whole(given, F.when(initials, "Initiale").otherwise("Vorname")), whole(surname, F.lit("Nachname")))).otherwise(F.array(whole(surname, F.lit("Nachname"))))
    turned = F.array(whole(F.slice("parts", 1, 1), F.lit("Nachname")), whole(F.slice("parts", 2, n), F.lit("Vorname")))
    groups = F.when(n == 1, F.array(whole(F.col("parts"), role))).when(swapped, turned).otherwise(two)
    rows = hits.select("doc_id", "unit_id", "letter", "text", F.explode(groups).alias("g")).select("doc_id", "unit_id", "letter", "text", "g.*")
    return rows.withColumn("value", F.substr("text", F.col("start") + 1, F.col("end") - F.col("start"))).drop("text")


def with_tails(hits: DataFrame) -> DataFrame:
    """``hits`` (parts, suffix, end, text) whose last word takes in what an edited text couldn't tell from a number or letter
    of the placeholder: digits and letters right behind the name, and an ending in capitals."""
    tail = F.char_length(F.regexp_extract(F.substr("text", F.col("end") + 1), r"^[\p{L}\p{N}]+", 0))
    odd = (tail > 0) | F.col("suffix").rlike(r"\p{Lu}")
    longer = F.transform("parts", lambda p: F.when(p["end"] == F.col("end"), p.withField("stem_end", F.col("end") + tail)).otherwise(p))
    return hits.withColumn("parts", F.when(odd, longer).otherwise(F.col("parts")))


def numbered(values: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """``values`` (doc_id, base, value, unit_id, start) with a placeholder for each different value of a base.

    In order of first sight the values get base, base2, base3 and so on; bases in brackets count from 1. Words of
    ``taken`` (doc_id, word) are skipped.
    """
    first = values.groupBy("doc_id", "base", "value").agg(F.min(F.struct("unit_id", "start")).alias("at"))
    ranked = first.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "base").orderBy("at", "value")))

    def shown(n: Column) -> Column:
        plain = F.when(n > 1, F.concat("base", n.cast("string"))).otherwise(F.col("base"))
        return F.when(F.startswith("base", F.lit("[")), F.concat(F.expr("substr(base, 1, length(base) - 1)"), F.lit("-"), n.cast("string"), F.lit("]"))).otherwise(plain)

    if taken is None:
        named = ranked.withColumn("placeholder", shown(F.col("nth")))
    else:
        # only documents with taken words need to look which placeholders are free
        own = ranked.join(taken.groupBy("doc_id").agg(F.count("*").alias("m")), "doc_id").groupBy("doc_id", "base").agg((F.count("*") + F.max("m")).alias("n"))
        pool = own.select("doc_id", "base", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("i")).withColumn("placeholder", shown(F.col("i")))
        pool = pool.join(taken.select("doc_id", F.col("word").alias("placeholder")).distinct(), ["doc_id", "placeholder"], "left_anti")
        pool = pool.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "base").orderBy("i"))).drop("i")
        named = ranked.join(pool, ["doc_id", "base", "nth"], "left").withColumn("placeholder", F.coalesce("placeholder", shown(F.col("nth"))))
    return values.join(named.select("doc_id", "base", "value", "placeholder"), ["doc_id", "base", "value"])


def restore_key(placed: DataFrame) -> DataFrame:
    """(doc_id, placeholder, value, count, category, role, owner) of the placeholders that stand in the output.

    The category is person, org or the kind of contact; persons have a role, and they and organisations an owner, the
    letter that all placeholders of one share. ``placed`` may lack kind, role and letter; then these are null.
    """
    have = set(placed.columns)
    fact = lambda own, name: (F.min(own) if own in have else F.lit(None).cast("string")).alias(name)
    return placed.groupBy("doc_id", "placeholder").agg(F.min("value").alias("value"), F.count("*").alias("count"), fact("kind", "category"), fact("role", "role"), fact("letter", "owner"))


_ENTRY = "placeholder string, value string, count long, category string, role string, owner string"
_ENTRIES = "array<struct<" + ",".join(f.replace(" ", ":") for f in _ENTRY.split(", ")) + ">>"


def key_json(key: DataFrame, persons: DataFrame | None = None, originals: DataFrame | None = None) -> DataFrame:
    """One JSON text for each document with a key.

    Its version is 2 if it holds an organisation, else 1, so that readers who know none refuse it. ``persons`` (doc_id,
    letter, display) says how the owners are shown, with their placeholders; ``originals`` (doc_id, word, n) are words like
    placeholders that stood in the text before, which a restore spares.
    """
    have = set(key.columns)
    entry = [F.col(n) if n in have else F.lit(None).cast(t).alias(n) for n, t in (x.split() for x in _ENTRY.split(", "))]
    rows = key.select("doc_id", F.struct(*entry).alias("e"))
    version = F.when(F.max(F.coalesce(F.col("e.category") == "org", F.lit(False))), 2).otherwise(1)
    whole = rows.groupBy("doc_id").agg(version.alias("version"), F.array_sort(F.collect_list("e")).alias("placeholders"))
    if persons is not None:
        names = persons.select("doc_id", F.col("letter").alias("owner"), "display")
        own = rows.filter("e.category = 'person'").groupBy("doc_id", F.col("e.owner").alias("owner")).agg(F.array_sort(F.collect_list("e.placeholder")).alias("placeholders")).join(names, ["doc_id", "owner"])
        per = own.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("owner", "display", "placeholders"))).alias("persons"))
        whole = whole.join(per, "doc_id", "left")
    if originals is not None:
        before = originals.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("word", "n"))).alias("originals"))
        whole = whole.join(before, "doc_id", "left")
    facts = [c for c in whole.columns if c != "doc_id"]
    return whole.select("doc_id", F.to_json(F.struct(*facts)).alias("key"))


def parse_key(texts: DataFrame) -> DataFrame:
    """(doc_id, placeholder, value, count, category, role, owner, problem) from (doc_id, key); a broken key has one row that names its problem."""
    schema = f"version int, placeholders {_ENTRIES}"
    parsed = texts.withColumn("k", F.from_json(F.regexp_replace("key", "^﻿", ""), schema))
    items = F.coalesce("k.placeholders", F.array().cast(_ENTRIES))
    names = F.transform(items, lambda x: x["placeholder"])
    problem = (
        F.when(F.trim(F.coalesce("key", F.lit(""))) == "", "empty")
        .when(F.col("k.version").isNull(), "not a key")
        .when(F.col("k.version") > 2, "unknown version")
        .when(F.exists(items, lambda x: x["placeholder"].isNull() | x["value"].isNull()), "damaged entry")
        .when(F.size(F.array_distinct(names)) < F.size(names), "repeated placeholder")
        .when(F.size(items) == 0, "no placeholders")
    )
    good = parsed.withColumn("problem", problem)
    rows = good.filter("problem is null").select("doc_id", F.inline("k.placeholders"), F.lit(None).cast("string").alias("problem"))
    return rows.unionByName(good.filter("problem is not null").select("doc_id", "problem"), allowMissingColumns=True)


def _exact(text: Column) -> Column:
    return F.concat(spans(text, NAME_PLACEHOLDER), spans(text, CONTACT_PLACEHOLDER))


def found_placeholders(units: DataFrame) -> DataFrame:
    """(doc_id, unit_id, start, end, placeholder) of everything in the texts that is written exactly like a placeholder."""
    return units.select("doc_id", "unit_id", F.explode_outer(_exact(F.coalesce("text", F.lit("")))).alias("s")).filter("s is not null").select("doc_id", "unit_id", "s.start", "s.end", F.col("s.text").alias("placeholder"))


def restore(units: DataFrame, key: DataFrame) -> DataFrame:
    """``units`` with ``restored``: exact placeholders of the key replaced by their values."""
    hits = found_placeholders(units).join(key.select("doc_id", "placeholder", "value"), ["doc_id", "placeholder"])
    per = hits.groupBy("doc_id", "unit_id").agg(F.collect_list(F.struct("start", "end", F.col("value").alias("text"))).alias("r"))
    rows = units.join(per, ["doc_id", "unit_id"], "left")
    none = F.array().cast("array<struct<start:int,end:int,text:string>>")
    return rows.withColumn("restored", apply_spans(F.col("text"), F.coalesce("r", none))).drop("r")


def restore_plan(units: DataFrame, key: DataFrame) -> DataFrame:
    """(doc_id, placeholder, expected, found, status): expected against found; what isn't in the key is ``unknown``."""
    found = found_placeholders(units).groupBy("doc_id", "placeholder").agg(F.count("*").alias("found"))
    both = key.select("doc_id", "placeholder", F.col("count").alias("expected")).join(found, ["doc_id", "placeholder"], "full_outer")
    n = F.coalesce("found", F.lit(0))
    status = F.when(F.col("expected").isNull(), "unknown").when(n == F.col("expected"), "ok").when(n < F.col("expected"), "fewer").otherwise("more")
    return both.select("doc_id", "placeholder", "expected", n.alias("found"), status.alias("status"))


def verdict(plan: DataFrame) -> DataFrame:
    """(doc_id, verdict): wrong if nothing was found; doubtful if under half of the placeholders were found or found as
    often as expected, or over a fifth of all places are unknown; else fitting."""
    known = F.col("expected").isNotNull()
    sums = plan.groupBy("doc_id").agg(
        F.sum(known.cast("int")).alias("n"), F.sum((known & (F.col("found") > 0)).cast("int")).alias("hit"), F.sum((F.col("status") == "ok").cast("int")).alias("ok"),
        F.sum(F.when(known, F.col("found")).otherwise(0)).alias("places"), F.sum(F.when(~known, F.col("found")).otherwise(0)).alias("unknown"),
    )
    doubt = (F.col("hit") * 2 < F.col("n")) | (F.col("ok") * 2 < F.col("n")) | (F.col("unknown") * 5 > F.col("places"))
    return sums.select("doc_id", F.when(F.col("places") == 0, "wrong").when(doubt, "doubtful").otherwise("fitting").alias("verdict"))


def changed_placeholders(units: DataFrame, key: DataFrame | None) -> DataFrame:
    """(doc_id, unit_id, start, text, guess, kind): what looks like a placeholder of the key but was changed; reported, never guessed at.

    What is no exact placeholder is found inside the row, without a join or group of places. Its kind is ``split`` if a line break stands inside, ``inflected`` if its word has an ending, else ``changed``.
    """
    text = F.coalesce("text", F.lit(""))
    loose = F.array_distinct(F.concat(spans(text, LOOSE), spans(text, LOOSE_CONTACT)))
    apart = let(_exact(text), lambda exact: F.filter(loose, lambda s: ~F.exists(exact, lambda e: (s["start"] < e["end"]) & (s["end"] > e["start"]))))
    free = units.select("doc_id", "unit_id", F.explode_outer(apart).alias("s")).filter("s is not null").select("doc_id", "unit_id", "s.*")
    word = F.initcap(F.regexp_extract("text", r"(?i)^(Vorname|Nachname|Initiale|Name)", 1))
    letter = F.upper(F.regexp_extract("text", r"(?i)^(?:Vorname|Nachname|Initiale|Name)(?:s|n)?[\s_-]*([A-Z]+[0-9]*)$", 1))
    base = F.replace(F.upper(F.regexp_extract("text", rf"(?i)({_CONTACTS})", 1)), F.lit("EMAIL"), F.lit("E-MAIL"))
    contact = F.concat(F.lit("["), base, F.lit("-"), F.regexp_extract("text", "([0-9]+)", 1), F.lit("]"))
    kind = F.when(F.col("text").rlike(r"[\r\n]"), "split").when(F.col("text").rlike(rf"(?i)^{_NAMES}[sn]\b"), "inflected").otherwise("changed")
    rows = free.withColumn("guess", F.when(F.col("text").rlike(r"[\[\]]"), contact).otherwise(F.concat_ws(" ", word, letter))).withColumn("kind", kind)
    return _of_key(rows, key).select("doc_id", "unit_id", "start", "text", "guess", "kind")


def _of_key(rows: DataFrame, key: DataFrame | None) -> DataFrame:
    """``rows`` whose guess the key has; all of them without a key."""
    return rows if key is None else rows.join(key.select("doc_id", F.col("placeholder").alias("guess")), ["doc_id", "guess"], "left_semi")


def split_placeholders(units: DataFrame, key: DataFrame | None) -> DataFrame:
    """(doc_id, unit_id, start, text, guess): a placeholder's word ends a unit, its letter begins the unit with the next number.

    Only the ends and beginnings of units that look like it are joined.
    """
    text = F.coalesce("text", F.lit(""))
    end = F.regexp_extract(text, rf"{_FREE_BEFORE}({'|'.join((*NAME_WORDS, 'Einrichtung'))})\s*$", 1)
    begin = F.regexp_extract(text, rf"^\s*([A-Z]+[0-9]*){_FREE_AFTER}", 1)
    place = F.char_length(F.rtrim(F.regexp_replace(text, r"\s+$", ""))) - F.char_length("word")
    upper = units.select("doc_id", "unit_id", "text", end.alias("word")).filter("word <> ''").select("doc_id", "unit_id", place.alias("start"), "word")
    lower = units.select("doc_id", (F.col("unit_id") - 1).alias("unit_id"), begin.alias("letter")).filter("letter <> ''")
    rows = upper.join(lower.hint("merge"), ["doc_id", "unit_id"]).withColumn("guess", F.concat_ws(" ", "word", "letter"))
    return _of_key(rows, key).select("doc_id", "unit_id", "start", F.concat_ws(" | ", "word", "letter").alias("text"), "guess")


def restore_issues(units: DataFrame, key: DataFrame, originals: DataFrame | None = None) -> DataFrame:
    """(doc_id, unit_id, start, kind, text, guess): what a restored text leaves open.

    ``unknown`` placeholders that the key doesn't have, ``changed``, ``inflected`` and ``split`` ones. ``originals``
    (doc_id, word) are words like placeholders that stood in the text before; they are spared.
    """
    exact = found_placeholders(units).select("doc_id", "unit_id", "start", F.lit("unknown").alias("kind"), F.col("placeholder").alias("text"), F.col("placeholder").alias("guess"))
    columns = ["doc_id", "unit_id", "start", "kind", "text", "guess"]
    rows = exact.unionByName(changed_placeholders(units, None).select(columns)).unionByName(split_placeholders(units, None).withColumn("kind", F.lit("split")).select(columns))
    # all kinds look into the key in one join: exact ones must not be there, the guesses for others must
    # Spark guesses exploded tables to be small and would broadcast them whole, so these joins say that both sides are dealt
    known = key.select("doc_id", F.col("placeholder").alias("guess")).distinct().withColumn("known", F.lit(True)).hint("merge")
    rows = rows.join(known, ["doc_id", "guess"], "left").filter((F.col("kind") == "unknown") == F.col("known").isNull())
    rows = rows.withColumn("guess", F.when(F.col("known"), F.col("guess"))).select(columns)
    return rows if originals is None else rows.join(originals.select("doc_id", F.col("word").alias("text")).distinct(), ["doc_id", "text"], "left_anti").select(columns)


def leftovers(restored: DataFrame, key: DataFrame) -> DataFrame:
    """(doc_id, unit_id, start, placeholder): placeholders of the key that still stand in a restored text."""
    return found_placeholders(restored).join(key.select("doc_id", "placeholder").distinct(), ["doc_id", "placeholder"], "left_semi").select("doc_id", "unit_id", "start", "placeholder")
