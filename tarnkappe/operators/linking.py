"""From mentions to persons: short forms are linked, merges resolved, name parts spread, letters given.

A mention row has doc_id, unit_id, start, end, and given, surname or single. Everything is grouped or joined by doc_id
and a name key, so a document is never gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnkappe.functions import lexicon
from tarnkappe.functions.text import fold, letter_for
from tarnkappe.operators import reversible
from tarnkappe.operators.tokens import one_of, stems
from tarnkappe.session import written

INITIAL_ONLY = r"\.$"
_SHORT_DATES = f"{lexicon.WEEKDAYS_SHORT} {lexicon.MONTHS_SHORT}"


def full_names(mentions: DataFrame) -> DataFrame:
    """Distinct (doc_id, given, surname, entity) of the mentions with a written-out given name."""
    full = mentions.filter(F.col("given").isNotNull() & (F.col("given") != "") & ~F.col("given").rlike(INITIAL_ONLY))
    return full.select("doc_id", "given", "surname").distinct().withColumn("entity", F.concat_ws("|", F.lit("N"), "given", "surname"))


def _one_each(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The entity of each key, and whether it is the only one."""
    return rows.groupBy(*keys).agg(F.min("entity").alias("entity"), (F.countDistinct("entity") == 1).alias("only"))


def link(mentions: DataFrame, unlinks: DataFrame | None = None) -> DataFrame:
    """``mentions`` with own (its own key), entity and link (how a short form was linked; ``ambiguous`` if several fit).

    A single name goes to the one full name with that surname (also its last word or a part between hyphens), else to the
    one with that given name; initials go to the one full name with that surname whose given name starts alike. Rows of
    ``unlinks`` (doc_id, own) stay on their own.
    """
    full = full_names(mentions)
    last = F.element_at(F.split("surname", " "), -1)
    by_surname = full.select("doc_id", "given", "surname", "entity", F.explode(F.array_distinct(F.concat(F.array("surname", last), F.split(last, "-")))).alias("key"))
    by_given = full.select("doc_id", "entity", F.element_at(F.split("given", " "), 1).alias("key"))
    surnames = _one_each(by_surname, ["doc_id", "key"]).select("doc_id", F.col("key").alias("name"), F.col("entity").alias("by_surname"), F.col("only").alias("one_surname"))
    givens = _one_each(by_given, ["doc_id", "key"]).select("doc_id", F.col("key").alias("name"), F.col("entity").alias("by_given"), F.col("only").alias("one_given"))
    starts = _one_each(by_surname.withColumn("letter", F.substring("given", 1, 1)), ["doc_id", "key", "letter"])
    starts = starts.select("doc_id", F.col("key").alias("name"), "letter", F.col("entity").alias("by_initial"), F.col("only").alias("one_initial"))
    whole = F.col("given").isNotNull() & (F.col("given") != "") & ~F.col("given").rlike(INITIAL_ONLY)
    own = F.when(F.col("single").isNotNull(), F.concat_ws("|", F.lit("S"), "single")).otherwise(F.concat_ws("|", F.lit("N"), "given", "surname"))
    rows = mentions.withColumn("own", own).withColumn("name", F.coalesce("single", "surname")).withColumn("letter", F.when(F.col("single").isNull(), F.substring("given", 1, 1)))
    rows = rows.join(surnames, ["doc_id", "name"], "left").join(givens, ["doc_id", "name"], "left").join(starts, ["doc_id", "name", "letter"], "left")
    free = F.lit(True)
    if unlinks is not None:
        rows = rows.join(unlinks.select("doc_id", "own").distinct().withColumn("alone", F.lit(True)), ["doc_id", "own"], "left")
        free = F.col("alone").isNull()
    single = F.col("single").isNotNull()
    choice = (
        F.when(whole | ~free, F.struct(F.col("own").alias("entity"), F.lit(None).cast("string").alias("link")))
        .when(single & F.col("one_surname"), F.struct(F.col("by_surname").alias("entity"), F.lit("surname only").alias("link")))
        .when(single & F.col("one_surname").isNull() & F.col("one_given"), F.struct(F.col("by_given").alias("entity"), F.lit("given name only").alias("link")))
        .when(single & (F.col("one_surname").isNotNull() | F.col("one_given").isNotNull()), F.struct(F.col("own").alias("entity"), F.lit("ambiguous").alias("link")))
        .when(~single & (F.col("given") != "") & F.col("one_initial"), F.struct(F.col("by_initial").alias("entity"), F.lit("initial and surname").alias("link")))
        .when(~single & (F.col("given") == "") & F.col("one_surname"), F.struct(F.col("by_surname").alias("entity"), F.lit("surname").alias("link")))
        .otherwise(F.struct(F.col("own").alias("entity"), F.lit(None).cast("string").alias("link")))
    )
    return rows.withColumn("chosen", choice).select(*mentions.columns, "own", "chosen.entity", "chosen.link")


def resolve_merges(hits: DataFrame, merges: DataFrame) -> DataFrame:
    """``hits`` with merged entities replaced by what they lead to; ``merges`` has doc_id, entity, target.

    Each round doubles the steps taken, until no target leads on; so chains of any length end where they should. A ring
    leads to its smallest entity: once all steps together are more than there are merges, whoever still leads on stands
    on a ring or leads into one, and has gone all around it. Of several targets of one entity the smallest counts.
    """
    chain = written(merges.filter("entity <> target").groupBy("doc_id", "entity").agg(F.min("target").alias("target")).withColumn("least", F.least("entity", "target")), "merges")
    number, steps = chain.count(), 1
    while True:
        after = chain.select("doc_id", F.col("entity").alias("target"), F.col("target").alias("further"), F.col("least").alias("below"))
        both = chain.join(after, ["doc_id", "target"], "left")
        if steps > 2 * number or not both.filter("further is not null").limit(1).count():
            break
        least = F.when(F.col("below").isNotNull(), F.least("least", "below")).otherwise(F.col("least"))
        chain = written(both.select("doc_id", "entity", F.coalesce("further", "target").alias("target"), least.alias("least")), "merges")
        steps *= 2
    # a target that still leads on lies on a ring, and the least that was met from there is the ring's
    ring = chain.select("doc_id", F.col("entity").alias("target"), F.col("least").alias("ring"))
    to = chain.join(ring, ["doc_id", "target"], "left").select("doc_id", "entity", F.coalesce("ring", "target").alias("target"))
    return hits.join(to, ["doc_id", "entity"], "left").withColumn("entity", F.coalesce("target", "entity")).drop("target")


def owned_parts(linked: DataFrame) -> DataFrame:
    """(doc_id, key, entity, grp) of name parts that may spread: words of three letters at least that exactly one entity owns.

    Words of certain mentions own; a word of a group (an uncertain name behind a form of address elsewhere) does where no
    certain mention has it, and hands on its group.
    """
    words = linked.select("doc_id", "entity", "certainty", "grp", F.explode("parts").alias("p")).filter("p.kind = 'word'").select("doc_id", "entity", "certainty", "grp", "p.key")
    words = words.filter((F.char_length("key") >= 3) & ~one_of(F.col("key"), lexicon.STOP) & ~one_of(F.col("key"), lexicon.PARTICLES))
    sure = F.col("certainty") == "certain"
    owner = lambda c: F.when(c, F.col("entity"))
    per = words.filter(sure | F.col("grp").isNotNull()).groupBy("doc_id", "key").agg(
        F.min(owner(sure)).alias("entity"), F.countDistinct(owner(sure)).alias("owners"),
        F.min(owner(~sure)).alias("weak"), F.countDistinct(owner(~sure)).alias("weak_owners"), F.min(F.when(~sure, F.col("grp"))).alias("grp"),
    )
    known = per.filter("owners = 1").select("doc_id", "key", "entity", F.lit(None).cast("string").alias("grp"))
    return known.unionByName(per.filter("owners = 0 and weak_owners = 1").select("doc_id", "key", F.col("weak").alias("entity"), "grp"))


def manual_parts(terms: DataFrame) -> DataFrame:
    """(doc_id, key, entity) of the words of terms (doc_id, term) that were marked by hand; a word of two terms is the smaller's."""
    whole = fold(F.trim(F.regexp_replace("term", r"[\s\x{a0}]+", " ")))
    rows = terms.select("doc_id", whole.alias("whole")).select("doc_id", F.concat(F.lit("M|"), "whole").alias("entity"), F.explode(F.split("whole", " ")).alias("key"))
    rows = rows.filter((F.char_length("key") >= 2) & ~one_of(F.col("key"), lexicon.PARTICLES))
    return rows.groupBy("doc_id", "key").agg(F.min("entity").alias("entity"))


def joined_words(hits: DataFrame) -> DataFrame:
    """Hits of one entity in a unit with at most one sign between become one, with the parts of all: gaps and islands."""
    order = Window.partitionBy("doc_id", "unit_id").orderBy("start")
    apart = (F.col("entity") != F.lag("entity").over(order)) | (F.col("start") - F.lag("end").over(order) > 1)
    island = F.sum(F.coalesce(apart.cast("int"), F.lit(1))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = hits.withColumn("island", island).groupBy("doc_id", "unit_id", "entity", "island").agg(F.array_sort(F.collect_list(F.struct("start", "end", "certainty", "suffix", "titled", "off", "single", "parts"))).alias("all"), F.max("link").alias("link"))
    keys = F.transform("all", lambda x: x["single"])
    n, first, last = F.size("all"), F.get("all", 0), F.element_at("all", -1)
    empty = F.lit(None).cast("string")
    return rows.select(
        "doc_id", "unit_id", first["start"].alias("start"), last["end"].alias("end"), first["certainty"].alias("certainty"), last["suffix"].alias("suffix"), first["titled"].alias("titled"), first["off"].alias("off"),
        F.when(n > 1, F.array_join(F.slice(keys, 1, n - 1), " ")).otherwise(empty).alias("given"), F.when(n > 1, F.element_at(keys, -1)).alias("surname"), F.when(n == 1, F.get(keys, 0)).alias("single"),
        F.flatten(F.transform("all", lambda x: x["parts"])).alias("parts"), "entity", "link",
    )


def noun_before(i: Column) -> Column:
    """Whether an article or preposition stands before token ``i`` of ``tokens``, with up to two small words between."""
    at = lambda k: F.get("tokens", i - k)
    small = lambda k: F.coalesce(at(k)["word"] & ~at(k)["cap"], F.lit(False))
    opens = lambda k: F.coalesce(at(k)["determiner"] | at(k)["preposition"], F.lit(False))
    return opens(1) | (small(1) & opens(2)) | (small(1) & small(2) & opens(3))


def propagate(lines: DataFrame, owned: DataFrame, covered: DataFrame, marked: bool = False, most: int = 300_000) -> DataFrame:
    """Further places of owned parts (doc_id, key, entity, grp) in lines of flagged tokens that no hit of ``covered`` touches.

    A token fits with the first of its stems that is a part; ambiguous words only with a capital, and then uncertain, and
    off behind an article or preposition. Weekdays and months are uncertain and off. A word with a group is uncertain and
    on, and of that group. An unknown capitalised word right before a clear part is taken in (``absorbed``: its start, end
    and key), and the whole is uncertain. Parts that are ``marked`` by hand are certain wherever they stand; but where they
    stand in capitals with an ending in capitals they are off, and ``caps``, since such a form may be another word. Words
    that are nobody's part are left out before the join, if parts have at most ``most`` different keys (broadcast).
    """
    kept = lambda t: t["word"] & ~t["exception"] if marked else t["word"] & ~t["stop"] & ~t["particle"] & ~t["strong"] & ~t["weak"] & ~t["exception"] & (t["cap"] | ~t["ambiguous"])
    small = lambda t, i: F.when(kept(t), F.struct(
        *[t[c].alias(c) for c in ("pos", "text", "start", "end", "cap", "ambiguous", "stop", "particle", "strong", "weak")],
        F.coalesce(t["calendar"] | (one_of(t["key"], _SHORT_DATES) & (F.get("tokens", i + 1)["text"] == ".") & (F.get("tokens", i + 1)["gap"] == "")), F.lit(False)).alias("calendar"),
        F.when(t["ambiguous"], noun_before(i)).alias("noun"), before(i, t["gap"]).alias("before"),
    ))

    def before(i: Column, gap: Column) -> Column:
        p = F.get("tokens", i - 1)
        unknown = p["word"] & p["cap"] & ~p["allcaps"] & ~(p["first"] | p["last"] | p["ambiguous"] | p["stop"] | p["strong"] | p["weak"] | p["exception"] | p["particle"] | p["calendar"])
        return F.when((i > 0) & gap.rlike(r"^[ \x{a0}]+$") & F.coalesce(unknown, F.lit(False)) & ~noun_before(i - 1), F.struct(p["start"].alias("start"), p["end"].alias("end"), p["key"].alias("key")))

    rows = lines.select("doc_id", "unit_id", F.explode_outer(F.filter(F.transform("tokens", small), lambda t: t.isNotNull())).alias("t")).filter("t is not null").select("doc_id", "unit_id", "t.*")
    cuts = rows.select("doc_id", "unit_id", "pos", "start", "end", "text", "cap", "ambiguous", "noun", "calendar", "before", (F.col("stop") | F.col("particle") | F.col("strong") | F.col("weak")).alias("small"), F.posexplode_outer(stems(F.col("text"))).alias("nth", "cut")).filter("cut is not null").withColumn("key", fold(F.col("cut.stem")))
    owned = written(owned, "owned")
    keys = written(owned.select("key").distinct(), "owned-keys")
    if keys.count() <= most:
        cuts = cuts.join(F.broadcast(keys), "key", "left_semi")
    owned = owned if "grp" in owned.columns else owned.withColumn("grp", F.lit(None).cast("string"))
    caps = F.col("cut.suffix").rlike(r"\p{Lu}") if marked else F.lit(False)
    found = cuts.join(owned, ["doc_id", "key"]).withColumn("caps", caps)
    found = found.filter("not (caps and small)") if marked else found
    # only places that fit are asked whether a hit touches them, so lines aren't shuffled
    spots = covered.groupBy("doc_id", "unit_id").agg(F.collect_list(F.struct("start", "end")).alias("spots"))
    touched = lambda start, end: F.coalesce(F.exists("spots", lambda s: (start < s["end"]) & (end > s["start"])), F.lit(False))
    found = found.join(spots, ["doc_id", "unit_id"], "left").filter(~touched(F.col("start"), F.col("end")))
    found = found.withColumn("before", F.when(F.col("before").isNotNull() & ~touched(F.col("before.start"), F.col("before.end")), F.col("before"))).drop("spots")
    first = F.row_number().over(Window.partitionBy("doc_id", "unit_id", "start").orderBy("nth"))
    found = found.withColumn("best", first).filter("best = 1")
    sure = F.lit(True) if marked else F.col("cap") & ~F.col("ambiguous") & F.col("grp").isNull() & ~F.col("calendar")
    # the word before is left alone where it is a place of its own
    own = F.coalesce(F.lag("pos").over(Window.partitionBy("doc_id", "unit_id").orderBy("pos")) == F.col("pos") - 1, F.lit(False))
    absorbed = F.lit(None).cast(found.schema["before"].dataType) if marked else F.when(sure & ~own, F.col("before"))
    found = found.withColumn("absorbed", absorbed)
    date = F.lit(False) if marked else F.col("calendar")
    return found.select(
        "doc_id", "unit_id", "start", "end", "entity", "key", F.col("cut.suffix").alias("suffix"),
        F.when(sure & F.col("absorbed").isNull(), "certain").otherwise("uncertain").alias("certainty"),
        (F.col("caps") | date | (~sure & F.col("ambiguous") & F.col("noun") & F.col("grp").isNull())).alias("off"),
        date.alias("calendar"), "caps", F.when(~date, F.col("grp")).alias("grp"), "absorbed",
    )


def placeholder_words(units: DataFrame) -> DataFrame:
    """(doc_id, word, n): what looks like a placeholder in the original already; none of these is given out."""
    text = F.coalesce("text", F.lit(""))
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in (reversible.LIKE_NAME, reversible.LIKE_BRACKET)])
    return units.select("doc_id", F.explode_outer(found).alias("word")).filter("word is not null").groupBy("doc_id", "word").agg(F.count("*").alias("n"))


def reserved(words: DataFrame) -> DataFrame:
    """(doc_id, word) that may not be given out: the words found, and what is left of them without an ending."""
    bare = lambda e: F.when(F.endswith("word", F.lit(e)), F.substr(F.col("word"), F.lit(1), F.char_length("word") - len(e)))
    stems_ = F.filter(F.array(*map(bare, reversible.ENDINGS)), lambda w: w.isNotNull() & w.rlike(r"[A-Z0-9\]]$"))
    return words.select("doc_id", F.explode(F.concat(F.array("word"), stems_)).alias("word")).distinct()


def letters(first_seen: DataFrame, taken: DataFrame | None = None, prefix: str = "Person ") -> DataFrame:
    """(doc_id, entity, letter) in order of first_seen (doc_id, entity, unit_id, start), skipping the letters of ``taken`` words."""
    order = Window.partitionBy("doc_id").orderBy("unit_id", "start", "entity")
    ranked = first_seen.groupBy("doc_id", "entity").agg(F.min(F.struct("unit_id", "start")).alias("at")).select("doc_id", "entity", "at.*")
    ranked = ranked.withColumn("nth", (F.row_number().over(order) - 1).cast("long"))
    if taken is None:
        return ranked.select("doc_id", "entity", letter_for(F.col("nth")).alias("letter"))
    bad = taken.filter(F.startswith("word", F.lit(prefix))).select("doc_id", F.substr("word", F.lit(len(prefix) + 1)).alias("letter")).distinct()
    # a document with taken letters needs as many as it has persons and taken ones; the others have theirs by number
    need = ranked.join(bad.groupBy("doc_id").agg(F.count("*").alias("m")), "doc_id").groupBy("doc_id").agg((F.count("*") + F.max("m")).alias("n"))
    pool = need.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i")).withColumn("letter", letter_for(F.col("i")))
    free = pool.join(bad, ["doc_id", "letter"], "left_anti").withColumn("nth", (F.row_number().over(Window.partitionBy("doc_id").orderBy("i")) - 1).cast("long"))
    named = ranked.join(free.select("doc_id", "nth", "letter"), ["doc_id", "nth"], "left")
    return named.select("doc_id", "entity", F.coalesce("letter", letter_for(F.col("nth"))).alias("letter"))


def display_forms(hits: DataFrame) -> DataFrame:
    """(doc_id, entity, display, forms): the most frequent surface form, then the longest, then the first by code points."""
    forms = hits.groupBy("doc_id", "entity", "surface").agg(F.count("*").alias("n"))
    best = Window.partitionBy("doc_id", "entity").orderBy(F.col("n").desc(), F.char_length("surface").desc(), "surface")
    top = forms.withColumn("best", F.row_number().over(best)).filter("best = 1").select("doc_id", "entity", F.col("surface").alias("display"))
    all_forms = forms.groupBy("doc_id", "entity").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("surface", "n")))).alias("forms"))
    return top.join(all_forms, ["doc_id", "entity"])
