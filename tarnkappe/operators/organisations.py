"""Organisations that a user lists: phrases found by a join on runs of tokens, the longest first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnkappe.functions.text import fold, let
from tarnkappe.operators.tokens import as_lines, stems, tiles
from tarnkappe.session import written


def term_runs(terms: DataFrame) -> DataFrame:
    """(term, n, run): the folded tokens of each term, joined by spaces."""
    pieces = F.filter(tiles(F.trim("term")), lambda t: ~t.rlike(r"^[\s\x{a0}]"))
    rows = terms.select("term").distinct().withColumn("pieces", pieces).filter(F.size("pieces") > 0)
    return rows.select("term", F.size("pieces").alias("n"), F.array_join(F.transform("pieces", fold), " ").alias("run"))


#: First signs of the endings that a last word may have, folded.
_ENDINGS = "'sen"


def _begins(word: Column) -> Column:
    """The first two signs of a folded word; a Greek final sigma may be one because an ending was cut off."""
    return F.translate(F.substring(word, 1, 2), "ς", "σ")


def find(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """``find_in_lines`` for tokens as rows."""
    return find_in_lines(as_lines(tokens, ["pos", "text", "start", "end"]), terms)


def find_in_lines(lines: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, unit_id, start, end, term, suffix) of all places of listed terms; ``lines`` has an array of tokens a unit.

    Runs of as many tokens as a term has, made inside a unit's row, meet the terms by an equal join of their folded text;
    the last word may have an ending. Runs don't go over a unit. Of overlapping places the longer, then the earlier stays: a place is dropped if a better one that isn't
    itself beaten overlaps it.
    """
    runs = term_runs(terms)
    lengths = sorted(r.n for r in runs.select("n").distinct().collect())  # as many as the longest term has tokens, at most
    if not lengths:
        none = lines.select("doc_id", "unit_id", F.inline("tokens"))
        return none.select("doc_id", "unit_id", "start", "end", F.lit(None).cast("string").alias("term"), F.lit(None).cast("string").alias("suffix")).limit(0)

    def run(t: Column, p: Column, n: int) -> Column:
        """The run of ``n`` tokens from place ``p`` on; null where the unit ends before."""
        last, at = F.get(t, p + n - 1), F.get(t, p)
        before = F.lit("") if n == 1 else F.array_join(F.transform(F.slice(t, p + 1, n - 1), lambda x: x["key"]), " ")
        return F.when(last.isNotNull(), F.struct(at["start"].alias("start"), last["end"].alias("end"), F.lit(n).alias("n"), at["key"].alias("first"), before.alias("before"), last["text"].alias("last"), _begins(last["key"]).alias("begins")))

    keyed = F.transform("tokens", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"), fold(x["text"]).alias("key")))
    all_runs = let(keyed, lambda t: F.flatten(F.transform(F.sequence(F.lit(0), F.size(t) - 1), lambda p: F.filter(F.array(*[run(t, p, n) for n in lengths]), lambda x: x.isNotNull()))))
    rows = lines.select("doc_id", "unit_id", F.explode_outer(all_runs).alias("r")).filter("r is not null").select("doc_id", "unit_id", "r.*")
    # a run begins as a term of as many tokens does, and its last word as that of the term; only that may have an ending
    words = F.split("run", " ")
    last = F.element_at(words, -1)
    short = F.transform(F.split(F.lit(_ENDINGS), ""), lambda e: F.concat(last, e))
    ends = F.when(F.char_length(last) > 1, F.array(_begins(last))).otherwise(F.concat(F.array(_begins(last)), F.transform(short, _begins)))
    like = runs.select("n", F.when(F.col("n") > 1, F.element_at(words, 1)).otherwise("").alias("first"), F.explode(ends).alias("begins")).distinct()
    rows = rows.withColumn("first", F.when(F.col("n") > 1, F.col("first")).otherwise("")).join(like, ["n", "first", "begins"], "left_semi")
    cuts = rows.select("doc_id", "unit_id", "start", "end", "n", "before", F.posexplode_outer(stems(F.col("last"))).alias("nth", "cut"))
    stem = fold(F.col("cut.stem"))
    places = cuts.withColumn("run", F.when(F.col("n") > 1, F.concat_ws(" ", "before", stem)).otherwise(stem)).join(runs, ["n", "run"])
    # the places of a unit are few: the best term of each run stays, and those kept are collected in order of rank
    place = F.struct((-F.col("n")).alias("rank"), "start", "nth", "term", "end", F.col("cut.suffix").alias("suffix"))
    units = places.groupBy("doc_id", "unit_id").agg(F.array_sort(F.collect_list(place)).alias("places"))
    none = F.expr("filter(places, p -> false)")
    kept = F.aggregate("places", none, lambda acc, p: F.when(F.exists(acc, lambda k: (p["start"] < k["end"]) & (p["end"] > k["start"])), acc).otherwise(F.concat(acc, F.array(p))))
    return units.select("doc_id", "unit_id", F.explode_outer(kept).alias("p")).select("doc_id", "unit_id", "p.start", "p.end", "p.term", "p.suffix")


#: Places in the second of two joined lines count from here on; no line is as long.
SECOND = 1 << 30


def find_across(tokens: DataFrame, terms: DataFrame, inside: DataFrame) -> DataFrame:
    """``find_across_lines`` for tokens as rows."""
    return find_across_lines(as_lines(tokens, ["pos", "text", "start", "end"]), terms, inside)


def find_across_lines(lines: DataFrame, terms: DataFrame, inside: DataFrame) -> DataFrame:
    """(doc_id, unit_id, start, end, term, suffix, rest) of terms that end a line and go on at the start of the next.

    The next line is the unit with the next higher number. Only the last and first tokens of two lines are put side by
    side, fewer of each than the longest term has, so whole texts aren't joined. ``inside`` are the places that
    ``find`` gives: where they overlap, the place with more letters stays (the one inside a line, if both have as many),
    and so among the places across two lines, then the one further up. A place gives two rows; the second, in the next
    line, is the ``rest``. Nothing but white space stands behind the first part or before the second.
    """
    runs = term_runs(terms)
    most = runs.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]  # a single number
    unit = lines.schema["unit_id"].dataType
    ends = [F.get("tokens", 0)["start"].alias("head"), F.element_at("tokens", -1)["end"].alias("last")]
    filled = lines.filter(F.size("tokens") > 0)
    part = lambda t, more: F.struct(t["text"].alias("text"), (t["start"] + more).cast("int").alias("start"), (t["end"] + more).cast("int").alias("end"), fold(t["text"]).alias("key"))
    words = F.split("run", " ")
    several = runs.filter("n > 1")
    # only lines that end with the beginning of a term, and those that begin as one goes on, are put side by side
    opens = several.select(F.explode(F.slice(words, 1, F.col("n") - 1)).alias("key")).distinct()
    reach = max(most - 1, 1)
    tail = F.slice("tokens", F.greatest(F.size("tokens") - reach + 1, F.lit(1)), reach)
    tails = filled.select("doc_id", "unit_id", *ends[1:], F.transform(tail, lambda t: part(t, 0)).alias("part")).withColumn("key", F.element_at("part", -1)["key"])
    tails = tails.join(opens, "key", "left_semi").drop("key")
    goes_on = several.select(F.explode(F.slice(words, 2, F.col("n") - 1)).alias("word"))
    short = F.transform(F.split(F.lit(_ENDINGS), ""), lambda e: F.concat("word", e))
    goes_on = goes_on.select(F.explode(F.concat(F.array(_begins(F.col("word"))), F.when(F.char_length("word") > 1, F.array().cast("array<string>")).otherwise(F.transform(short, _begins)))).alias("begins")).distinct()
    heads = filled.select("doc_id", (F.col("unit_id") - 1).cast(unit).alias("unit_id"), ends[0], ends[1].alias("last2"), F.transform(F.slice("tokens", 1, reach), lambda t: part(t, SECOND)).alias("more"))
    heads = heads.withColumn("begins", _begins(F.get("more", 0)["key"])).join(goes_on, "begins", "left_semi").drop("begins")
    both = written(tails.join(heads, ["doc_id", "unit_id"]).select("doc_id", "unit_id", "head", "last", "last2", F.concat("part", "more").alias("tokens")), "line-breaks")
    found = find_in_lines(both, terms.filter(F.size(tiles(F.trim("term"))) > 1)).filter((F.col("start") < SECOND) & (F.col("end") > SECOND))
    across = found.join(both.drop("tokens"), ["doc_id", "unit_id"])
    size = F.char_length("term")
    first = across.select("doc_id", "unit_id", "term", "suffix", "start", F.col("last").alias("end"), size.alias("size"), F.col("unit_id").alias("above"), F.lit(False).alias("rest"))
    second = across.select("doc_id", (F.col("unit_id") + 1).cast(unit).alias("unit_id"), "term", "suffix", F.col("head").alias("start"), F.least(F.col("end") - SECOND, "last2").alias("end"), size.alias("size"), F.col("unit_id").alias("above"), F.lit(True).alias("rest"))
    parts = first.unionByName(second)
    kept = inside.select("doc_id", "unit_id", "start", "end", F.char_length("term").alias("size"), F.lit(None).cast(unit).alias("above"))
    others = kept.unionByName(parts.select(kept.columns)).select(F.col("doc_id").alias("d"), F.col("unit_id").alias("u"), F.col("start").alias("s"), F.col("end").alias("e"), F.col("size").alias("z"), F.col("above").alias("a"))
    better = (F.col("z") > F.col("size")) | ((F.col("z") == F.col("size")) & (F.col("a").isNull() | (F.col("a") < F.col("above"))))
    beaten = parts.join(others, (F.col("doc_id") == F.col("d")) & (F.col("unit_id") == F.col("u")) & (F.col("start") < F.col("e")) & (F.col("end") > F.col("s")) & better, "left_semi").select("doc_id", "above").distinct()
    good = parts.join(beaten, ["doc_id", "above"], "left_anti")
    return good.select("doc_id", "unit_id", "start", F.col("end").cast("int").alias("end"), "term", F.when(F.col("rest"), F.col("suffix")).otherwise("").alias("suffix"), "rest")


def without_overlaps(inside: DataFrame, across: DataFrame) -> DataFrame:
    """Places of ``find`` and of ``find_across`` together, with ``rest``; places inside a line give way to those across."""
    a = across.select(F.col("doc_id").alias("d"), F.col("unit_id").alias("u"), F.col("start").alias("s"), F.col("end").alias("e"))
    alone = inside.join(a, (F.col("doc_id") == F.col("d")) & (F.col("unit_id") == F.col("u")) & (F.col("start") < F.col("e")) & (F.col("end") > F.col("s")), "left_anti")
    return alone.withColumn("rest", F.lit(False)).unionByName(across)


def uncovered(places: DataFrame, hits: DataFrame) -> DataFrame:
    """Places of terms that no active hit (doc_id, unit_id, start, end) covers whole: an interval anti-join."""
    h = hits.select("doc_id", "unit_id", F.col("start").alias("s"), F.col("end").alias("e"))
    return places.join(h, (places["doc_id"] == h["doc_id"]) & (places["unit_id"] == h["unit_id"]) & (F.col("s") <= F.col("start")) & (F.col("e") >= F.col("end")), "left_anti")
