"""Mixing sources to target weights, as a time-varying curriculum (operator 6; DataFrame operations only).

Targets: sources share a budget of words by weight; none may repeat its words too often, the excess goes to the others
by weight. Curriculum: each source has a weight schedule over the training time from 0 to 1. The integral of the
schedule is the source's cumulative demand; a copy of a document is due when that demand reaches the copy's place in its
source's words, so the place is put into the inverse of the integral. The demand of all sources up to that time, as a
part of the whole, is the copy's position in the stream of tokens, and the mix is range-sorted by it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnkappe.llm.common import GAP, count_words
from tarnkappe.session import written

#: Weights at the start, the end and, if there are more, at equal distances between, linear from one to the next; given
#: to sources in turn. Only their proportions count.
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))


def source_targets(sized: DataFrame, weights: tuple, budget: float, most: float) -> DataFrame:
    """A row for each source: source, nth, source_size, target.

    Sources in code point order, null last, take ``weights`` in turn. With level L a source gets the smaller of
    L * weight and ``most`` * size; L is where these sum up to the budget. Sources are filled up in the order of
    most * size / weight, so L follows from running sums.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    turn = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sources.withColumn("nth", nth).withColumn("weight", F.element_at(turn, (F.col("nth") % len(weights) + 1).cast("int")))
    cap = F.lit(float(most)) * F.col("source_size")
    ranked = ranked.withColumn("cap", cap).withColumn("full_at", F.col("cap") / F.col("weight"))
    up = Window.orderBy("full_at", "nth")
    left = F.lit(float(budget)) * F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = left / F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing))
    ranked = ranked.withColumn("level", level).withColumn("open_from", F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "nth", "level")))
    final = F.min("open_from").over(Window.partitionBy())["level"]
    return ranked.select("source", "nth", "source_size", F.least("cap", F.coalesce(final * F.col("weight"), F.col("cap"))).alias("target"))


def _integrals(schedules: tuple) -> tuple[list[list[float]], list[list[float]]]:
    """Each schedule's weights scaled to an integral of 1, and its integral up to each knot."""
    weights, upto = [], []
    for s in schedules:
        steps = [(a + b) / 2 / (len(s) - 1) for a, b in zip(s[:-1], s[1:])]
        total = sum(steps)
        if min(s) < 0 or total <= 0:
            raise ValueError("the weights of a schedule must not be negative, nor all zero")
        weights.append([float(w) / total for w in s])
        upto.append([sum(steps[:i]) / total for i in range(len(s))])
    if len({len(s) for s in schedules}) > 1:
        raise ValueError("schedules must have the same number of weights")
    return weights, upto


def _picked(tables: list[list[float]], nth: Column) -> Column:
    return F.element_at(F.array(*[F.array(*[F.lit(x) for x in row]) for row in tables]), (nth % len(tables) + 1).cast("int"))


def due_time(share: Column, nth: Column, schedules: tuple = SCHEDULES) -> Column:
    """When a source's cumulative demand, as a share of its target, reaches ``share``: a struct (step, x) of the number of
    knots passed and the time since; solves a*x + (b-a)/(2h)*x*x = what is left of the share, h being a knot's distance."""
    weights, upto = (_picked(t, nth) for t in _integrals(schedules))
    h = 1 / (len(schedules[0]) - 1)
    step = F.least(F.size(F.filter(upto, lambda c: c < share)), F.lit(len(schedules[0]) - 1)) - 1
    step = F.greatest(step, F.lit(0))
    a, b, left = F.get(weights, step), F.get(weights, step + 1), F.greatest(share - F.get(upto, step), F.lit(0.0))
    bend = (b - a) / h
    # the stable form of the root: no difference of nearly equal numbers, and right without a bend
    x = 2 * left / F.greatest(a + F.sqrt(F.greatest(a * a + 2 * bend * left, F.lit(0.0))), F.lit(1e-300))
    return F.struct(step.cast("int").alias("step"), F.least(x, F.lit(h)).alias("x"))


def _streams(targets: DataFrame, schedules: tuple) -> DataFrame:
    """``targets`` with the weights of all sources together, by their targets, and their integral, at each knot."""
    weights, upto = (_picked(t, F.col("nth")) for t in _integrals(schedules))
    whole = Window.partitionBy()
    total = F.greatest(F.sum("target").over(whole), F.lit(1e-9))
    at = lambda table: F.array(*[F.sum(F.col("target") * F.get(table, F.lit(i))).over(whole) / total for i in range(len(schedules[0]))])
    return targets.withColumn("all_weights", at(weights)).withColumn("all_upto", at(upto))


def position(due: Column, schedules: tuple = SCHEDULES) -> Column:
    """The part of all words that is due by a time (step, x)."""
    h = 1 / (len(schedules[0]) - 1)
    a, b = F.get(F.col("all_weights"), due["step"]), F.get(F.col("all_weights"), due["step"] + 1)
    return F.least(F.lit(1.0), F.get(F.col("all_upto"), due["step"]) + a * due["x"] + (b - a) / (2 * h) * due["x"] * due["x"])


def mix(docs: DataFrame, weights: tuple = (3, 1, 2), budget: float = 1.5, most: float = 2.0, schedules: tuple = SCHEDULES) -> DataFrame:
    """What the mix takes of each document: doc_id, tie, source, size, source_size, target, taken, copies.

    ``docs`` has doc_id, text, source. ``copies`` is an array of (pass, words, position): as many whole copies as the
    target holds whole passes over the source, and for what remains one more of the documents that come first in an
    order by a hash of the id; the one at the edge is taken in part, so a source's words sum up to its target, rounded
    down. Null texts have size 0 and are never taken; sources of null are one source; repeated rows count as documents
    of their own; an empty table gives an empty mix. ``tie`` is a hash of the text, which tells rows of one id apart.
    """
    tie = F.xxhash64("text")
    sized = written(docs.select("doc_id", tie.alias("tie"), "source", count_words(F.col("text")).alias("size"), F.xxhash64("doc_id", tie, F.lit(6)).alias("spot")), "mix-sizes")
    bits = min(16, max(6, math.ceil(math.log2(sized.count() / 4096 + 1))))
    targets = _streams(source_targets(sized, weights, budget, most), schedules)
    sized = sized.withColumn("bucket", F.shiftrightunsigned("spot", 64 - bits))
    # a hot source is summed in two steps, first by buckets of its order, so no task holds all its rows
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = sized.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    buckets = buckets.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "bucket").orderBy("spot", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(buckets, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    targets = targets.withColumnRenamed("source", "of")
    placed = placed.join(targets, F.col("source").eqNullSafe(F.col("of"))).withColumn("place", F.col("base") + F.col("inner"))
    whole = F.floor(F.col("target") / F.greatest("source_size", F.lit(1)))
    edge = F.floor(F.col("target")) - whole * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), edge - F.col("place")))
    placed = placed.withColumn("whole", whole.cast("int")).withColumn("part", part.cast("long"))

    def copy(n: Column) -> Column:
        words = F.when(n < F.col("whole"), F.col("size")).otherwise(F.col("part"))
        middle = n * F.col("source_size") + F.col("place") + words / 2
        return F.struct(n.alias("pass"), words.alias("words"), position(due_time(F.least(F.lit(1.0), middle / F.greatest(F.col("target"), F.lit(1e-9))), F.col("nth"), schedules), schedules).alias("position"))

    copies = F.filter(F.transform(F.sequence(F.lit(0), F.col("whole")), copy), lambda c: c["words"] > 0)
    taken = (F.col("whole") * F.col("size") + F.col("part")).cast("long").alias("taken")
    return placed.select("doc_id", "tie", "source", "size", "source_size", "target", taken, copies.alias("copies"))


def in_training_order(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The documents' rows as the mix takes them, a row for each copy, range-sorted by position.

    A copy taken in part keeps its first words, joined by spaces; ``n_chars`` is set anew where the table has it.
    """
    names = docs.columns
    held = docs.groupBy("doc_id", F.xxhash64("text").alias("tie")).agg(F.first(F.struct(*[F.col(f"`{n}`") for n in names])).alias("row"))
    copies = plan.select(F.col("doc_id").alias("id"), F.col("tie").alias("t"), "size", F.explode("copies").alias("copy"))
    joined = copies.join(held, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("tie")))
    words = F.filter(F.split("row.text", GAP), lambda w: w != "")
    text = F.when(F.col("copy.words") < F.col("size"), F.array_join(F.slice(words, 1, F.col("copy.words").cast("int")), " ")).otherwise(F.col("row.text"))
    out = joined.withColumn("text", text).withColumn("position", F.col("copy.position"))
    out = out.repartitionByRange("position", "id").sortWithinPartitions("position", "id", "t", F.col("copy.pass"))
    return out.select(*[F.col("text") if n == "text" else F.char_length("text").cast("long").alias(n) if n == "n_chars" else F.col(f"row.`{n}`").alias(n) for n in names])


def mix_query(docs: DataFrame) -> DataFrame:
    """The mix, range-sorted by the position of each document's first copy; documents that aren't taken come last."""
    first = F.array_min(F.transform("copies", lambda c: c["position"]))
    rows = mix(docs).withColumn("position", first)
    return rows.orderBy(F.col("position").asc_nulls_last(), "doc_id", "tie").select("doc_id", "size", "source_size", "target", "taken", "position", "copies")
