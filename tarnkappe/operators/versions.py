"""Which key belongs to which state of a document: states and saved keys are rows that are only ever added."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def id_numbers(log: DataFrame) -> DataFrame:
    """``log`` (doc_id, stamp, event) with ``id_number``, which of its ids a document had from then on, counted from 0.

    A change of the hits gives a document a new id only if a key was saved for the present one, since its last change;
    else nobody holds a key of it, and the id stays. So no two keys that differ have one id. Other events change nothing.
    Stamps order a document's events; events of one stamp come in order of their names.
    """
    order = Window.partitionBy("doc_id").orderBy("stamp", "event")
    # whether the last of the events that count was a save
    mark = F.when(F.col("event") == "saved", F.lit(1)).when(F.col("event") == "changed", F.lit(0))
    saved = F.last(mark, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = (F.col("event") == "changed") & (F.coalesce(saved, F.lit(0)) == 1)
    number = F.sum(F.col("fresh").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return log.withColumn("fresh", fresh).withColumn("id_number", number).drop("fresh")


def keys_as_of(files: DataFrame, keys: DataFrame, on: list[str], what: str = "key") -> DataFrame:
    """``files`` (``on``, stamp, ...) with the ``what`` of the newest row of ``keys`` (``on``, stamp, ``what``) that isn't newer; null without one.

    An as-of join by one sort of both sides together: linear in them, however many keys a document has. Of keys of one
    stamp the largest counts.
    """
    facts = [c for c in files.columns if c not in (*on, "stamp")]
    none = F.lit(None)
    f = files.select(*on, "stamp", F.lit(1).alias("side"), F.struct(*(facts or [F.lit(True).alias("there")])).alias("file"), none.cast(keys.schema[what].dataType).alias("held"))
    k = keys.filter(F.col(what).isNotNull()).select(*on, "stamp", F.lit(0).alias("side"), none.cast(f.schema["file"].dataType).alias("file"), F.col(what).alias("held"))
    order = Window.partitionBy(*on).orderBy("stamp", "side", "held").rowsBetween(Window.unboundedPreceding, 0)
    both = f.unionByName(k).withColumn(what, F.last("held", ignorenulls=True).over(order)).filter("side = 1")
    return both.select(*on, "stamp", *[F.col(f"file.{c}").alias(c) for c in facts], what)
