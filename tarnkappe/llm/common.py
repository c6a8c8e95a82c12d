"""What several operators share: words, exact prefix sums, range cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of characters other than the space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """A-Z to lower case, all else as it is."""
    return F.translate(text, UPPER, LOWER)


def count_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def exclusive_totals(totals: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """``totals`` with the sum of ``value`` over all smaller keys. For tables of a row per partition, not per record."""
    before = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(key, F.coalesce(F.sum(value).over(before), F.lit(0)).cast("long").alias(out))


def range_cuts(df: DataFrame, key: str, size: str, shards: int, bins: int = 4096, rounds: int = 5) -> list[int]:
    """Ascending lower bounds of at most ``shards`` + 1 ranges of the long column ``key`` with about equal sums of ``size``.

    Depends on the rows alone, not on partitions or samples, so reruns cut alike. Each round takes a histogram of at
    most ``bins`` bars to the driver and splits anew the bars that are too large for one shard. Null keys aren't counted.
    """
    low, high, total = df.agg(F.min(key), F.max(key), F.sum(size)).first()
    if low is None or shards < 2 or not total:
        return []
    spans = [(low, high + 1)]
    bars: list[tuple[int, int]] = []
    for step in range(rounds):
        wide: list[tuple[int, int, int]] = []
        for first, end in spans:
            width = max(1, -(-(end - first) // max(2, bins // len(spans))))
            bar = F.floor((F.col(key).cast("decimal(38,0)") - F.lit(first)) / F.lit(width)).cast("long")
            own = df.filter((F.col(key) >= first) & (F.col(key) < end)).groupBy(bar.alias("bar")).agg(F.sum(size).alias("sum"))
            for b, n in sorted(own.collect()):
                left = first + b * width
                if width > 1 and n > total / shards and step + 1 < rounds and len(wide) < 64:
                    wide.append((left, min(end, left + width), n))
                else:
                    bars.append((left, n))
        spans = [w[:2] for w in wide]
        if not spans:
            break
    cuts, run = [], 0
    for left, n in sorted(bars):
        if run and run + n / 2 > total / shards:
            cuts.append(left)
            run = 0
        run += n
    return cuts


def shard_of(key: Column, cuts: list[int]) -> Column:
    """Number of the range of ``range_cuts`` that a key lies in; null keys lie in the first."""
    if not cuts:
        return F.lit(0)
    inside = F.array(*[F.lit(c).cast("long") for c in cuts])
    return F.coalesce(F.size(F.filter(inside, lambda c: c <= key)), F.lit(0))


def by_key(rows: DataFrame, facts: DataFrame, key: str, frequent: Column) -> DataFrame:
    """Join on ``key``; the few ``frequent`` keys of ``facts`` are broadcast, so none of them is one task.

    ``frequent`` must hold for a bounded number of keys, as a key that takes a given share of all rows does.
    """
    hot = F.broadcast(facts.filter(frequent))
    return rows.join(hot, key).unionByName(rows.join(facts.filter(~frequent), key))


def spread_keys(spark: SparkSession, n: int) -> list[int]:
    """For each of ``n`` places the smallest number that hash partitioning into ``n`` parts puts there.

    Rows that carry the number of their place are dealt one place to a part, and a window by it needs no other shuffle.
    """
    numbers = spark.range(0, n * (16 + 2 * n.bit_length()))
    least = numbers.groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("part")).agg(F.min("id").alias("id")).collect()
    found = {r.part: r.id for r in least}
    if len(found) < n:
        raise ValueError(f"{n} parts, but numbers for {len(found)} only")
    return [found[i] for i in range(n)]
