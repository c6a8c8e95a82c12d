"""Document fingerprints by closed syncmers (operator 7; DataFrame operations only).

The units are pieces of words in small letters: up to ``PIECE`` characters from a word's beginning, and a unit for each
character of scripts that are written without spaces. All texts are cut alike, whatever their length or script. A k-mer
of units is an anchor if the smallest hash among the s-mers inside it lies at its first or last place. That depends on
nothing outside the k-mer, so an edit changes only anchors that overlap it, and the same passage gives the same anchors
in any text.

Anchors are matched by position: an entry of the fingerprint is an anchor's hash and its distance from the one before.
So a passage matches where its anchors stand in the same places to each other, wherever it is in the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnkappe.llm.common import range_cuts, shard_of, spread_keys
from tarnkappe.session import written

K, S, PIECE = 4, 2, 3
#: An anchor is a long: 40 bits of its hash, then 24 of its position (of distances between positions, later on).
ANCHORS, PLACE = "array<bigint>", 24
#: Scripts that are written without spaces, whose characters are units of their own.
_SPACELESS = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
UNIT = rf"[{_SPACELESS}]|[^\x20\x09-\x0D{_SPACELESS}]{{1,{PIECE}}}"


def _packed(hash_: Column, place: Column) -> Column:
    """The upper 40 bits of a hash and a number; of numbers beyond 24 bits the rest counts."""
    return hash_.bitwiseAND(F.lit(-1 << PLACE)).bitwiseOR(_place(place.cast("long")))


def _place(x: Column) -> Column:
    return x.bitwiseAND(F.lit((1 << PLACE) - 1))


def with_anchors(df: DataFrame, text: str, out: str, k: int = K, s: int = S) -> DataFrame:
    """``df`` with ``out``, an array of anchors in order of position, counted from 1, from the text column named.

    A text with units but without an anchor has one: the hash of all its units at position 1. Null and white space have none.
    """
    units, inner, span = f"__{out}_units", f"__{out}_inner", k - s + 1
    pieces = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(UNIT), F.lit(0))
    df = df.withColumn(units, F.transform(pieces, lambda x: F.xxhash64(x)))
    n, m = F.size(units), F.col(inner)
    upto = lambda array, last: F.slice(array, 1, F.greatest(n - last, F.lit(0)))
    df = df.withColumn(inner, F.transform(upto(units, s - 1), lambda x, i: F.xxhash64(x, *[F.get(F.col(units), i + j) for j in range(1, s)])))
    # s-mers that tile the k-mer, and its last one, stand for its units
    tiles = sorted({*range(0, span, s), span - 1})

    def judge(x: Column, i: Column) -> Column:
        held = [x, *[F.get(m, i + j) for j in range(1, span)]]
        least = F.least(*held)
        return F.when((held[0] == least) | (held[-1] == least), _packed(F.xxhash64(*[held[t] for t in tiles]), i + 1))

    found = F.filter(F.transform(upto(inner, k - 1), judge), lambda x: x.isNotNull())
    alone = F.array(_packed(F.xxhash64(F.col(units)), F.lit(1)))
    df = df.withColumn(out, found)
    return df.withColumn(out, F.when((F.size(out) > 0) | (n == 0), F.col(out)).otherwise(alone)).drop(units, inner)


def entries(anchors: str) -> Column:
    """The fingerprint as an array of longs: each anchor's hash, and its distance from the one before instead of its position; 0 for the first."""

    def entry(a: Column, i: Column) -> Column:
        apart = F.when(i > 0, _place(a) - _place(F.get(F.col(anchors), i - 1))).otherwise(0)
        return _packed(a, apart)

    return F.transform(anchors, entry)


def as_string(found: Column) -> Column:
    """Entries in order, each in hexadecimal: ten digits of its hash, leading zeros left out, and six of its distance."""
    return F.array_join(F.transform(found, lambda x: F.hex(x)), " ")


def likeness(a: Column, b: Column) -> Column:
    """Shared part of the distinct entries of two fingerprints (Jaccard), given as such; 1 if neither has any."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def with_next(docs: DataFrame, chunk_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, text and anchors of every document, with next_text and next_anchors of the one that follows by descending doc_id.

    The last is followed by the first. Documents are dealt by ranges of ids of about ``chunk_bytes``; inside a range a
    window finds the next row, and a range's last row gets the first of the next range.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sizes = written(rows.select("doc_id", (F.octet_length("text") + 64).cast("long").alias("bytes")), "syncmer-sizes")
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    cuts = range_cuts(sizes, "doc_id", "bytes", min(4096, max(1, -(-total // chunk_bytes))))
    keys = spread_keys(docs.sparkSession, len(cuts) + 1)
    chunk = F.element_at(F.array(*map(F.lit, keys)), shard_of(F.col("doc_id"), cuts) + 1)
    rows = rows.withColumn("chunk", chunk.cast("long"))
    order = Window.partitionBy("chunk").orderBy(F.col("doc_id").desc_nulls_last(), "text")
    dealt = with_anchors(rows.repartition(len(keys), "chunk"), "text", "anchors")
    inside = dealt.withColumn("next", F.lead(F.struct("text", "anchors")).over(order)).withColumn("ends", F.lead(F.lit(1)).over(order).isNull())
    # at most one row for each range: the largest id, and the range before which it stands
    tops = sizes.groupBy(chunk.cast("long").alias("chunk")).agg(F.max("doc_id").alias("top"))
    up = Window.orderBy(F.col("top").desc_nulls_last())
    follows = F.coalesce(F.lag("chunk").over(up), F.last("chunk").over(up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    tops = tops.withColumn("before", follows)
    heads = rows.join(F.broadcast(tops.select("before", F.col("top").alias("doc_id"))), "doc_id")
    one = Window.partitionBy("before").orderBy("text")
    heads = with_anchors(heads.withColumn("nth", F.row_number().over(one)).filter("nth = 1"), "text", "anchors")
    heads = heads.select(F.col("before").alias("at"), F.struct("text", "anchors").alias("head"))
    joined = inside.join(heads, (F.col("chunk") == F.col("at")) & F.col("ends"), "left")
    after = F.coalesce("next", "head")
    return joined.select("doc_id", "text", "anchors", F.coalesce(after["text"], F.lit("")).alias("next_text"), F.coalesce(after["anchors"], F.array().cast(ANCHORS)).alias("next_anchors"))


def fingerprint(docs: DataFrame) -> DataFrame:
    """Fingerprints of whole texts: doc_id, n_chars, anchors, fingerprint. Null texts are empty and have no anchors; rows are independent."""
    rows = with_anchors(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", "anchors")
    shown = F.transform("anchors", lambda x: F.struct(_place(x).cast("int").alias("position"), F.shiftrightunsigned(x, PLACE).alias("hash")))
    rows = rows.withColumn("fingerprint", as_string(entries("anchors"))).withColumn("anchors", shown)
    return rows.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), "anchors", "fingerprint")


def fingerprint_query(docs: DataFrame) -> DataFrame:
    """Each document beside its edited text and the next document.

    Rows of one id follow each other by text; rows without id come last; a single document is followed by itself; an
    empty table gives no rows.
    """
    rows = with_next(docs)
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substr(F.col("text"), F.lit(1), n - cut), F.substr(F.col("next_text"), F.lit(1), cut))
    rows = with_anchors(rows.withColumn("edited", edited), "edited", "edited_anchors")
    own = {c: entries(c) for c in ("anchors", "edited_anchors", "next_anchors")}
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), *[e.alias(c) for c, e in own.items()])
    for c in own:  # each once, however often it is compared
        rows = rows.withColumn(f"{c}_once", F.array_distinct(c))
    once = lambda c: F.col(f"{c}_once")
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_string(F.col("anchors")).alias("fingerprint"),
        as_string(F.col("edited_anchors")).alias("edited_fingerprint"),
        likeness(once("anchors"), once("edited_anchors")).alias("near_edited"),
        likeness(once("anchors"), once("next_anchors")).alias("near_next"),
    )
