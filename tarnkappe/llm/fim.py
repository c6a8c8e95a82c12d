"""Fill-in-the-middle examples out of plain texts, and back (operator 13). Built-in expressions only, no shuffle.

A text is an array of units, each a word with the white space before it; white space at the end is a unit of its own.
Hashes of the document's id cut it in prefix, middle and suffix and choose the arrangement, so reruns agree and no
random state is kept. Texts that hold a sentinel already stay plain, and no sentinel can begin in one piece and end in
the next (none ends as another begins), so cutting the output at its sentinels gives the pieces back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: Marks before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_SENTINEL = "<[PSM]>"


def _drawn(doc_id: Column, seed: int) -> Column:
    """Four numbers of 32 bits from the document's id: an array of longs, null for a null id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("long").cast("string")), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """doc_id, text (null: empty), n (units), form, prefix, middle, suffix (null if plain) and output of every row.

    ``rate`` of a hundred texts are rearranged, and ``spm`` of a hundred of these begin with the suffix. Empty texts, those
    that hold a sentinel and rows without doc_id (which nothing can be drawn for) are plain: their output is the text.
    Repeated rows come out alike, rows of one id with unlike texts are drawn alike and cut each by its own units; pieces
    may be empty. Other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("units", F.regexp_extract_all("text", F.lit(UNIT), F.lit(0))).withColumn("h", _drawn(F.col("doc_id"), seed))
    n = F.size("units")
    cut = lambda i: (F.get("h", i) % (n + 1)).cast("int")
    rows = rows.withColumn("a", F.least(cut(0), cut(1))).withColumn("b", F.greatest(cut(0), cut(1)))
    plain = F.col("h").isNull() | F.get("h", 0).isNull() | (F.col("text") == "") | F.col("text").rlike(_SENTINEL) | (F.get("h", 2) % 100 >= rate)
    form = F.when(plain, "plain").when(F.get("h", 3) % 100 < spm, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", n.cast("long").alias("n"), form.alias("form"), "units", "a", "b")
    piece = lambda first, length: F.when(F.col("form") != "plain", F.array_join(F.slice("units", first, length), ""))
    rows = rows.select(
        "doc_id", "text", "n", "form", piece(F.lit(1), F.col("a")).alias("prefix"), piece(F.col("a") + 1, F.col("b") - F.col("a")).alias("middle"),
        piece(F.col("b") + 1, F.size("units") - F.col("b")).alias("suffix"),
    )
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    turned = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    return rows.withColumn("output", F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", turned).otherwise(F.col("text")))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from, read from it and its form alone."""
    parts = F.split(output, _SENTINEL, -1)
    part = lambda i: F.get(parts, i)
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def fim_query(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of every document."""
    rows = fill_in_middle(docs)
    chars = lambda c: F.char_length(c).cast("long").alias(f"{c}_chars")
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return rows.select("doc_id", "n", "form", chars("prefix"), chars("middle"), digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
