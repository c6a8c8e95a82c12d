"""Column functions on words and texts. All are built-in expressions; none leaves the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that don't decompose, and what they fold to; signs used as apostrophes.
FOLDS = {"ß": "ss", "ı": "i", "ł": "l", "đ": "d", "ø": "o", "æ": "ae", "œ": "oe", "þ": "th", "ð": "d", "ħ": "h", "ŀ": "l"}
APOSTROPHES = "’ʼ`´‘"
UMLAUTS = {"ä": "ae", "ö": "oe", "ü": "ue", "Ä": "Ae", "Ö": "Oe", "Ü": "Ue"}


def _bare_letters() -> tuple[str, str]:
    """Lower-case Latin, Greek and Cyrillic letters with marks, and the same without, by Unicode's own decompositions."""
    marked, bare = "", ""
    for code in [*range(0x00C0, 0x0250), *range(0x0370, 0x0530), *range(0x1E00, 0x2000)]:
        c = chr(code)
        plain = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.category(x).startswith("M"))
        if len(plain) == 1 and plain != c and c == c.lower():
            marked, bare = marked + c, bare + plain
    return marked, bare


MARKED, BARE = _bare_letters()


def fold(word: Column) -> Column:
    """Key for comparing names: lower case, no accents or marks, special letters spelled out, one kind of apostrophe.

    Words of a-z, apostrophe and hyphen are their own keys and skip the work. Fold distinct words, then join.
    """
    low = F.regexp_replace(F.translate(F.lower(word), MARKED, BARE), r"\p{M}+", "")
    for old, new in FOLDS.items():
        low = F.replace(low, F.lit(old), F.lit(new))
    return F.when(word.rlike(r"^[a-z'\-]*$"), word).otherwise(F.translate(low, APOSTROPHES, "'" * len(APOSTROPHES)))


def umlaut_variant(word: Column) -> Column:
    """``ä`` as ``ae`` and so on; null for a word without umlauts."""
    out = word
    for old, new in UMLAUTS.items():
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.when(out != word, out)


def is_cap(word: Column) -> Column:
    """The first character has case and is upper."""
    first = F.substring(word, 1, 1)
    return (first != F.lower(first)) & (first == F.upper(first))


def is_allcaps(word: Column) -> Column:
    """At least two characters, with case, none of them lower."""
    return (F.char_length(word) > 1) & (word == F.upper(word)) & (word != F.lower(word))


def letter_for(n: Column) -> Column:
    """0 is A, 25 is Z, 26 is AA: a bijective numeral of base 26, exact for all longs from 0 (up to 14 letters)."""
    alphabet, n, out, least = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), n.cast("long"), [], 0
    for place in range(14):
        # numbers from ``least`` on have a letter at this place from the right
        least += 26**place if place else 0
        digit = F.call_function("div", n - F.lit(least).cast("long"), F.lit(26**place).cast("long")) % 26
        out.append(F.when(n >= least, F.substr(alphabet, (digit + 1).cast("int"), F.lit(1))).otherwise(""))
    return F.concat(*reversed(out))


def spans(text: Column, pattern: str, kind: str | None = None) -> Column:
    """All matches of a Java pattern as an array of (start, end, text), counted in code points from 0.

    The pieces between the matches and the matches together are the text, so running lengths are the places. Spark
    compiles the pattern of a split anew for each row, but needs none for a single sign: matches are put between two NULs,
    in one search. A text that holds a NUL itself is split by the pattern.
    """
    pair = lambda gap, match: F.struct(F.char_length(gap).alias("gap"), match.alias("text"))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    by_pattern = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(found)), found, pair)
    pieces = F.split(F.regexp_replace(text, pattern, "\0$0\0"), "\0", -1)
    by_sign = let(pieces, lambda p: F.when(F.size(p) > 1, F.transform(F.sequence(F.lit(1), F.size(p) - 1, F.lit(2)), lambda i: pair(F.get(p, i - 1), F.get(p, i)))))
    both = F.when(F.contains(text, F.lit("\0")), by_pattern).otherwise(by_sign)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("spans"))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + x["gap"]
        end = begin + F.char_length(x["text"])
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["text"].alias("text")))).alias("spans"))

    return F.coalesce(F.aggregate(both, start, step)["spans"], F.array().cast("array<struct<start:int,end:int,text:string>>"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def running(lengths: Column, piece: int = 64) -> Column:
    """Running sums of an array of ints, inside the row: within pieces, then over their totals, so that time doesn't grow
    with the square of the length."""
    start = lambda: F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    inner = lambda part: F.aggregate(part, start(), lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"] + x)).alias("out")))["out"]

    def joined(parts: Column) -> Column:
        before = F.aggregate(parts, start(), lambda s, x: F.struct((s["at"] + F.element_at(x, -1)).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))["out"]
        return F.flatten(F.zip_with(parts, before, lambda x, b: F.transform(x, lambda y: y + b)))

    def cut(all_: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(all_), F.lit(piece))
        return let(F.transform(starts, lambda i: inner(F.slice(all_, i, piece))), joined)

    return let(lengths, lambda x: F.when(F.size(x) <= piece, inner(x)).otherwise(cut(x)))


def apply_spans(text: Column, replacements: Column) -> Column:
    """``text`` with the spans of an array of (start, end, text) replaced; of overlapping ones the first by place counts."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, x: Column) -> Column:
        gap = F.substr(text, state["at"] + 1, F.greatest(x["start"] - state["at"], F.lit(0)))
        taken = F.struct(x["end"].alias("at"), F.concat(state["out"], gap, x["text"]).alias("out"))
        return F.when(x["start"] >= state["at"], taken).otherwise(state)

    done = F.aggregate(F.array_sort(replacements), start, step, lambda s: F.concat(s["out"], F.substr(text, s["at"] + 1, F.char_length(text))))
    return F.coalesce(done, text)


def neutral_path(path: Column) -> Column:
    """A local path without the user's name: what follows a folder of users is replaced."""
    return F.regexp_replace(path, r"(?i)((?:Users|Benutzer|Dokumente und Einstellungen|Documents and Settings|home)[\\/]+)[^\\/]+", "$1benutzer")
