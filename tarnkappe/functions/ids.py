"""File ids, which tie an output to its key: four signs, drawn at random and unlike any word."""

from __future__ import annotations

import itertools
import math
import random

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The signs of an id (no 0, O, 1 or I) and the name of an output.
SIGNS = "ABCDEFGHJKLMNPQRSTUVWXYZ23456789"
FORM = f"^[{SIGNS}]{{4}}$"
OUTPUT = r"^anonymisiert_([A-Z0-9]{4})(?: ?\([0-9]+\))?\.[A-Za-z0-9]+$"


def is_id(text: Column) -> Column:
    """Four signs, and never two letters side by side, so that an id can't look like a name."""
    return F.coalesce(text.rlike(FORM) & ~text.rlike("[A-Z]{2}"), F.lit(False))


def id_of_name(path: Column) -> Column:
    """The id in the name of an output; null for other names."""
    found = F.regexp_extract(F.regexp_replace(path, r"^.*[\\/]", ""), OUTPUT, 1)
    return F.when(is_id(found), found)


def id_state(inside: Column, in_name: Column, of_key: Column) -> Column:
    """Whether a key fits a file: ``old key`` without an id, ``none`` in the file, ``ok`` or ``other``. An id inside the file goes before that in its name."""
    own = F.coalesce(inside, in_name)
    return F.when(of_key.isNull(), "old key").when(own.isNull(), "none").when(own == of_key, "ok").otherwise("other")


def new_id(row: Column) -> Column:
    """An id for each row by the system's random source; nothing of the row goes in, and no two runs agree."""

    letters, digits = [c for c in SIGNS if c.isalpha()], [c for c in SIGNS if c.isdigit()]
    # where the letters of an id may stand, as often as there are ids with letters just there
    shapes = [s for s in itertools.product((True, False), repeat=4) if not any(a and b for a, b in zip(s, s[1:]))]
    weights = [math.prod(len(letters) if at else len(digits) for at in s) for s in shapes]

    def drawn() -> str:
        source = random.SystemRandom()
        return "".join(source.choice(letters if at else digits) for at in source.choices(shapes, weights)[0])

    @F.pandas_udf("string")
    def ids(rows: pd.Series) -> pd.Series:
        return pd.Series([drawn() for _ in rows])

    return ids.asNondeterministic()(row)
