"""Contact masking on streams: stateless, so it takes any streaming table of texts. Persons need whole documents."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tarnkappe.operators.contacts import ContactOptions, with_masked


def masked_stream(texts: DataFrame, text_col: str = "text", options: ContactOptions = ContactOptions()) -> DataFrame:
    """``texts`` with masked and contacts; a map over rows, without state or watermark."""
    return with_masked(texts, text_col, options)
