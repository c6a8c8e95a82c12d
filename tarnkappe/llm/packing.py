"""Concatenate and cut (operator 8).

Pass one encodes every text once and writes the ids with each document's place in its partition. The partitions'
totals, summed, give every document its place in the one long run of ids. Pass two cuts that run at the multiples of
the sequence length; a document that crosses a cut gets a record on either side. Nothing is shuffled but the totals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnkappe.llm.common import exclusive_totals
from tarnkappe.llm.tokens import _as_rows, binary_rows
from tarnkappe.session import new_folder, small_batches

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            place = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            size = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            windows = (place + size - 1) // length - place // length + 1
            row = np.repeat(np.arange(len(size)), windows)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
            sequence = place[row] // length + nth
            begin = np.maximum(sequence * length, place[row])
            end = np.minimum((sequence + 1) * length, place[row] + size[row])
            start = begin - place[row]
            # the pieces stand in the order of the rows, so their ids together are those of the rows
            ids = np.frombuffer(b"".join(batch.column(3).to_pylist()), "<u2").astype("<u4")
            ids = binary_rows(ids, np.concatenate([[0], np.cumsum(end - begin)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(start), pa.array(end - begin), pa.array(size[row]), pa.array(sequence), pa.array(begin - sequence * length), ids],
                ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )

    return run


def file_runs(docs: DataFrame) -> Column:
    """Names for the pieces of files that a table just read is scanned by, ascending in the order the rows were written.

    A writer's partitions are the numbers in the files' names, and a piece holds a file's rows from its offset on. The
    scan deals pieces to partitions by length, so the order of partitions isn't that of the rows.
    """
    file = docs.metadataColumn("_metadata")
    digits = lambda n: F.lpad(n.cast("string"), 20, "0")
    number = F.coalesce(F.regexp_extract(file["file_name"], "^part-([0-9]+)", 1).try_cast("long"), F.lit(0))
    return F.concat_ws("/", digits(number), file["file_path"], digits(file["file_block_start"]))


def pack(docs: DataFrame, tokenizer: str, end_id: int, length: int = 1024, id_col: str = "doc_id", text_col: str = "text", runs: Column | None = None) -> DataFrame:
    """The pieces of all documents in sequences of ``length`` ids; ``ids`` are little-endian 32-bit integers.

    Each document's ids are followed by ``end_id``. Every sequence but the last is full; only that needs padding. Null
    texts are empty (a piece with the end id alone), repeated rows are packed each, other columns are ignored, an empty
    table gives no pieces. Documents follow each other by partition; with ``runs``, a string that names the run of rows
    a row is in (see ``file_runs``), by that name and inside a run in the order of the rows. Ids from 65,536 on are refused, for they are kept in 16 bits between the passes.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *([] if runs is None else [runs.alias("run")]))
    schema = f"part {'int' if runs is None else 'string'}, before long, doc_id long, n_tokens long, ids binary"
    path = new_folder(spark, "packing")
    rows.mapInArrow(_as_rows(tokenizer, end_id, narrow=True), schema).write.option("compression", "zstd").parquet(path)
    encoded = spark.read.schema(schema).parquet(path)
    totals = encoded.groupBy("part").agg(F.max(F.col("before") + F.col("n_tokens")).alias("total"))
    # one row for each partition or run: small whatever the texts are
    starts = exclusive_totals(totals, "part", "total", "base")
    placed = encoded.join(F.broadcast(starts), "part").select("doc_id", (F.col("base") + F.col("before")).alias("place"), "n_tokens", "ids")
    return placed.mapInArrow(_cut(length), PIECES)


def pack_query(docs: DataFrame, tokenizer: str, end_id: int, length: int = 1024) -> DataFrame:
    return pack(docs, tokenizer, end_id, length).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
