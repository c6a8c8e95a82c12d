"""Token ids of whole texts, and their ORC archive.

The archive (operator 3) holds one row for each document in ascending id order. Integers, ids included, are stored by
ORC's run-length encoding in stripes; row indexes and a Bloom filter on ``doc_id`` let readers skip stripes and row
groups by metadata, and stripes are read in parallel.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnkappe.llm.common import exclusive_totals
from tarnkappe.session import new_folder, small_batches

ROWS = "part int, before long, doc_id long, n_tokens long, ids array<int>"


def _byte_signs() -> dict[int, int]:
    """Byte-level models write a byte as one printable sign: itself, or the next free sign from 256."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return {b: b if b in keep else next(free) for b in range(256)}


def _gather(codes: np.ndarray, ends: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans of ``flat`` that are named by ``codes``, one behind the other, and their sizes; span c ends at ends[c + 1]."""
    starts = ends[codes]
    sizes = ends[codes + 1] - starts
    upto = np.cumsum(sizes)
    return flat[np.repeat(starts - upto + sizes, sizes) + np.arange(upto[-1])], sizes


class Encoder:
    """Ids of whole texts by a file of the tokenizers library.

    A batch of texts is cut at spaces and single line breaks, which no token of the two kinds of model spans; each
    different piece falls into a line break, a word of letters and signs behind it, and each different word is encoded
    once. The ids lie in one pool, from which a batch's are gathered. The pool is emptied before a batch if it takes more
    than ``most`` bytes, so a worker holds that and one batch's words. The ids are those that
    ``Tokenizer.encode(text, add_special_tokens=False)`` gives.
    """

    #: Letters, then signs that no rule of these models joins to letters or to special tokens.
    LETTERS, SIGNS = "A-Za-zÀ-ÖØ-öø-ÿ", r".,!?;:*$%&#()\-"
    PLAIN = f"^(?P<lead>\n?)(?P<word>[{LETTERS}]+)(?P<tail>[{SIGNS}]*)$"
    #: White space beside white space is a run, which must stay together.
    BLANK = "[\\t-\\r\\x1c-\\x20\\x85\\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
    CUT = re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, path: str, most: int = 160 << 20):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model, self.most = self.tok.model, most
        self.drops_space = getattr(self.model, "end_of_word_suffix", None) is not None
        self.signs = _byte_signs()
        self.space = "" if self.drops_space else chr(self.signs[32])
        self._clear()

    def _clear(self) -> None:
        #: code 0 is the empty span
        self.flat, self.ends, self.held = array("i"), array("q", [0, 0]), 0
        self.words: dict[str, dict[str, int]] = {"": {}, self.space: {}}
        self.others: dict[str, int] = {"": 0}

    def _put(self, ids: list[int], piece: str) -> int:
        self.flat.extend(ids)
        self.ends.append(len(self.flat))
        self.held += 200 + len(piece) + 4 * len(ids)
        return len(self.ends) - 2

    def _word_codes(self, words: list[str], sign: str) -> list[int]:
        known, tokenize, signs = self.words[sign], self.model.tokenize, self.signs
        for word in words:
            if word not in known:
                key = word if word.isascii() else word.encode().decode("latin-1").translate(signs)
                known[word] = self._put([t.id for t in tokenize(sign + key)], word)
        return list(map(known.__getitem__, words))

    def _other_code(self, piece: str) -> int:
        """Any text, by the library."""
        if piece not in self.others:
            self.others[piece] = self._put(self.tok.encode(piece, add_special_tokens=False).ids, piece)
        return self.others[piece]

    def _piece_codes(self, pieces: pa.Array, leads: bool) -> np.ndarray:
        """Three codes for each piece: of the line break or what is no word, of the word, of the signs behind.

        A piece has a space before it if ``leads``, unless it begins with a line break.
        """
        out = np.zeros((len(pieces), 3), np.int64)
        if not len(pieces):
            return out
        parts = pc.extract_regex(pieces, self.PLAIN)
        plain = parts.is_valid().to_numpy(zero_copy_only=False)
        lead, word, tail = parts.flatten()
        broken = pc.equal(lead, "\n").fill_null(False).to_numpy(zero_copy_only=False)
        word = pc.utf8_lower(word) if self.drops_space else word
        for own, sign in ((plain & ~broken, self.space if leads else ""), (broken, "")):
            found = word.filter(pa.array(own)).dictionary_encode()
            names = found.dictionary.to_numpy(zero_copy_only=False).tolist()
            out[own, 1] = np.array(self._word_codes(names, sign), np.int64)[found.indices.to_numpy()]
        out[broken, 0] = self._other_code("\n") if broken.any() else 0
        found = tail.filter(pa.array(plain)).dictionary_encode()
        out[plain, 2] = np.array([self._other_code(x) for x in found.dictionary.to_pylist()], np.int64)[found.indices.to_numpy()]
        odd = np.flatnonzero(~plain)
        for i, piece in zip(odd.tolist(), pieces.take(pa.array(odd)).to_pylist()):
            lead = "" if not leads or piece.startswith("\n") or (self.drops_space and not piece) else " "
            out[i, 0] = self._other_code(lead + piece)
        return out

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each text has, and the ids of all in a row. Null is the empty text."""
        if not len(texts):
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        if self.held > self.most:
            self._clear()
        texts, odd = texts.fill_null(""), []
        if self.drops_space:
            plain = pc.replace_substring(texts, "\n", " ")
        else:
            runs = pc.match_substring_regex(texts, self.BLANK + self.BLANK)
            odd = np.flatnonzero(runs.to_numpy(zero_copy_only=False)).tolist()
            plain = pc.replace_substring(pc.if_else(runs, "", texts) if odd else texts, "\n", " \n")
        cut = pc.split_pattern(plain, " ")
        pieces = cut.flatten().dictionary_encode()
        begin = cut.offsets.to_numpy()[:-1].astype(np.int64) - cut.offsets[0].as_py()
        codes = self._piece_codes(pieces.dictionary, True)
        place = pieces.indices.to_numpy().astype(np.int64)
        if not self.drops_space:  # a text's first piece has no space before it
            heads = pieces.dictionary.take(pieces.indices.take(pa.array(begin)))
            place[begin] = len(codes) + np.arange(len(begin))
            codes = np.concatenate([codes, self._piece_codes(heads, False)])
        for i in odd:  # put together from what stands between its runs
            head, *others = self.CUT.split(texts[i].as_py())
            found = [*self._piece_codes(pa.array([head]), False).ravel(), *self._piece_codes(pa.array(others, pa.string()), True).ravel()]
            codes[place[begin[i]]] = self._put([x for c in found for x in self.flat[self.ends[c] : self.ends[c + 1]]], ""), 0, 0
        ids, sizes = _gather(codes.ravel(), np.frombuffer(self.ends, np.int64), np.frombuffer(self.flat, np.int32))
        ends = np.concatenate([[0], np.cumsum(sizes.reshape(-1, 3).sum(axis=1))])
        ids, sizes = _gather(place, ends, ids)
        return np.add.reduceat(sizes, begin), ids


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each file and worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _as_rows(path: str, end_id: int, narrow: bool):
    """A function for mapInArrow: rows as in ROWS, or with binary ids of 16 bits each.

    ``part`` is the partition's number. If there is a third column it names the run of rows that a row belongs to;
    ``part`` then has that name and ``before`` counts inside the run. Ids beyond 16 bits are refused, not cut.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, before = encoder(path), TaskContext.get().partitionId(), {}
        for batch in batches:
            sizes, found = enc.encode_all(batch.column(1))
            sizes = sizes + 1
            ends = np.concatenate([[0], np.cumsum(sizes)])
            ids, own = np.full(ends[-1], end_id, np.int32), np.ones(ends[-1], bool)
            own[ends[1:] - 1] = False
            ids[own] = found
            parts = batch.column(2) if batch.num_columns > 2 else pa.array(np.full(len(sizes), part, np.int32))
            place = np.empty(len(sizes), np.int64)
            runs = parts.dictionary_encode()
            codes = runs.indices.to_numpy(zero_copy_only=False)
            for code, run_name in enumerate(runs.dictionary.to_pylist()):
                mine = codes == code
                up = np.cumsum(sizes[mine])
                place[mine] = before.get(run_name, 0) + up - sizes[mine]
                before[run_name] = before.get(run_name, 0) + int(up[-1])
            if narrow:
                if len(ids) and (ids.max() >= 1 << 16 or ids.min() < 0):
                    raise ValueError(f"id {ids.max()} doesn't fit into 16 bits")
                column = binary_rows(ids.astype("<u2"), ends)
            else:
                column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays(
                [parts, pa.array(place), batch.column(0).cast(pa.int64()), pa.array(sizes), column],
                ["part", "before", "doc_id", "n_tokens", "ids"],
            )

    return run


def binary_rows(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values of the numbers in ``flat``, one for each span between two of ``ends`` (counts of numbers)."""
    at = pa.py_buffer((ends * flat.itemsize).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, at, pa.py_buffer(np.ascontiguousarray(flat))])


def write_archive(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text and write ids in ascending document order as ORC.

    Each file covers a range of ids, later files hold larger ones. ``part`` is a file's place, ``before`` counts the ids
    that stand before the document in its file. Null texts are empty (only the end id), null ids come first, rows of one
    id are ordered by a hash of the text, other columns are ignored; an empty table gives an archive without rows.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    tie = F.xxhash64("text")
    ranged = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie, "text")
    (
        ranged.mapInArrow(_as_rows(tokenizer, end_id, narrow=False), ROWS)
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.row.index.stride", "1000")
        .option("orc.stripe.size", str(32 << 20))
        .orc(path)
    )


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the archive with ``start``, the number of ids of all documents before: the files' totals, summed."""
    rows = spark.read.schema(ROWS).orc(path)
    totals = rows.groupBy("part").agg(F.max(F.col("before") + F.col("n_tokens")).alias("total"))
    # one row for each file: small whatever the texts are
    starts = exclusive_totals(totals, "part", "total", "base")
    return rows.join(F.broadcast(starts), "part").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids")


def with_crc(rows: DataFrame) -> DataFrame:
    """``ids`` replaced by the CRC-32 of its little-endian 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            ids = np.ascontiguousarray(pc.list_flatten(lists).to_numpy(zero_copy_only=False), dtype="<i4").data.cast("B")
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64) * 4
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_archive_query(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    path = new_folder(spark, "token-archive")
    write_archive(docs, path, tokenizer, end_id)
    return with_crc(read_archive(spark, path))
