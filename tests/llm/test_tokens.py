import zlib

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnkappe.llm import packing, queries, tokens

WORD_FILE, BYTE_FILE = queries.tokenizer_file("word_bpe_49k.json"), queries.tokenizer_file("byte_bpe_50k.json")
SIGNS = st.text(st.sampled_from("ab Thé ßÇ'.,!<|>\n\t ́ x09 \x1c  中"), max_size=40)


@pytest.mark.parametrize("path", [WORD_FILE, BYTE_FILE])
@settings(max_examples=300, deadline=None)
@given(text=st.one_of(SIGNS, st.text(max_size=30), st.just("a<|endoftext|> b  <|startoftext|>'s don't\n\n c")))
def test_ids_equal_the_librarys(path, text):
    enc = tokens.encoder(path)
    ids = enc.tok.encode(text, add_special_tokens=False).ids
    sizes, found = enc.encode_all(pa.array([text, None, text]))
    assert sizes.tolist() == [len(ids), 0, len(ids)] and found.tolist() == ids + ids


ROWS = [(5, "The  end.\n"), (1, "a b"), (None, "nobody"), (3, None), (3, ""), (9, "x" * 4000 + " y " * 3000), (1, "a b")]


def docs(spark, rows=ROWS):
    return spark.createDataFrame([(a, b, 7, "s") for a, b in rows], "doc_id long, text string, start int, ids string").repartition(3)


def expected(path, end):
    tok = tokens.encoder(path).tok
    return {(a, b): tok.encode(b or "", add_special_tokens=False).ids + [end] for a, b in ROWS}


def test_archive_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/archive"
    tokens.write_archive(docs(spark), path, WORD_FILE, 2)
    rows = tokens.read_archive(spark, path).orderBy("start").collect()
    assert sorted(map(tuple, ((r.doc_id, *r.ids) for r in rows)), key=str) == sorted(((a, *expected(WORD_FILE, 2)[a, b]) for a, b in ROWS), key=str)
    assert [r.doc_id for r in rows] == [None, 1, 1, 3, 3, 5, 9]
    place = 0
    for r in rows:
        assert (r.start, r.n_tokens) == (place, len(r.ids))
        place += len(r.ids)
    crc = {r.start: r.ids_crc32 for r in tokens.with_crc(tokens.read_archive(spark, path)).collect()}
    assert crc == {r.start: zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r.ids)) for r in rows}


@pytest.mark.parametrize("length", [4, 64, 1024])
def test_pieces_cover_every_id_once(spark, length):
    rows = packing.pack(docs(spark), BYTE_FILE, 0, length).collect()
    runs = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == runs.get(r.sequence_id, 0) and len(r.ids) == 4 * r.length > 0
        runs[r.sequence_id] = r.offset + r.length
    assert all(n == length for s, n in runs.items() if s != max(runs)) and list(runs) == list(range(len(runs)))
    want = sorted(b"".join(i.to_bytes(4, "little") for i in x) for (a, b), x in expected(BYTE_FILE, 0).items() if a in (5, 9))
    got = sorted(b"".join(r.ids for r in sorted((r for r in rows if r.doc_id == k), key=lambda r: r.start)) for k in (5, 9))
    assert got == want
    assert sum(r.length for r in rows) == sum(len(expected(BYTE_FILE, 0)[x]) for x in ROWS)


def test_empty_tables(spark, tmp_path):
    none = docs(spark).limit(0)
    tokens.write_archive(none, f"file://{tmp_path}/none", WORD_FILE, 2)
    assert tokens.read_archive(spark, f"file://{tmp_path}/none").count() == 0
    assert packing.pack(none, BYTE_FILE, 0).count() == 0


def rows_scanned(df):
    """Rows that the scan of ``df`` handed on, after stripes and row groups were left out by their metadata."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    return plan.collectLeaves().head().metrics().apply("numOutputRows").value()


def test_readers_skip_by_metadata(spark, tmp_path):
    path = f"file://{tmp_path}/archive"
    many = spark.range(0, 40000, 2).selectExpr("id AS doc_id", "concat('word ', id) AS text")
    tokens.write_archive(many, path, WORD_FILE, 2)
    scan = spark.read.schema(tokens.ROWS).orc(path).select("doc_id", "n_tokens")
    assert rows_scanned(scan) == 20000
    # one row group of 1000 rows of one file: by the ranges in the footers and the row index
    assert 0 < rows_scanned(scan.filter("doc_id = 20000")) <= 1000
    assert rows_scanned(scan.filter("doc_id BETWEEN 10000 AND 10010")) <= 2000
    # odd ids lie inside the ranges: only Bloom filters say that they aren't there
    assert sum(rows_scanned(scan.filter(f"doc_id = {i}")) for i in (10001, 20001, 30001)) <= 1000
    # splits inside a file begin at stripes, so that they are read in parallel
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        parallel = spark.read.schema(tokens.ROWS).orc(path)
        assert parallel.rdd.getNumPartitions() > len(list((tmp_path / "archive").glob("part-*")))
        assert parallel.count() == 20000 == parallel.select("doc_id").distinct().count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
