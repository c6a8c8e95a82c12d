import base64
import hashlib

from pyarrow import fs

from tarnkappe.llm import warc

ROWS = [(i, f"http://h/{i}", "same" if i % 3 == 0 else f"page {i} " * (i % 50)) for i in range(200)]
ROWS += [(500, None, None), (501, "a\r\nb ", ""), (None, "x", "same"), (3, "http://h/3", "same"), (3, "http://h/3", "other"), (700, "u", "<p>ü😀\r\n\r\n</p>" * 9000)]


def pages(spark):
    return spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "1 as kind", "'x' as digest").repartition(5)


def test_round_trip(spark, tmp_path):
    root = f"file://{tmp_path}/a"
    warc.write_warc(pages(spark), root, shard_bytes=20_000, roll_bytes=2_000)
    got = warc.read_warc(spark, root).collect()
    assert len(got) == len(ROWS)
    first = {}
    for i, _, html in sorted((r for r in ROWS if r[0] is not None), key=lambda r: r[0]):
        first.setdefault(html or "", i)
    want = []
    for i, _, html in ROWS:
        data = (html or "").encode()
        to = first[html or ""] if i is not None and i > first[html or ""] else None
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if to is None else "revisit", to, None if to is not None else data))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got), key=str) == sorted(want, key=str)


def test_reruns_write_equal_bytes(spark, tmp_path):
    sums = []
    for name, df in (("a", pages(spark)), ("b", pages(spark).repartition(2))):
        root = f"file://{tmp_path}/{name}"
        warc.write_warc(df, root, shard_bytes=20_000, roll_bytes=2_000)
        sums.append(sorted(map(tuple, spark.read.parquet(f"{root}/manifest-00000").collect())))
        files = {f.base_name for f in fs.LocalFileSystem().get_file_info(fs.FileSelector(f"{tmp_path}/{name}")) if f.base_name.endswith(".gz")}
        assert files == {x[1] for x in sums[-1]}
    assert sums[0] == sums[1] and len(sums[0]) > 5 and len({x[0] for x in sums[0]}) > 3


def test_empty_table(spark, tmp_path):
    root = f"file://{tmp_path}/none"
    warc.write_warc(pages(spark).limit(0), root)
    assert warc.read_warc(spark, root).count() == 0


def test_a_root_is_written_again(spark, tmp_path):
    root = f"file://{tmp_path}/again"
    warc.write_warc(pages(spark), root, shard_bytes=20_000, roll_bytes=2_000)
    first = spark.read.parquet(f"{root}/manifest-00000").collect()
    fewer = pages(spark).filter("page_id < 50")
    warc.write_warc(fewer, root, shard_bytes=20_000, roll_bytes=2_000)
    got = warc.read_warc(spark, root).collect()
    assert sorted(r.page_id for r in got) == sorted(r[0] for r in ROWS if r[0] is not None and r[0] < 50)
    # the write before stays readable until its files are taken away
    there = {f.base_name for f in fs.LocalFileSystem().get_file_info(fs.FileSelector(f"{tmp_path}/again"))}
    assert {r.file for r in first} < there and "manifest-00001" in there
    assert not list((tmp_path / "again" / "_temporary").iterdir())
