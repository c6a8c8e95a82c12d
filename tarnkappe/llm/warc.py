"""Deterministic sharded WARC writer and its reader (operator 5).

Pages are range-sorted by id into shards of about equal bytes, cut by exact histograms, so reruns cut alike. Every
shard is written by one task, which rolls to a new file when the compressed size of the present one is reached. Headers,
record ids and digests are made anew from the content. A file is written under a temporary name and renamed when it is
whole. A write has a number, which its files' names begin with; its manifest, renamed last, names the files that count,
and readers take the highest number. So a root may be written again, and until that is whole readers see the write
before. An attempt that is lost leaves only temporary files, and a repeated one renames equal bytes over equal names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnkappe.llm.common import by_key, range_cuts, shard_of
from tarnkappe.session import arrow_batches, new_folder, written

MANIFEST = "shard int, file string, records long, bytes long, sha256 string"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def _temporary(number: int) -> str:
    return f"_temporary/{number:05d}"


def _manifests(root: str) -> dict[int, str]:
    """Numbers of the writes below ``root`` that are whole, and their manifests' names."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(root)
    found = store.get_file_info(fs.FileSelector(base, allow_not_found=True))
    names = [f.base_name for f in found if f.type == fs.FileType.Directory and f.base_name.startswith("manifest-")]
    return {int(n.removeprefix("manifest-")): n for n in names}


def sha1_name(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page_id: int | None, url: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest} {url}')}>"


def _one_line(url: str) -> str:
    """Control characters would end a header line."""
    return "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def _record(headers: list[tuple[str, object]], block: bytes, level: int) -> bytes:
    lines = [("WARC-Block-Digest", f"sha1:{sha1_name(block)}"), ("Content-Length", len(block))]
    head = "".join(f"{k}: {v}\r\n" for k, v in headers + lines)
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    return squeeze.compress(f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n") + squeeze.flush()


class _Shard:
    """The open file of a shard."""

    def __init__(self, root: str, number: int, shard: int, roll: int, date: str, level: int):
        from pyarrow import fs

        self.fs, self.base = fs.FileSystem.from_uri(root)
        self.number, self.shard, self.roll, self.date, self.level, self.n, self.out = number, shard, roll, date, level, 0, None
        self.temporary = f"{self.base}/{_temporary(number)}/{uuid.uuid4().hex}"

    def add(self, data: bytes) -> Iterator[tuple]:
        if self.out is None:
            self.name = f"{self.number:05d}-shard-{self.shard:05d}-{self.n:05d}.warc.gz"
            self.fs.create_dir(self.temporary, recursive=True)
            self.out = self.fs.open_output_stream(f"{self.temporary}/{self.name}", compression=None)
            self.records, self.bytes, self.sum = 0, 0, hashlib.sha256()
            info = f"format: WARC File Format 1.1\r\nisPartOf: {self.name}\r\n".encode()
            self._put(_record([("WARC-Type", "warcinfo"), ("WARC-Date", self.date), ("WARC-Record-ID", _record_id(None, self.name, "")), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], info, self.level))
        self._put(data)
        self.records += 1
        if self.bytes >= self.roll:
            yield from self.close()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.sum.update(data)
        self.bytes += len(data)

    def close(self) -> Iterator[tuple]:
        if self.out is not None:
            self.out.close()
            self.fs.move(f"{self.temporary}/{self.name}", f"{self.base}/{self.name}")
            yield self.shard, self.name, self.records, self.bytes, self.sum.hexdigest()
            self.out, self.n = None, self.n + 1


def _page_record(page: dict, first: dict | None, date: str, level: int) -> bytes:
    payload, url, page_id = page["html"].encode(), _one_line(page["url"]), page["page_id"]
    digest, http = sha1_name(payload), HTTP.format(len(page["html"].encode())).encode()
    headers = [("WARC-Type", "revisit" if first else "response"), ("WARC-Target-URI", url), ("WARC-Date", date), ("WARC-Record-ID", _record_id(page_id, url, digest)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response"), ("X-Page-Id", "" if page_id is None else page_id), ("X-Payload-Length", len(payload))]
    if first:
        to = _one_line(first["url"])
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _record_id(first["first_id"], to, digest)), ("WARC-Refers-To-Target-URI", to), ("X-Refers-To-Page-Id", first["first_id"])]
    return _record(headers, http if first else http + payload, level)


def _writer(root: str, number: int, roll: int, date: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, first = None, None
        done: list[tuple] = []
        for batch in batches:
            for row in batch.to_pylist():
                if shard is None or shard.shard != row["shard"]:
                    done += shard.close() if shard else ()
                    shard = _Shard(root, number, row["shard"], roll, date, level)
                if row["kind"] == 0:  # a decision stands just before the pages that it is about
                    first = row
                    continue
                same = first is not None and (first["page_id"], first["digest"]) == (row["page_id"], row["digest"])
                done += shard.add(_page_record(row, first if same else None, date, level))
        done += shard.close() if shard else ()
        columns = list(zip(*done)) or [[]] * 5
        types = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["shard", "file", "records", "bytes", "sha256"])

    return run


def write_warc(pages: DataFrame, root: str, shard_bytes: int = 32 << 20, roll_bytes: int = 8 << 20, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", level: int = 6) -> None:
    """Write page_id, url, html as gzipped WARC files below ``root``, a URI that pyarrow can write to.

    The payload is the html in UTF-8. Of equal payloads of at least ``min_bytes`` the one with the smallest page_id is a
    response, the others are revisits that refer to it. Null html is an empty payload, a null url an empty one; pages
    without id are responses and stand first; rows that repeat the id of the response are responses too; other columns
    are ignored; an empty table gives a manifest without files. A root that was written before gets a write of the next
    number; one writer at a time.
    """
    from pyarrow import fs

    spark = pages.sparkSession
    number = max(_manifests(root), default=-1) + 1
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    size = F.octet_length("html").cast("long")
    narrow = written(rows.select("page_id", "url", "digest", size.alias("bytes")), "warc-digests")
    # at most 4096 shards: beyond that they hold more files each
    shards = min(4096, max(1, -(-(narrow.agg(F.sum("bytes")).first()[0] or 0) // shard_bytes)))
    cuts = range_cuts(narrow.withColumn("cost", F.col("bytes") + 1024), "page_id", "cost", shards)
    able = narrow.filter(F.col("page_id").isNotNull() & (F.col("bytes") >= min_bytes))
    firsts = able.groupBy("digest").agg(F.min(F.struct("page_id", "url")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    # payloads of more than one of 4096 pages are few: these are looked up by broadcast, so no digest is one task
    frequent = F.col("n") * 4096 > narrow.count()
    later = by_key(able.select("page_id", "digest"), firsts, "digest", frequent).filter(F.col("page_id") > F.col("first.page_id")).select("page_id", "digest", "first").distinct()
    nothing = F.lit(None)
    decisions = later.select("page_id", F.col("first.url").alias("url"), nothing.cast("string").alias("html"), "digest", F.lit(0).alias("kind"), F.col("first.page_id").alias("first_id"))
    both = rows.select("*", F.lit(1).alias("kind"), nothing.cast("long").alias("first_id")).unionByName(decisions).withColumn("shard", shard_of(F.col("page_id"), cuts))
    ordered = both.repartitionById(len(cuts) + 1, F.col("shard")).sortWithinPartitions("shard", "page_id", "digest", "kind", "url")
    store, base = fs.FileSystem.from_uri(root)
    store.create_dir(base, recursive=True)
    manifest = f"{_temporary(number)}/{uuid.uuid4().hex}"
    with arrow_batches(spark, 256):
        ordered.mapInArrow(_writer(root, number, roll_bytes, date, level), MANIFEST).write.parquet(f"{root}/{manifest}")
    store.move(f"{base}/{manifest}", f"{base}/manifest-{number:05d}")
    store.delete_dir(f"{base}/{_temporary(number)}")


def _headers(stream: io.BufferedIOBase) -> dict[str, str] | None:
    line = stream.readline()
    if not line:
        return None
    if line != b"WARC/1.1\r\n":
        raise ValueError(f"not a WARC record: {line[:60]!r}")
    found = {}
    while (line := stream.readline()) not in (b"\r\n", b""):
        name, _, value = line.decode().partition(":")
        found[name.lower()] = value.strip()
    return found


def _reader(root: str, with_payload: bool):
    def records(name: str) -> Iterator[tuple]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        with store.open_input_stream(f"{base}/{name}", compression=None) as raw, gzip.open(io.BufferedReader(raw)) as stream:
            while (head := _headers(stream)) is not None:
                block = stream.read(int(head["content-length"]))
                if stream.read(4) != b"\r\n\r\n" or head["warc-block-digest"] != f"sha1:{sha1_name(block)}":
                    raise ValueError(f"a damaged record in {name}")
                if head["warc-type"] == "warcinfo":
                    continue
                payload, digest = None, head["warc-payload-digest"].removeprefix("sha1:")
                if head["warc-type"] == "response":
                    payload = block[block.index(b"\r\n\r\n") + 4 :]
                    if sha1_name(payload) != digest or len(payload) != int(head["x-payload-length"]):
                        raise ValueError(f"a damaged payload in {name}")
                to, page = head.get("x-refers-to-page-id"), head["x-page-id"]
                yield int(page) if page else None, head["warc-target-uri"], int(head["x-payload-length"]), digest, head["warc-type"], int(to) if to else None, payload if with_payload else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                for r in records(name):
                    rows.append(r)
                    held += len(r[6] or b"") + 256
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return run


def read_warc(spark: SparkSession, root: str, with_payload: bool = True) -> DataFrame:
    """Records of the files that the last manifest names, with digests checked; a revisit's payload is null.

    A task reads a shard's files one after the other; nothing but a few megabytes of a file is held.
    """
    manifests = _manifests(root)
    if not manifests:
        raise FileNotFoundError(f"no manifest below {root}")
    files = spark.read.schema(MANIFEST).parquet(f"{root}/{manifests[max(manifests)]}").select("shard", "file")
    shards = (files.agg(F.max("shard")).first()[0] or 0) + 1
    return files.repartitionById(shards, F.col("shard")).select("file").mapInArrow(_reader(root, with_payload), RECORDS)


def warc_query(spark: SparkSession, pages: DataFrame) -> DataFrame:
    root = new_folder(spark, "warc")
    write_warc(pages, root)
    return read_warc(spark, root, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
