"""Text and CSV files as units, and back. Files are read by Spark's binaryFile source, so any store that it reaches will do."""

from __future__ import annotations

import io
import re
import unicodedata
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LARGEST, LARGE = 20_000_000, 5_000_000
#: The inside of a quoted cell.
QUOTED = '[^"]*(?:""[^"]*)*'


def decode(data: bytes) -> str:
    """By byte order mark (UTF-8, UTF-16), else strict UTF-8, else Windows-1252; composed form."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return unicodedata.normalize("NFC", data[len(mark) :].decode(name, "replace"))
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        text = data.decode("cp1252", "replace")
    return unicodedata.normalize("NFC", text)


def archive_kind(data: bytes) -> str:
    """A zip is a document or a table if its list of content types says so; other archives, broken ones too, aren't taken."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = set(z.namelist())
            types = z.read("[Content_Types].xml") if "[Content_Types].xml" in names else b""
    except (zipfile.BadZipFile, zlib.error):
        return "rejected: archive"
    if b"wordprocessingml" in types or "word/document.xml" in names:
        return "docx"
    return "xlsx" if b"spreadsheetml" in types or names & {"xl/workbook.xml", "xl/sharedStrings.xml"} else "rejected: archive"


def sniff(data: bytes, name: str) -> str:
    """What a file is by its content: txt, csv, docx, xlsx, or why it isn't taken."""
    head = data[:4096]
    if b"%PDF-" in data[:1024]:
        return "rejected: pdf"
    if data.startswith(b"PK\x03\x04"):
        return archive_kind(data)
    if data.startswith(b"\xd0\xcf\x11\xe0") or data.startswith(b"{\\rtf"):
        return "rejected: old format"
    wide = data.startswith((b"\xff\xfe", b"\xfe\xff"))
    controls = sum(b < 32 and b not in (9, 10, 12, 13) for b in head)
    if not wide and (b"\0" in data or controls > 0.05 * max(1, len(head))):
        return "rejected: binary"
    return "csv" if name.lower().endswith((".csv", ".tsv")) else "txt"


def delimiter(text: str) -> str:
    """Of ; , tab and | the one whose number is the same in most of the first 20 rows, then the one with more.

    Signs and line breaks inside quotes don't count.
    """
    rows = [r for r in re.sub(f'"{QUOTED}(?:"|$)', "", text[:20_000]).splitlines() if r.strip()][:20]

    def rank(sign: str) -> int:
        counts = [r.count(sign) for r in rows]
        return sum(c == counts[0] for c in counts) * 100 + counts[0] if counts and counts[0] else 0

    return max(";,\t|", key=rank)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, kind, warning, content; files over 20 MB are rejected, over 5 MB warned of."""
    files = spark.read.format("binaryFile").load(path)

    @F.pandas_udf("string")
    def kind(content: pd.Series, name: pd.Series) -> pd.Series:
        return pd.Series([sniff(bytes(c), n) for c, n in zip(content, name)])

    small = files.filter(F.col("length") <= LARGEST).select("path", kind("content", "path").alias("kind"), F.when(F.col("length") > LARGE, "large").alias("warning"), "content")
    return small.unionByName(files.filter(F.col("length") > LARGEST).select("path", F.lit("rejected: too large").alias("kind")), allowMissingColumns=True)


def text_units(files: DataFrame) -> DataFrame:
    """A unit for each line of the txt files: doc_id (the path), unit_id, text, eol."""

    @F.pandas_udf("string")
    def decoded(content: pd.Series) -> pd.Series:
        return pd.Series([decode(bytes(c)) for c in content])

    text = files.filter("kind = 'txt'").select(F.col("path").alias("doc_id"), decoded("content").alias("whole"))
    lines = text.select("doc_id", F.posexplode(F.split("whole", r"(?<=\n)|(?<=\r)(?!\n)", -1)).alias("unit_id", "line"))
    return lines.select("doc_id", "unit_id", F.regexp_replace("line", r"[\r\n]+$", "").alias("text"), F.regexp_extract("line", r"[\r\n]+$", 0).alias("eol"))


def written_text(units: DataFrame, column: str = "masked") -> DataFrame:
    """doc_id and the whole text of its units in order, line ends as they were."""
    line = F.struct("unit_id", F.concat(column, "eol").alias("line"))
    return units.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "").alias("text"))


def encoded(text: Column, mark: bool = True) -> Column:
    """The bytes of a text in UTF-8, with a byte order mark in front unless ``mark`` is false."""
    return F.concat(F.unhex(F.lit("EFBBBF")), F.encode(text, "UTF-8")) if mark else F.encode(text, "UTF-8")


CELLS = "doc_id string, table_id string, r int, c int, text string, quoted boolean, open boolean, raw string, end string, sign string"


def table_cells(text: str, sign: str) -> Iterator[tuple[int, int, str, bool, bool, str, str]]:
    """(row, column, text, quoted, open, raw, end) of each cell; ``raw + end`` of all cells together are the text.

    ``open`` is a quote that is never closed: the cell goes on to the end of the text. What stands behind a closing quote
    belongs to the cell.
    """
    s = re.escape(sign)
    cell = re.compile(rf'(?:"(?P<inside>{QUOTED})(?P<close>"?)(?P<rest>[^{s}\r\n]*)|(?P<plain>[^{s}\r\n]*))(?P<end>{s}|\r\n|\r|\n|$)')
    at, r, c, end = 0, 0, 0, "\n"
    while at < len(text) or end == sign:
        m = cell.match(text, at)
        at, end = m.end(), m["end"]
        quoted = m["plain"] is None
        value = m["inside"].replace('""', '"') + m["rest"] if quoted else m["plain"]
        yield r, c, value, quoted, quoted and not m["close"], m[0][: len(m[0]) - len(end)], end
        r, c = (r, c + 1) if end == sign else (r + 1, 0)


def csv_cells(files: DataFrame) -> DataFrame:
    """A row for every cell of the csv files; a quoted cell may hold line breaks.

    doc_id (the path), table_id, r, c, text, quoted, open (a quote that is never closed), raw (as it stands in the file),
    end (the sign or line break behind it) and sign. An empty file has no cells.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                text = decode(bytes(content))
                sign = delimiter(text)
                rows = [(path, "csv", *cell, sign) for cell in table_cells(text, sign)]
                yield pd.DataFrame(rows, columns=[x.split()[0] for x in CELLS.split(", ")])

    return files.filter("kind = 'csv'").select("path", "content").mapInPandas(run, CELLS)


def written_csv(cells: DataFrame, column: str = "text") -> DataFrame:
    """doc_id and the text of its table. Cells whose ``column`` is their text stay as they stood in the file; others get
    quotes if they had or need them."""
    need = F.col("quoted") | F.contains(F.col(column), F.col("sign")) | F.col(column).rlike('["\r\n]')
    new = F.when(need, F.concat(F.lit('"'), F.replace(F.col(column), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col(column))
    cell = F.concat(F.when(F.col(column) == F.col("text"), F.col("raw")).otherwise(new), "end")
    rows = cells.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("r", "c", cell.alias("t")))).alias("all"))
    return rows.select("doc_id", F.array_join(F.transform("all", lambda x: x["t"]), "").alias("text"))
