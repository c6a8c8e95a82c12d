"""Texts of DOCX and XLSX files as units and cells, and back into copies of the files, with the standard library's zip and
XML readers inside tasks. A file is one row; the reader of files keeps them below 20 MB.

Copies are edited in place: only the bytes of changed texts, of authors and of properties differ from the original.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree
from xml.parsers import expat
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The namespaces of the two formats.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
DC = "{http://purl.org/dc/elements/1.1/}"
CORE = "{http://schemas.openxmlformats.org/package/2006/metadata/core-properties}"
#: The parts with text, and the properties that say who wrote a file or what it is about.
TEXT_PARTS = r"word/(document|header\d*|footer\d*|footnotes|endnotes|comments|glossary/document|charts/[^/]*|diagrams/[^/]*)\.xml"
SHEETS = r"xl/worksheets/sheet\d+\.xml"
PROPERTIES = {
    "docProps/core.xml": "creator lastModifiedBy title subject keywords description category contentStatus identifier language",
    "docProps/app.xml": "Company Manager HyperlinkBase",
    "docProps/custom.xml": "lpwstr lpstr bstr",
}
UNITS = "doc_id string, unit_id int, part string, text string"
CELLS = "doc_id string, unit_id int, table_id string, r int, c int, text string"
#: A start tag, whose attributes may hold > in quotes.
TAG = re.compile(rb"<(?:\"[^\"]*\"|'[^']*'|[^>\"'])*>")
Edit = tuple[int, int, bytes]


@dataclass
class Piece:
    """Text of an element, and where it stands in the part's bytes; a tab or break has no bytes to write to."""

    text: str
    begin: int = -1
    end: int = -1


@dataclass
class Part:
    """Paragraphs of a part in order of their beginning, each a list of pieces, and the edits that take authors out."""

    paragraphs: list[list[Piece]] = field(default_factory=list)
    authors: list[Edit] = field(default_factory=list)


def read_part(xml: bytes) -> Part:
    """Paragraphs of Word and of drawings. A text belongs to the innermost paragraph around it, so boxes count once."""
    part, open_, texts, path = Part(), [], [], []
    parser = expat.ParserCreate(namespace_separator="}")

    def start(name: str, attributes: dict[str, str]) -> None:
        name, at = "{" + name if "}" in name else name, parser.CurrentByteIndex
        tag = TAG.match(xml, at)[0]
        if name in (f"{W}p", f"{A}p"):
            part.paragraphs.append([])
            open_.append(part.paragraphs[-1])
        elif open_ and name in (f"{W}t", f"{W}delText", f"{A}t") and not tag.endswith(b"/>"):
            texts.append(Piece("", at + len(tag)))
        elif open_ and path and path[-1] in (f"{W}r", f"{A}p") and name in (f"{W}tab", f"{W}br", f"{W}cr", f"{A}br"):
            open_[-1].append(Piece("\t" if name == f"{W}tab" else "\n"))
        if any("{" + a in (f"{W}author", f"{W}initials") for a in attributes):
            part.authors.append((at, at + len(tag), re.sub(rb"(:(?:author|initials)\s*=\s*)(?:\"[^\"]*\"|'[^']*')", rb'\1""', tag)))
        path.append(name)

    def end(name: str) -> None:
        path.pop()
        name = "{" + name if "}" in name else name
        if name in (f"{W}p", f"{A}p"):
            open_.pop()
        elif texts and name in (f"{W}t", f"{W}delText", f"{A}t"):
            texts[-1].end = parser.CurrentByteIndex
            open_[-1].append(texts.pop())

    def data(text: str) -> None:
        if texts:
            texts[-1].text += text

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, data
    parser.Parse(xml, True)
    return part


def spread(pieces: list[Piece], swaps: list[tuple[int, int, str]]) -> list[Edit]:
    """The edits of a paragraph: a label goes where its span first meets a piece with bytes, the rest of the span is taken out.

    A span over nothing but tabs and breaks goes to the next piece. ``swaps`` don't overlap; of overlapping ones the first
    by place counts.
    """
    edits, at, left = [], 0, sorted(swaps)
    clear, last = [], 0
    for s, e, label in left:
        if s >= last:
            clear.append([s, e, label, False])
            last = e
    for piece in pieces:
        stop, new, here = at + len(piece.text), "", at
        if piece.begin >= 0:
            for span in clear:
                s, e, label, placed = span
                if e <= at and placed or s >= stop:
                    continue
                cut = max(s, at)
                new += piece.text[here - at : max(cut, here) - at] + ("" if placed else label)
                here, span[3] = max(here, min(e, stop)), True
            new += piece.text[here - at :]
            if new != piece.text:
                edits.append((piece.begin, piece.end, escape(new).encode()))
        at = stop
    return edits


def edited(xml: bytes, edits: list[Edit]) -> bytes:
    out, at = [], 0
    for begin, end, new in sorted(edits):
        out += [xml[at:begin], new]
        at = end
    return b"".join([*out, xml[at:]])


def _parts(z: zipfile.ZipFile, pattern: str) -> list[str]:
    return sorted(n for n in z.namelist() if re.fullmatch(pattern, n))


def docx_paragraphs(data: bytes) -> Iterator[tuple[str, str]]:
    """(part, text) of every paragraph of the document, headers, footers, notes, comments, charts and drawings."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for name in _parts(z, TEXT_PARTS):
            for pieces in read_part(z.read(name)).paragraphs:
                yield name, "".join(p.text for p in pieces)


def _shared(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    # readings above a text (rPh) aren't part of it
    return ["".join(t.text or "" for x in si for t in ([x] if x.tag == f"{S}t" else x.iter(f"{S}t") if x.tag == f"{S}r" else [])) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{S}si")]


def column_number(letters: str) -> int:
    n = 0
    for x in letters:
        n = n * 26 + ord(x) - 64
    return n - 1


def sheet_cells(xml: bytes, shared: list[str]) -> Iterator[tuple[int, int, str, int | None]]:
    """(row, column, text, number of the shared string) of a sheet's cells with text, in the file's order; cells must name their place."""
    for c in ElementTree.fromstring(xml).iter(f"{S}c"):
        letters, row = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r")).groups()
        value, kind = c.find(f"{S}v"), c.get("t")
        number = int(value.text) if kind == "s" and value is not None else None
        text = shared[number] if number is not None else "".join(t.text or "" for t in c.iter(f"{S}t")) if kind == "inlineStr" else value.text or "" if kind == "str" and value is not None else ""
        if text:
            yield int(row) - 1, column_number(letters), text, number


def xlsx_cells(data: bytes) -> Iterator[tuple[int, str, int, int, str]]:
    """(unit, sheet, row, column, text) of every cell with text; shared, inline and formula strings."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared, unit = _shared(z), 0
        for name in _parts(z, SHEETS):
            for r, c, text, _ in sheet_cells(z.read(name), shared):
                yield unit, name, r, c, text
                unit += 1


def meta_names(data: bytes) -> Iterator[tuple[str, str]]:
    """(kind, name) of author, last editor, manager and company in the file's properties."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if "docProps/core.xml" in z.namelist():
            core = ElementTree.fromstring(z.read("docProps/core.xml"))
            for tag, kind in ((f"{DC}creator", "person"), (f"{CORE}lastModifiedBy", "person")):
                for x in core.iter(tag):
                    if x.text:
                        yield kind, x.text
        if "docProps/app.xml" in z.namelist():
            for x in ElementTree.fromstring(z.read("docProps/app.xml")).iter():
                tag = x.tag.rpartition("}")[2]
                if tag in ("Manager", "Company") and x.text:
                    yield "org" if tag == "Company" else "person", x.text


def cleared(xml: bytes, names: str) -> bytes:
    """A part of properties without the texts of the named elements."""
    edits, open_, wanted = [], [], set(names.split())
    parser = expat.ParserCreate(namespace_separator="}")

    def start(name: str, _: dict[str, str]) -> None:
        tag = TAG.match(xml, parser.CurrentByteIndex)[0]
        open_.append(None if tag.endswith(b"/>") else parser.CurrentByteIndex + len(tag))

    def end(name: str) -> None:
        begin = open_.pop()
        if begin is not None and name.rpartition("}")[2] in wanted:
            edits.append((begin, parser.CurrentByteIndex, b""))

    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.Parse(xml, True)
    return edited(xml, edits)


def _docx_edits(z: zipfile.ZipFile, swaps: dict[int, list]) -> dict[str, bytes]:
    new, unit = {}, 0
    for name in _parts(z, TEXT_PARTS):
        xml = z.read(name)
        part = read_part(xml)
        edits = list(part.authors)
        for pieces in part.paragraphs:
            edits += spread(pieces, swaps.get(unit, []))
            unit += 1
        new[name] = edited(xml, edits)
    return new


def _xlsx_edits(z: zipfile.ZipFile, swaps: dict[int, list]) -> dict[str, bytes]:
    """A changed cell becomes an inline string; a shared string that only changed cells had is emptied."""
    new, shared, unit = {}, _shared(z), 0
    kept, gone = set(), set()
    for name in _parts(z, SHEETS):
        xml, changed = z.read(name), {}
        for r, c, text, number in sheet_cells(xml, shared):
            if unit in swaps:
                piece = Piece(text, 0, 0)
                changed[r, c] = next((new_text for _, _, new_text in spread([piece], swaps[unit])), None)
            (gone if changed.get((r, c)) is not None else kept).add(number)
            unit += 1
        edits = []
        for m in re.finditer(rb"<((?:[\w.-]+:)?)c((?:\s[^<>]*?)?)(?<!/)>(?:(?!</(?:[\w.-]+:)?c>).)*</(?:[\w.-]+:)?c>", xml, re.S):
            place = re.search(rb"\sr\s*=\s*[\"']([A-Z]+)(\d+)", m[2])
            text = changed.get((int(place[2]) - 1, column_number(place[1].decode()))) if place else None
            if text is not None:
                p, kind = m[1], re.sub(rb"\st\s*=\s*(?:\"[^\"]*\"|'[^']*')", b"", m[2])
                edits.append((m.start(), m.end(), b'<%sc%s t="inlineStr"><%sis><%st xml:space="preserve">%s</%st></%sis></%sc>' % (p, kind, p, p, text, p, p, p)))
        new[name] = edited(xml, edits)
    if gone - kept - {None}:
        xml, n = z.read("xl/sharedStrings.xml"), -1
        edits = []
        for m in re.finditer(rb"<((?:[\w.-]+:)?)si(?:\s[^<>]*)?(?:/>|>(.*?)</\1si>)", xml, re.S):
            n += 1
            if n in gone - kept and m[2]:
                edits.append((m.start(2), m.end(2), b"<%st></%st>" % (m[1], m[1])))
        new["xl/sharedStrings.xml"] = edited(xml, edits)
    return new


def rewritten(data: bytes, kind: str, swaps: dict[int, list]) -> bytes:
    """A copy of a file with swaps (start, end, label) by unit, without authors and telling properties."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as z, zipfile.ZipFile(out, "w") as copy:
        new = (_docx_edits if kind == "docx" else _xlsx_edits)(z, swaps)
        for info in z.infolist():
            part = new.get(info.filename, z.read(info))
            copy.writestr(info, cleared(part, PROPERTIES[info.filename]) if info.filename in PROPERTIES else part)
    return out.getvalue()


def _rows(files: DataFrame, kind: str, read, schema: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                yield pd.DataFrame([(path, *row) for row in read(bytes(content))], columns=names)

    return files.filter(files["kind"].isin(kind.split())).select("path", "content").mapInPandas(run, schema)


def docx_units(files: DataFrame) -> DataFrame:
    return _rows(files, "docx", lambda data: ((i, part, text) for i, (part, text) in enumerate(docx_paragraphs(data))), UNITS)


def xlsx_tables(files: DataFrame) -> DataFrame:
    return _rows(files, "xlsx", xlsx_cells, CELLS)


def file_names(files: DataFrame) -> DataFrame:
    """doc_id, kind, name of persons and companies in the properties, each once."""
    return _rows(files, "docx xlsx", meta_names, "doc_id string, kind string, name string").distinct()


def written_office(files: DataFrame, swaps: DataFrame) -> DataFrame:
    """(path, kind, content): copies of the DOCX and XLSX files with ``swaps`` (doc_id, unit_id, start, end, label) made.

    Units are those of ``docx_units`` and ``xlsx_tables``. A file's swaps are gathered beside it; they are fewer than its
    characters, and a file has 20 MB at most. Files without swaps lose their authors and properties only. A changed cell
    loses formats inside its text, and its formula.
    """
    per = swaps.groupBy(F.col("doc_id").alias("path")).agg(F.collect_list(F.struct("unit_id", "start", "end", "label")).alias("swaps"))
    rows = files.filter("kind in ('docx', 'xlsx')").select("path", "kind", "content").join(per, "path", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, kind, content, swapped in zip(batch["path"], batch["kind"], batch["content"], batch["swaps"]):
                by_unit: dict[int, list] = {}
                for x in [] if swapped is None else swapped:
                    by_unit.setdefault(x["unit_id"], []).append((x["start"], x["end"], x["label"]))
                yield pd.DataFrame({"path": [path], "kind": [kind], "content": [rewritten(bytes(content), kind, by_unit)]})

    return rows.mapInPandas(run, "path string, kind string, content binary")
