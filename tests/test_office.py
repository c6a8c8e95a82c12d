import io
import zipfile

from tarnkappe.sources import office, text

NS = f'xmlns:w="{office.W[1:-1]}" xmlns:v="urn:other"'
BODY = (
    f'<?xml version="1.0" encoding="UTF-8"?><w:document {NS} v:Ignorable="w14"><w:body><w:p><w:pPr><w:tabs><w:tab w:val="left"/></w:tabs></w:pPr><w:r><w:t>Frau An</w:t></w:r>'
    '<w:r><w:rPr><w:b/></w:rPr><w:t xml:space="preserve">na </w:t><w:br/><w:t>Müller &amp; Co</w:t></w:r><w:ins w:author="Anna &gt; B" w:id="1"><w:r><w:t/></w:r></w:ins></w:p>'
    "<w:p><w:r><w:t>Rahmen</w:t></w:r><w:p><w:r><w:t>Weber</w:t></w:r></w:p></w:p></w:body></w:document>"
)
SHEET = f'<x:worksheet xmlns:x="{office.S[1:-1]}"><x:c r="A1" s="3" t="s"><x:v>0</x:v></x:c><x:c r="C1"/><x:c r="B1" t="s"><x:v>1</x:v></x:c><x:c r="A2" t="s"><x:v>1</x:v></x:c><x:c r="B2" t="str"><x:f>A1</x:f><x:v>Anna &lt;3</x:v></x:c><x:c r="C2"><x:v>5</x:v></x:c></x:worksheet>'
STRINGS = f'<sst xmlns="{office.S[1:-1]}"><si><r><t>An</t></r><r><t>na</t></r><rPh><t>x</t></rPh></si><si><t>Weber</t></si></sst>'
CORE = f'<c xmlns:dc="{office.DC[1:-1]}"><dc:creator>Anna B</dc:creator><dc:title/><dc:date>2024</dc:date></c>'


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def parts(data):
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return {n: z.read(n).decode() for n in z.namelist()}


def test_pieces_and_spans():
    p = office.read_part(BODY.encode())
    assert ["".join(x.text for x in y) for y in p.paragraphs] == ["Frau Anna \nMüller & Co", "Rahmen", "Weber"]
    piece = lambda *texts: [office.Piece(t, 10 * i, 10 * i + 9) if t not in "\t\n" else office.Piece(t) for i, t in enumerate(texts)]
    assert office.spread(piece("ab", "cd"), [(1, 3, "<X>")]) == [(0, 9, b"a&lt;X&gt;"), (10, 19, b"d")]
    assert office.spread(piece("ab", "\t", "cd"), [(2, 3, "X")]) == [(20, 29, b"Xcd")]
    assert office.spread(piece("abc"), [(0, 1, "X"), (2, 3, "Y"), (2, 3, "Z")]) == [(0, 9, b"XbY")]
    assert office.spread(piece("abc"), []) == [] and office.edited(b"0123", [(1, 2, b"xx")]) == b"0xx23"


def test_files_are_rewritten(spark):
    made = {"a.docx": ("docx", zipped({"[Content_Types].xml": "<T/>", "word/document.xml": BODY, "docProps/core.xml": CORE, "word/media/i.png": "png"})), "b.xlsx": ("xlsx", zipped({"xl/worksheets/sheet1.xml": SHEET, "xl/sharedStrings.xml": STRINGS})), "c.docx": ("docx", zipped({"word/document.xml": BODY}))}
    files = spark.createDataFrame([(n, k, d) for n, (k, d) in made.items()], "path string, kind string, content binary")
    cells = office.xlsx_tables(files).collect()
    assert [(c.unit_id, c.r, c.c, c.text) for c in cells] == [(0, 0, 0, "Anna"), (1, 0, 1, "Weber"), (2, 1, 0, "Weber"), (3, 1, 1, "Anna <3")]
    swaps = [("a.docx", 0, 5, 17, "Person A"), ("a.docx", 2, 0, 5, "Person B"), ("b.xlsx", 0, 0, 4, "Person A"), ("b.xlsx", 1, 0, 5, "Person B"), ("b.xlsx", 3, 0, 4, "Person A")]
    out = {r.path: r for r in office.written_office(files, spark.createDataFrame(swaps, "doc_id string, unit_id int, start int, end int, label string")).collect()}
    doc = parts(bytes(out["a.docx"].content))
    assert doc["word/document.xml"] == BODY.replace("Frau An<", "Frau Person A<").replace("na <", "<").replace("Müller &amp; Co", " &amp; Co").replace("Anna &gt; B", "").replace("Weber", "Person B")
    assert doc["docProps/core.xml"] == CORE.replace("Anna B", "") and doc["word/media/i.png"] == "png"
    assert parts(bytes(out["c.docx"].content))["word/document.xml"] == BODY.replace("Anna &gt; B", "")
    book = parts(bytes(out["b.xlsx"].content))
    assert "Anna" not in book["xl/sharedStrings.xml"] and "An<" not in book["xl/sharedStrings.xml"] and "Weber" in book["xl/sharedStrings.xml"]
    again = spark.createDataFrame([(r.path, r.kind, r.content) for r in out.values()], "path string, kind string, content binary")
    assert [(c.r, c.c, c.text) for c in office.xlsx_tables(again).collect()] == [(0, 0, "Person A"), (0, 1, "Person B"), (1, 0, "Weber"), (1, 1, "Person A <3")]
    assert 's="3"' in book["xl/worksheets/sheet1.xml"] and '<x:c r="C1"/>' in book["xl/worksheets/sheet1.xml"] and "<x:f>" not in book["xl/worksheets/sheet1.xml"]


def test_kinds_of_archives():
    assert text.sniff(zipped({"word/document.xml": "<d/>"}), "a") == "docx"
    assert text.sniff(zipped({"mimetype": "application/vnd.oasis.opendocument.text", "content.xml": "word/ in a text"}), "a.odt") == "rejected: archive"
    assert text.sniff(zipped({"[Content_Types].xml": "<T t='application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml'/>"}), "a") == "xlsx"
    assert text.sniff(b"PK\x03\x04broken", "a.docx") == "rejected: archive"
