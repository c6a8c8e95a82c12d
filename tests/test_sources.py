import io
import zipfile

from tarnkappe.sources import office, text
from tarnkappe.streaming.contacts import masked_stream


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def test_files(spark, tmp_path):
    w, s = office.W[1:-1], office.S[1:-1]
    core = f'<c xmlns:dc="{office.DC[1:-1]}" xmlns:cp="{office.CORE[1:-1]}"><dc:creator>Anna B</dc:creator><cp:lastModifiedBy>Anna B</cp:lastModifiedBy></c>'
    made = {
        "a.txt": "Zeile 1\r\n\r\nZeile ä\nEnde".encode(), "old.txt": "Grüße".encode("cp1252"), "b.csv": 'Name;Text\r\n"Anna; B";"x ""y""\nz"'.encode("utf-8-sig"),
        "c.docx": zipped({"word/document.xml": f'<d xmlns:w="{w}"><w:p><w:r><w:t>Frau </w:t></w:r><w:r><w:t>Weber</w:t><w:tab/></w:r></w:p><w:p/></d>', "word/header1.xml": f'<d xmlns:w="{w}"><w:p><w:t>Kopf</w:t></w:p></d>', "docProps/core.xml": core}),
        "d.xlsx": zipped({"xl/sharedStrings.xml": f'<s xmlns="{s}"><si><t>Name</t></si><si><r><t>An</t></r><r><t>na</t></r></si></s>', "xl/worksheets/sheet1.xml": f'<w xmlns="{s}"><c r="A1" t="s"><v>0</v></c><c r="AB2" t="s"><v>1</v></c><c r="B3" t="inlineStr"><is><t>in</t></is></c><c r="C3"><v>5</v></c></w>'}),
        "e.bin": b"\x00\x01\x02" * 50, "f.pdf": b"%PDF-1.4",
    }
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    files = text.read_files(spark, str(tmp_path)).cache()
    assert {r.path.rpartition("/")[2]: r.kind for r in files.collect()} == {"a.txt": "txt", "old.txt": "txt", "b.csv": "csv", "c.docx": "docx", "d.xlsx": "xlsx", "e.bin": "rejected: binary", "f.pdf": "rejected: pdf"}
    units = text.text_units(files)
    assert {r.text for r in units.collect()} == {"Zeile 1", "", "Zeile ä", "Ende", "Grüße"}
    assert {r.text for r in text.written_text(units, "text").collect()} == {"Zeile 1\r\n\r\nZeile ä\nEnde", "Grüße"}
    cells = text.csv_cells(files)
    assert sorted((r.r, r.c, r.text) for r in cells.collect()) == [(0, 0, "Name"), (0, 1, "Text"), (1, 0, "Anna; B"), (1, 1, 'x "y"\nz')]
    assert text.written_csv(cells).first().text == 'Name;Text\r\n"Anna; B";"x ""y""\nz"'
    assert sorted((r.part, r.text) for r in office.docx_units(files).collect()) == [("word/document.xml", ""), ("word/document.xml", "Frau Weber\t"), ("word/header1.xml", "Kopf")]
    assert sorted((r.r, r.c, r.text) for r in office.xlsx_tables(files).collect()) == [(0, 0, "Name"), (1, 27, "Anna"), (2, 1, "in")]
    assert [(r.kind, r.name) for r in office.file_names(files).collect()] == [("person", "Anna B")]
    assert text.delimiter("a,b;c\nd;e\n") == ";" and text.decode(b"\xff\xfeA\x00") == "A"


TABLES = ['a;b\r\n"c";d\n', 'x;"1;2;3"\n\n;;\r"open;\nend', "", "one", 'a;\n"q""q"tail;z\r\n', "\n\n"]


def test_csv_comes_back_byte_for_byte(spark):
    files = spark.createDataFrame([(str(i), "csv", t.encode()) for i, t in enumerate(TABLES)], "path string, kind string, content binary")
    cells = text.csv_cells(files).cache()
    back = {r.doc_id: r.text for r in text.written_csv(cells).collect()}
    assert back == {str(i): t for i, t in enumerate(TABLES) if t}
    got = {(int(r.doc_id), r.r, r.c): (r.text, r.open) for r in cells.collect()}
    assert got[1, 0, 1] == ("1;2;3", False) and got[1, 3, 0] == ("open;\nend", True) and got[4, 0, 1] == ("", False) and got[4, 1, 0] == ('q"qtail', False)
    changed = cells.filter("doc_id in ('0', '1')").withColumn("masked", text.F.when(text.F.col("text").isin("d", "c", "b"), text.F.concat("text", text.F.lit(";x"))).otherwise(text.F.col("text")))
    assert {r.doc_id: r.text for r in text.written_csv(changed, "masked").collect()} == {"0": 'a;"b;x"\r\n"c;x";"d;x"\n', "1": TABLES[1]}
    assert text.delimiter('"a,b,c";1\n"d,e\n,f";2\n') == ";"


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "a@b.de")], "id long, text string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, text string").parquet(f"{tmp_path}/in")
    query = masked_stream(stream).select("id", "masked").writeStream.format("memory").queryName("masked").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [tuple(r) for r in spark.table("masked").collect()] == [(1, "[E-MAIL]")]
