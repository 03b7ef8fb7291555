"""Readers of documents: what odd, damaged and random files give."""

import io
import random
import struct
import time
import zipfile
import zlib

import pytest

from leafmill.plans import families, writers
from leafmill.sources import cells, compound, datasource, documents, pdf

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
X = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def texts(kind, ending, data):
    return [r[0] for r in documents.file_rows(kind, ending, data)]


def errors(kind, ending, data):
    return [r[-1] for r in documents.file_rows(kind, ending, data)]


def grid(ending, data):
    return [tuple(c) for c in documents._cells_of(ending, data)]


# a folder with damaged files


def test_damaged_files_are_rows_and_the_others_are_read(spark, tmp_path):
    good = writers.docx("a\tb\nsecond", header="top")
    (tmp_path / "good.docx").write_bytes(good)
    (tmp_path / "member.docx").write_bytes(families.damaged_member(good, "word/document.xml"))
    (tmp_path / "cut.xlsx").write_bytes(writers.xlsx({"s": [(1, 2, "number", 5, 1, 1)]})[:60])
    (tmp_path / "empty.pdf").write_bytes(b" ")
    (tmp_path / "nothing.pdf").write_bytes(b"%PDF-1.4\n%%EOF")
    (tmp_path / "page.pdf").write_bytes(writers.pdf([["one"], ["two " * 50]], plain=True, broken=True))
    (tmp_path / "zero.docx").write_bytes(b"PK")
    (tmp_path / "other.docx").write_bytes(writers.archive({"x": "y"}))
    (tmp_path / "old.doc").write_bytes(writers.doc("x")[:700])
    got = {(r["path"].rpartition("/")[2], r["part"]): r for r in documents.read_packed(spark, f"file://{tmp_path}").collect()}
    assert got["good.docx", 0]["text"] == "a\tb\nsecond" and (got["good.docx", 1]["name"], got["good.docx", 1]["text"]) == ("header", "top")
    assert got["page.pdf", 0]["text"] == "one" and got["page.pdf", 1]["text"] is None and "PdfError" in got["page.pdf", 1]["error"]
    for name in ("member.docx", "cut.xlsx", "empty.pdf", "nothing.pdf", "zero.docx", "other.docx", "old.doc"):
        assert got[name, 0]["error"] and got[name, 0]["text"] is None, name
    assert len(got) == 11
    everything = documents.read_documents(spark, f"file://{tmp_path}")
    assert everything.where("error is not null").count() == 8 and everything.count() == 11


def test_random_damage_never_raises():
    """Bytes changed, cut out and repeated: rows come back, soon, whatever the damage."""
    rng = random.Random(11)
    lines = ["Some text of a line", "Ünïcode 日本", "third"]
    sheets = {"A": [(r, c, "text" if c % 2 else "number", f"t{r}" if c % 2 else r * c, 1, 1) for r in range(12) for c in range(4)]}
    files = [("pdf", "pdf", writers.pdf([lines, lines], plain=False)), ("pdf", "pdf", writers.pdf([lines[:1]] * 5, plain=True)), ("office", "doc", writers.doc("\n".join(lines))), ("office", "xls", writers.xls(sheets, 64))]
    files += [("office", "docx", writers.docx("\n".join(lines))), ("office", "xlsx", writers.xlsx(sheets)), ("libreoffice", "ods", writers.ods(sheets)), ("libreoffice", "odt", writers.odt("\n".join(lines)))]
    began = time.monotonic()
    for kind, ending, data in files:
        for _ in range(150):
            raw = bytearray(data)
            for _ in range(rng.randint(1, 6)):
                at, n = rng.randrange(len(raw)), rng.randint(1, 8)
                how = rng.randrange(3)
                raw[at : at + n] = rng.randbytes(n) if how == 0 else b"" if how == 1 else raw[at : at + n] * 2
            assert documents.file_rows(kind, ending, bytes(raw))
    assert time.monotonic() - began < 120


# PDF


def test_pdf_round_trips():
    rng = random.Random(2)
    for _ in range(60):
        pages = [["".join(rng.choices("ab (c)\\ é€日Ж<>[]/%", k=rng.randint(0, 12))) for _ in range(rng.randint(0, 4))] for _ in range(rng.randint(1, 9))]
        want = ["\n".join(x for x in (" ".join(w for w in line.split(" ") if w) for line in page) if x) for page in pages]
        for plain in (True, False):
            assert texts("pdf", "pdf", writers.pdf(pages, plain)) == want
            data = writers.pdf(pages, plain)
            # references that lead nowhere: objects are found by their headings
            assert texts("pdf", "pdf", data[: data.rindex(b"startxref")] + b"startxref\n7\n%%EOF") == want


def page(content, fonts=b"", more=b""):
    return b"%PDF-1.4\n1 0 obj <</Type/Catalog/Pages 2 0 R>> endobj\n2 0 obj <</Kids[3 0 R]/Count 1>> endobj\n3 0 obj <</Type/Page/Contents 4 0 R/Resources<</Font<<" + fonts + b">>/XObject<</X 9 0 R>>>>>> endobj\n4 0 obj <</Length " + str(len(content)).encode() + b">> stream\n" + content + b"\nendstream endobj\n" + more


def test_pdf_fonts_and_operators():
    shown = b"BT /F Tf [(Wor) -20 (ld) -300 (next)] TJ 10 0 Td (same) Tj 0 -12 Td (line \\(a\\) \\101\\\nB) Tj T* <48 69> Tj 1 0 0 1 0 50 Tm (new) Tj (quote) ' ET"
    assert texts("pdf", "pdf", page(shown)) == ["World next same\nline (a) AB\nHi\nnew\nquote"]
    glyphs = b"/F <</Type/Font/Encoding<</Differences[65/eacute/uni00E9/B/space 70/fi]>>>>"
    assert texts("pdf", "pdf", page(b"BT /F 1 Tf (ABCDFZ) Tj ET", glyphs)) == ["�éB fiZ"]
    ranges = b"1 begincodespacerange <00> <ff> endcodespacerange 2 beginbfrange <01> <03> <0041> <10> <11> [<00660069> <D83DDE00>] endbfrange"
    mapped = page(b"BT /F 1 Tf <0102031011> Tj ET", b"/F <</ToUnicode 5 0 R>>", b"5 0 obj <<>> stream\n" + ranges + b"\nendstream endobj\n")
    assert texts("pdf", "pdf", mapped) == ["ABCfi😀"]
    assert "Unicode map" in errors("pdf", "pdf", page(b"BT /F 1 Tf (x) Tj ET", b"/F <</Subtype/Type0>>"))[0]
    form = b"9 0 obj <</Subtype/Form/Resources<<>>>> stream\nBT (inside) Tj ET\nendstream endobj\n"
    assert texts("pdf", "pdf", page(b"BT (out) Tj ET /X Do", more=form)) == ["out\ninside"]
    endless = b"9 0 obj <</Subtype/Form>> stream\n/X Do\nendstream endobj\n"
    assert "without end" in errors("pdf", "pdf", page(b"/X Do", more=endless))[0]
    assert texts("pdf", "pdf", page(b"BI /W 1 ID \x00(not text) Tj\nEI BT (text) Tj ET")) == ["text"]


def test_pdf_filters_and_odd_trees():
    content = b"BT (filtered) Tj ET"
    for name, data in ((b"/ASCIIHexDecode", content.hex().encode() + b">"), (b"/RunLengthDecode", bytes([len(content) - 1]) + content + b"\x80"), (b"/FlateDecode", zlib.compress(content))):
        one = page(b"").replace(b"<</Length 0>> stream\n\nendstream", b"<</Filter " + name + b"/Length %d>> stream\n" % len(data) + data + b"\nendstream")
        assert texts("pdf", "pdf", one) == ["filtered"], name
    assert "LZWDecode" in errors("pdf", "pdf", page(content).replace(b"<</Length", b"<</Filter/LZWDecode/Length"))[0]
    circle = b"%PDF-1.4\n1 0 obj <</Type/Catalog/Pages 2 0 R>> endobj\n2 0 obj <</Kids[2 0 R 2 0 R]>> endobj\n"
    assert "no pages" in errors("pdf", "pdf", circle)[0]
    assert "encrypted" in errors("pdf", "pdf", page(content) + b"trailer <</Root 1 0 R/Encrypt 8 0 R>>")[0]
    itself = b"%PDF-1.4\n1 0 obj 1 0 R endobj\n2 0 obj <</Length 2 0 R>> stream\nBT (x) Tj ET\nendstream endobj"
    assert texts("pdf", "pdf", itself) == ["x"]
    for kind in range(5):  # predictions of PNG, each kind
        raw = bytes([3, 9, 200, 7, 7, 250])
        rows, above = b"", bytes(3)
        for at in (0, 3):
            row, out = raw[at : at + 3], []
            for i in range(3):
                left, up, corner = row[i - 1] if i else 0, above[i], above[i - 1] if i else 0
                near = min((left, up, corner), key=lambda v, p=left + up - corner: abs(p - v))
                out.append((row[i] - (0, left, up, (left + up) // 2, near)[kind]) & 255)
            rows, above = rows + bytes([kind, *out]), row
        assert pdf._unpredicted(rows, {"Predictor": 15, "Columns": 3}) == raw


# Office and LibreOffice


def test_separators_aren_t_lost():
    body = f"<w:document {W}><w:p><w:pPr><w:tabs><w:tab/></w:tabs></w:pPr><w:r><w:t>alpha</w:t><w:tab/><w:t>beta</w:t><w:br/><w:t>gamma</w:t><w:noBreakHyphen/><w:t>x</w:t></w:r></w:p></w:document>"
    extra = {"word/footnotes.xml": f"<w:footnotes {W}><w:p><w:r><w:t>note</w:t></w:r></w:p></w:footnotes>", "word/comments.xml": f"<w:comments {W}/>"}
    rows = documents.file_rows("office", "docx", writers.archive({"word/document.xml": body} | extra))
    assert [(r[0], r[1]) for r in rows] == [("alpha\tbeta\ngamma-x", "document"), ("note", "footnotes")]
    odt = '<o xmlns:t="urn:t"><t:p>alpha<t:tab/>beta<t:s t:c="3"/>gamma<t:line-break/>delta<t:s/>end</t:p></o>'
    assert texts("libreoffice", "odt", writers.archive({"content.xml": odt})) == ["alpha\tbeta   gamma\ndelta end"]
    odp = '<o xmlns:d="urn:d" xmlns:t="urn:t"><o:b xmlns:o="urn:o"><o:presentation><d:page d:name="p1"><t:p>one</t:p></d:page><d:page d:name="p2"><t:p>two</t:p></d:page></o:presentation></o:b></o>'
    assert [(r[1], r[0]) for r in documents.file_rows("libreoffice", "odp", writers.archive({"content.xml": odp}))] == [("p1", "one"), ("p2", "two")]


def test_cells_keep_their_places_and_types():
    sheet = f'<worksheet {X}><sheetData><row r="2"><c r="C2"><v>5</v></c></row><row><c t="str"><v>f</v></c><c t="e"><v>#N/A</v></c><c s="1"><v>60.5</v></c><c s="1"><v>0.25</v></c><c s="1"><v>59</v></c><c/><c t="b"><v>0</v></c></row></sheetData></worksheet>'
    book = {"xl/workbook.xml": f"<workbook {X}/>", "xl/worksheets/sheet1.xml": sheet, "xl/styles.xml": f'<styleSheet {X}><cellXfs><xf/><xf numFmtId="22"/></cellXfs></styleSheet>'}
    own = [(c[2], c[3], c[4], c[5]) for c in grid("xlsx", writers.archive(book))]
    assert own == [(1, 2, "number", "5"), (2, 0, "text", "f"), (2, 1, "error", "#N/A"), (2, 2, "date", "1900-02-28T12:00:00"), (2, 3, "date", "06:00:00"), (2, 4, "date", "1900-02-28"), (2, 6, "boolean", "false")]
    assert texts("office", "xlsx", writers.archive(book))[0].split("\n")[0] == "\t\t5"
    for code, dated in (("General", False), ("0.00", False), ('"day"0', False), ("[Red]0", False), ("[h]:mm", True), ("mmm\\-yy", True), ("0.0E+00", False), ("AM/PM h", True)):
        assert cells.is_date_format(170, {170: code}) is dated, code
    many = '<o xmlns:b="urn:b" xmlns:t="urn:t" xmlns:x="urn:x"><b:spreadsheet><t:table t:name="s"><t:table-row t:number-rows-repeated="9000000"><t:table-cell t:number-columns-repeated="16000" b:value-type="float" b:value="1"/></t:table-row></t:table></b:spreadsheet></o>'
    with pytest.raises(cells.TooLargeError):
        grid("ods", writers.archive({"content.xml": many}))


@pytest.mark.parametrize("seed", range(3))
def test_sheets_round_trip(seed):
    """Random sparse sheets through every format, with merged cells, and strings that records cut anywhere."""
    import datetime as dt

    rng = random.Random(seed)
    kinds = {"text": lambda: "".join(rng.choices("ab&<>\"; é日😀", k=rng.randint(1, 30))).strip() or "x", "number": lambda: rng.choice([0, -3, 7, 1.5, -2.25, 1e-7, 123456789012, 0.1]), "boolean": lambda: rng.random() < 0.5}
    kinds["date"] = lambda: dt.date(1990, 1, 1) + dt.timedelta(days=rng.randrange(20_000))
    sheets, want = {}, []
    for no, name in enumerate(["One", "Zwei & <drei>"]):
        places = sorted({(rng.randrange(40), rng.randrange(0, 60, 4)) for _ in range(60)})
        sheets[name] = [(r, c, kind := rng.choice(list(kinds)), kinds[kind](), *rng.choice([(1, 1), (1, 1), (2, 3)])) for r, c in places]
        for r, c, kind, v, *span in sheets[name]:
            shown = cells.number_text(v) if kind == "number" else str(v).lower() if kind == "boolean" else v.isoformat() if kind == "date" else v
            want.append((no, name, r, c, kind, shown, *span))
    assert grid("xlsx", writers.xlsx(sheets)) == want
    assert grid("ods", writers.ods(sheets)) == want
    for limit in (24, 40, 8224):
        assert grid("xls", writers.xls(sheets, limit)) == want
    plain = [c for c in want if c[0] == 0]
    got = grid("csv", writers.csv_file(sheets))
    assert [c[2:4] for c in got] == [c[2:4] for c in plain] and [c[5] for c in got if c[4] != "text"] == [c[5] for c in plain if c[4] != "text"]


def test_csv_marks():
    assert cells.delimiter_of("a;b\n1;2\n") == ";" and cells.delimiter_of("a\tb,c\n1\t2\n") == "\t" and cells.delimiter_of('"a;b",c\n"x",y\n') == "," and cells.delimiter_of("one\ntwo") == ","
    assert [c[2:6] for c in grid("csv", "﻿id,när\r\n007,2024-01-02 03:04\r\n1.50,\"a\n\"\"b\"\r\n".encode())] == [(0, 0, "text", "id"), (0, 1, "text", "när"), (1, 0, "text", "007"), (1, 1, "date", "2024-01-02T03:04"), (2, 0, "number", "1.5"), (2, 1, "text", 'a\n"b')]
    assert grid("csv", "x|y\n1|2".encode("utf-16"))[1][5] == "y" and grid("csv", b"caf\xe9,1")[0][5] == "café" and grid("csv", b"") == []


def test_legacy_documents():
    rng = random.Random(4)
    for _ in range(40):
        lines = ["".join(rng.choices("ab é€日😀\t", k=rng.randint(0, 300))) for _ in range(rng.randint(0, 30))]
        want = "\n".join(x for x in (line.strip() for line in lines) if x)
        found = list(compound.word_texts(writers.doc("\n".join(lines), header="über 日")))
        assert found == [("document", want), ("headers", "über 日")]
    assert list(compound.word_texts(writers.doc("see \x13 HYPERLINK x \x14here\x15 now\x07cell\x01"))) == [("document", "see here now\tcell")]
    long = "long text " * 40_000
    assert list(compound.word_texts(writers.doc(long)))[0][1] == long.strip()
    loop = bytearray(writers.doc("x" * 5000))
    fat = struct.unpack_from("<I", loop, 76)[0]
    struct.pack_into("<I", loop, 512 * (fat + 1), 0)  # a chain that leads to itself
    assert "end" in errors("office", "doc", bytes(loop))[0]
    assert [cells.number_text(compound._rk(v)) for v in (0x3FF00000, 0x3FF00001, 5 << 2 | 2, 1234 << 2 | 3, (-7 << 2 | 2) & 0xFFFFFFFF)] == ["1", "0.01", "5", "12.34", "-7"]


# the data source


def test_source_deals_files_by_size_and_pushes_families(spark, tmp_path):
    datasource.register(spark)
    for i in range(30):
        (tmp_path / f"{i}.txt").write_text(f"text {i}")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.docx").write_bytes(writers.docx("inside"))
    (tmp_path / "bad.pdf").write_bytes(b"no pdf")
    (tmp_path / "zero.docx").write_bytes(b"")
    (tmp_path / ".hidden.txt").write_text("no")
    df = spark.read.format("documents").option("partitionBytes", 20_000).load(f"file://{tmp_path}")
    assert df.rdd.getNumPartitions() > 5
    rows = {r["path"].rpartition("/")[2]: r for r in df.collect()}
    assert len(rows) == 33 and rows["zero.docx"]["error"] and rows["3.txt"]["text"] == "text 3" and rows["a.docx"]["text"] == "inside" and rows["bad.pdf"]["error"]
    reader = datasource.DocumentsReader({"path": str(tmp_path)})
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    left = list(reader.pushFilters([In(("family",), ("pdf", "office")), GreaterThan(("length",), 3), EqualTo(("family",), "pdf")]))
    assert len(left) == 1 and [f[1].rpartition("/")[2] for p in reader.partitions() for f in p.files] == ["bad.pdf"]
    assert sorted(r["path"].rpartition("/")[2] for r in df.where("family = 'office'").collect()) == ["a.docx", "zero.docx"]
    assert spark.read.format("documents").load(f"file://{tmp_path}/sub").where("family = 'image'").count() == 0


def test_source_streams_new_files(spark, tmp_path):
    import os

    datasource.register(spark)
    where, out = tmp_path / "in", f"file://{tmp_path}/out"
    where.mkdir()

    def run():
        stream = spark.readStream.format("documents").load(f"file://{where}").select("path", "text", "error")
        q = stream.writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start(out)
        q.awaitTermination()
        return sorted(r["text"] or "error" for r in spark.read.schema("text string").parquet(out).collect())

    (where / "a.txt").write_text("a")
    os.utime(where / "a.txt", (1_000, 1_000))
    assert run() == ["a"]
    for i, name in enumerate(("b.md", "c.pdf")):
        (where / name).write_text(name)
        os.utime(where / name, (2_000 + i, 2_000 + i))
    assert run() == ["a", "b.md", "error"] and run() == ["a", "b.md", "error"]


def test_archives_hold_the_marks_that_damage_them():
    data = writers.docx("text")
    with zipfile.ZipFile(io.BytesIO(families.damaged_member(data, "word/document.xml"))) as z, pytest.raises(zlib.error):
        z.read("word/document.xml")
