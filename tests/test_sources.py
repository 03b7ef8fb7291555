"""Document formats, written by the test and read by Spark."""

import io
import struct
import zipfile
import zlib

import pytest

from leafmill.plans import writers
from leafmill.sources import cells, compound, datasource, documents, pdf


def _zip(path, members):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("docs")
    (d / "sub").mkdir()
    (d / "a.txt").write_text("plain\ntext")
    (d / "sub" / "b.py").write_text("x = 1\nprint(x)\n")
    (d / "c.md").write_text("# Title\n\nSome **bold** [link](http://x)\n\n## Second\n- item\n")
    (d / "t.csv").write_text('id,name\n1,"two\nlines"\n2,"say ""hi"""\n')
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    _zip(d / "w.docx", {"word/document.xml": f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>First</w:t></w:r></w:p><w:p><w:r><w:t>Sec</w:t></w:r><w:r><w:t>ond</w:t></w:r></w:p></w:body></w:document>'})
    s = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    _zip(
        d / "x.xlsx",
        {
            "xl/workbook.xml": f'<workbook xmlns="{s}"/>',
            "xl/sharedStrings.xml": f'<sst xmlns="{s}"><si><t>name</t></si><si><t>value</t></si></sst>',
            "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{s}"><sheetData><row><c t="s"><v>0</v></c><c t="s"><v>1</v></c></row><row><c><v>5</v></c><c><v>7.5</v></c></row></sheetData></worksheet>',
            "xl/worksheets/sheet2.xml": f'<worksheet xmlns="{s}"><sheetData><row><c><v>9</v></c></row></sheetData></worksheet>',
        },
    )
    a = "http://schemas.openxmlformats.org/drawingml/2006/main"
    _zip(d / "p.pptx", {f"ppt/slides/slide{k}.xml": f'<p xmlns:a="{a}"><a:p><a:r><a:t>slide {k}</a:t></a:r></a:p></p>' for k in (10, 2)})
    _zip(d / "o.odt", {"content.xml": '<office xmlns:t="urn:t"><t:h>Head</t:h><t:p>A <t:span>styled</t:span> line</t:p></office>'})
    (d / "broken.docx").write_bytes(b"not a zip")
    (d / "i.png").write_bytes(b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBBBBB", 13, b"IHDR", 31, 17, 8, 2, 0, 0, 0) + b"\0" * 4)
    (d / "i.gif").write_bytes(b"GIF89a" + struct.pack("<HH", 5, 6) + b"\0" * 3)
    packed = zlib.compress(b"BT (Hello \\(there\\)) Tj T* [(Wor) -20 (ld)] TJ ET")
    pdf = io.BytesIO()
    pdf.write(b"%PDF-1.4\n1 0 obj\n<</Length " + str(len(packed)).encode() + b" /Filter /FlateDecode>>\nstream\n" + packed + b"\nendstream\nendobj\n")
    (d / "f.pdf").write_bytes(pdf.getvalue())
    return f"file://{d}"


def test_packed_formats(spark, folder):
    got = {(r["path"].rpartition("/")[2], r["part"]): r for r in documents.read_packed(spark, folder).collect()}
    assert got["w.docx", 0]["text"] == "First\nSecond"
    assert got["x.xlsx", 0]["text"] == "name\tvalue\n5\t7.5" and got["x.xlsx", 1]["text"] == "9"
    assert [got["p.pptx", k]["text"] for k in (0, 1)] == ["slide 2", "slide 10"]
    assert got["o.odt", 0]["text"] == "Head\nA styled line"
    assert got["f.pdf", 0]["text"] == "Hello (there)\nWorld"
    assert got["broken.docx", 0]["error"].startswith("BadZipFile")
    assert (got["i.png", 0]["format"], got["i.png", 0]["width"], got["i.png", 0]["height"]) == ("png", 31, 17)
    assert (got["i.gif", 0]["format"], got["i.gif", 0]["width"]) == ("gif", 5)


def test_text_formats(spark, folder):
    assert documents.read_text(spark, folder).first()["text"] == "plain\ntext"
    assert documents.read_code(spark, folder).select("language", "n_lines").first()[:] == ("py", 3)
    md = documents.read_markdown(spark, folder).first()
    assert md["title"] == "Title" and md["headings"] == ["Title", "Second"] and "Some bold link" in md["text"]
    rows = documents.read_csv(spark, folder, "id long, name string", pathGlobFilter="*.csv").orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, "two\nlines"), (2, 'say "hi"')]


def test_everything_together(spark, folder):
    found = {(r["family"]) for r in documents.read_documents(spark, folder).collect()}
    assert found == {"pdf", "office", "libreoffice", "image", "text", "code", "csv", "markdown"}
    listed = documents.list_files(spark, folder)
    assert listed.where("family is null").count() == 0 and listed.count() == 12


def test_webp_headers():
    lossy = b"RIFF\0\0\0\0WEBPVP8 \0\0\0\0\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 640, 480 | 1 << 14)
    lossless = b"RIFF\0\0\0\0WEBPVP8L\0\0\0\0\x2f" + (99 | 49 << 14).to_bytes(4, "little") + b"\0" * 5
    assert documents.image_size(lossy) == ("webp", 640, 480) and documents.image_size(lossless) == ("webp", 100, 50)


def test_members_over_the_bound_are_errors(monkeypatch):
    monkeypatch.setattr(cells, "MAX_MEMBER", 1000)
    monkeypatch.setattr(pdf, "MAX_STREAM", 1000)
    packed = zlib.compress(b"BT (" + b"x" * 5000 + b") Tj ET")
    data = b"%PDF-1.4\n1 0 obj\n<</Filter /FlateDecode>>\nstream\n" + packed + b"\nendstream\nendobj\n"
    assert "bytes" in documents.file_rows("pdf", "pdf", data)[0][-1]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("content.xml", "<a>" + "x" * 5000 + "</a>")
    with pytest.raises(cells.TooLargeError):
        list(documents.libreoffice_parts(out.getvalue()))
