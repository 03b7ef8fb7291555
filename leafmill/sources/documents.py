"""Documents of many formats as tables: PDF, Office, LibreOffice, text, code, Markdown, CSV and images.

Folders of mixed files are listed and read by Spark.  Text formats go through its text reader and column
functions; packed formats are opened inside tasks, a file at a time, and give one row per page, sheet or slide.
"""

from __future__ import annotations

import io
import re
import struct
import tarfile
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.scalar import markdown_text
from leafmill.sources import cells, compound, pdf

#: Suffixes of each family.
FAMILIES = {
    "pdf": ("pdf",),
    "office": ("docx", "xlsx", "pptx", "doc", "xls"),
    "libreoffice": ("odt", "ods", "odp"),
    "text": ("txt", "text", "log"),
    "markdown": ("md", "markdown"),
    "csv": ("csv", "tsv"),
    "image": ("png", "jpg", "jpeg", "gif", "bmp", "webp"),
    "code": ("py", "java", "kt", "js", "ts", "c", "h", "cpp", "rs", "go", "rb", "sh", "sql", "html", "css", "xml", "json", "yaml", "yml", "toml"),
}
#: Names of the languages of code, by suffix.
LANGUAGES = {
    "py": "Python", "java": "Java", "kt": "Kotlin", "js": "JavaScript", "ts": "TypeScript", "c": "C", "h": "C", "cpp": "C++", "rs": "Rust", "go": "Go",
    "rb": "Ruby", "sh": "Shell", "sql": "SQL", "html": "HTML", "css": "CSS", "xml": "XML", "json": "JSON", "yaml": "YAML", "yml": "YAML", "toml": "TOML",
}
#: Families whose files are opened inside tasks.
PACKED = ("pdf", "office", "libreoffice", "image")
#: Suffixes of sheets.
SHEETS = ("xlsx", "xls", "ods", "csv", "tsv")
#: Rows of one batch of cells.
CELL_ROWS = 20_000
#: Rows and characters of one batch of parts, about.
PART_ROWS, PART_CHARS = 256, 4 << 20
#: Suffix of an archive that ``archives.read_archives`` couldn't read to its end, and what its row says.
ARCHIVE, DAMAGED = "tar", "a damaged archive"


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def family(path: Column) -> Column:
    out = None
    for name, suffixes in FAMILIES.items():
        out = F.when(suffix(path).isin(*suffixes), name) if out is None else out.when(suffix(path).isin(*suffixes), name)
    return out


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, family, suffix, length, modified) of all files below a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", family(F.col("path")).alias("family"), suffix(F.col("path")).alias("suffix"), "length", F.col("modificationTime").alias("modified"))


def _glob(name: str) -> str:
    return "*.{" + ",".join(s for x in FAMILIES[name] for s in (x, x.upper())) + "}"


def _whole(spark: SparkSession, path: str, name: str) -> DataFrame:
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", _glob(name)).text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of plain text files."""
    return _whole(spark, path, "text")


def code_rows(files: DataFrame) -> DataFrame:
    """(path, language, text, n_lines, language_name) of rows (path, text); the language is the file's suffix."""
    names = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    rows = files.select("path", suffix(F.col("path")).alias("language"), "text", F.size(F.split("text", "\n")).alias("n_lines"))
    return rows.withColumn("language_name", names[F.col("language")])


def read_code(spark: SparkSession, path: str) -> DataFrame:
    return code_rows(_whole(spark, path, "code"))


def markdown_rows(files: DataFrame) -> DataFrame:
    """(path, title, headings, text) of rows (path, text): the first heading, all of them, and the text without marks."""
    headings = F.regexp_extract_all("text", F.lit(r"(?m)^\s{0,3}#{1,6}\s+(.*?)\s*#*\s*$"), F.lit(1))
    rows = files.withColumn("headings", headings)
    return rows.select("path", F.get("headings", F.lit(0)).alias("title"), "headings", markdown_text(F.col("text")).alias("text"))


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    return markdown_rows(_whole(spark, path, "markdown"))


def read_csv(spark: SparkSession, path: str, schema: str | None = None, **options: str) -> DataFrame:
    """A table from CSV files with a header; give a schema at scale, inference is a pass of its own."""
    reader = spark.read.options(**({"header": "true", "multiLine": "true", "escape": '"', "recursiveFileLookup": "true"} | options))
    return (reader.schema(schema) if schema else reader.option("inferSchema", "true")).csv(path)


def image_size(data: bytes) -> tuple[str, int, int] | None:
    """(format, width, height) from an image's header."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return "png", *struct.unpack(">II", data[16:24])
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return "gif", *struct.unpack("<HH", data[6:10])
    if data[:2] == b"BM" and len(data) >= 26:
        width, height = struct.unpack("<ii", data[18:26])
        return "bmp", width, abs(height)
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP" and len(data) >= 30:
        if data[12:16] == b"VP8X":
            return "webp", 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
        if data[12:16] == b"VP8 " and data[23:26] == b"\x9d\x01\x2a":
            return "webp", *(n & 0x3FFF for n in struct.unpack("<HH", data[26:30]))
        if data[12:16] == b"VP8L" and data[20] == 0x2F:
            bits = int.from_bytes(data[21:25], "little")
            return "webp", 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(data) and data[at] == 0xFF:
            marker, length = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack(">HH", data[at + 5 : at + 9])
                return "jpeg", width, height
            at += 2 + length
    return None


def _member(archive: zipfile.ZipFile, name: str) -> ElementTree.Element:
    return ElementTree.fromstring(cells.Bounded(archive, name).read())


#: Elements that stand for characters, in Office's and in LibreOffice's files, and those whose contents aren't text.
SEPARATORS = {"tab": "\t", "br": "\n", "cr": "\n", "line-break": "\n", "noBreakHyphen": "-"}
PROPERTIES = frozenset({"pPr", "rPr", "tabs", "tracked-changes"})


def _xml_text(root: ElementTree.Element, blocks: frozenset[str], texts: frozenset[str] | None) -> str:
    """Text of XML, a line for each block element, with tabs and breaks; only inside ``texts`` elements if they are given."""
    lines, line = [], []

    def walk(node: ElementTree.Element) -> None:
        name = cells.tag(node)
        if name in PROPERTIES:
            return
        if name in SEPARATORS:
            line.append(SEPARATORS[name])
        elif name == "s" and texts is None:
            line.append(" " * int(cells.attribute(node, "c", "1")))
        if node.text and (texts is None or name in texts):
            line.append(node.text)
        for child in node:
            walk(child)
            if child.tail and texts is None:
                line.append(child.tail)
        if name in blocks:
            lines.extend(x.strip() for x in "".join(line).split("\n"))
            line.clear()

    walk(root)
    lines.append("".join(line).strip())
    return "\n".join(x for x in lines if x)


def _numbered(names: list[str], pattern: str) -> list[str]:
    return sorted((n for n in names if re.fullmatch(pattern, n)), key=lambda n: (re.sub(r"\d", "", n), int(re.sub(r"\D", "", n.rpartition("/")[2]) or 0)))


def office_parts(data: bytes) -> Iterator[tuple[str, str]]:
    """(name, text) of an Office file: a document with its headers, footers, notes and comments, slides with their notes, or sheets."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        names = archive.namelist()
        text = lambda n: _xml_text(_member(archive, n), frozenset({"p"}), frozenset({"t"}))
        if "word/document.xml" in names:
            yield "document", text("word/document.xml")
            for n in _numbered(names, r"word/(header|footer|footnotes|endnotes|comments)\d*\.xml"):
                if found := text(n):
                    yield re.sub(r"word/|\d*\.xml", "", n), found
        for n in _numbered(names, r"ppt/slides/slide\d+\.xml"):
            yield "slide", text(n)
        for n in _numbered(names, r"ppt/notesSlides/notesSlide\d+\.xml"):
            yield "notes", text(n)
        if "xl/workbook.xml" in names:
            yield from cells.grid_texts(cells.xlsx_cells(archive))


def libreoffice_parts(data: bytes) -> Iterator[tuple[str, str]]:
    """(name, text) of a LibreOffice file: its sheets, its slides, or its text with headers and footers."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        root = _member(archive, "content.xml")
        blocks, kinds = frozenset({"p", "h"}), {cells.tag(n) for n in root.iter()}
        if "spreadsheet" in kinds:
            yield from cells.grid_texts(cells.ods_cells(archive))
        elif "presentation" in kinds:
            for page in (n for n in root.iter() if cells.tag(n) == "page"):
                yield cells.attribute(page, "name", ""), _xml_text(page, blocks, None)
        else:
            yield "document", _xml_text(root, blocks, None)
        if "styles.xml" in archive.namelist():
            for n in _member(archive, "styles.xml").iter():
                if cells.tag(n) in ("header", "footer") and (found := _xml_text(n, blocks, None)):
                    yield cells.tag(n), found


def parts_of(kind: str, ending: str, data: bytes) -> Iterator[tuple]:
    """(text, name, format, width, height, error) of each part of a file of this family and suffix."""
    if kind == "image":
        size = image_size(data)
        yield (None, None, *size, None) if size else (None, None, None, None, None, "not an image of a known format")
    elif kind == "pdf":
        for text, error in pdf.page_texts(data):
            yield text, "page", None, None, None, error
    else:
        found = compound.word_texts(data) if ending == "doc" else cells.grid_texts(compound.xls_cells(data)) if ending == "xls" else office_parts(data) if kind == "office" else libreoffice_parts(data)
        for name, text in found:
            yield text, name, None, None, None, None


def file_rows(kind: str, ending: str, data: bytes) -> list[tuple]:
    """The same of any bytes: a file that can't be read, or that has no part, gives one row with an error."""
    found = []
    try:
        for row in parts_of(kind, ending, data):
            found.append(row)
        return found or [(None, None, None, None, None, "no part of the file is read")]
    except Exception as e:  # noqa: BLE001  whatever a damaged file leads to is its own row, not the end of the job
        return [*found, (None, None, None, None, None, f"{type(e).__name__}: {e}"[:200])]


PARTS = pa.schema([("path", pa.string()), ("family", pa.string()), ("part", pa.int32()), ("name", pa.string()), ("text", pa.string()), ("format", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("error", pa.string())])
PARTS_SQL = "path string, family string, part int, name string, text string, format string, width int, height int, error string"
CELLS = pa.schema([
    ("path", pa.string()), ("family", pa.string()), ("sheet_no", pa.int32()), ("sheet", pa.string()), ("row", pa.int32()), ("column", pa.int32()), ("type", pa.string()), ("value", pa.string()),
    ("rows_spanned", pa.int32()), ("columns_spanned", pa.int32()), ("error", pa.string()),
])
CELLS_SQL = "path string, family string, sheet_no int, sheet string, row int, column int, type string, value string, rows_spanned int, columns_spanned int, error string"


def _binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def _valid(text: str | None) -> str | None:
    """Text that UTF-8 can hold: lone halves of surrogate pairs become marks."""
    return text if text is None else text.encode("utf-8", "replace").decode()


def _record(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(map(_valid, c) if pa.types.is_string(f.type) else c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, str, bytes]]:
    """(path, family, suffix, content), a file at a time."""
    for b in batches:
        for i in range(b.num_rows):
            yield tuple(b.column(c)[i].as_py() for c in ("path", "family", "suffix", "content"))


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """PDF, Office, LibreOffice and image files: a row for each page, sheet, slide or other part.

    A part that can't be read has an ``error``; of a file that can't, the parts before the damage are followed by such a row.
    Spark's reader passes over files of no bytes; the data source of ``datasource`` gives them a row too.
    """
    return packed_parts(_binary(spark, path))


def packed_parts(files: DataFrame) -> DataFrame:
    """The same of rows (path, content)."""
    files = files.select("path", family(F.col("path")).alias("family"), suffix(F.col("path")).alias("suffix"), "content").where(F.col("family").isin(*PACKED) | (F.col("suffix") == ARCHIVE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for file, kind, ending, data in _opened(batches):
            found = file_rows(kind, ending, data or b"") if ending != ARCHIVE else [(*[None] * 5, DAMAGED)]
            rows += [(file, kind, k, name, text, *rest) for k, (text, name, *rest) in enumerate(found)]
            held += sum(len(text or "") for text, *_ in found)
            # many small files are one batch, a large one is its own
            if len(rows) >= PART_ROWS or held >= PART_CHARS:
                yield _record(rows, PARTS)
                rows, held = [], 0
        yield _record(rows, PARTS)

    return files.mapInArrow(run, PARTS_SQL)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """Sheets (xlsx, xls, ods, csv): a row for each cell that holds something, with its place, type, value and span; see ``cells.Cell``.

    Rows and columns count from 0.  A file that can't be read to its end has a row with ``error`` behind its cells; one
    without cells has no row.
    """
    return sheet_cells(_binary(spark, path))


def _cells_of(ending: str, data: bytes) -> Iterator[cells.Cell]:
    if ending in ("csv", "tsv"):
        yield from cells.csv_cells(data)
    elif ending == "xls":
        yield from compound.xls_cells(data)
    else:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            yield from cells.xlsx_cells(archive) if ending == "xlsx" else cells.ods_cells(archive)


def sheet_cells(files: DataFrame) -> DataFrame:
    """The same of rows (path, content)."""
    files = files.select("path", family(F.col("path")).alias("family"), suffix(F.col("path")).alias("suffix"), "content").where(F.col("suffix").isin(*SHEETS, ARCHIVE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, kind, ending, data in _opened(batches):
            rows: list[tuple] = []
            try:
                if ending == ARCHIVE:
                    raise tarfile.ReadError(DAMAGED)
                for cell in _cells_of(ending, data or b""):
                    rows.append((file, kind, *cell, None))
                    if len(rows) == CELL_ROWS:
                        yield _record(rows, CELLS)
                        rows = []
            except Exception as e:  # noqa: BLE001  see file_rows
                rows.append((file, kind, *[None] * 8, f"{type(e).__name__}: {e}"[:200]))
            yield _record(rows, CELLS)

    return files.mapInArrow(run, CELLS_SQL)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Every file of a known family below a folder: (path, family, part, text, error); a CSV file's text is its lines."""
    whole = lambda rows, name: rows.select("path", F.lit(name).alias("family"), F.lit(0).alias("part"), "text", F.lit(None).cast("string").alias("error"))
    out = read_packed(spark, path).select("path", "family", "part", "text", "error")
    for name in ("text", "code", "csv"):
        out = out.unionByName(whole(_whole(spark, path, name), name))
    return out.unionByName(whole(read_markdown(spark, path), "markdown"))
