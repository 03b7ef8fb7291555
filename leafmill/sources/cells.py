"""Sheets as typed cells: xlsx, ods and csv, one row for each cell that holds something.

A cell keeps its place by its own reference, its type by its number format, and its span where it is merged.  Sheets
are read as streams, so what a task holds is a file's unpacked member at most, not its cells.
"""

from __future__ import annotations

import csv
import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from typing import NamedTuple
from xml.etree import ElementTree

#: Cells of a file at most: repetitions in a few bytes can stand for any number.
MAX_CELLS = 1 << 25
#: Unpacked bytes of one archive member at most; a larger one is an error.
MAX_MEMBER = 256 << 20
#: Number formats that are dates or times without saying so in a code of their own.
DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])


class Cell(NamedTuple):
    """value: text, the shortest digits of a number, true or false, an ISO date, date with time or time, or an error's code."""

    sheet_no: int
    sheet: str
    row: int
    column: int
    type: str
    value: str
    rows: int = 1
    columns: int = 1


class TooLargeError(ValueError):
    pass


class Bounded(io.RawIOBase):
    """A member's bytes, an error beyond the bound."""

    def __init__(self, archive: zipfile.ZipFile, name: str, most: int | None = None):
        self.file, self.name, self.left = archive.open(name), name, MAX_MEMBER if most is None else most

    def read(self, size: int = -1) -> bytes:
        data = self.file.read(size if size >= 0 else self.left + 1)
        self.left -= len(data)
        if self.left < 0:
            raise TooLargeError(f"{self.name} has more bytes than are read")
        return data


def number_text(value: float) -> str:
    """The shortest digits, of whole numbers without a point."""
    return str(int(value)) if value == int(value) and abs(value) < 1e15 else repr(value)


def moment_text(serial: float, from_1904: bool = False) -> str:
    """An ISO date of a day's number; with a time where it has a fraction, only that before the first day."""
    if serial < 1 and not from_1904:
        return (dt.datetime(2000, 1, 1) + dt.timedelta(milliseconds=round(serial * 86_400_000))).time().isoformat()
    # 1900 counts as a leap year, so days before its March are one off
    start = dt.datetime(1904, 1, 1) if from_1904 else dt.datetime(1899, 12, 31 if serial < 60 else 30)
    at = start + dt.timedelta(milliseconds=round(serial * 86_400_000))
    return at.date().isoformat() if at.time() == dt.time() else at.isoformat()


def is_date_format(number: int, codes: dict[int, str]) -> bool:
    """Whether a number format shows a day or a time: its code, without what is quoted, has their letters."""
    if number in codes:
        return bool(re.search("[dmyhs]", re.sub(r'"[^"]*"|\\.|\[(?!h+\]|m+\]|s+\])[^\]]*\]|[_*].|General|AM/PM|A/P', "", codes[number], flags=re.I), re.I))
    return number in DATE_FORMATS


def tag(node: ElementTree.Element) -> str:
    return node.tag.rpartition("}")[2]


def attribute(node: ElementTree.Element, name: str, default: str | None = None) -> str | None:
    """An attribute by its local name."""
    return next((v for k, v in node.items() if k.rpartition("}")[2] == name), default)


def place_of(reference: str) -> tuple[int, int]:
    """(row, column) from 0 of a reference like ``C2``."""
    m = re.fullmatch(r"\$?([A-Za-z]{1,4})\$?([0-9]{1,9})", reference)
    if m is None:
        raise ValueError(f"{reference} is no cell")
    column = 0
    for letter in m[1].upper():
        column = column * 26 + ord(letter) - 64
    return int(m[2]) - 1, column - 1


def _streamed(archive: zipfile.ZipFile, name: str, wanted: set[str]) -> Iterator[ElementTree.Element]:
    """Whole elements of these names, each forgotten after its use."""
    path: list[ElementTree.Element] = []
    for event, node in ElementTree.iterparse(Bounded(archive, name), events=("start", "end")):
        if event == "start":
            path.append(node)
            continue
        path.pop()
        if tag(node) in wanted:
            yield node
            if path:
                path[-1].remove(node)


def _run_text(node: ElementTree.Element) -> str:
    """Text of a string item: its runs without what is written beside them as their reading."""
    out = []
    for child in node:
        if tag(child) == "t":
            out.append(child.text or "")
        elif tag(child) == "r":
            out += [t.text or "" for t in child if tag(t) == "t"]
    return "".join(out)


def _member(archive: zipfile.ZipFile, name: str) -> ElementTree.Element:
    return ElementTree.fromstring(Bounded(archive, name).read())


def _targets(archive: zipfile.ZipFile, book: str) -> dict[str, str]:
    """Paths of what a part's relationships lead to, by their ids."""
    folder, _, name = book.rpartition("/")
    rels = f"{folder}/_rels/{name}.rels"
    if rels not in archive.namelist():
        return {}
    out = {}
    for node in _member(archive, rels):
        target = attribute(node, "Target", "")
        path: list[str] = []
        for step in (target if target.startswith("/") else f"{folder}/{target}").split("/"):
            if step == "..":
                path = path[:-1]
            elif step not in ("", "."):
                path.append(step)
        out[attribute(node, "Id")] = "/".join(path)
    return out


def xlsx_cells(archive: zipfile.ZipFile) -> Iterator[Cell]:
    names = set(archive.namelist())
    book, targets = _member(archive, "xl/workbook.xml"), _targets(archive, "xl/workbook.xml")
    sheets = [(attribute(s, "name", ""), targets.get(attribute(s, "id"), "")) for s in book.iter() if tag(s) == "sheet"]
    if not sheets:  # a book that names none: the sheets there are, by their numbers
        found = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.sub(r"\D", "", n)))
        sheets = [(n.rpartition("/")[2].removesuffix(".xml"), n) for n in found]
    from_1904 = any(tag(p) == "workbookPr" and attribute(p, "date1904") in ("1", "true") for p in book.iter())
    shared = [_run_text(s) for s in _streamed(archive, "xl/sharedStrings.xml", {"si"})] if "xl/sharedStrings.xml" in names else []
    dates = []
    if "xl/styles.xml" in names:
        styles = _member(archive, "xl/styles.xml")
        codes = {int(attribute(f, "numFmtId")): attribute(f, "formatCode", "") for f in styles.iter() if tag(f) == "numFmt"}
        formats = next((list(x) for x in styles if tag(x) == "cellXfs"), [])
        dates = [is_date_format(int(attribute(x, "numFmtId", "0")), codes) for x in formats]
    for no, (sheet, path) in enumerate(sheets):
        if path not in names or "worksheets" not in path:
            continue  # a sheet of charts
        spans, row, column = {}, -1, -1
        for node in _streamed(archive, path, {"mergeCell"}):
            (r1, c1), (r2, c2) = (place_of(x) for x in (attribute(node, "ref", "") + ":" + attribute(node, "ref", "")).split(":")[:2])
            spans[r1, c1] = (r2 - r1 + 1, c2 - c1 + 1)
        for node in _streamed(archive, path, {"row"}):
            row, column = int(attribute(node, "r", row + 2)) - 1, -1
            for c in node:
                column = column + 1
                if ref := attribute(c, "r"):
                    row, column = place_of(ref)
                kind, style = attribute(c, "t", "n"), int(attribute(c, "s", "0"))
                value = next((v.text or "" for v in c if tag(v) == "v"), None)
                if kind == "inlineStr":
                    found = ("text", "".join(_run_text(v) for v in c if tag(v) == "is"))
                elif value is None or (value == "" and kind != "str"):
                    continue
                elif kind == "s":
                    found = ("text", shared[int(value)])
                elif kind == "b":
                    found = ("boolean", "true" if value == "1" else "false")
                elif kind in ("str", "e", "d"):
                    found = ({"str": "text", "e": "error", "d": "date"}[kind], value)
                elif style < len(dates) and dates[style]:
                    found = ("date", moment_text(float(value), from_1904))
                else:
                    found = ("number", number_text(float(value)))
                yield Cell(no, sheet, row, column, *found, *spans.get((row, column), (1, 1)))


def odf_text(node: ElementTree.Element) -> str:
    """Text of a paragraph, with the spaces, tabs and line ends that are elements of their own."""
    out = [node.text or ""]
    for child in node:
        name = tag(child)
        if name == "s":
            out.append(" " * int(attribute(child, "c", "1")))
        elif name in ("tab", "line-break"):
            out.append("\t" if name == "tab" else "\n")
        elif name not in ("annotation", "note"):
            out.append(odf_text(child))
        out.append(child.tail or "")
    return "".join(out)


def _odf_time(value: str) -> str:
    m = re.fullmatch(r"PT(\d+)H(\d+)M(\d+)(?:[.,]\d+)?S", value)
    return f"{m[1]:0>2}:{m[2]:0>2}:{m[3]:0>2}" if m else value


def _odf_value(cell: ElementTree.Element) -> tuple[str, str] | None:
    kind = attribute(cell, "value-type")
    text = "\n".join(odf_text(p) for p in cell if tag(p) in ("p", "h"))
    if kind in ("float", "percentage", "currency"):
        return "number", number_text(float(attribute(cell, "value", "0")))
    if kind == "boolean":
        return "boolean", attribute(cell, "boolean-value", "false")
    if kind == "date":
        return "date", attribute(cell, "date-value", "").removesuffix("T00:00:00")
    if kind == "time":
        return "date", _odf_time(attribute(cell, "time-value", ""))
    return ("text", text) if text else None


def ods_cells(archive: zipfile.ZipFile) -> Iterator[Cell]:
    no, sheet, row, made, inside = -1, "", 0, 0, 0
    path: list[ElementTree.Element] = []
    for event, node in ElementTree.iterparse(Bounded(archive, "content.xml"), events=("start", "end")):
        name = tag(node)
        if event == "start":
            path.append(node)
            if name == "table":
                inside += 1
                if inside == 1:
                    no, sheet, row = no + 1, attribute(node, "name", ""), 0
            continue
        path.pop()
        if name == "table":
            inside -= 1
        if name != "table-row" or inside != 1:
            continue
        rows, cells, column = int(attribute(node, "number-rows-repeated", "1")), [], 0
        for c in node:
            if tag(c) not in ("table-cell", "covered-table-cell"):
                continue
            columns = int(attribute(c, "number-columns-repeated", "1"))
            if (found := _odf_value(c)) is not None:
                span = (int(attribute(c, "number-rows-spanned", "1")), int(attribute(c, "number-columns-spanned", "1")))
                cells.append((column, columns, found, span))
            column += columns
        made += rows * sum(c[1] for c in cells)
        if made > MAX_CELLS:
            raise TooLargeError(f"more than {MAX_CELLS} cells")
        for r in range(row, row + rows) if cells else ():
            for at, columns, found, span in cells:
                for c in range(at, at + columns):
                    yield Cell(no, sheet, r, c, *found, *span)
        row += rows
        if path:
            path[-1].remove(node)


def delimiter_of(text: str) -> str:
    """The mark that parts the first lines into equally many fields, most of them; a comma if none does."""
    lines = [line for line in re.sub(r'"[^"]*"', "", text[:65_536]).splitlines() if line][:50]
    counts = {mark: [line.count(mark) for line in lines] for mark in (",", ";", "\t", "|")}
    even = {mark: n[0] for mark, n in counts.items() if n and n[0] and sum(x == n[0] for x in n) * 10 >= 9 * len(n)}
    return max(even, key=even.get) if even else ","


def csv_value(text: str) -> tuple[str, str]:
    if re.fullmatch(r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d{1,3})?", text) and not re.match(r"[+-]?0\d", text):
        return "number", number_text(float(text))
    if re.fullmatch(r"\d{4}-\d\d-\d\d([T ]\d\d:\d\d(:\d\d)?)?", text):
        return "date", text.replace(" ", "T")
    return ("boolean", text.lower()) if text.lower() in ("true", "false") else ("text", text)


def decoded(data: bytes) -> str:
    """Text by its byte order mark, else as UTF-8, else as Windows' western code page."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16")
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return data.decode("cp1252", "replace")


def csv_cells(data: bytes) -> Iterator[Cell]:
    text = decoded(data)
    csv.field_size_limit(MAX_MEMBER)
    for row, fields in enumerate(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter_of(text))):
        for column, field in enumerate(fields):
            if field:
                yield Cell(0, "", row, column, *csv_value(field))


def grid_texts(cells: Iterator[Cell]) -> Iterator[tuple[str, str]]:
    """(sheet, text) of each sheet with cells: a line for each row, a tab for each column passed."""
    lines: list[str] = []
    sheet, row, column, line = None, -1, 0, []
    for c in cells:
        if sheet is not None and (c.sheet_no, c.sheet) != sheet:
            yield sheet[1], "\n".join([*lines, "".join(line)])
            lines, line, row, column = [], [], -1, 0
        elif sheet is not None and c.row != row:
            lines.append("".join(line))
            line, column = [], 0
        line.append("\t" * (c.column - column) + c.value)
        sheet, row, column = (c.sheet_no, c.sheet), c.row, c.column
    if sheet is not None:
        yield sheet[1], "\n".join([*lines, "".join(line)])
