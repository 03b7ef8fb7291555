"""Legacy Office files: compound files' sectors, Word's piece table and Excel's records."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

from leafmill.sources.cells import Cell, is_date_format, moment_text, number_text

#: Fixed values of the formats.
SIGNATURE = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
LAST_SECTOR = 0xFFFFFFFA  # greater numbers are marks
ERRORS = {0x00: "#NULL!", 0x07: "#DIV/0!", 0x0F: "#VALUE!", 0x17: "#REF!", 0x1D: "#NAME?", 0x24: "#NUM!", 0x2A: "#N/A"}
SUBDOCUMENTS = ("document", "footnotes", "headers", "macros", "comments", "endnotes", "text boxes", "header text boxes")


class CompoundFile:
    """Streams of a compound file, by name."""

    def __init__(self, data: bytes):
        if data[:8] != SIGNATURE:
            raise ValueError("not a compound file")
        self.data = data
        shift, mini_shift = struct.unpack_from("<HH", data, 30)
        if not 7 <= shift <= 16 or not 2 <= mini_shift <= shift:
            raise ValueError("sectors of an impossible size")
        self.size, self.mini_size = 1 << shift, 1 << mini_shift
        directory, _, self.cutoff, mini_fat, _, more, _ = struct.unpack_from("<7I", data, 48)
        sectors = [s for s in struct.unpack_from("<109I", data, 76) if s <= LAST_SECTOR]
        seen = set()
        while more <= LAST_SECTOR and more not in seen:
            seen.add(more)
            *entries, more = struct.unpack(f"<{self.size // 4}I", self.sector(more))
            sectors += [s for s in entries if s <= LAST_SECTOR]
        self.fat = [n for s in sectors for n in struct.unpack(f"<{self.size // 4}I", self.sector(s))]
        self.mini_fat = self._numbers(self.chain(mini_fat))
        self.entries: dict[str, tuple[int, int]] = {}
        listed = self.chain(directory)
        self.mini = b""
        for at in range(0, len(listed) - 127, 128):
            length, kind = struct.unpack_from("<HB", listed, at + 64)
            start, size = struct.unpack_from("<IQ", listed, at + 116)
            if kind == 5:
                self.mini = self.chain(start)
            elif kind == 2:
                self.entries.setdefault(listed[at : at + max(0, min(length, 64) - 2)].decode("utf-16-le", "replace"), (start, size & 0xFFFFFFFF))

    @staticmethod
    def _numbers(data: bytes) -> list[int]:
        return list(struct.unpack(f"<{len(data) // 4}I", data[: len(data) // 4 * 4]))

    def sector(self, number: int) -> bytes:
        out = self.data[(number + 1) * self.size : (number + 2) * self.size]
        if not out:
            raise ValueError("a sector lies behind the file's end")
        return out.ljust(self.size, b"\0")

    @staticmethod
    def _links(start: int, table: list[int]) -> Iterator[int]:
        for _ in range(len(table) + 1):
            if start > LAST_SECTOR:
                return
            if start >= len(table):
                raise ValueError("a chain of sectors leads out of its table")
            yield start
            start = table[start]
        raise ValueError("a chain of sectors has no end")

    def chain(self, start: int) -> bytes:
        return b"".join(map(self.sector, self._links(start, self.fat)))

    def stream(self, name: str) -> bytes:
        if name not in self.entries:
            raise ValueError(f"no stream {name}")
        start, size = self.entries[name]
        if size >= self.cutoff:
            return self.chain(start)[:size]
        n = self.mini_size
        return b"".join(self.mini[s * n : (s + 1) * n] for s in self._links(start, self.mini_fat))[:size]


def _plain(text: str) -> str:
    """Word's text without codes of fields and marks of objects; cells end with a tab, paragraphs and breaks with a line."""
    out, depth, skipped = [], 0, []
    for c in re.split("([\x13\x14\x15])", text):
        if c == "\x13":
            depth += 1
            skipped.append(depth)
        elif c == "\x14":
            if skipped and skipped[-1] == depth:
                skipped.pop()
        elif c == "\x15":
            if skipped and skipped[-1] == depth:
                skipped.pop()
            depth = max(0, depth - 1)
        elif not skipped:
            out.append(c)
    marks = str.maketrans({"\r": "\n", "\x0b": "\n", "\x0c": "\n", "\x07": "\t", "\x1e": "-", "\xa0": " ", **dict.fromkeys("\x01\x02\x03\x04\x05\x08\x1f", "")})
    lines = (line.strip() for line in "".join(out).translate(marks).split("\n"))
    return "\n".join(line for line in lines if line)


def word_texts(data: bytes) -> Iterator[tuple[str, str]]:
    """(subdocument, text) of a .doc: its text, and its notes, headers and so on where it has any."""
    files = CompoundFile(data)
    main = files.stream("WordDocument")
    flags = struct.unpack_from("<H", main, 0x0A)[0]
    if struct.unpack_from("<H", main, 0)[0] != 0xA5EC:
        raise ValueError("not a document of Word 97 or later")
    if flags & 0x0100:
        raise ValueError("the file is encrypted")
    table = files.stream("1Table" if flags & 0x0200 else "0Table")
    at, size = struct.unpack_from("<II", main, 0x1A2)
    pieces, end = b"", at + size
    while at < end:
        if table[at] == 1:
            at += 3 + struct.unpack_from("<H", table, at + 1)[0]
        elif table[at] == 2:
            n = struct.unpack_from("<I", table, at + 1)[0]
            pieces = table[at + 5 : at + 5 + n]
            break
        else:
            raise ValueError("a damaged piece table")
    n = (len(pieces) - 4) // 12
    if n < 0:
        raise ValueError("no piece table")
    places, out = struct.unpack_from(f"<{n + 1}I", pieces), []
    for i in range(n):
        start = struct.unpack_from("<I", pieces, 4 * (n + 1) + 8 * i + 2)[0]
        count = places[i + 1] - places[i]
        if start & 0x40000000:
            start = (start & 0x3FFFFFFF) // 2
            out.append(main[start : start + count].decode("cp1252", "replace").encode("utf-16-le"))
        else:
            out.append(main[start : start + 2 * count])
    # places count UTF-16 units, so what is cut by them is cut as such
    units, at = b"".join(out), 0
    for k, (name, count) in enumerate(zip(SUBDOCUMENTS, struct.unpack_from("<8I", main, 0x4C), strict=True)):
        text = _plain(units[2 * at : 2 * (at + count)].decode("utf-16-le", "replace"))
        at += count
        if text or not k:
            yield name, text


class _Records:
    """Strings that run on through continued records: each new record begins with a width of its own."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.part, self.at = parts, 0, 0

    def take(self, n: int) -> bytes:
        out = b""
        while len(out) < n:
            if self.at >= len(self.parts[self.part]):
                self.part, self.at = self.part + 1, 0
                if self.part >= len(self.parts):
                    raise ValueError("strings end early")
            found = self.parts[self.part][self.at : self.at + n - len(out)]
            self.at += len(found)
            out += found
        return out

    def string(self, length: int, flags: int) -> str:
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        out = []
        while length:
            if self.at >= len(self.parts[self.part]):
                self.part, self.at = self.part + 1, 0
                flags = self.take(1)[0]
            wide = 2 if flags & 1 else 1
            n = min(length, (len(self.parts[self.part]) - self.at) // wide)
            if not n:
                raise ValueError("a damaged string")
            out.append(self.take(n * wide).decode("utf-16-le" if wide == 2 else "latin-1", "surrogatepass"))
            length -= n
        self.take(4 * runs + extra)
        return "".join(out).encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def _string(data: bytes, at: int, wide_length: bool) -> str:
    length = struct.unpack_from("<H" if wide_length else "<B", data, at)[0]
    reader = _Records([data[at + (2 if wide_length else 1) :]])
    return reader.string(length, reader.take(1)[0])


def _rk(value: int) -> float:
    number = float(struct.unpack("<i", struct.pack("<I", value & 0xFFFFFFFC))[0] >> 2) if value & 2 else struct.unpack("<d", struct.pack("<Q", (value & 0xFFFFFFFC) << 32))[0]
    return number / 100 if value & 1 else number


def _records(book: bytes, at: int = 0) -> Iterator[tuple[int, bytes, int]]:
    while at + 4 <= len(book):
        kind, size = struct.unpack_from("<HH", book, at)
        yield kind, book[at + 4 : at + 4 + size], at
        at += 4 + size


def xls_cells(data: bytes) -> Iterator[Cell]:
    """Cells of a .xls; formulas by the results that are stored with them."""
    files = CompoundFile(data)
    if "Workbook" not in files.entries:
        raise ValueError("not a book of Excel 97 or later")
    book = files.stream("Workbook")
    sheets, parts, formats, codes, from_1904, begun = [], [], [], {}, False, False
    for kind, body, _ in _records(book):
        if kind == 0x3C and begun:
            parts.append(body)
            continue
        begun = kind == 0xFC
        if kind == 0xFC:
            parts = [body]
        elif kind == 0x2F:
            raise ValueError("the file is encrypted")
        elif kind == 0x85:
            at, _, sort = struct.unpack_from("<IBB", body)
            sheets.append((_string(body, 6, False), at, sort))
        elif kind == 0x41E:
            codes[struct.unpack_from("<H", body)[0]] = _string(body, 2, True)
        elif kind == 0xE0:
            formats.append(struct.unpack_from("<H", body, 2)[0])
        elif kind == 0x22:
            from_1904 = body[:2] == b"\x01\0"
        elif kind == 0x0A:
            break
    shared = []
    if parts:
        reader = _Records(parts)
        for _ in range(struct.unpack("<II", reader.take(8))[1]):
            length, flags = struct.unpack("<HB", reader.take(3))
            shared.append(reader.string(length, flags))
    dates = [is_date_format(f, codes) for f in formats]

    def number(style: int, value: float) -> tuple[str, str]:
        dated = style < len(dates) and dates[style]
        return ("date", moment_text(value, from_1904)) if dated else ("number", number_text(value))

    for no, (sheet, at, sort) in enumerate(sheets):
        if sort:
            continue  # charts and macros
        spans: dict[tuple[int, int], tuple[int, int]] = {}
        found: list[tuple[int, int, tuple[str, str]]] = []
        awaited: tuple[int, int] | None = None
        for kind, body, _ in _records(book, at):
            if kind == 0x0A:
                break
            if kind == 0xE5:
                for i in range(struct.unpack_from("<H", body)[0]):
                    r1, r2, c1, c2 = struct.unpack_from("<4H", body, 2 + 8 * i)
                    spans[r1, c1] = (r2 - r1 + 1, c2 - c1 + 1)
            elif kind == 0x207 and awaited:
                found.append((*awaited, ("text", _string(body, 0, True))))
                awaited = None
            elif kind in (0xFD, 0x203, 0x27E, 0xBD, 0x205, 0x06, 0x204) and len(body) >= 6:
                row, column, style = struct.unpack_from("<3H", body)
                if kind == 0xFD:
                    found.append((row, column, ("text", shared[struct.unpack_from("<I", body, 6)[0]])))
                elif kind == 0x204:
                    found.append((row, column, ("text", _string(body, 6, True))))
                elif kind == 0x203:
                    found.append((row, column, number(style, struct.unpack_from("<d", body, 6)[0])))
                elif kind == 0x27E:
                    found.append((row, column, number(style, _rk(struct.unpack_from("<I", body, 6)[0]))))
                elif kind == 0xBD:
                    for i in range((len(body) - 6) // 6):
                        style, value = struct.unpack_from("<HI", body, 4 + 6 * i)
                        found.append((row, column + i, number(style, _rk(value))))
                elif kind == 0x205 or body[12:14] == b"\xff\xff":
                    sort, value = (2 if body[7] else 1, body[6]) if kind == 0x205 else (body[6], body[8])
                    if sort == 0:
                        awaited = (row, column)
                    elif sort in (1, 2):
                        found.append((row, column, ("boolean", "true" if value else "false") if sort == 1 else ("error", ERRORS.get(value, "#N/A"))))
                else:
                    found.append((row, column, number(style, struct.unpack_from("<d", body, 6)[0])))
        for row, column, value in sorted(found, key=lambda c: c[:2]):
            if value[1] or value[0] != "text":
                yield Cell(no, sheet, row, column, *value, *spans.get((row, column), (1, 1)))
