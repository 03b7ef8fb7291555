"""Small files of each document format, as the registered queries and tests make them inside tasks."""

from __future__ import annotations

import base64
import datetime as dt
import io
import struct
import zipfile
import zlib
from xml.sax.saxutils import escape, quoteattr

import numpy as np

#: (row, column, type, value, rows spanned, columns spanned); a date is a datetime.date.
CellValue = tuple[int, int, str, object, int, int]


def archive(members: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


def docx(text: str, header: str = "") -> bytes:
    """A paragraph for each line; tabs are elements, and so is the break after every other paragraph's line."""
    space = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    run = lambda t: "<w:tab/>".join(f'<w:t xml:space="preserve">{escape(x)}</w:t>' for x in t.split("\t"))
    lines = text.split("\n")
    body = "".join(f'<w:p><w:pPr><w:tabs><w:tab w:val="left"/></w:tabs></w:pPr><w:r>{"<w:br/>".join(map(run, lines[i : i + 2]))}</w:r></w:p>' for i in range(0, len(lines), 2))
    members = {"word/document.xml": f"<w:document {space}><w:body>{body}</w:body></w:document>"}
    if header:
        members["word/header1.xml"] = f"<w:hdr {space}><w:p><w:r>{run(header)}</w:r></w:p></w:hdr>"
    return archive(members)


def odt(text: str) -> bytes:
    """The same in LibreOffice's elements."""
    lines = [escape(line).replace("\t", "<t:tab/>").replace("  ", ' <t:s t:c="1"/>') for line in text.split("\n")]
    body = "".join(f"<t:p>{'<t:line-break/>'.join(lines[i : i + 2])}</t:p>" for i in range(0, len(lines), 2))
    return archive({"mimetype": "application/vnd.oasis.opendocument.text", "content.xml": f'<o:body xmlns:o="urn:o" xmlns:t="urn:t"><o:text>{body}</o:text></o:body>'})


def reference(row: int, column: int) -> str:
    letters, column = "", column + 1
    while column:
        column, rest = divmod(column - 1, 26)
        letters = chr(65 + rest) + letters
    return f"{letters}{row + 1}"


def serial(day: dt.date) -> int:
    return (day - dt.date(1899, 12, 30)).days


def xlsx(sheets: dict[str, list[CellValue]]) -> bytes:
    """Sheets whose files aren't in the order of the book, shared and own strings, a date format by number and one by code."""
    space, office = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    texts = sorted({str(v) for found in sheets.values() for _, _, kind, v, *_ in found if kind == "text"})
    place, members, n = {t: i for i, t in enumerate(texts)}, {}, len(sheets)
    for no, (_, found) in enumerate(sheets.items()):
        rows: dict[int, list[str]] = {}
        merged = []
        for row, column, kind, value, high, wide in sorted(found, key=lambda c: c[:2]):
            at = f'r="{reference(row, column)}"'
            if kind == "text":
                cell = f'<c {at} t="s"><v>{place[str(value)]}</v></c>' if column % 2 else f'<c {at} t="inlineStr"><is><t>{escape(str(value))}</t></is></c>'
            elif kind == "date":
                cell = f'<c {at} s="{1 + row % 2}"><v>{serial(value)}</v></c>'
            elif kind == "boolean":
                cell = f'<c {at} t="b"><v>{int(value)}</v></c>'
            else:
                cell = f"<c {at}><v>{value!r}</v></c>"
            rows.setdefault(row, []).append(cell + (f'<c r="{reference(row, column + 1)}" s="1"/>' if wide > 1 else ""))
            if high > 1 or wide > 1:
                merged.append(f'<mergeCell ref="{reference(row, column)}:{reference(row + high - 1, column + wide - 1)}"/>')
        data = "".join(f'<row r="{r + 1}">{"".join(cells)}</row>' for r, cells in sorted(rows.items()))
        members[f"xl/worksheets/sheet{n - no}.xml"] = f'<worksheet xmlns="{space}"><sheetData>{data}</sheetData><mergeCells>{"".join(merged)}</mergeCells></worksheet>'
    names = "".join(f'<sheet name={quoteattr(s)} sheetId="{i + 1}" r:id="r{i}"/>' for i, s in enumerate(sheets))
    rels = "".join(f'<Relationship Id="r{i}" Target="worksheets/sheet{n - i}.xml"/>' for i in range(n))
    return archive(members | {
        "xl/workbook.xml": f'<workbook xmlns="{space}" xmlns:r="{office}"><sheets>{names}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>',
        "xl/styles.xml": f'<styleSheet xmlns="{space}"><numFmts><numFmt numFmtId="164" formatCode="&quot;day &quot;yyyy\\-mm\\-dd"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/></cellXfs></styleSheet>',
        "xl/sharedStrings.xml": f'<sst xmlns="{space}">{"".join(f"<si><r><t>{escape(t[:1])}</t></r><r><t>{escape(t[1:])}</t></r><rPh><t>x</t></rPh></si>" for t in texts)}</sst>',
    })


def ods(sheets: dict[str, list[CellValue]]) -> bytes:
    """The same with gaps as repeated empty cells and rows, and equal neighbours as repeated cells."""
    tables = []
    for name, found in sheets.items():
        rows: dict[int, list[CellValue]] = {}
        for cell in sorted(found, key=lambda c: c[:2]):
            rows.setdefault(cell[0], []).append(cell)
        out, last = [], 0
        for row, cells in rows.items():
            if row > last:
                out.append(f'<t:table-row t:number-rows-repeated="{row - last}"><t:table-cell t:number-columns-repeated="1024"/></t:table-row>')
            line, column, i = [], 0, 0
            while i < len(cells):
                _, at, kind, value, high, wide = cells[i]
                same = i + 1
                while same < len(cells) and cells[same][2:] == cells[i][2:] and cells[same][1] == at + same - i:
                    same += 1
                if at > column:
                    line.append(f'<t:table-cell t:number-columns-repeated="{at - column}"/>')
                held = {
                    "text": lambda v: f'o:value-type="string"><x:p>{escape(str(v))}</x:p>', "number": lambda v: f'o:value-type="float" o:value="{v!r}"><x:p>shown</x:p>',
                    "boolean": lambda v: f'o:value-type="boolean" o:boolean-value="{str(bool(v)).lower()}"><x:p>shown</x:p>', "date": lambda v: f'o:value-type="date" o:date-value="{v.isoformat()}"><x:p>shown</x:p>',
                }[kind](value)
                repeated = f' t:number-columns-repeated="{same - i}"' if same > i + 1 else ""
                span = f' t:number-rows-spanned="{high}" t:number-columns-spanned="{wide}"' if high > 1 or wide > 1 else ""
                line.append(f"<t:table-cell{repeated}{span} {held}</t:table-cell>" + (f'<t:covered-table-cell t:number-columns-repeated="{wide - 1}"/>' if wide > 1 else ""))
                column, i = at + same - i + (wide - 1), same
            out.append(f"<t:table-row>{''.join(line)}</t:table-row>")
            last = row + 1
        tables.append(f"<t:table t:name={quoteattr(name)}>{''.join(out)}</t:table>")
    spaces = 'xmlns:o="urn:o" xmlns:t="urn:t" xmlns:x="urn:x"'
    return archive({"content.xml": f"<o:document {spaces}><o:body><o:spreadsheet>{''.join(tables)}</o:spreadsheet></o:body></o:document>"})


def csv_file(sheets: dict[str, list[CellValue]]) -> bytes:
    """The first sheet, parted by semicolons, each line as long as the longest."""
    (found, *_) = sheets.values()
    wide = max(c[1] for c in found) + 1
    lines = [[""] * wide for _ in range(max(c[0] for c in found) + 1)]
    for row, column, kind, value, *_ in found:
        lines[row][column] = '"' + str(value).replace('"', '""') + '"' if kind == "text" else str(value).lower() if kind == "boolean" else str(value)
    return "\r\n".join(map(";".join, lines)).encode()


def compound_file(streams: dict[str, bytes]) -> bytes:
    """Sectors of 512 bytes; streams under 4096 bytes in the stream of small sectors."""
    sectors: list[bytes] = []
    fat: list[int] = []

    def put(data: bytes) -> int:
        first, n = len(sectors), max(1, -(-len(data) // 512))
        sectors.extend(data[512 * i : 512 * i + 512].ljust(512, b"\0") for i in range(n))
        fat.extend([*range(first + 1, first + n), 0xFFFFFFFE])
        return first

    small, small_fat, entries = b"", [], []
    for name, data in streams.items():
        if len(data) >= 4096:
            start = put(data)
        else:
            start, n = len(small_fat), max(1, -(-len(data) // 64))
            small += data.ljust(64 * n, b"\0")
            small_fat += [*range(start + 1, start + n), 0xFFFFFFFE]
        entries.append((name, 2, start, len(data)))
    entries.insert(0, ("Root Entry", 5, put(small) if small else 0xFFFFFFFE, len(small)))
    directory = b""
    for i, (name, kind, start, size) in enumerate(entries):
        raw, none = name.encode("utf-16-le") + b"\0\0", 0xFFFFFFFF
        right, child = (none, 1 if len(entries) > 1 else none) if i == 0 else (i + 1 if i + 1 < len(entries) else none, none)
        directory += raw.ljust(64, b"\0") + struct.pack("<HBBIII36xIQ", len(raw), kind, 1, none, right, child, start, size)
    small_start = put(struct.pack(f"<{len(small_fat)}I", *small_fat)) if small_fat else 0xFFFFFFFE
    directory_start = put(directory)
    n = 1
    while n * 128 < len(fat) + n:
        n += 1
    if n > 109:
        raise ValueError("a file this large isn't made")
    first = len(sectors)
    table = struct.pack(f"<{128 * n}I", *(fat + [0xFFFFFFFD] * n + [0xFFFFFFFF] * (128 * n - len(fat) - n)))
    head = bytes.fromhex("D0CF11E0A1B11AE1") + bytes(16) + struct.pack("<HHHHH6xII", 0x3E, 3, 0xFFFE, 9, 6, 0, n)
    head += struct.pack("<IIIIIII", directory_start, 0, 4096, small_start, max(0, -(-len(small_fat) // 128)), 0xFFFFFFFE, 0)
    head += struct.pack("<109I", *range(first, first + n), *[0xFFFFFFFF] * (109 - n))
    return head + b"".join(sectors) + table


def doc(text: str, header: str = "") -> bytes:
    """A document whose pieces are turns of one-byte and two-byte text, out of order in the stream."""
    lines = (text + "\n").split("\n")[:-1]
    body = [line + "\r" for line in lines] + ([header + "\r"] if header else [])
    pieces, places, where = b"", [0], []
    for line in reversed(body):
        try:
            raw, narrow = line.encode("cp1252"), True
        except UnicodeEncodeError:
            raw, narrow = line.encode("utf-16-le"), False
        pieces += b"\0" * (len(pieces) % 2)
        where.append((len(pieces), narrow, len(line.encode("utf-16-le")) // 2))
        pieces += raw
    where.reverse()
    base, table = 1536, b""
    for at, narrow, units in where:
        places.append(places[-1] + units)
        table += struct.pack("<HIH", 0, ((base + at) * 2 | 0x40000000) if narrow else base + at, 0)
    plc = struct.pack(f"<{len(places)}I", *places) + table
    clx = b"\x01" + struct.pack("<H", 4) + b"\0" * 4 + b"\x02" + struct.pack("<I", len(plc)) + plc
    fib = bytearray(base)
    struct.pack_into("<H", fib, 0, 0xA5EC)
    struct.pack_into("<H", fib, 0x0A, 0x0200)
    main = sum(w[2] for w in where[: len(lines)])
    struct.pack_into("<8I", fib, 0x4C, main, 0, places[-1] - main, 0, 0, 0, 0, 0)
    struct.pack_into("<II", fib, 0x1A2, 0, len(clx))
    return compound_file({"WordDocument": bytes(fib) + pieces, "1Table": clx})


def _biff(kind: int, body: bytes) -> bytes:
    return struct.pack("<HH", kind, len(body)) + body


def _biff_text(text: str, wide_length: bool) -> bytes:
    raw, wide = (text.encode("latin-1"), 0) if all(ord(c) < 256 for c in text) else (text.encode("utf-16-le"), 1)
    return struct.pack("<HB" if wide_length else "<BB", len(raw) >> wide, wide) + raw


def _shared_strings(texts: list[str], limit: int) -> bytes:
    """A record of strings and those that continue it; text is cut wherever a record is full."""
    records, body = [], struct.pack("<II", len(texts), len(texts))
    for text in texts:
        raw = text.encode("utf-16-le")
        if len(body) + 5 > limit:
            records.append(body)
            body = b""
        body += struct.pack("<HB", len(raw) // 2, 1)
        while len(body) + len(raw) > limit:
            n = (limit - len(body)) // 2 * 2
            records.append(body + raw[:n])
            body, raw = b"\x01", raw[n:]
        body += raw
    records.append(body)
    return b"".join(_biff(0x3C if i else 0xFC, r) for i, r in enumerate(records))


def xls(sheets: dict[str, list[CellValue]], limit: int = 8224) -> bytes:
    """Numbers as doubles, as packed ones and as formulas' results, strings shared, dates by number and by code."""
    texts = sorted({str(v) for found in sheets.values() for _, _, kind, v, *_ in found if kind == "text"})
    place = {t: i for i, t in enumerate(texts)}
    front = _biff(0x809, struct.pack("<HHHHII", 0x0600, 5, 0, 0, 0, 0)) + _biff(0x22, b"\0\0") + _biff(0x41E, struct.pack("<H", 164) + _biff_text('"day "yyyy-mm-dd', True))
    front += b"".join(_biff(0xE0, struct.pack("<HH16x", 0, f)) for f in (0, 14, 164))
    back = _shared_strings(texts, limit) + _biff(0x0A, b"")
    heads = [_biff_text(name, False) for name in sheets]
    at = len(front) + sum(10 + len(h) for h in heads) + len(back)
    bounds, bodies = b"", []
    for head, found in zip(heads, sheets.values(), strict=True):
        out, merged = _biff(0x809, struct.pack("<HHHHII", 0x0600, 0x10, 0, 0, 0, 0)), []
        for row, column, kind, value, high, wide in found:
            key = struct.pack("<HH", row, column)
            if kind == "text":
                out += _biff(0xFD, key + struct.pack("<HI", 0, place[str(value)])) if column % 2 else _biff(0x06, key + struct.pack("<HB5xHHI", 0, 0, 0xFFFF, 0, 0)) + _biff(0x207, _biff_text(str(value), True))
            elif kind == "date":
                out += _biff(0x27E, key + struct.pack("<HI", 1 + row % 2, serial(value) << 2 | 2))
            elif kind == "boolean":
                out += _biff(0x205, key + struct.pack("<HBB", 0, int(value), 0))
            elif float(value) == int(value) and abs(value) < 1 << 28:
                out += _biff(0xBD, key + struct.pack("<HIH", 0, (int(value) << 2 | 2) & 0xFFFFFFFF, column))
            elif row % 2:
                out += _biff(0x06, key + struct.pack("<HdHI", 0, float(value), 0, 0))
            else:
                out += _biff(0x203, key + struct.pack("<Hd", 0, float(value)))
            if high > 1 or wide > 1:
                merged.append(struct.pack("<4H", row, row + high - 1, column, column + wide - 1))
        for i in range(0, len(merged), 1000):
            out += _biff(0xE5, struct.pack("<H", len(merged[i : i + 1000])) + b"".join(merged[i : i + 1000]))
        out += _biff(0x0A, b"")
        bounds += _biff(0x85, struct.pack("<IH", at, 0) + head)
        bodies.append(out)
        at += len(out)
    return compound_file({"Workbook": front + bounds + back + b"".join(bodies)})


def _ascii85(data: bytes) -> bytes:
    """As the library's, which is slow; groups of zeros have a short form there."""
    groups = np.frombuffer(data + bytes(-len(data) % 4), ">u4").astype(np.int64)
    if not groups.all():
        return base64.a85encode(data)
    return (groups[:, None] // 85 ** np.arange(4, -1, -1) % 85 + 33).astype(np.uint8).tobytes()[: len(groups) * 5 - (-len(data) % 4)]


def _literal(raw: bytes) -> bytes:
    return b"(" + raw.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r").replace(b"\n", b"\\n") + b")"


def _pages(pages: list[list[str]], code, broken: bool, filters) -> list[tuple[bytes, bytes]]:
    """(dictionary, data) of each page's content; the last one's is cut if it's to be broken."""
    out = []
    for i, lines in enumerate(pages):
        shown = b" ".join(b"[" + code(line[: len(line) // 2]) + b" -20 " + code(line[len(line) // 2 :]) + b"] TJ 0 -14 Td" for line in lines)
        name, data = filters(b"q BT /F1 12 Tf 72 700 Td " + shown + b" ET Q")
        if broken and i == len(pages) - 1:
            data = data[: len(data) // 2]
        out.append((b"/Length %d /Filter %s" % (len(data), name), data))
    return out


def _tree(n_pages: int, first: int, resources: bytes) -> dict[int, bytes]:
    """A page tree of two levels, numbered down so that pages stand in the file against their order: object 2 is its root, the pages end at ``first``."""
    pages = {first + n_pages - 1 - i: i for i in range(n_pages)}
    order = sorted(pages, reverse=True)
    groups = [order[i : i + 3] for i in range(0, n_pages, 3)]
    base, out = first + n_pages, {}
    for k, group in enumerate(groups):
        out[base + k] = b"<</Type /Pages /Parent 2 0 R /Count %d /Kids [%s]>>" % (len(group), b" ".join(b"%d 0 R" % g for g in group))
        out |= {g: b"<</Type /Page /Parent %d 0 R /Contents [%d 0 R]>>" % (base + k, base + len(groups) + pages[g]) for g in group}
    out[2] = b"<</Type /Pages /Count %d /Resources %s /Kids [%s]>>" % (n_pages, resources, b" ".join(b"%d 0 R" % (base + k) for k in range(len(groups))))
    return out


def pdf(pages: list[list[str]], plain: bool, broken: bool = False) -> bytes:
    """Plain: one-byte codes, a table of references.  Otherwise: codes by number with a Unicode map, object streams, a predicted stream of references.

    Text that one-byte codes can't hold isn't plain.  A broken file's last page can't be decoded.
    """
    try:
        "".join(line for page in pages for line in page).encode("cp1252")
    except UnicodeEncodeError:
        plain = False
    objects: dict[int, bytes] = {1: b"<</Type /Catalog /Pages 2 0 R>>"}
    streams: dict[int, tuple[bytes, bytes]] = {}
    if plain:
        objects[3] = b"<</Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding>>"
        content = _pages(pages, lambda t: _literal(t.encode("cp1252")), broken, lambda d: (b"/FlateDecode", zlib.compress(d)))
    else:
        known = {c: i + 1 for i, c in enumerate(sorted({c for page in pages for line in page for c in line}))}
        hexed = lambda c: c.encode("utf-16-be").hex().encode()
        chars = b"\n".join(b"%d beginbfchar\n%s\nendbfchar" % (len(part), b"\n".join(b"<%04x> <%s>" % (known[c], hexed(c)) for c in part)) for part in (list(known)[i : i + 100] for i in range(0, len(known), 100)))
        cmap = b"/CIDInit /ProcSet findresource begin 12 dict begin begincmap\n1 begincodespacerange\n<0000> <ffff>\nendcodespacerange\n" + chars + b"\nendcmap end end"
        objects[3] = b"<</Type /Font /Subtype /Type0 /Encoding /Identity-H /DescendantFonts [5 0 R] /ToUnicode 4 0 R>>"
        objects[5] = b"<</Type /Font /Subtype /CIDFontType2>>"
        packed = zlib.compress(cmap)
        streams[4] = (b"/Length %d /Filter /FlateDecode" % len(packed), packed)
        digits = {ord(c): f"{n:04x}" for c, n in known.items()}
        code = lambda t: b"<" + t.translate(digits).encode() + b">"
        content = _pages(pages, code, broken, lambda d: (b"[/ASCII85Decode /FlateDecode]", _ascii85(zlib.compress(d)) + b"~>"))
    tree = _tree(len(pages), 6, b"<</Font <</F1 3 0 R>>>>")
    objects |= tree
    streams |= {max(tree) + 1 + i: c for i, c in enumerate(content)}
    size = max([*objects, *streams]) + 1
    out, places = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"), {}
    for number, (head, data) in streams.items():
        places[number] = (1, len(out), 0)
        out += b"%d 0 obj\n<<%s>>\nstream\n" % (number, head) + data + b"\nendstream\nendobj\n"
    if plain:
        for number, body in objects.items():
            places[number] = (1, len(out), 0)
            out += b"%d 0 obj\n%s\nendobj\n" % (number, body)
        start = len(out)
        entry = lambda n: b"%010d 00000 n \n" % places[n][1] if n in places else b"0000000000 65535 f \n"
        out += b"xref\n0 %d\n" % size + b"".join(map(entry, range(size))) + b"trailer\n<</Size %d /Root 1 0 R>>\nstartxref\n%d\n%%%%EOF" % (size, start)
        return bytes(out)
    head, body = b"", b""
    for i, (number, value) in enumerate(objects.items()):
        head += b"%d %d " % (number, len(body))
        body += value + b" "
        places[number] = (2, size, i)
    packed = zlib.compress(head + body)
    places[size] = (1, len(out), 0)
    out += b"%d 0 obj\n<</Type /ObjStm /N %d /First %d /Length %d /Filter /FlateDecode>>\nstream\n" % (size, len(objects), len(head), len(packed)) + packed + b"\nendstream\nendobj\n"
    start = places[size + 1] = (1, len(out), 0)
    rows, above = b"", bytes(8)
    for n in range(size + 2):
        kind, at, i = places.get(n, (0, 0, 0))
        row = struct.pack(">BIHx", kind, at, i)
        rows += b"\x02" + bytes((a - b) & 255 for a, b in zip(row, above, strict=True))
        above = row
    packed = zlib.compress(rows)
    out += b"%d 0 obj\n<</Type /XRef /Size %d /W [1 4 3] /Root 1 0 R /Length %d /Filter /FlateDecode /DecodeParms <</Predictor 12 /Columns 8>>>>\nstream\n" % (size + 1, size + 2, len(packed))
    return bytes(out) + packed + b"\nendstream\nendobj\nstartxref\n%d\n%%%%EOF" % start[1]


def image(kind: str, width: int, height: int) -> bytes:
    """A header of the kind; readers of sizes look no further."""
    if kind == "png":
        return b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", width, height) + b"\x08\x02\0\0\0"
    if kind == "gif":
        return b"GIF89a" + struct.pack("<HH", width, height) + b"\0\0\0"
    if kind == "bmp":
        return b"BM" + struct.pack("<IHHIIii", 0, 0, 0, 54, 40, width, height) + b"\0" * 28
    if kind == "jpeg":
        return b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x11\x08" + struct.pack(">HH", height, width) + b"\x03" * 10
    return b"RIFF\0\0\0\0WEBPVP8L\0\0\0\0\x2f" + ((width - 1) | (height - 1) << 14).to_bytes(4, "little") + b"\0" * 8


def png(width: int, height: int, samples: bytes, colour: int = 2, bits: int = 8, filters: tuple[int, ...] = (0, 1, 2, 3, 4), palette: bytes = b"") -> bytes:
    """An image of rows of packed samples, each row by the next of the filters; the data in two chunks."""
    per_pixel = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    wide, step = (width * per_pixel * bits + 7) // 8, max(1, per_pixel * bits // 8)
    rows = np.frombuffer(samples, np.uint8, wide * height).reshape(height, wide).astype(np.int16)
    a, b, c = (np.zeros_like(rows) for _ in range(3))  # to the left, above, and above that to the left
    a[:, step:], b[1:], c[1:, step:] = rows[:, :-step], rows[:-1], rows[:-1, :-step]
    kinds = np.resize(np.array(filters, np.uint8), height)
    left, up, corner = (abs(a + b - c - v) for v in (a, b, c))
    nearest = np.where((left <= up) & (left <= corner), a, np.where(up <= corner, b, c))
    near = np.choose(kinds[:, None], (0 * a, a, b, (a + b) // 2, nearest))
    raw = np.hstack([kinds[:, None], (rows - near).astype(np.uint8)])
    packed = zlib.compress(raw.tobytes())
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    data = [packed[: len(packed) // 2], packed[len(packed) // 2 :]]
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, bits, colour, 0, 0, 0))
    return b"\x89PNG\r\n\x1a\n" + head + (chunk(b"PLTE", palette) if palette else b"") + b"".join(chunk(b"IDAT", d) for d in data) + chunk(b"IEND", b"")
