"""Markdown as blocks: headings, paragraphs, list items, quotes, code and tables, with their places and inline marks removed."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame


class Block(NamedTuple):
    """kind: heading, paragraph, item, quote, code, table row or rule; level: of a heading, or how deep a list or quote is; first: a table's head or a list's number."""

    kind: str
    level: int
    text: str
    first: str | None = None
    cells: list[str] | None = None


HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
FENCE = re.compile(r"( *)(`{3,}|~{3,})[ \t]*([^`]*)$")
ITEM = re.compile(r"([ \t]*)([-+*]|\d{1,9}[.)])[ \t]+(.*)$")
RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
QUOTE = re.compile(r" {0,3}((?:> ?)+)(.*)$")
UNDERLINE = re.compile(r" {0,3}(=+|-+)[ \t]*$")
DASHES = re.compile(r"[ \t]*\|?[ \t]*:?-+:?[ \t]*(\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
CODE = re.compile(r"(`+)(.+?)(?<!`)\1(?!`)", re.S)
LINK = re.compile(r"!?\[([^\[\]]*)\](?:\([^()]*\)|\[[^\[\]]*\])")
MARKED = re.compile(r"(\*\*\*|\*\*|\*|~~)(?=\S)(.+?)(?<=\S)\1|(?<!\w)(__|_)(?=\S)(.+?)(?<=\S)\3(?!\w)", re.S)
#: Marks inside marks that are resolved.
DEPTH = 4


def plain(text: str) -> str:
    """Text without inline marks: what stands in code is as it is, links are their texts, escaped marks are themselves."""
    kept: list[str] = []

    def hold(value: str) -> str:
        kept.append(value)
        return f"\x00{len(kept) - 1}\x00"

    text = CODE.sub(lambda m: hold(m[2].strip(" ") or m[2]), text.replace("\x00", ""))
    text = re.sub(r"\\([!-/:-@\[-`{-~])", lambda m: hold(m[1]), text)
    for _ in range(DEPTH):
        text = MARKED.sub(lambda m: m[2] or m[4], LINK.sub(r"\1", text))
    text = re.sub(r"<(https?://[^<>\s]+)>", r"\1", text)
    return re.sub("\x00(\\d+)\x00", lambda m: kept[int(m[1])], text)


def row_cells(line: str) -> list[str]:
    """A table row's cells; a bar behind a backslash is part of one."""
    line = re.sub(r"^[ \t]*\|?|(?<!\\)\|?[ \t]*$", "", line, count=2)
    return [plain(c.replace("\\|", "|").strip()) for c in re.split(r"(?<!\\)\|", line)]


def blocks(text: str) -> Iterator[Block]:
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    held: list[str] = []  # lines of a paragraph, item or quote that goes on
    kind, level, first = "paragraph", 0, None
    indents: list[int] = []

    def flush() -> Iterator[Block]:
        nonlocal held, kind, level, first
        if held:
            yield Block(kind, level, plain("\n".join(held)), first)
        held, kind, level, first = [], "paragraph", 0, None

    i = 0
    while i < len(lines):
        line = lines[i]
        i += 1
        if m := FENCE.match(line):
            yield from flush()
            body: list[str] = []
            while i < len(lines) and not re.match(rf" *{re.escape(m[2][0])}{{{len(m[2])},}}[ \t]*$", lines[i]):
                body.append(re.sub(rf"^ {{0,{len(m[1])}}}", "", lines[i]))
                i += 1
            i += 1
            yield Block("code", 0, "\n".join(body), m[3].strip().split(" ")[0] or None)
        elif not line.strip():
            yield from flush()
        elif held and kind == "paragraph" and (m := UNDERLINE.match(line)):
            text_, held = "\n".join(held), []
            yield Block("heading", 1 if m[1][0] == "=" else 2, plain(text_))
        elif m := HEADING.match(line):
            yield from flush()
            indents = []
            yield Block("heading", len(m[1]), plain(m[2] or ""))
        elif RULE.match(line):
            yield from flush()
            yield Block("rule", 0, "")
        elif i < len(lines) and "|" in line and DASHES.match(lines[i]) and len(row_cells(line)) == len(row_cells(lines[i])):
            yield from flush()
            rows = [line]
            i += 1
            while i < len(lines) and "|" in lines[i] and lines[i].strip():
                rows.append(lines[i])
                i += 1
            wide = len(row_cells(line))
            for k, row in enumerate(rows):
                found = (row_cells(row) + [""] * wide)[:wide]
                yield Block("table row", k, "\t".join(found), "head" if k == 0 else None, found)
        elif m := ITEM.match(line):
            yield from flush()
            indent = len(m[1].expandtabs(4))
            while indents and indents[-1] > indent:
                indents.pop()
            if not indents or indents[-1] < indent:
                indents.append(indent)
            kind, level, first, held = "item", len(indents), m[2] if m[2][0].isdigit() else None, [m[3]]
        elif m := QUOTE.match(line):
            deep = m[1].count(">")
            if kind != "quote" or level != deep:
                yield from flush()
            kind, level = "quote", deep
            held.append(m[2])
        elif not held and (line.startswith("    ") or line.startswith("\t")) and not indents:
            body = [line]
            while i < len(lines) and (lines[i].startswith(("    ", "\t")) or not lines[i].strip()):
                body.append(lines[i])
                i += 1
            while not body[-1].strip():
                body.pop()
            yield Block("code", 0, "\n".join(re.sub(r"^(?: {4}|\t)", "", x) for x in body))
        else:
            if not held and not line[0].isspace():
                indents = []
            held.append(line.strip())
    yield from flush()


ROWS = pa.schema([("path", pa.string()), ("block", pa.int32()), ("kind", pa.string()), ("level", pa.int32()), ("text", pa.string()), ("first", pa.string()), ("cells", pa.list_(pa.string()))])


#: Files of one batch of blocks.
FILES = 64


def markdown_blocks(files: DataFrame) -> DataFrame:
    """(path, block, kind, level, text, first, cells) of rows (path, text): the blocks of each file in order; see ``Block``.  Null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, FILES):
                part = b.slice(at, FILES)
                rows = [(path, k, *block) for path, text in zip(part.column("path").to_pylist(), part.column("text").to_pylist(), strict=True) for k, block in enumerate(blocks(text or ""))]
                columns = zip(*rows, strict=True) if rows else [[]] * len(ROWS)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ROWS, strict=True)], schema=ROWS)

    return files.select("path", "text").mapInArrow(run, "path string, block int, kind string, level int, text string, first string, cells array<string>")
