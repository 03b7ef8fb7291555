"""Removal of repeated byte strings: sampled suffixes are sorted, neighbours compared, the rest merged in.

Suffixes are sampled by a difference cover that is defined by content: of each window of ``length`` bytes the
place of its least-named ``GRAM``-gram, leftmost if several.  As with a cover of fixed residues, two equal
windows have sampled suffixes at one and the same offset, whatever their places, so repeated windows meet at a
sampled suffix; but only about 2 in ``length - GRAM + 2`` suffixes are sampled instead of a share that grows
with the cover.

A sampled suffix is sorted by a triple of names, of the gram and of what its windows show left and right of it.
Neighbours of one triple repeat all windows of the first of them.  Names that no other suffix has are discarded.
Where a gram has several triples, their first occurrences are looked at again on the text: the windows that
weren't sampled are merged in by the gram and their content, and neighbours of equal content compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import bounded, id_and_text, materialize, release, slices, utf8
from leafmill.llm.hashing import Names, mix

GRAM = 32
#: Bytes of a document that are sampled at once; what spans two pieces is sampled in both.
PIECE = 1 << 22
#: Bytes of text whose sampled suffixes are combined before they are dealt out.
COMBINED = 1 << 23
#: First occurrences of one gram whose windows a task compares; those of more are exploded and grouped by Spark.
HOT = 20_000
#: Windows sorted at once; whole grams, so at most HOT blocks more.
SORTED = 1 << 19
#: Windows whose bytes are compared at once.
VERIFIED = 1 << 15
#: Stands for a null doc_id, which comes before all others.
NO_ID = -(1 << 63)

_U = np.uint64


def sampled(data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(gram, left, right, lo, hi) of each sampled suffix: its names, and its first and last window."""
    names, span = Names(data), length - GRAM + 1
    at = np.arange(len(data) - GRAM + 1)
    grams = names.of(at, at + GRAM)
    windows = len(grams) - span + 1
    keyed = (grams >> _U(23) << _U(23)) | at.astype(np.uint64)  # PIECE < 2 ** 23
    # least of each window: of the rest of one aligned stretch and the beginning of the next
    padded = np.concatenate((keyed, np.full(-len(keyed) % span, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, span)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:windows], ahead[span - 1 : span - 1 + windows])
    place = (least & _U((1 << 23) - 1)).astype(np.int64)
    lo = np.flatnonzero(np.diff(place, prepend=-1))
    hi = np.append(lo[1:], windows) - 1
    here = place[lo]
    return grams[here], names.of(lo, here), names.of(here + GRAM, hi + length), lo, hi


def pieces(text: bytes, length: int, piece: int = PIECE) -> Iterator[tuple[int, np.ndarray]]:
    """(offset, bytes) of parts that together show every window once at least."""
    data = np.frombuffer(text, np.uint8)
    for at in range(0, max(len(data) - length + 1, 0), piece):
        yield at, data[at : at + piece + length - 1]


def runs(places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs [start, end) of bytes that windows beginning at sorted places cover."""
    new = np.flatnonzero(np.diff(places, prepend=-2 * length - 1) > length)
    return places[new], np.append(places[new[1:] - 1], places[-1:]) + length


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = id_and_text(docs, id_col, text_col)
    return rows.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text")


SUFFIXES = pa.schema([("gram", pa.int64()), ("sides", pa.int64()), ("doc_id", pa.int64()), ("lo", pa.int64()), ("n", pa.int32())])


def sampled_suffixes(docs: DataFrame, length: int, piece: int = PIECE, together: int = COMBINED) -> DataFrame:
    """(gram, sides, doc_id, lo, n): sampled suffixes and their number of windows, the first of its triple in each combined part.

    The later ones are known to repeat; they come with n negative and a gram by chance.
    """

    def combined(parts: list[tuple]) -> pa.RecordBatch:
        gram, sides, doc, lo, n = map(np.concatenate, zip(*parts, strict=True))
        order = np.lexsort((lo, doc, sides, gram))
        gram, sides, doc, lo, n = gram[order], sides[order], doc[order], lo[order], n[order]
        first = np.append(True, (np.diff(gram) != 0) | (np.diff(sides) != 0))
        again = np.append(True, (np.diff(doc) != 0) | (np.diff(lo) != 0)) & ~first
        keep = first | again
        gram = np.where(first, gram, mix(gram + lo.astype(np.uint64)))
        columns = (gram.view(np.int64), sides.view(np.int64), doc, lo, np.where(first, n, -n))
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in columns], schema=SUFFIXES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for b in slices(batches):
            for doc, text in zip(b.column("doc_id").to_pylist(), utf8(b.column("text")), strict=True):
                for offset, data in pieces(text, length, piece):
                    gram, left, right, lo, hi = sampled(data, length)
                    parts.append((gram, mix(left * _U(3) + right) ^ left, np.full(len(lo), doc, np.int64), lo + offset, (hi - lo + 1).astype(np.int32)))
                    held += len(data)
                    if held > together:
                        yield combined(parts)
                        parts, held = [], 0
        if parts:
            yield combined(parts)

    return docs.mapInArrow(run, "gram long, sides long, doc_id long, lo long, n int")


MARKS = pa.schema([("doc_id", pa.int64()), ("lo", pa.int64()), ("n", pa.int32()), ("gram", pa.int64())])


def sorted_neighbours(suffixes: DataFrame) -> DataFrame:
    """(doc_id, lo, n, gram): suffixes whose triple came before (gram null), and first occurrences of triples whose
    gram has others.

    The suffixes are sorted over all partitions, which cuts a hot gram or triple into several of them; a task
    streams its part and keeps one row.  What came before a partition isn't known in it, so the first occurrences
    at its ends are always handed on: there the windows themselves are compared.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, handed = None, False  # the first occurrence of the current triple; whether it is handed on already
        for b in batches:
            rows = np.stack([b.column(c).to_numpy().astype(np.int64) for c in ("gram", "sides", "doc_id", "lo", "n")])
            known = rows[:, rows[4] < 0]
            yield from emit(known[2:] * np.array([[1], [1], [-1]]), None)
            rows = rows[:, rows[4] > 0]
            if not rows.shape[1]:
                continue
            both = rows if last is None else np.hstack((last, rows))
            new = np.append(True, (np.diff(both[0]) != 0) | (np.diff(both[1]) != 0))
            head = np.maximum.accumulate(np.where(new, np.arange(both.shape[1]), 0))
            # a repeated row of the first occurrence is no second one
            again = (both[2] != both[2, head]) | (both[3] != both[3, head])
            yield from emit(both[2:, again], None)
            firsts = both[:, new]
            beside = np.diff(firsts[0]) == 0
            hand = np.append(last is None, beside) | np.append(beside, False)
            if last is not None and handed:
                hand[0], handed = False, True
            yield from emit(firsts[2:, hand], firsts[0, hand])
            handed = bool(hand[-1]) or (handed and firsts.shape[1] == 1)
            last = firsts[:, -1:]
        if last is not None and not handed:
            yield from emit(last[2:], last[0])

    def emit(rows: np.ndarray, gram: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        if rows.shape[1]:
            grams = pa.nulls(rows.shape[1], pa.int64()) if gram is None else pa.array(gram)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1]), pa.array(rows[2].astype(np.int32)), grams], schema=MARKS)

    order = ["gram", "sides", "doc_id", "lo"]
    return suffixes.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "doc_id long, lo long, n int, gram long")


BLOCKS = pa.schema([("gram", pa.int64()), ("doc_id", pa.int64()), ("lo", pa.int64()), ("n", pa.int32()), ("block", pa.binary())])


def block_texts(texts: DataFrame, length: int) -> DataFrame:
    """(gram, doc_id, lo, n, block): what the windows of first occurrences show, from rows (doc_id, text, places)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out: list[list] = [[] for _ in BLOCKS]
            for doc, text, places in zip(b.column("doc_id").to_pylist(), utf8(b.column("text")), b.column("places").to_pylist(), strict=True):
                for p in places:
                    block = text[p["lo"] : p["lo"] + p["n"] - 1 + length]
                    if len(block) == p["n"] - 1 + length:  # else another text of a repeated doc_id
                        for column, value in zip(out, (p["gram"], doc, p["lo"], p["n"], block), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, BLOCKS, strict=True)], schema=BLOCKS)

    return texts.mapInArrow(run, "gram long, doc_id long, lo long, n int, block binary")


def window_names(blocks: list[bytes], n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, Windows]:
    """(row, name) of every window of the blocks, and the windows' bytes."""
    data = np.frombuffer(b"".join(blocks), np.uint8)
    names = Names(data)
    begin = np.cumsum([0, *map(len, blocks[:-1])])
    row = np.repeat(np.arange(len(blocks)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + begin[row]
    return row, names.of(at, at + length), Windows(data, at, length)


class Windows:
    """The bytes of windows, copied out only as they are asked for."""

    def __init__(self, data: np.ndarray, at: np.ndarray, length: int):
        self.view = np.lib.stride_tricks.sliding_window_view(data, length) if len(data) >= length else np.empty((0, length), np.uint8)
        self.at = at

    def __getitem__(self, rows: np.ndarray) -> np.ndarray:
        return self.view[self.at[rows]]


def unlike(windows: Windows, one: np.ndarray, other: np.ndarray) -> bool:
    """Whether any of the pairs of windows differs."""
    return any((windows[one[k : k + VERIFIED]] != windows[other[k : k + VERIFIED]]).any() for k in range(0, len(one), VERIFIED))


def merged_windows(blocks: DataFrame, length: int, at_once: int = SORTED) -> DataFrame:
    """(doc_id, start, end): runs covered by windows that an earlier first occurrence of the gram shows too.

    Windows of one name are compared byte by byte; should any differ, all are named by their bytes.
    """

    def found(grams: list[int], docs: list[int], los: list[int], ns: list[int], texts: list[bytes]) -> pa.RecordBatch:
        n, doc, lo = np.array(ns, np.int64), np.array(docs, np.int64), np.array(los, np.int64)
        row, name, windows = window_names(texts, n, length)
        gram = np.array(grams, np.int64)[row]
        place = lo[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        for _ in range(2):
            order = np.lexsort((place, doc[row], name, gram))
            same = np.append(False, (np.diff(gram[order]) == 0) & (np.diff(name[order]) == 0))
            again = np.flatnonzero(same)
            if not unlike(windows, order[again], order[again - 1]):
                break
            name = np.unique(np.ascontiguousarray(windows[np.arange(len(row))]).view(f"V{length}").ravel(), return_inverse=True)[1]
        # of neighbours with equal windows all but the first; a repeated row is the first again
        start = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        head = order[start]
        again = np.empty(len(order), bool)
        again[order] = same & ((doc[row[order]] != doc[row[head]]) | (place[order] != place[head]))
        return covered(doc[row[again]], place[again], length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in range(5)]
        windows = 0
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("gram", "doc_id", "lo", "n", "block")), strict=True):
                if windows > at_once and r[0] != held[0][-1]:
                    yield found(*held)
                    held, windows = [[] for _ in range(5)], 0
                for column, value in zip(held, r, strict=True):
                    column.append(value)
                windows += r[3]
        if held[0]:
            yield found(*held)

    return blocks.repartition("gram").sortWithinPartitions("gram").mapInArrow(run, "doc_id long, start long, end long")


def covered(doc: np.ndarray, place: np.ndarray, length: int) -> pa.RecordBatch:
    """Runs of each document that windows at these places cover."""
    order = np.lexsort((place, doc))
    doc, place = doc[order], place[order]
    new = np.append(True, (np.diff(doc) != 0) | (np.diff(place) > length)) if len(doc) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    ends = place[np.append(at[1:], len(place)) - 1] + length if len(at) else place[:0]
    return pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(place[at]), pa.array(ends)], ["doc_id", "start", "end"])


def hot_windows(blocks: DataFrame, length: int, name_bits: int = 64) -> DataFrame:
    """The same for grams of very many first occurrences: a row for each window, summed up before the shuffle.

    Of the windows of one name the least and the greatest bytes are carried along: where they are equal, all are.  Windows
    of a name whose bytes differ are grouped by their bytes instead.  Of a name so many bits count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(at, 256) for at in range(0, whole.num_rows, 256)):
                n = b.column("n").to_numpy().astype(np.int64)
                row, name, windows = window_names(b.column("block").to_pylist(), n, length)
                place = b.column("lo").to_numpy()[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                shown = pa.FixedSizeBinaryArray.from_buffers(pa.binary(length), len(row), [None, pa.py_buffer(np.ascontiguousarray(windows[np.arange(len(row))]))]).cast(pa.binary())
                short = name & np.uint64((1 << name_bits) - 1)
                columns = (b.column("gram").to_numpy()[row], short.view(np.int64), b.column("doc_id").to_numpy()[row], place)
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), shown], ["gram", "name", "doc_id", "place", "window"])

    windows = blocks.mapInArrow(run, "gram long, name long, doc_id long, place long, window binary")

    def later(rows: DataFrame, firsts: DataFrame, key: list[str]) -> DataFrame:
        found = rows.join(firsts, key).where(F.struct("doc_id", "place") != F.col("_first"))
        return found.select("doc_id", F.col("place").alias("start"), (F.col("place") + length).alias("end"))

    first = F.min(F.struct("doc_id", "place")).alias("_first")
    named = windows.groupBy("gram", "name").agg(F.count("*").alias("_n"), first, F.min("window").alias("_lo"), F.max("window").alias("_hi")).where("_n > 1")
    named = materialize(named.select("gram", "name", "_first", (F.col("_lo") == F.col("_hi")).alias("_alike")), "hot-windows")
    out = later(windows.drop("window"), named.where("_alike").drop("_alike"), ["gram", "name"])
    mixed = named.where("not _alike").select("gram", "name")
    if not mixed.isEmpty():
        own = windows.join(mixed, ["gram", "name"], "left_semi")
        shown = materialize(own.groupBy("gram", "window").agg(F.count("*").alias("_n"), first).where("_n > 1").drop("_n"), "mixed-windows")
        out = out.union(later(own, shown, ["gram", "window"]))
    return out


RESULT_SQL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def cut_texts(joined: DataFrame, with_text: bool) -> DataFrame:
    """Remove the union of each row's runs (doc_id, text, runs)."""
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    schema = pa.schema([*fields, ("kept", pa.binary())] if with_text else fields)

    def cut(text: bytes, runs: list[tuple[int, int]]) -> tuple[bytes, int]:
        parts, done, spans, reach = [], 0, 0, -1
        for start, end in sorted(runs):
            end = min(end, len(text))
            if start >= end:
                continue
            if start > reach:
                spans += 1
                parts.append(text[done:start])
            reach = done = max(done, end)
        return b"".join([*parts, text[done:]]), spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out: list[list] = [[] for _ in schema]
            for doc, text, found in zip(b.column("doc_id").to_pylist(), utf8(b.column("text")), b.column("runs").to_pylist(), strict=True):
                kept, spans = cut(text, [(r["start"], r["end"]) for r in found or ()])
                row = [None if doc == NO_ID else doc, len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept]
                for column, value in zip(out, row[: len(schema)], strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return joined.mapInArrow(run, RESULT_SQL + ", kept binary" * with_text)


def remove_repeats(
    docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, piece: int = PIECE, together: int = COMBINED, at_once: int = SORTED, hot: int = HOT
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and ``with_text`` the bytes kept.

    Removed is each byte covered by a string of ``length`` bytes that also starts earlier, in a smaller doc_id or
    before in the document.  Null texts are empty; a null doc_id comes before all others; rows repeated under one
    doc_id are one document, and each has its result; an empty table gives none.  A doc_id shouldn't stand
    for different texts: what is removed from one is removed from the other.  The last four are sizes of what a task
    holds (see ``PIECE``, ``COMBINED``, ``SORTED`` and ``HOT``) and don't change the result.
    """
    if length < GRAM + 2:
        raise ValueError(f"strings of {length} bytes are too short to be sampled")
    rows = keyed(docs, id_col, text_col)
    suffixes = materialize(sampled_suffixes(rows, length, piece, together), "suffixes")
    marks = materialize(sorted_neighbours(suffixes), "neighbours")
    release(suffixes)
    some = materialize(marks.where("gram is not null").groupBy("doc_id").agg(F.collect_list(F.struct("gram", "lo", "n")).alias("places")), "first-occurrences")
    wanted = rows.join(bounded(some.select("doc_id")), "doc_id", "left_semi")
    blocks = materialize(block_texts(wanted.join(some, "doc_id"), length).distinct(), "blocks")
    crowded = materialize(blocks.groupBy("gram").count().where(F.col("count") > hot).select("gram"), "hot-grams")
    ordinary = merged_windows(blocks.join(crowded, "gram", "left_anti"), length, at_once)
    many = hot_windows(blocks.join(crowded, "gram", "left_semi"), length)
    repeats = marks.where("gram is null").select("doc_id", F.col("lo").alias("start"), (F.col("lo") + F.col("n") - 1 + length).alias("end"))
    runs = repeats.union(ordinary).union(many).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("runs"))
    runs = materialize(runs, "runs")
    release(marks, some, blocks)
    return cut_texts(rows.join(runs, "doc_id", "left"), with_text)
