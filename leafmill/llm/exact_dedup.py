"""Exact deduplication by composable polynomial fingerprints.

A text's fingerprint is a polynomial in a fixed base modulo a prime.  Chunks are hashed on their own and
combined by length-shifted arithmetic, H(AB) = H(A) * base ** len(B) + H(B).  Documents of over ``HUGE`` bytes
are cut into rows of one chunk, which are hashed by as many tasks as there are and combined by a grouped sum
(``combine_chunks``); shorter ones are hashed where they are read.  Equal fingerprints are then compared chunk by chunk: the least and the greatest content of each chunk position of a group are
aggregated before the shuffle, so a group of any size sends one row per task and chunk position.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import ASCII_SPACE, ROW, batch, bounded, identified, materialize, picked, release, slices, utf8

PRIME = (1 << 31) - 1
BASES = (1_000_003, 998_244_353)
CHUNK = 1 << 16
#: Texts of more bytes are hashed chunk by chunk in tasks of their own.
HUGE = 1 << 22

FINGERPRINTS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("n_bytes", pa.int64()), ("fingerprint", pa.int64()), ("sha256", pa.binary())])
HASHES = pa.schema([("doc_id", pa.binary()), ("chunk_no", pa.int64()), ("n_bytes", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())])
CHUNKS = pa.schema([("fingerprint", pa.int64()), ("n_bytes", pa.int64()), ("chunk_no", pa.int64()), ("chunk", pa.binary())])


@lru_cache(maxsize=8)
def powers(base: int, prime: int, n: int) -> np.ndarray:
    """base ** (n-1), ..., base ** 0 modulo prime, as uint64."""
    out = [1] * n
    for i in range(1, n):
        out[i] = out[i - 1] * base % prime
    return np.array(out[::-1], np.uint64)


def chunk_hash(chunk: bytes, base: int, prime: int, size: int) -> int:
    """At most ``size`` bytes; 2**8 * 2**31 * 2**16 terms stay below 2**64."""
    values = np.frombuffer(chunk, np.uint8).astype(np.uint64)
    return int(values @ powers(base, prime, size)[size - len(values) :]) % prime


def combine(left: int, right: int, right_len: int, base: int, prime: int) -> int:
    return (left * pow(base, right_len, prime) + right) % prime


def fingerprint(text: bytes, prime: int = PRIME, size: int = CHUNK) -> int:
    """The two polynomials' values in one 62-bit number."""
    found = []
    for base in BASES:
        h = 0
        for at in range(0, len(text), size):
            part = text[at : at + size]
            h = combine(h, chunk_hash(part, base, prime, size), len(part), base, prime)
        found.append(h)
    return found[0] << 31 | found[1]


def fingerprints(rows: DataFrame, prime: int = PRIME, chunk: int = CHUNK, huge: int = HUGE) -> DataFrame:
    """Of rows (row, doc_id, text): row, doc_id, code points, bytes after normalising, fingerprint and SHA-256 of the normalised text; one scan.

    The fingerprint of a text of over ``huge`` bytes is null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            raw = utf8(b.column("text"))
            texts = [t.translate(None, ASCII_SPACE) for t in raw]
            yield batch(
                FINGERPRINTS,
                [
                    b.column("row"),
                    b.column("doc_id"),
                    pc.cast(pc.fill_null(pc.utf8_length(b.column("text")), 0), pa.int64()),
                    [len(t) for t in texts],
                    [fingerprint(t, prime, chunk) if len(r) <= huge else None for t, r in zip(texts, raw, strict=True)],
                    [hashlib.sha256(t).digest() for t in texts],
                ],
            )

    return rows.mapInArrow(run, "row long, doc_id long, n_chars long, n_bytes long, fingerprint long, sha256 binary")


def huge_fingerprints(texts: DataFrame, prime: int = PRIME, chunk: int = CHUNK) -> DataFrame:
    """(sha256, fingerprint) of rows (text): a row for each chunk is dealt to any task, hashed there, and combined."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            for text in utf8(b.column("text")):
                text = text.translate(None, ASCII_SPACE)
                name = hashlib.sha256(text).digest()
                for no, at in enumerate(range(0, len(text) or 1, chunk)):
                    yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([no], pa.int64()), pa.array([text[at : at + chunk]], pa.binary())], ["sha256", "chunk_no", "chunk"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            parts = b.column("chunk").to_pylist()
            h1, h2 = ([chunk_hash(p, base, prime, chunk) for p in parts] for base in BASES)
            yield batch(HASHES, [b.column("sha256"), b.column("chunk_no"), [len(p) for p in parts], h1, h2])

    # equal texts have equal chunks: one of each is enough
    chunks = texts.mapInArrow(cut, "sha256 binary, chunk_no long, chunk binary").repartition("sha256", "chunk_no")
    hashes = chunks.mapInArrow(hashed, "doc_id binary, chunk_no long, n_bytes long, h1 long, h2 long").distinct()
    return combine_chunks(hashes, prime).select(F.col("doc_id").alias("sha256"), "fingerprint")


def combine_chunks(chunks: DataFrame, prime: int = PRIME) -> DataFrame:
    """Fingerprints of documents that come as rows (doc_id, chunk_no, n_bytes, h1, h2), in plain arithmetic.

    Each chunk's value is shifted by the bytes behind it, so the chunks of one document may be hashed
    by any number of tasks; sums are in decimals, which don't overflow.
    """
    from pyspark.sql import Window

    behind = Window.partitionBy("doc_id").orderBy(F.col("chunk_no").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = chunks.withColumn("_shift", F.coalesce(F.sum("n_bytes").over(behind), F.lit(0)))

    def shifted(h: str, base: int) -> Column:
        # square and multiply over the 40 bits of a shift
        power = F.aggregate(
            F.sequence(F.lit(39), F.lit(0), F.lit(-1)),
            F.lit(1).cast("long"),
            lambda acc, bit: (acc * acc % prime) * F.when(F.expr("1L").bitwiseAND(F.call_function("shiftright", F.col("_shift"), bit)) == 1, F.lit(base).cast("long")).otherwise(F.lit(1).cast("long")) % prime,
        )
        return F.sum((F.col(h) * power % prime).cast("decimal(38,0)")) % prime

    return rows.groupBy("doc_id").agg(
        F.sum("n_bytes").alias("n_bytes"),
        (F.shiftleft(shifted("h1", BASES[0]).cast("long"), 31).bitwiseOR(shifted("h2", BASES[1]).cast("long"))).alias("fingerprint"),
    )


def chunk_rows(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(fingerprint, n_bytes, chunk_no, chunk) of rows (fingerprint, n_bytes, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out: tuple[list, list, list, list] = ([], [], [], [])
            held = 0
            for key, n, text in zip(b.column("fingerprint").to_pylist(), b.column("n_bytes").to_pylist(), utf8(b.column("text")), strict=True):
                text = text.translate(None, ASCII_SPACE)
                for no, at in enumerate(range(0, len(text), chunk)):
                    part = text[at : at + chunk]
                    for column, value in zip(out, (key, n, no, part), strict=True):
                        column.append(value)
                    held += len(part)
                    if held > 1 << 23:
                        yield batch(CHUNKS, out)
                        out, held = ([], [], [], []), 0
            yield batch(CHUNKS, out)

    return rows.mapInArrow(run, "fingerprint long, n_bytes long, chunk_no long, chunk binary")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prime: int = PRIME, chunk: int = CHUNK, huge: int = HUGE) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are so after deleting ASCII white space; null counts as empty, so empty, blank
    and null texts form one group.  Of a group the row with most code points stays, of those the smallest
    doc_id, a row without id last.  Rows repeated under one doc_id share their fate and count each, and so do a group's
    rows without id if one of them stays.  An empty table gives none.  Texts are compared by rows' own numbers, whatever their ids.
    """
    known = picked(identified(docs), row=ROW, doc_id=id_col, text=text_col)
    rows = known.select("row", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints = materialize(fingerprints(rows, prime, chunk, huge), "fingerprints")
    long_ones = prints.where("fingerprint is null")
    if not long_ones.isEmpty():
        texts = rows.where(F.octet_length("text") > huge).select("text")
        whole = materialize(huge_fingerprints(texts, prime, chunk), "huge")
        filled = long_ones.drop("fingerprint").join(whole, "sha256").select(prints.columns)
        short = prints
        prints = materialize(prints.where("fingerprint is not null").unionByName(filled), "fingerprints")
        release(whole, short)
    key = ["fingerprint", "n_bytes"]
    # aggregates are written before they are joined, so that Spark can split a hot group
    shared = materialize(prints.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1").select(*key), "shared")
    # texts of rows whose fingerprint others have too, compared chunk by chunk
    doubtful = materialize(prints.join(shared, key, "left_semi").select("row", *key), "doubtful")
    pieces = chunk_rows(rows.select("row", "text").join(bounded(doubtful), "row").select(*key, "text"), chunk)
    broken = pieces.groupBy(*key, "chunk_no").agg(F.min("chunk").alias("_lo"), F.max("chunk").alias("_hi")).where("_lo <> _hi").select(*key)
    broken = materialize(broken.distinct(), "collisions")
    release(doubtful, shared)
    # a collision's texts, hardly ever any, are told apart by their SHA-256
    split = broken.withColumn("_split", F.lit(True))
    rows = prints.join(split, key, "left").select("doc_id", "n_chars", "sha256", F.concat_ws(":", *key, F.when(F.col("_split"), F.hex("sha256"))).alias("_class"))
    # another key than the join's, so that rows are summed up before they are dealt out
    group = ["_class"]
    best = rows.groupBy(*group).agg(F.count("*").alias("group_size"), F.min(F.struct((-F.col("n_chars")).alias("_n"), F.col("doc_id").isNull().alias("_null"), "doc_id")).alias("_best"))
    best = materialize(best.select(*group, "group_size", F.col("_best.doc_id").alias("keep_id")), "groups")
    return rows.join(best, group).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha256")).alias("text_sha256"),
    )
