"""Vector best-fit packing of tokenized documents into training sequences.

Every piece is a vector (tokens, documents, attention cost); a sequence has a capacity in each dimension.
Pieces are numbered where they arise and dealt by a hash of that number into blocks of a fixed expected size,
equal ones as well as others, and each block is packed on its own, largest first: of the open sequences with room in every dimension the one with the best score takes
the piece, by the weighted dot product of piece and residual or by the least norm of what would remain.
A block leaves a handful of sequences part full, whatever the size of the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import batch, id_and_text, materialize, slices, strings

#: Pieces of a block, about.
BLOCK_PIECES = 8192
PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


class Encoder:
    """Ids of a byte-level BPE file of the tokenizers library, by the same vocabulary as ranks where given.

    Both give the same ids; the rank form is several times faster.  Special tokens' strings in a text get
    their ids, as the tokenizers library has it.
    """

    def __init__(self, tokenizer_file: str, ranks_file: str | None = None):
        self.tokenizer_file, self.whole, self.ranks = tokenizer_file, None, None
        if ranks_file:
            import base64
            import json

            import public_tokenizers
            import tiktoken

            with open(ranks_file, "rb") as lines:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            with open(tokenizer_file, encoding="utf-8") as spec:
                special = {t["content"]: t["id"] for t in json.load(spec)["added_tokens"]}
            self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    @property
    def full(self):
        """The tokenizers library's own, loaded where it is needed."""
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.tokenizer_file)
        return self.whole

    def __call__(self, text: str) -> np.ndarray:
        if self.ranks is not None:
            try:
                return np.asarray(self.ranks.encode_to_numpy(text, allowed_special="all"), np.uint32)
            except ValueError:  # its splitter gives up on very long runs of white space
                pass
        return np.array(self.full.encode(text, add_special_tokens=False).ids, np.uint32)


_encoders: dict[tuple, Encoder] = {}


def encoder(tokenizer_file: str, ranks_file: str | None) -> Encoder:
    """One per Python worker."""
    if (tokenizer_file, ranks_file) not in _encoders:
        _encoders[tokenizer_file, ranks_file] = Encoder(tokenizer_file, ranks_file)
    return _encoders[tokenizer_file, ranks_file]


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else full pieces behind a shorter first one."""
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def document_pieces(
    docs: DataFrame, tokenizer_file: str, ranks_file: str | None = None, end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """Tokenize and cut: one row per piece (doc_id, piece, start, length, ids_crc32[, ids], row_no), numbered by ``row_no``."""
    schema = pa.schema([*PIECES, *([pa.field("ids", pa.list_(pa.int32()))] if with_ids else []), ("row_no", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, row_no = encoder(tokenizer_file, ranks_file), TaskContext.get().partitionId() << 40
        for b in slices(batches):
            out: list[list] = [[] for _ in schema]
            for doc_id, text in zip(b.column("doc_id").to_pylist(), strings(b.column("text")), strict=True):
                ids = np.append(encode(text), np.uint32(end_id)).astype("<u4")
                for k, (start, length) in enumerate(cuts(len(ids), capacity)):
                    own = ids[start : start + length]
                    row = [doc_id, k, start, length, zlib.crc32(own.tobytes()), *([own.astype(np.int32)] if with_ids else []), row_no]
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                    row_no += 1
            yield batch(schema, out)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids + ", row_no long")


def best_fit(lengths: np.ndarray, capacity: np.ndarray, weights: np.ndarray, rule: str = "dot") -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in tokens) of each piece, by vector best fit over decreasing lengths.

    A piece is (length, 1, length ** 2).  Only bins with room in every dimension are looked at.  ``rule`` dot: the
    greatest weighted dot product of piece and residual, so bins with most room where the piece needs it; norm:
    the least weighted norm of the residual after placing, so the tightest.  Ties: the bin opened first, as
    long as none is closed, else a fixed one.  Bins that not even the least piece fits in are closed.
    """
    n = len(lengths)
    order = np.lexsort((np.arange(n), -lengths))
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    room = np.empty((3, max(n, 1)))  # residuals of open bins; closed ones are swapped out
    label = np.empty(max(n, 1), np.int64)
    is_open = made = 0
    scale = weights / (capacity * capacity)
    least = np.array([lengths.min() if n else 0, 1, float(lengths.min()) ** 2 if n else 0])
    for i in order:
        size = float(lengths[i])
        item = np.array([size, 1.0, size * size])
        at = -1
        if is_open:
            now = room[:, :is_open]
            fits = (now[0] >= item[0]) & (now[1] >= 1.0) & (now[2] >= item[2])
            if rule == "dot":
                score = (scale * item) @ now
                score = np.where(fits, -score, np.inf)
            else:
                left = now - item[:, None]
                score = np.where(fits, scale @ (left * left), np.inf)
            at = int(np.argmin(score))
            if not np.isfinite(score[at]):
                at = -1
        if at < 0:
            at, is_open, made = is_open, is_open + 1, made + 1
            room[:, at], label[at] = capacity, made - 1
        bins[i], offsets[i] = label[at], int(capacity[0] - room[0, at])
        room[:, at] -= item
        if (room[:, at] < least).any():  # nothing fits any more
            is_open -= 1
            room[:, at], label[at] = room[:, is_open], label[is_open]
    return bins, offsets


def pack_pieces(
    pieces: DataFrame,
    blocks: int,
    capacity: int = 2048,
    max_documents: int | None = None,
    max_attention: float | None = None,
    weights: tuple[float, float, float] = (1.0, 0.5, 0.5),
    rule: str = "norm",
) -> DataFrame:
    """pieces with sequence_id and offset; every other column but ``row_no`` is carried along as it is.

    No sequence has over ``capacity`` tokens, ``max_documents`` pieces or ``max_attention`` as its sum of
    squared lengths; without the last two they are those of a sequence of single tokens and of one piece.  All three
    residuals weigh in the choice.  A piece that alone is over a capacity raises.  One shuffle, of the pieces' rows;
    ``row_no`` deals and orders them.
    """
    caps = np.array([capacity, max_documents or capacity, max_attention or float(capacity) ** 2], float)
    weight = np.array(weights, float)

    def pack(block: pa.Table) -> pa.Table:
        lengths = block.column("length").to_numpy().astype(np.int64)
        if ((lengths > caps[0]) | (lengths.astype(float) ** 2 > caps[2])).any():
            raise ValueError("a piece is longer than a sequence may be")
        block = block.take(np.argsort(block.column("row_no").to_numpy()))
        bins, offsets = best_fit(block.column("length").to_numpy().astype(np.int64), caps, weight, rule)
        first = block.column("_block")[0].as_py() << 32
        return block.drop_columns(["_block", "row_no"]).append_column("sequence_id", pa.array(bins + first)).append_column("offset", pa.array(offsets))

    block = F.pmod(F.xxhash64("row_no"), F.lit(blocks).cast("long"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name != "row_no")
    return pieces.withColumn("_block", block).groupBy("_block").applyInArrow(pack, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_file: str, ranks_file: str | None = None, end_id: int = 0, capacity: int = 2048, block_pieces: int = BLOCK_PIECES, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids].

    Null texts count as empty and give one piece of the end id alone.  Equal or repeated documents, and rows without
    id, are packed each for itself.  An empty table gives no rows.  The pieces are written once, so that blocks can be
    counted by them: a very long document makes as many blocks as its pieces fill.
    """
    pieces = materialize(document_pieces(docs, tokenizer_file, ranks_file, end_id, capacity, id_col, text_col, with_ids), "pieces")
    blocks = max(1, -(-pieces.count() // block_pieces))
    return pack_pieces(pieces, blocks, capacity, **limits)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of a table packed ``with_ids``: the pieces of a sequence one behind the other."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
