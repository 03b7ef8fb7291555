"""Spans (start, kind, end) in code points: their order, their text form and Arrow types."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

Span = tuple[int, int, int, str]  # start, place of the kind in the operator's list, end, kind

SPAN_TYPE = pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("end", pa.int64()), ("kind", pa.string())])
SPAN_SQL = "struct<start:bigint,rank:int,end:bigint,kind:string>"


def joined(spans: Iterable[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in sorted(spans))


def sha256(spans: Iterable[Span]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()


def as_dicts(spans: Sequence[Span]) -> list[dict]:
    return [{"start": s, "rank": r, "end": e, "kind": k} for s, r, e, k in sorted(spans)]


def joined_column(spans: Column) -> Column:
    """The same text form of an array column of spans."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
