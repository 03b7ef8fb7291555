"""Embedding near-deduplication with an inverted multi-index.

Each half of the unit vectors has a codebook of its own; the pairs of codewords form a product grid.  A vector
lies in the cell of its nearest codewords, and visits cells in the order of a multi-sequence traversal: by the
sum of both halves' squared slack, half the excess of a codeword's distance over the nearest one's.  By the
triangle inequality a vector at distances (a, b) of the two halves lies in a cell of slacks at most (a, b), so
going on up to the whole squared distance can't miss; the traversal ends earlier, where the target recall is
reached for pairs at the very threshold.  Of two cells the one of lower number visits the other.  All that visitors
meet is verified in double precision.

Cells are dealt in regions of about ``BLOCK`` vectors; hot ones are split, so a task holds one block and
streams its visitors.  Links are counted and joined to trees inside tasks; pairs never become rows.

Vectors of each length have an index of their own, and their length is part of every key, so one pass serves them all.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import materialize, picked, release
from leafmill.llm.components import connected_components
from leafmill.llm.forest import Forest

#: Vectors that the codebooks are fitted on, about (chosen by a hash), shared out to the lengths by their numbers but at
#: least ``LEAST`` for each, and Lloyd's rounds.
SAMPLE, LEAST, ROUNDS = 16_384, 64, 8
#: Vectors of a region's block, and visitors compared with it at once.
BLOCK, VISITORS = 4096, 512
#: Share of pairs at the threshold that the traversal is to reach.
TARGET_RECALL = 0.9995


@dataclass(frozen=True)
class MultiIndex:
    """Codebooks of the halves, slack at which the traversal ends, and how many second codewords share a region."""

    first: np.ndarray
    second: np.ndarray
    limit: float
    together: int

    @property
    def k(self) -> int:
        return len(self.first)

    def slacks(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared slack of every codeword of either half, by vector."""
        half = unit.shape[1] // 2
        out = []
        for part, book in ((unit[:, :half], self.first), (unit[:, half:], self.second)):
            squared = (part * part).sum(1)[:, None] - 2 * part @ book.T + (book * book).sum(1)
            distance = np.sqrt(np.maximum(squared, 0))
            out.append(((distance - distance.min(1, keepdims=True)) / 2) ** 2)
        return out[0], out[1]

    def visits(self, first: np.ndarray, second: np.ndarray) -> list[int]:
        """Cells of one vector by growing sum of slacks, its own first: the multi-sequence traversal."""
        a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
        x, y = first[a].tolist(), second[b].tolist()
        heap, seen, out = [(x[0] + y[0], 0, 0)], {(0, 0)}, []
        while heap:
            total, i, j = heapq.heappop(heap)
            if total > self.limit:
                break
            out.append(int(a[i]) * self.k + int(b[j]))
            for following in ((i + 1, j), (i, j + 1)):
                if following[0] < len(x) and following[1] < len(y) and following not in seen:
                    seen.add(following)
                    heapq.heappush(heap, (x[following[0]] + y[following[1]], *following))
        return out

    def ahead(self, cells: list[int]) -> dict[int, list[int]]:
        """Of a vector's visits those to its own cell and cells of higher number, by region: the others visit it."""
        out: dict[int, list[int]] = {}
        for c in cells:
            if c >= cells[0]:
                out.setdefault(self.region(c), []).append(c)
        return out

    def region(self, cell: int) -> int:
        return cell // self.k * self.k + cell % self.k // self.together


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def codebook(points: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means; the codewords are sorted along the widest direction, so that neighbours tend to be near."""
    book = points[rng.choice(len(points), k, replace=len(points) < k)].copy()
    for _ in range(ROUNDS):
        near = np.argmin((book * book).sum(1) - 2 * points @ book.T, axis=1)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(book)
        np.add.at(sums, near, points)
        book = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], points[rng.integers(len(points), size=k)])
    axis = np.linalg.svd(book - book.mean(0), full_matrices=False)[2][0]
    return book[np.argsort(book @ axis, kind="stable")]


def fit(sample: np.ndarray, n: int, cosine: float, recall: float = TARGET_RECALL, seed: int = 7) -> MultiIndex:
    """Codebooks for n vectors: about four times the fourth root of n codewords each, so cells grow slowly.

    The end of the traversal is the quantile ``recall`` of the slack sums at which vectors turned by exactly the
    threshold's angle are found, in random directions or in those of the sample's own differences, whichever takes
    more; it is never beyond the bound that can't miss.
    """
    rng = np.random.default_rng(seed)
    unit = unit_rows(sample.astype(float))
    k = int(min(1024, max(4, 1 << round(np.log2(4 * max(n, 1) ** 0.25)))))
    half = unit.shape[1] // 2
    first, second = codebook(unit[:, :half], k, rng), codebook(unit[:, half:], k, rng)
    index = MultiIndex(first, second, 0.0, max(1, min(k, round(BLOCK * k * k / max(n, 1)))))
    some = unit[rng.choice(len(unit), 4096)]
    limit = 0.0
    # in any direction, and in directions in which the vectors themselves differ
    for aside in (rng.normal(size=some.shape), unit[rng.choice(len(unit), 4096)] - unit[rng.choice(len(unit), 4096)]):
        aside = aside - (aside * some).sum(1, keepdims=True) * some
        length = np.linalg.norm(aside, axis=1)
        near, aside = some[length > 1e-9], aside[length > 1e-9]
        if len(near):
            turned = cosine * near + np.sqrt(1 - cosine**2) * unit_rows(aside)
            a, b = index.slacks(near)
            own = [np.argmin(x, 1) for x in index.slacks(turned)]
            rows = np.arange(len(near))
            limit = max(limit, float(np.quantile(a[rows, own[0]] + b[rows, own[1]], recall)))
    return MultiIndex(first, second, min(limit, 2 - 2 * cosine), index.together)


def vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, dims, key, vector): a vector's bytes and a key of them; nulls for vectors that link with nothing.

    The bytes are float32 where that says the same, so that a vector of floats isn't carried along as doubles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, keys, values = [], [], []
            for v in b.column("vector").to_pylist():
                good = bool(v) and None not in v
                x = np.array(v, float) if good else None
                if good and np.isfinite(x).all() and x.any():
                    scale = np.abs(x).max()
                    x = x if 1e-100 < scale < 1e100 else x / scale  # so that squares neither vanish nor overflow
                    dims.append(len(x))
                    x = x if len(x) > 1 else np.append(x, 0.0)  # the halves have a number each; the cosine stays
                    single = x.astype(np.float32)
                    data = (single if (single == x).all() else x).tobytes()
                    keys.append(xxhash.xxh3_128_digest(data))
                    values.append(data)
                else:
                    dims.append(0)
                    keys.append(None)
                    values.append(None)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(dims, pa.int32()), pa.array(keys, pa.binary()), pa.array(values, pa.binary())], ["vec_id", "dims", "key", "vector"])

    rows = picked(table, vec_id=id_col, vector=vector_col).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector"))
    return rows.mapInArrow(run, "vec_id long, dims int, key binary, vector binary")


def unpacked(values: list[bytes], dims: int) -> np.ndarray:
    """float64 rows of vectors' bytes; those of one number have a nought beside it."""
    dims = max(dims, 2)
    if all(len(v) == 4 * dims for v in values):
        return np.frombuffer(b"".join(values), np.float32).reshape(-1, dims).astype(float)
    return np.array([np.frombuffer(v, np.float32 if len(v) == 4 * dims else float) for v in values], float).reshape(-1, dims)


def placed(nodes: DataFrame, indexes: dict[int, MultiIndex]) -> DataFrame:
    """nodes with their cell, its region, and by region the cells they visit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = b.column("dims").to_numpy()
            for dims in np.unique(lengths).tolist():
                part, index = b.take(pa.array(np.flatnonzero(lengths == dims))), indexes[dims]
                x = unpacked(part.column("vector").to_pylist(), dims)
                cells = [index.visits(p, q) for p, q in zip(*index.slacks(unit_rows(x)), strict=True)]
                arrays = [*(part.column(c) for c in ("dims", "node", "weight", "vector")), pa.array([c[0] for c in cells], pa.int32()), pa.array([index.region(c[0]) for c in cells], pa.int32())]
                visits = [[{"region": k, "cells": v} for k, v in index.ahead(c).items()] for c in cells]
                arrays.append(pa.array(visits, pa.list_(pa.struct([("region", pa.int32()), ("cells", pa.list_(pa.int32()))]))))
                yield pa.RecordBatch.from_arrays(arrays, ["dims", "node", "weight", "vector", "cell", "region", "visits"])

    rows = nodes.select("dims", "node", "weight", "vector")
    return rows.mapInArrow(run, "dims int, node long, weight long, vector binary, cell int, region int, visits array<struct<region:int,cells:array<int>>>")


class _Block:
    """One block of a region's vectors, what its visitors meet there, and the links found."""

    def __init__(self, dims: int, cosine: float):
        self.dims, self.cosine = dims, cosine
        self.rows: list[tuple] = []
        self.ready = False
        self.counts: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []
        self.forest = Forest()

    def _arrays(self, rows: list[tuple]) -> tuple[np.ndarray, ...]:
        unit = unit_rows(unpacked([r[2] for r in rows], self.dims))
        return unit, np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[3] for r in rows])

    def meet(self, visitors: list[tuple]) -> None:
        """Verify visitors with the members of cells they visit; of one cell's members the smaller id visits the greater."""
        if not self.rows or not visitors:
            return
        if not self.ready:
            self.unit, self.ids, self.weights, self.cells = self._arrays(self.rows)
            self.local = {c: i for i, c in enumerate(np.unique(self.cells).tolist())}
            self.place = np.array([self.local[c] for c in self.cells.tolist()])
            self.roots = self.ids.copy()
            self.found = np.zeros(len(self.rows), np.int64)
            self.ready = True
        unit, ids, weights, cells = self._arrays(visitors)
        open_ = np.zeros((len(visitors), len(self.local)), bool)
        for i, r in enumerate(visitors):
            open_[i, [self.local[c] for c in r[4] if c in self.local]] = True
        good = (unit @ self.unit.T >= self.cosine) & open_[:, self.place]
        good &= (cells[:, None] != self.cells) | (ids[:, None] < self.ids)
        some, there = np.flatnonzero(good.any(1)), np.flatnonzero(good.any(0))
        if not len(some):
            return
        good = good[np.ix_(some, there)]
        for i, n in zip(ids[some].tolist(), (good @ self.weights[there]).tolist(), strict=True):
            self.counts[i] = self.counts.get(i, 0) + n
        self.found[there] += weights[some] @ good
        for i, row in zip(ids[some].tolist(), good, strict=True):
            at = there[row]
            # one link for each tree that the visitor's members stand in
            for k in np.unique(self.roots[at], return_index=True)[1]:
                other = int(self.ids[at[k]])
                if self.forest.join(i, other):
                    self.links.append((i, other))
            self.roots[np.isin(self.roots, self.roots[at])] = self.forest.root(i)

    def counted(self) -> dict[int, int]:
        if self.ready:
            for i, n in zip(self.ids.tolist(), self.found.tolist(), strict=True):
                if n:
                    self.counts[i] = self.counts.get(i, 0) + n
        return self.counts


def link_counts(cells: DataFrame, regions: DataFrame, cosine: float) -> DataFrame:
    """(u, v, n): links counted for u where v is null, else a link between u and v.  regions: their numbers of blocks."""
    body = ["node", "weight", "vector", "cell"]
    none = F.lit(None).cast("array<int>").alias("visits")
    members = cells.join(regions, ["dims", "region"]).select("dims", "region", F.pmod(F.xxhash64("node"), "_blocks").alias("block"), F.lit(0).alias("side"), *body, none)
    visitors = cells.select("dims", *body, F.explode("visits").alias("v")).select("dims", *body, F.col("v.region").alias("region"), F.col("v.cells").alias("visits"))
    visitors = visitors.join(regions, ["dims", "region"]).select("dims", "region", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("block"), F.lit(1).alias("side"), *body, "visits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block, held = None, _Block(0, cosine), []

        def result() -> pa.RecordBatch:
            block.meet(held)
            held.clear()
            counts = block.counted()
            u = [*counts, *(a for a, _ in block.links)]
            v = [*[None] * len(counts), *(b for _, b in block.links)]
            n = [*counts.values(), *[None] * len(block.links)]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (u, v, n)], ["u", "v", "n"])

        for b in batches:
            keys = zip(b.column("dims").to_pylist(), b.column("region").to_pylist(), b.column("block").to_pylist(), strict=True)
            rows = zip(*(b.column(c).to_pylist() for c in ("node", "weight", "vector", "cell", "visits")), strict=True)
            for k, side, row in zip(keys, b.column("side").to_pylist(), rows, strict=True):
                if k != key:
                    yield result()
                    key, block = k, _Block(k[0], cosine)
                if side == 0:
                    block.rows.append(row)
                else:
                    held.append(row)
                    if len(held) >= VISITORS:
                        block.meet(held)
                        held.clear()
        yield result()

    dealt = members.unionByName(visitors).repartition("dims", "region", "block").sortWithinPartitions("dims", "region", "block", "side")
    return dealt.mapInArrow(run, "u long, v long, n long")


def sampled(classes: DataFrame, sizes: dict[int, int]) -> dict[int, list[bytes]]:
    """By length the vectors that codebooks are fitted on, chosen by a hash of their key."""
    everything, spark = sum(sizes.values()), classes.sparkSession
    upto = [(dims, float(min(1.0, max(SAMPLE * n / everything, LEAST) / n))) for dims, n in sizes.items()]
    shares = F.broadcast(spark.createDataFrame(upto, "dims int, _share double"))
    chosen = classes.join(shares, "dims").where(F.pmod(F.xxhash64("key"), F.lit(1 << 40)) <= F.col("_share") * (1 << 40)).select("dims", "vector")
    out: dict[int, list[bytes]] = {}
    for r in chosen.toLocalIterator():
        out.setdefault(r["dims"], []).append(bytes(r["vector"]))
    return out


def near_vectors(table: DataFrame, cosine: float = 0.95, recall: float = TARGET_RECALL, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors that are null, empty or nought, or hold nulls or non-finite numbers, link with nothing; vectors of
    different lengths don't link with each other.  Equal vectors count as one node of their number and link with each
    other; rows repeated under one vec_id are rows of their own, and so are rows without one, whose component may have no
    smallest vec_id: it is null then, and they are kept.  A vec_id shouldn't stand for different vectors: what
    one is linked with, the other is too.  An empty table gives none.
    """
    rows = materialize(vectors(table, id_col, vector_col), "vectors")
    alone = F.col("vec_id")
    good = rows.where("dims > 0")
    classes = good.groupBy("dims", "key").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.first("vector").alias("vector"))
    # vectors of no id at all have to be called something
    classes = materialize(classes.withColumn("node", F.coalesce("least", F.xxhash64("dims", "key"))), "nodes")
    # a row for each length there is
    sizes = {r["dims"]: r["count"] for r in classes.groupBy("dims").count().collect()}
    if not sizes:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), alone.alias("component_id"), F.lit(True).alias("kept"))
    samples = sampled(classes, sizes)
    # the least hash of a short list may lie above its share
    for dims in sizes.keys() - samples.keys():
        samples[dims] = [bytes(classes.where(F.col("dims") == dims).first()["vector"])]
    indexes = {dims: fit(unpacked(samples[dims], dims), n, cosine, recall) for dims, n in sizes.items()}
    cells = materialize(placed(classes, indexes), "cells")
    regions = materialize(cells.groupBy("dims", "region").agg(F.ceil(F.count("*") / BLOCK).alias("_blocks")), "regions")
    found = materialize(link_counts(cells, regions, cosine), "found")
    release(cells, regions)
    counts = found.where("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("_n"))
    components = connected_components(found.where("v is not null").select("u", "v")).withColumnsRenamed({"id": "node", "component_id": "_component"})
    nodes = classes.drop("vector").join(counts, "node", "left").join(components, "node", "left")
    nodes = nodes.select("dims", "key", "least", (F.coalesce("_n", F.lit(0)) + F.col("weight") - 1).alias("_links"), F.coalesce("_component", "node").alias("_root"))
    nodes = materialize(nodes, "node-links")
    # written before it is joined, so that Spark can split a large component
    least = materialize(nodes.groupBy("_root").agg(F.min("least").alias("_component")), "components")
    nodes = nodes.drop("least").join(least, "_root")
    release(classes, found)
    component = F.coalesce("_component", alone)
    out = rows.join(nodes, ["dims", "key"], "left")
    return out.select("vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), alone.eqNullSafe(component).alias("kept"))
