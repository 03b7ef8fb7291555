"""Merkle manifest of a dataset: a tree of each source's documents, a tree of the sources, a proof for every document.

Rows are dealt out by ranges of (source, doc_id), so that a large source is many partitions.  Each partition folds its
leaves into a sparse forest: the nodes whose run of siblings isn't whole there, by level and index.  Forests merge in
any grouping with the same result, so those of neighbouring partitions are merged in rounds, sixteen at a time, until
only roots are left.  What a partition lacks for its proofs are the siblings at its two borders, a few on each level.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.llm.common import in_order, materialize, picked, release

#: Fixed value of the contract: siblings of a run.
ARITY = 3
#: Rows of a range partition, on average: what one task holds.
PART_ROWS = 32_768
#: Neighbouring forests merged by one task in a round.
FAN = 16


def digest(parts: str) -> str:
    return hashlib.sha256(parts.encode()).hexdigest()


def widths(total: int) -> list[int]:
    """Nodes of each level of a tree with so many leaves, up to the root."""
    out = [total]
    while out[-1] > 1:
        out.append(-(-out[-1] // ARITY))
    return out


class Forest:
    """The nodes of one tree whose siblings aren't all known, by (level, index); ``made`` are the parents found so far."""

    def __init__(self, total: int):
        self.widths = widths(total)
        self.open: dict[tuple[int, int], str] = {}
        self.made: dict[tuple[int, int], str] = {}

    def run(self, level: int, index: int) -> range:
        first = index - index % ARITY
        return range(first, min(first + ARITY, self.widths[level]))

    def add(self, level: int, index: int, node: str) -> None:
        """Put a node in; each run that is whole by it becomes its parent.  The order of additions doesn't matter."""
        while True:
            self.open[level, index] = node
            if level == len(self.widths) - 1:
                return
            run = self.run(level, index)
            children = [self.open.get((level, i)) for i in run]
            if None in children:
                return
            for i in run:
                del self.open[level, i]
            level, index, node = level + 1, index // ARITY, digest("".join(children))
            self.made[level, index] = node

    def is_root(self, level: int) -> bool:
        return level == len(self.widths) - 1


NODES = pa.schema([("tree", pa.string()), ("total", pa.int64()), ("level", pa.int32()), ("index", pa.int64()), ("node", pa.string()), ("pid", pa.int64()), ("open", pa.bool_()), ("root", pa.bool_())])
NODES_DDL = "tree string, total long, level int, index long, node string, pid long, open boolean, root boolean"


def node_rows(trees: list[tuple[str | None, int, Forest]], pid: int, made: bool) -> pa.Table:
    """Open nodes of forests, and with ``made`` those made on the way."""
    rows = []
    for tree, total, forest in trees:
        for at in {**forest.open, **(forest.made if made else {})}:
            rows.append((tree, total, *at, forest.open.get(at) or forest.made[at], pid, at in forest.open, forest.is_root(at[0])))
    columns = zip(*rows, strict=True) if rows else [[]] * len(NODES)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, NODES, strict=True)], schema=NODES)


def local_forest(part: dict, hashes: list[str]) -> Forest:
    forest = Forest(part["total"])
    for i in range(part["rows"]):
        forest.add(0, part["offset"] + i, hashes[part["first"] + i])
    return forest


def fold_part(key: tuple, leaves: pa.Table, parts: pa.Table) -> pa.Table:
    """A partition's leaves as forests, one for each tree that it has leaves of."""
    hashes = leaves.sort_by("k").column("hash").to_pylist()
    trees = [(p["tree"], p["total"], local_forest(p, hashes)) for p in parts.to_pylist()]
    return node_rows(trees, key[0].as_py(), made=False)


def merge_forests(key: tuple, nodes: pa.Table) -> pa.Table:
    """The forests of neighbouring partitions as one."""
    forests: dict[str | None, Forest] = {}
    for r in nodes.to_pylist():
        forests.setdefault(r["tree"], Forest(r["total"])).add(r["level"], r["index"], r["node"])
    totals = {r["tree"]: r["total"] for r in nodes.to_pylist()}
    return node_rows([(tree, totals[tree], f) for tree, f in forests.items()], key[0].as_py(), made=True)


def border_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pid, tree, level, index) of siblings that a partition's part of a tree lacks: those not wholly below its leaves."""
    for b in batches:
        rows = []
        for p in b.to_pylist():
            low, high = p["offset"], p["offset"] + p["rows"]  # nodes of the level that are whole here
            first, last = low, high - 1  # nodes of the level that have leaves here
            sizes = widths(p["total"])
            for level, width in enumerate(sizes[:-1]):
                for i in range(first - first % ARITY, min(last - last % ARITY + ARITY, width)):
                    if not low <= i < high:
                        rows.append((p["pid"], p["tree"], level, i))
                low, high = -(-low // ARITY), sizes[level + 1] if high == width else high // ARITY
                first, last = first // ARITY, last // ARITY
        columns = zip(*rows, strict=True) if rows else [[]] * 4
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["pid", "tree", "level", "index"])


@dataclass
class Trees:
    """Leaves in order (pid, k, hash and more), the parts of trees by partition, roots, and siblings at borders."""

    leaves: DataFrame
    parts: DataFrame
    roots: DataFrame
    borders: DataFrame


def build(leaves: DataFrame, keys: list[Column], part_rows: int, label: str) -> Trees:
    """Trees over leaves, which have the columns tree (null is a tree too) and hash; keys order them within a tree."""
    placed = in_order(leaves, [F.col("tree").asc_nulls_first(), *keys], part_rows, label)
    own = Window.partitionBy("tree")
    parts = placed.groupBy("tree", "pid").agg(F.count("*").alias("rows"), F.min("k").alias("first"))
    before = F.coalesce(F.sum("rows").over(own.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = materialize(parts.withColumn("offset", before).withColumn("total", F.sum("rows").over(own)), f"{label}-parts")
    nodes = materialize(placed.select("pid", "k", "hash").groupBy("pid").cogroup(parts.groupBy("pid")).applyInArrow(fold_part, NODES_DDL), f"{label}-nodes")
    every, step = [nodes], 1
    while not (rest := nodes.where("open and not root")).isEmpty():
        step *= FAN
        merged = rest.withColumn("pid", F.col("pid") - F.col("pid") % step).groupBy("pid").applyInArrow(merge_forests, NODES_DDL)
        nodes = materialize(merged, f"{label}-nodes")
        every.append(nodes)
    known = every[0].select("tree", "level", "index", "node", "root")
    for more in every[1:]:  # what was made in a round; nodes that it only passed on are known
        known = known.unionByName(more.select(*known.columns))
    known = known.distinct()
    wanted = parts.where("rows < total").mapInArrow(border_keys, "pid long, tree string, level int, index long").toDF("pid", "_tree", "_level", "_index")
    met = F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("level") == F.col("_level")) & (F.col("index") == F.col("_index"))
    borders = materialize(wanted.join(known, met).select("pid", "tree", "level", "index", "node"), f"{label}-borders")
    roots = materialize(known.where("root").select("tree", F.col("node").alias("subroot")), f"{label}-roots")
    release(*every)
    return Trees(placed, parts, roots, borders)


class Paths:
    """Siblings on the way from leaves of one tree to its root; leaves are asked for in order, so one path is kept."""

    def __init__(self, forest: Forest, leaves: dict[tuple[int, int], str], borders: dict[tuple[int, int], str]):
        self.forest, self.known = forest, (leaves, forest.made, borders)
        self.last: list[tuple[int, list, str] | None] = [None] * len(forest.widths)

    def node(self, level: int, index: int) -> str:
        return next(found[level, index] for found in self.known if (level, index) in found)

    def above(self, level: int, index: int) -> tuple[list[tuple[str, str]], str]:
        """([(siblings to the left, to the right) of each level], all of them as one text)."""
        if self.forest.is_root(level):
            return [], ""
        kept = self.last[level]
        if kept is None or kept[0] != index:
            run = self.forest.run(level, index)
            left = "".join(self.node(level, i) for i in run if i < index)
            right = "".join(self.node(level, i) for i in run if i > index)
            sides, text = self.above(level + 1, index // ARITY)
            self.last[level] = kept = (index, [(left, right), *sides], left + right + text)
        return kept[1], kept[2]


def folded(leaf: str, sides: list[tuple[str, str]]) -> str:
    for left, right in sides:
        leaf = digest(left + leaf + right)
    return leaf


def part_paths(leaves: pa.Table, side: pa.Table) -> Iterator[tuple[dict, list[int], Paths]]:
    """For each tree with leaves here: its part, the rows of ``leaves`` (sorted by k) and their paths."""
    hashes = leaves.column("hash").to_pylist()
    rows = side.to_pylist()
    borders: dict[str | None, dict] = {}
    for r in rows:
        if r["level"] is not None:
            borders.setdefault(r["tree"], {})[r["level"], r["index"]] = r["node"]
    for p in rows:
        if p["level"] is None:
            forest = local_forest(p, hashes)
            own = {(0, p["offset"] + i): hashes[p["first"] + i] for i in range(p["rows"])}
            yield p, list(range(p["first"], p["first"] + p["rows"])), Paths(forest, own, borders.get(p["tree"], {}))


def with_borders(parts: DataFrame, borders: DataFrame) -> DataFrame:
    return parts.unionByName(borders, allowMissingColumns=True)


UPPER = pa.schema([("source", pa.string()), ("subroot", pa.string()), ("lefts", pa.list_(pa.string())), ("rights", pa.list_(pa.string()))])


def upper_paths(key: tuple, leaves: pa.Table, side: pa.Table) -> pa.Table:
    """The path of each source's subroot to the root."""
    leaves = leaves.sort_by("k")
    names, hashes = leaves.column("source").to_pylist(), leaves.column("hash").to_pylist()
    rows = []
    for part, places, paths in part_paths(leaves, side):
        for i in places:
            sides, _ = paths.above(0, part["offset"] + i - part["first"])
            rows.append((names[i], hashes[i], [s[0] for s in sides], [s[1] for s in sides]))
    columns = zip(*rows, strict=True) if rows else [[]] * len(UPPER)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, UPPER, strict=True)], schema=UPPER)


PROOFS = pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string())])


def document_proofs(key: tuple, leaves: pa.Table, side: pa.Table) -> pa.Table:
    """Each document's siblings up to the root, and the root that its leaf as found folds to."""
    leaves = leaves.sort_by("k")
    ids, hashes, found = (leaves.column(c).to_pylist() for c in ("doc_id", "hash", "found"))
    rows = []
    for part, places, paths in part_paths(leaves, side):
        upper = list(zip(part["lefts"], part["rights"], strict=True))
        rest = "".join(left + right for left, right in upper)
        for i in places:
            sides, text = paths.above(0, part["offset"] + i - part["first"])
            rows.append((ids[i], hashes[i], part["subroot"], digest(text + rest), folded(folded(found[i], sides), upper)))
    columns = zip(*rows, strict=True) if rows else [[]] * len(PROOFS)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, PROOFS, strict=True)], schema=PROOFS)


def leaf(*fields: Column) -> Column:
    """SHA-256 of the fields, each ``-`` if null, else its UTF-8 byte count, a colon and itself."""
    texts = [F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in (c.cast("string") for c in fields)]
    return F.sha2(F.concat(*texts).cast("binary"), 256)


def tampered_text(doc_id: Column, text: Column) -> Column:
    """The contract's damage: where the CRC-32 of the id is even the text loses its line feeds."""
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def manifest(docs: DataFrame, found_text=tampered_text, part_rows: int = PART_ROWS, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text")) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``found_text(doc_id, text)`` is the text that a document is checked with; proofs are those of the original table.  Sources
    and ids ascend, nulls first; rows of one source and id by their leaf, so repeated rows are leaves each and any order
    of them gives the same tree.  A null source is a tree of its own.  A row without id isn't damaged.  Empty and null
    texts differ in their leaves.  An empty table has no root and gives no rows.  A document's text is hashed where it is
    read and isn't shuffled.
    """
    rows = picked(docs, doc_id=columns[0], source=columns[1], lang=columns[2], n_chars=columns[3], text=columns[4])
    rest = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    own, other = leaf(*rest, F.col("text")), found_text(F.col("doc_id"), F.col("text"))
    found = F.when(other.eqNullSafe(F.col("text")), F.col("hash")).otherwise(leaf(*rest, other))
    rows = rows.withColumn("hash", own).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("tree"), "hash", found.alias("found"))
    leaves = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "leaves")
    lower = build(leaves, [F.col("doc_id").asc_nulls_first(), F.col("hash"), F.col("_row")], part_rows, "lower")
    subroots = lower.roots.select(F.lit(None).cast("string").alias("tree"), F.col("subroot").alias("hash"), F.col("tree").alias("source"))
    upper = build(subroots, [F.col("source").asc_nulls_first()], part_rows, "upper")
    root = upper.roots.select("subroot").first()
    paths = upper.leaves.groupBy("pid").cogroup(with_borders(upper.parts, upper.borders).groupBy("pid")).applyInArrow(upper_paths, "source string, subroot string, lefts array<string>, rights array<string>")
    parts = lower.parts.join(materialize(paths, "upper-paths"), F.col("tree").eqNullSafe(F.col("source"))).drop("source")
    side = with_borders(parts, lower.borders)
    proofs = lower.leaves.select("pid", "k", "doc_id", "hash", "found").groupBy("pid").cogroup(side.groupBy("pid"))
    out = proofs.applyInArrow(document_proofs, "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string")
    release(leaves)
    return out.select("doc_id", "leaf", "subroot", F.lit(root[0] if root else None).cast("string").alias("root"), "proof_sha256", "folded_root").withColumn("verified", F.col("folded_root") == F.col("root"))

