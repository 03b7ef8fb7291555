"""MinHash near-deduplication with SetSketch registers.

A document's set are its distinct word shingles.  A register holds the least of one hash over the set, taken to
an exponential variable and truncated to a power of the base: registers of a union are the maxima of the
registers, and two sets share a register with about the probability of their Jaccard similarity.  Bands of
registers make candidates, a likelihood over the registers' order estimates a pair's similarity jointly with the
known set sizes, and pairs that come near the threshold are verified on their full sets.

Equal sets count as one node.  In a bucket of candidates all are compared with one hub, the member with the
greatest company over all bands, so a group of near copies is one star; only members that the hub isn't linked
with are compared with the rest of the hub's group, in blocks inside tasks.  No list of all pairs is ever made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import arrow_rows, bounded, id_and_text, materialize, release, slices, utf8
from leafmill.llm.components import connected_components
from leafmill.llm.forest import Forest
from leafmill.llm.hashing import mix, text_words

BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 1
BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
#: Standard errors that an estimate may lie under the threshold before its pair is left unverified.
SLACK = 5.0
#: Members of a hub's group in one block: those left of the hub's links, and those they are compared with.
LEFT_BLOCK, GROUP_BLOCK = 256, 2048
#: A signature is the lowest bits of so many registers.  Members that differ from their hub in over WIDE of them
#: (a similarity under about a quarter) aren't of its group; those in over TIGHT look for a further hub in their bucket.
#: A member that stays with a hub thus has all others of its bucket beside it that it differs from in WIDE - TIGHT
#: bits at most; of pairs at a similarity of 0.8, which differ in 12.8 on average, some 3 in a million differ in more.
SIGNATURE, WIDE, TIGHT = 128, 48, 18
#: Hubs that a bucket may have before what is left of it is joined to one whatever the signatures say.
HUBS = 6

_ODD = np.uint64(0x9E3779B97F4A7C15)


_SEEDS = mix(np.arange(1, 2 * REGISTERS + 1, dtype=np.uint64) * _ODD)
_FACTOR, _ADDEND = _SEEDS[:REGISTERS] | np.uint64(1), _SEEDS[REGISTERS:]


def shingle_sets(texts: list[bytes], words: int = 2) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles; with fewer words the whole sequence is one."""
    out: list[np.ndarray] = []
    for own in text_words(texts):
        n = len(own)
        k = min(words, n)
        if not k:
            out.append(np.empty(0, np.uint64))
            continue
        joined = own[: n - k + 1].copy()
        for j in range(1, k):
            joined = mix(joined * _ODD + own[j : n - k + 1 + j])
        out.append(np.unique(joined + np.uint64(n if n < words else 0)))
    return out


def registers(shingles: np.ndarray) -> np.ndarray:
    """SetSketch registers: exponentially spaced truncated minima; all nought for an empty set."""
    if not len(shingles):
        return np.zeros(REGISTERS, np.uint16)
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 512):
        part = shingles[at : at + 512, None] * _FACTOR
        part += _ADDEND
        np.minimum(least, part.min(axis=0), out=least)
    exponential = -np.log1p(-((least >> np.uint64(11)).astype(float) + 0.5) / (1 << 53))
    return np.clip(np.floor(1.0 - np.log(exponential / RATE) / np.log(BASE)), 0, TOP).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


def band_keys(regs: np.ndarray) -> list[int]:
    """A signed 64-bit key of each band's registers."""
    return [xxhash.xxh3_64_intdigest(regs[k * ROWS : (k + 1) * ROWS].tobytes(), k) - (1 << 63) for k in range(BANDS)]


def estimated_similarity(n_a: np.ndarray, n_b: np.ndarray, greater: np.ndarray, less: np.ndarray) -> np.ndarray:
    """The likeliest Jaccard similarity for ``greater`` and ``less`` of the registers differing so, the sizes known.

    A register of a is the greater with probability p(u - v J), p(x) = -log_b(1 - x (b - 1) / b), where u and v
    are the sets' shares of n_a + n_b; the likelihood is concave in J, so its slope is bisected.
    """
    u = n_a / (n_a + n_b)
    v = 1.0 - u
    c, log_b = (BASE - 1) / BASE, np.log(BASE)
    same = REGISTERS - greater - less
    lo, hi = np.zeros(np.shape(u)), np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.maximum(x, 1e-12) * c) / log_b
    slope = lambda x: c / log_b / (1 - np.maximum(x, 1e-12) * c)
    for _ in range(14):
        j = (lo + hi) / 2
        a, b = u - v * j, v - u * j
        pa_, pb = p(a), p(b)
        da, db = -v * slope(a), -u * slope(b)
        rises = greater * da / pa_ + less * db / pb - same * (da + db) / np.maximum(1 - pa_ - pb, 1e-12) > 0
        lo, hi = np.where(rises, j, lo), np.where(rises, hi, j)
    return (lo + hi) / 2


def linked(n_a: np.ndarray, n_b: np.ndarray, shared: np.ndarray, percent: int) -> np.ndarray:
    return 100 * shared >= percent * (n_a + n_b - shared)


def likely(regs_a: np.ndarray, n_a: np.ndarray, regs_b: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs (rows of a, rows of b) may reach the threshold, by sizes first and then by their registers."""
    out = 100 * np.minimum(n_a[:, None], n_b) >= percent * np.maximum(n_a[:, None], n_b)
    floor = percent / 100 - SLACK * np.sqrt(percent / 100 * (1 - percent / 100) / REGISTERS)
    for i in np.flatnonzero(out.any(1)):
        at = np.flatnonzero(out[i])
        more, fewer = (regs_a[i] > regs_b[at]).sum(1), (regs_a[i] < regs_b[at]).sum(1)
        out[i, at] = estimated_similarity(np.full(len(at), float(n_a[i])), n_b[at].astype(float), more, fewer) >= floor
    return out


def shared_counts(a: list[np.ndarray], b: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs (row of a, row of b), by one product of bit matrices where there are many."""
    if len(pairs) <= 4 * (len(a) + len(b)):
        return np.array([len(np.intersect1d(a[i], b[j], assume_unique=True)) for i, j in pairs], np.int64)
    rows = np.repeat(np.arange(len(a) + len(b)), [len(s) for s in (*a, *b)])
    values, column, times = np.unique(np.concatenate((*a, *b)), return_inverse=True, return_counts=True)
    keep = times[column] > 1  # others are in no intersection
    rows, column = rows[keep], (np.cumsum(times > 1) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    total = np.zeros((len(a), len(b)), np.float32)
    width = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, width, 4096):
        lo, hi = np.searchsorted(column, (at, at + 4096))
        bits = np.zeros((len(a) + len(b), 4096), np.float32)
        bits[rows[lo:hi], column[lo:hi] - at] = 1
        total += bits[: len(a)] @ bits[len(a) :].T
    return total[pairs[:, 0], pairs[:, 1]].astype(np.int64)


def signature(regs: np.ndarray) -> tuple[int, int]:
    """The lowest bits of the first registers; sets of similarity J agree in about (1 + J) / 2 of them."""
    return tuple(np.packbits((regs[:SIGNATURE] & 1).astype(np.uint8)).view(np.int64).tolist())


SKETCHES_SQL = "doc_id long, text_key long, n_shingles long, set_key binary, bands array<long>, s1 long, s2 long"
SETS_SQL = "doc_id long, n_shingles long, registers binary, shingles binary"


def sketches(docs: DataFrame, words: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's set size, a key of its set and its bands' keys; text_key is a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = shingle_sets(utf8(b.column("text")), words)
            keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            regs = [registers(s) for s in sets]
            bands = [band_keys(r) if len(s) else None for r, s in zip(regs, sets, strict=True)]
            s1, s2 = zip(*map(signature, regs), strict=True)
            arrays = [b.column("doc_id"), b.column("text_key"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(s1, pa.int64()), pa.array(s2, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text_key", "n_shingles", "set_key", "bands", "s1", "s2"])

    return id_and_text(docs, id_col, text_col).withColumn("text_key", F.xxhash64("text")).mapInArrow(run, SKETCHES_SQL)


def full_sets(texts: DataFrame, words: int = 2) -> DataFrame:
    """Sets and registers of rows (node, set_key, text), called doc_id by their node; a text that hashes like the node's but has another set is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = zip(b.column("node").to_pylist(), b.column("set_key").to_pylist(), shingle_sets(utf8(b.column("text")), words), strict=True)
            own = [(node, s) for node, key, s in found if xxhash.xxh3_128_digest(s.tobytes()) == key]
            arrays = [pa.array([n for n, _ in own], pa.int64()), pa.array([len(s) for _, s in own], pa.int64()), pa.array([registers(s).tobytes() for _, s in own], pa.binary()), pa.array([s.tobytes() for _, s in own], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_shingles", "registers", "shingles"])

    return texts.mapInArrow(run, SETS_SQL)


def star_edges(sketch: DataFrame) -> DataFrame:
    """(hub, doc_id): members of buckets and the hubs they are near to by their signatures, each pair once.

    sketch: one row per distinct set, with the smallest id that has it (rank).  A bucket's hub, of those with most company the one of
    the smallest id as originals come before their copies, takes the members whose signatures are near; those not near
    enough to be linked for sure stay for a further hub of the bucket, chosen among them, until none are left.
    Buckets are counted and hubs chosen by aggregates that sum up before they shuffle, and are written before
    they are joined, so that Spark can split a hot bucket.
    """
    rows = sketch.select("doc_id", F.explode("bands").alias("bucket"))
    counts = materialize(rows.groupBy("bucket").agg(F.count("*").alias("_n")).where("_n > 1"), "bucket-counts")
    members = materialize(rows.join(counts, "bucket"), "buckets")
    company = members.groupBy("doc_id").agg(F.sum("_n").alias("_company")).join(sketch.select("doc_id", "rank", "s1", "s2"), "doc_id")
    left = materialize(members.drop("_n").join(company, "doc_id").select("bucket", "doc_id", "_company", "rank", "s1", "s2"), "bucket-members")
    release(members, counts)
    edges = []
    for k in range(HUBS):
        best = F.max(F.struct("_company", (-F.col("rank")).alias("_rank"), (-F.col("doc_id")).alias("_id"), "s1", "s2"))
        hubs = left.groupBy("bucket").agg(F.count("*").alias("_n"), best.alias("_h")).where("_n > 1")
        hubs = materialize(hubs.select("bucket", (-F.col("_h._id")).alias("hub"), F.col("_h.s1").alias("_h1"), F.col("_h.s2").alias("_h2")), "hubs")
        if hubs.isEmpty():
            break
        apart = F.bit_count(F.col("s1").bitwiseXOR(F.col("_h1"))) + F.bit_count(F.col("s2").bitwiseXOR(F.col("_h2")))
        met = materialize(left.join(hubs, "bucket").where("doc_id <> hub").withColumn("_apart", apart).drop("_h1", "_h2"), "met")
        near = met if k + 1 == HUBS else met.where(F.col("_apart") <= WIDE)
        edges.append(near.select("hub", "doc_id").distinct())
        release(left, hubs)
        left = met.where(F.col("_apart") > TIGHT).drop("hub", "_apart")
    union = edges[0] if edges else left.select(F.col("doc_id").alias("hub"), "doc_id").limit(0)
    for more in edges[1:]:
        union = union.union(more)
    return materialize(union.distinct(), "stars")


def _sets(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(v, np.uint64) for v in column.to_pylist()]


def _links(u: list[int], v: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def hub_links(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v, similar): each star edge, verified.  A task streams: a hub's set, then the members of that block."""
    blocks = materialize(edges.groupBy("hub").agg(F.ceil(F.count("*") / GROUP_BLOCK).alias("_blocks")), "hub-blocks")
    dealt = edges.join(blocks, "hub").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("_blocks")))
    body = F.col("n_shingles"), F.col("registers"), F.col("shingles")
    members = dealt.join(sets, "doc_id").select("hub", "block", F.lit(1).alias("side"), "doc_id", *body)
    hubs = dealt.select("hub", "block").distinct().join(sets.withColumnRenamed("doc_id", "hub"), "hub").select("hub", "block", F.lit(0).alias("side"), F.col("hub").alias("doc_id"), *body)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = regs = own = None
        for b in batches:
            u, v, good = [], [], []
            rows = zip(b.column("hub").to_pylist(), b.column("side").to_pylist(), b.column("doc_id").to_pylist(), b.column("registers").to_pylist(), _sets(b.column("shingles")), strict=True)
            for h, side, doc, reg, shingles in rows:
                reg = np.frombuffer(reg, np.uint16)[None]
                if side == 0:
                    hub, regs, own = h, reg, shingles
                    continue
                n, m = np.array([len(own)]), np.array([len(shingles)])
                near = h == hub and likely(regs, n, reg, m, percent)[0, 0]
                u.append(h)
                v.append(doc)
                good.append(bool(near and linked(n, m, shared_counts([own], [shingles], np.zeros((1, 2), int)), percent)[0]))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(good, pa.bool_())], ["u", "v", "similar"])

    together = hubs.unionByName(members).repartition("hub", "block").sortWithinPartitions("hub", "block", "side")
    return together.mapInArrow(run, "u long, v long, similar boolean")


def rest_links(stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) of members that their hub isn't linked with, to any other member of the hub's group.

    They are dealt in blocks against blocks of the group; a task holds one block of them, streams the others
    and returns links that join what nothing in the task joined before.
    """
    size = stars.groupBy("u").agg(F.count("*").alias("_n"), F.count_if(~F.col("similar")).alias("_rest")).where("_rest > 0 and _n > 1")
    sized = stars.join(materialize(size, "hub-sizes"), "u").withColumns({"_lefts": F.ceil(F.col("_rest") / LEFT_BLOCK), "_rights": F.ceil(F.col("_n") / GROUP_BLOCK)})
    left_of, right_of = F.pmod(F.xxhash64("v"), F.col("_lefts")), F.pmod(F.xxhash64("v", F.lit(1)), F.col("_rights"))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    lefts = sized.where("not similar").select("u", "v", "similar", left_of.alias("left"), F.explode(upto("_rights")).alias("right"), F.lit(0).alias("side"))
    rights = sized.select("u", "v", "similar", right_of.alias("right"), F.explode(upto("_lefts")).alias("left"), F.lit(1).alias("side"))
    rows = lefts.unionByName(rights).join(sets.withColumnRenamed("doc_id", "v"), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, lists, regs, forest = None, [], [], [], Forest()
        for b in batches:
            u, v = [], []
            cols = [b.column(c).to_pylist() for c in ("u", "left", "right", "side", "v", "similar", "registers")]
            held: list[tuple] = []

            def compare() -> None:
                if not ids or not held:
                    return
                theirs = [h[2] for h in held]
                n_a, n_b = np.array([len(s) for s in lists]), np.array([len(s) for s in theirs])
                near = likely(np.array(regs), n_a, np.array([h[3] for h in held]), n_b, percent)
                near &= np.array(ids)[:, None] != np.array([h[0] for h in held])
                pairs = np.argwhere(near)
                if len(pairs):
                    good = linked(n_a[pairs[:, 0]], n_b[pairs[:, 1]], shared_counts(lists, theirs, pairs), percent)
                    for i, j in pairs[good].tolist():
                        # what is linked with the hub is one node here
                        if forest.join(ids[i], key[0] if held[j][1] else held[j][0]):
                            u.append(ids[i])
                            v.append(held[j][0])

            for h, left, right, side, doc, similar, reg, shingles in zip(*cols, _sets(b.column("shingles")), strict=True):
                if (h, left, right) != key:
                    compare()
                    held.clear()
                    key, ids, lists, regs, forest = (h, left, right), [], [], [], Forest()
                if side == 0:
                    ids.append(doc)
                    lists.append(shingles)
                    regs.append(np.frombuffer(reg, np.uint16))
                else:
                    held.append((doc, similar, shingles, np.frombuffer(reg, np.uint16)))
                    if len(held) >= 512:
                        compare()
                        held.clear()
            compare()
            yield _links(u, v)

    dealt = rows.repartition("u", "left", "right").sortWithinPartitions("u", "left", "right", "side")
    return dealt.mapInArrow(run, "u long, v long")


def _components_of_sets(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Each row's set, and (set_key, n_shingles, _component) of each set; written tables."""
    sketch = materialize(sketches(docs, words, id_col, text_col), "sketches")
    # equal sets are one node with a number of its own, so that ids may repeat or be null
    filled = sketch.where("n_shingles > 0")
    same = filled.groupBy("set_key", "n_shingles").agg(F.min("doc_id").alias("least"), F.min(F.struct("text_key", "bands", "s1", "s2")).alias("_one"))
    classes = materialize(same.select("set_key", "n_shingles", "least", "_one.*").withColumn("node", F.monotonically_increasing_id()), "classes")
    edges = star_edges(classes.select(F.col("node").alias("doc_id"), F.col("least").alias("rank"), "bands", "s1", "s2"))
    ends = edges.select("doc_id").union(edges.select("hub")).distinct().withColumnRenamed("doc_id", "node")
    wanted = materialize(classes.join(ends, "node", "left_semi").select("text_key", "set_key", "node"), "wanted")
    texts = id_and_text(docs, id_col, text_col).select(F.xxhash64("text").alias("text_key"), "text").join(bounded(wanted), "text_key")
    # repeated texts of a node are dropped before they are hashed; texts that only share a hash stay, and full_sets tells them apart
    texts = texts.withColumns({"_hash": F.hash("text"), "_size": F.octet_length("text")}).dropDuplicates(["node", "_hash", "_size"])
    sets = materialize(full_sets(texts.select("node", "set_key", "text"), words), "sets")
    stars = materialize(hub_links(edges, sets, percent), "hub-links")
    links = materialize(stars.where("similar").select("u", "v").union(rest_links(stars, sets, percent)), "links")
    release(edges, wanted, sets, stars)
    found = connected_components(links).toDF("node", "_group")
    joined = materialize(classes.select("node", "set_key", "n_shingles", "least").join(found, "node", "left").withColumn("_group", F.coalesce("_group", "node")), "joined-classes")
    least = materialize(joined.groupBy("_group").agg(F.min("least").alias("_component")), "least-ids")
    nodes = materialize(joined.join(least, "_group").select("set_key", "n_shingles", "_component"), "components-of-sets")
    return sketch, nodes


def near_duplicates(docs: DataFrame, words: int = 2, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Linked are documents with 100 * intersection >= percent * union of their shingle sets, of whole texts however
    long.  Null, empty and blank texts have an empty set and are linked with nothing.  Every row of docs is a document:
    ids may repeat, with equal or other texts, or be null.  component_id is the smallest id that links reach, null where all
    of them are null; rows of one id and component are kept together.  An empty table gives none.  Ties don't arise: the
    smallest doc_id of a component stays.
    """
    with arrow_rows(docs.sparkSession):  # rows of sets are wide, and all steps that hold them run here
        sketch, nodes = _components_of_sets(docs, words, percent, id_col, text_col)
    out = sketch.select("doc_id", "set_key", "n_shingles").join(nodes, ["set_key", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("_component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
