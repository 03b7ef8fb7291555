"""Repair of conversations: the cheapest edits after which the roles are ``(s?(ua)+)?``.

A dynamic program over the retained turns.  What lies between two retained turns costs the sum of its deletions, read
off prefix sums, and the inserts that the pair of roles needs; the least over all retained turns that can follow is a
running minimum for each state.  Audits break ties: among edits of equal cost the first in ASCII order is taken.

A conversation may hold any share of all rows, so the rows are dealt out by ranges of (conversation, turn).  A part of
a conversation is priced from each state to each state; the parts' prices, sixteen numbers each, are put together for
the few conversations that span partitions.  Only the SHA-256 of a repaired conversation needs all of its texts in
order: they pass through a task as a stream, none of them held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import ASCII_SPACE, in_order, materialize, picked, release

#: Fixed values of the contract: prices of edits.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States by what was retained last: nothing, a system turn, a user's, an assistant's.  Which roles may follow in each.
AFTER = {"s": 1, "u": 2, "a": 3}
MAY_FOLLOW = ("su", "u", "a", "u")
#: The one role of user and assistant that may follow, and so what a reroled or an inserted turn becomes.
NEEDED = ("u", "u", "a", "u")
NAMES = {"u": "user", "a": "assistant"}
#: Inserts after the last turn.
CLOSING = (0, 2, 1, 0)
#: Rows of a range partition, on average: what one task prices at once.
PART_ROWS = 16_384
NEVER = 1 << 60

#: A turn as priced: initial of its role, has to be deleted, is truncated.
Turn = tuple[str, bool, bool]


def prices(turns: list[Turn], ends: list[int]) -> list[list[int]]:
    """[place][state]: the least cost of all edits from a place on, if the end costs ``ends[state]``."""
    n = len(turns)
    deleted = [DELETE * i for i in range(n + 1)]  # prefix sums: what lies between places i and j costs deleted[j] - deleted[i]
    out = [ends] * (n + 1)
    # the least over turns retained from here on that come next in a state, counted from the first place
    least = [NEVER] * 4
    closed = [deleted[n] + e for e in ends]
    for i in range(n - 1, -1, -1):
        initial, must_go, cut = turns[i]
        if not must_go:
            own = deleted[i] + (TRUNCATED if cut else 0)
            for state in range(4):
                keep = own + out[i + 1][AFTER[initial]] if initial and initial in MAY_FOLLOW[state] else NEVER
                least[state] = min(least[state], keep, own + REROLE + out[i + 1][AFTER[NEEDED[state]]])
        row = []
        for state in range(4):
            best, at, added = closed[state], state, 0
            for _ in range(3):  # none, one or two inserts before the next retained turn: more only repeat a state
                best = min(best, least[at] + added)
                at, added = AFTER[NEEDED[at]], added + INSERT
            row.append(best - deleted[i])
        out[i] = row
    return out


def audit(turns: list[Turn], ends: list[int], start: int) -> tuple[int, str, int]:
    """(cost, edits, state at the end): of the cheapest edits the first in ASCII order, D before I, K and R."""
    cost, state, edits, i, n = prices(turns, ends), start, [], 0, len(turns)
    while i < n:
        here = cost[i][state]
        initial, must_go, cut = turns[i]
        own = TRUNCATED if cut else 0
        if DELETE + cost[i + 1][state] == here:
            edits.append("D")
            i += 1
        elif INSERT + cost[i][AFTER[NEEDED[state]]] == here:
            edits.append("I")
            state = AFTER[NEEDED[state]]
        else:
            kept = not must_go and initial and initial in MAY_FOLLOW[state] and own + cost[i + 1][AFTER[initial]] == here
            edits.append("K" if kept else "R")
            state = AFTER[initial if kept else NEEDED[state]]
            i += 1
    return cost[0][start], "".join(edits), state


#: At the end of a conversation, and at the end of a part that has to end in one state.
AT_END = [INSERT * n for n in CLOSING]
ONLY = [[0 if s == t else NEVER for s in range(4)] for t in range(4)]

SEGMENTS = pa.schema([
    ("conv_id", pa.int64()), ("pid", pa.int64()), ("whole", pa.bool_()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
    ("first", pa.string()), ("last", pa.string()), ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int32())), ("audits", pa.list_(pa.string())),
])
SEGMENTS_DDL = "conv_id long, pid long, whole boolean, blank long, duplicate long, truncated long, illegal long, first string, last string, costs array<long>, ranks array<int>, audits array<string>"


def table_of(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def priced_parts(key: tuple, turns: pa.Table) -> pa.Table:
    """A range partition's conversations: whole ones with their edits, the first and last, which may go on elsewhere, from each state to each."""
    turns = turns.sort_by("k")
    ids, initials, blanks, twice, cuts = (turns.column(c).to_pylist() for c in ("conv_id", "initial", "blank", "duplicate", "cut"))
    rows, at, n, pid = [], 0, turns.num_rows, key[0].as_py()
    while at < n:
        end = at
        while end < n and ids[end] == ids[at]:
            end += 1
        part = [(initials[i], blanks[i] or twice[i], cuts[i]) for i in range(at, end)]
        illegal = sum(initials[i] + initials[i + 1] not in ("su", "ua", "au") for i in range(at, end - 1))
        if whole := 0 < at and end < n:
            cost, edits, state = audit(part, AT_END, 0)
            costs, ranks, audits = [cost], [0], [edits + "I" * CLOSING[state]]
        else:
            # only what comes first in the partition can have begun in another one
            costs, ranks, audits = [NEVER] * 16, [0] * 16, [""] * 16
            for start in range(4 if at == 0 else 1):
                for target in range(4):
                    cost = prices(part, ONLY[target])[0][start]
                    if cost < NEVER:
                        costs[4 * start + target], audits[4 * start + target], _ = audit(part, ONLY[target], start)
                order = sorted(range(4), key=lambda t, start=start: audits[4 * start + t])
                for rank, target in enumerate(order):
                    ranks[4 * start + target] = rank
        rows.append((ids[at], pid, whole, sum(blanks[at:end]), sum(twice[at:end]), sum(cuts[at:end]), illegal, initials[at], initials[end - 1], costs, ranks, audits))
        at = end
    return table_of(rows, SEGMENTS)


CHOICES = pa.schema([("conv_id", pa.int64()), ("pid", pa.int64()), ("cell", pa.int32()), ("closing", pa.int32()), ("seams", pa.int64())])


def chosen_states(key: tuple, parts: pa.Table) -> pa.Table:
    """The states at the seams of one conversation's parts: the cheapest way, of ties that with the first edits in ASCII order.

    Edits from one state over the same turns never begin each other, so where ways part the order of the part's edits decides.
    """
    rows = parts.sort_by("pid").to_pylist()
    cost = [AT_END]
    for r in reversed(rows):
        cost.append([min(r["costs"][4 * s + t] + cost[-1][t] for t in range(4)) for s in range(4)])
    cost.reverse()
    state, out, last = 0, [], None
    for i, r in enumerate(rows):
        ways = [t for t in range(4) if r["costs"][4 * state + t] + cost[i + 1][t] == cost[i][state]]
        target = min(ways, key=lambda t, r=r, state=state: r["ranks"][4 * state + t])
        seam = int(last is not None and last + r["first"] not in ("su", "ua", "au"))
        out.append((r["conv_id"], r["pid"], 4 * state + target, CLOSING[target] if i == len(rows) - 1 else 0, seam))
        state, last = target, r["last"]
    return table_of(out, CHOICES)


REPAIRED = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])


def repaired_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation, from rows in order: a part's edits come before its turns."""
    current, state, edits, sha, lines, out, begun = None, 0, iter(""), None, 0, [], False

    def line(role: str, text: str) -> None:
        nonlocal lines
        sha.update(f"{chr(10) if lines else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        lines += 1

    def inserts(then: str) -> str:
        """Write the inserts that come next; the edit after them."""
        nonlocal state
        for edit in edits:
            if edit != "I":
                return edit
            line(NAMES[NEEDED[state]], "")
            state = AFTER[NEEDED[state]]
        return then

    def finish() -> None:
        inserts("")
        out.append((current, sha.hexdigest()))

    for b in batches:
        for conv, k, edit_row, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "k", "audit", "role", "text")), strict=True):
            if not begun or conv != current:
                if begun:
                    finish()
                current, state, sha, lines, edits, begun = conv, 0, hashlib.sha256(), 0, iter(""), True
            if k < 0:
                inserts("")
                edits = iter(edit_row)
                continue
            edit = inserts("")
            if edit in ("K", "R"):
                initial = role[:1] if edit == "K" else NEEDED[state]
                line(role if edit == "K" else NAMES[initial], text)
                state = AFTER[initial]
        if out:
            yield from table_of(out, REPAIRED).to_batches()
            out = []
    if begun:
        finish()
        yield from table_of(out, REPAIRED).to_batches()


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage to rows (conv_id, turn, role, text): a row lost, emptied, without stops, twice, or the user's."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = rows.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("_how")).where("_how <> 0")
    text = F.when(F.col("_how") == 1, "").when(F.col("_how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_how") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("_how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")).drop("_copy")


def faults(rows: DataFrame) -> DataFrame:
    """rows with initial, blank, cut and a digest of role and text."""
    end = F.rtrim("text", F.lit(ASCII_SPACE.decode()))
    blank = end == ""
    said = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    return rows.select(
        "*", F.substring("role", 1, 1).alias("initial"), blank.alias("blank"), (~blank & ~F.substring(end, -1, 1).isin(".", "!", "?")).alias("cut"), F.unhex(F.sha2(said.cast("binary"), 256)).alias("digest")
    )


def repair(conversations: DataFrame, damage=damaged, part_rows: int = PART_ROWS, columns: tuple[str, ...] = ("conv_id", "turn", "role", "text")) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``damage`` is applied to the rows (conv_id, turn, role, text) first.  Turns ascend, nulls first; rows of one turn by role, then by
    text (of these the first 50 and 200 characters, then a hash), so that the order of rows that repeat doesn't matter.
    Null roles and texts are one space after the damage of the contract, which has no role's initial and is blank.  Rows of null
    conv_id are a conversation.  One without rows after the damage has zeros, an empty audit and the hash of the empty
    string.  An empty table gives none.
    """
    source = picked(conversations, conv_id=columns[0], turn=columns[1], role=columns[2], text=columns[3])
    source = source.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    left = damage(source)
    left = left.select("conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")))
    rows = materialize(faults(left).withColumn("_row", F.monotonically_increasing_id()), "turns")
    order: list[Column] = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.substring("role", 1, 50), F.substring("text", 1, 200), F.col("digest"), F.col("_row")]
    placed = in_order(rows, order, part_rows, "turns-in-order")
    release(rows)
    # the first row of each role and text in a conversation; summed up before the shuffle, however many there are
    said = placed.where("not blank").groupBy("conv_id", "digest").agg(F.min(F.struct("pid", "k")).alias("_first"))
    firsts = said.select("_first.pid", "_first.k", F.lit(True).alias("_new"))
    turns = placed.select("conv_id", "pid", "k", "initial", "blank", "cut").join(firsts, ["pid", "k"], "left")
    again = ~F.col("blank") & F.col("_new").isNull()
    turns = turns.select("conv_id", "pid", "k", "initial", "blank", again.alias("duplicate"), (F.col("cut") & ~again).alias("cut"))
    parts = materialize(turns.groupBy("pid").applyInArrow(priced_parts, SEGMENTS_DDL), "conversation-parts")
    seams = parts.where("not whole").select("conv_id", "pid", "costs", "ranks", "first", "last").groupBy("conv_id")
    choices = seams.applyInArrow(chosen_states, "conv_id long, pid long, cell int, closing int, seams long").toDF("_conv", "_pid", "cell", "closing", "seams")
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("pid") == F.col("_pid"))
    edits = F.concat(F.get("audits", "cell"), F.repeat(F.lit("I"), F.col("closing")))
    split = parts.where("not whole").join(choices, same).select(
        "conv_id", "pid", "blank", "duplicate", "truncated", (F.col("illegal") + F.col("seams")).alias("illegal"), (F.get("costs", "cell") + INSERT * F.col("closing")).alias("cost"), edits.alias("audit")
    )
    whole = parts.where("whole").select("conv_id", "pid", "blank", "duplicate", "truncated", "illegal", F.get("costs", F.lit(0)).alias("cost"), F.get("audits", F.lit(0)).alias("audit"))
    edited = materialize(whole.unionByName(split), "edited-parts")
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    audits = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pid", "audit"))), lambda p: p["audit"]), "")
    summed = edited.groupBy("conv_id").agg(*sums, audits.alias("audit"))
    texts = placed.select("conv_id", "pid", "k", F.lit(None).cast("string").alias("audit"), "role", "text")
    heads = edited.select("conv_id", "pid", F.lit(-1).cast("long").alias("k"), "audit", *(F.lit(None).cast("string").alias(c) for c in ("role", "text")))
    stream = texts.unionByName(heads).repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "pid", "k")
    hashes = stream.mapInArrow(repaired_hashes, "conv_id long, repaired_sha256 string")
    once = placed.select("conv_id", "turn").distinct()
    gaps = once.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    out = source.select("conv_id").distinct()
    for i, more in enumerate((gaps, summed, hashes)):
        key = f"_conv{i}"
        out = out.join(more.withColumnRenamed("conv_id", key), F.col("conv_id").eqNullSafe(F.col(key)), "left").drop(key)
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
