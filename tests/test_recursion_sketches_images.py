"""Graphs, sketches, images and Markdown blocks on small and odd inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.operators import graphs, sketches
from leafmill.plans import writers
from leafmill.sources import images, markdown
from leafmill.streaming import events


def test_reached_is_breadth_first_search(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(70)] + [(1, 1), (None, 2), (2, None), (5, 6), (5, 6)] + [(i, i + 1) for i in range(100, 125)]
    start = [1, 5, 100, None, 5]
    hops, frontier = {n: 0 for n in start if n is not None}, {n for n in start if n is not None}
    k = 0
    while frontier:
        k += 1
        frontier = {b for a, b in edges if a in frontier and b is not None} - set(hops)
        hops |= dict.fromkeys(frontier, k)
    table, first = spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(n,) for n in start], "n long")
    got = graphs.reached(first, table).collect()
    assert {r["node"]: r["hops"] for r in got} == hops and len(got) == len(hops) and max(hops.values()) > graphs.TABLES
    assert {r["node"]: r["hops"] for r in graphs.reached(first, table, max_hops=2).collect()} == {n: h for n, h in hops.items() if h <= 2}
    assert graphs.reached(first, table.limit(0)).count() == 3 and graphs.reached(first.limit(0), table).count() == 0


def test_sketches_merge_to_what_is_sketched_at_once(spark):
    df = spark.range(60_000).select((F.col("id") % 7).alias("day"), (F.col("id") % 3).alias("kind"), F.pmod(F.xxhash64("id"), F.lit(20_000)).alias("user"), (F.col("id") % 1000).alias("v"))
    df = df.unionByName(spark.createDataFrame([(1, 9, None, None), (2, 9, None, None)], "day long, kind long, user long, v long"))
    stored = sketches.sketched(df, ["day", "kind"], "user", "v")
    rolled = {r["kind"]: r for r in sketches.estimated(sketches.merged(stored, ["kind"]), (0.5, 0.9)).collect()}
    whole = {r["kind"]: r for r in sketches.estimated(sketches.sketched(df, ["kind"], "user", "v"), (0.5, 0.9)).collect()}
    exact = {r["kind"]: r for r in df.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("user").alias("users")).collect()}
    for kind in (0, 1, 2):
        assert rolled[kind]["n"] == exact[kind]["n"] and rolled[kind]["hll_distinct"] == whole[kind]["hll_distinct"]
        for name in ("hll_distinct", "theta_distinct"):
            assert abs(rolled[kind][name] / exact[kind]["users"] - 1) < 0.07
        assert abs(rolled[kind]["q50"] - 500) < 30 and abs(rolled[kind]["q90"] - 900) < 30
    assert rolled[9]["n"] == 2 and rolled[9]["hll_distinct"] == 0 and rolled[9]["q50"] is None
    twice = sketches.estimated(sketches.merged(sketches.merged(stored, ["day"]), [])).first()
    assert twice["n"] == 60_002 and abs(twice["theta_distinct"] / df.select("user").dropna().distinct().count() - 1) < 0.07


def test_estimates_are_those_of_the_buckets_however_they_were_filled(spark):
    """Sketched in one task, in many, and merged from days; the first was another number before."""
    df = spark.range(60_000).select((F.col("id") % 7).alias("day"), F.lit(1).alias("kind"), F.pmod(F.xxhash64("id"), F.lit(20_000)).alias("user"), (F.col("id") % 1000).alias("v"))
    days = sketches.merged(sketches.sketched(df, ["day", "kind"], "user", "v"), ["kind"])
    found = [sketches.estimated(s).first()["hll_distinct"] for s in (sketches.sketched(df.coalesce(1), ["kind"], "user", "v"), sketches.sketched(df.repartition(5), ["kind"], "user", "v"), days)]
    assert len(set(found)) == 1


def pixels(rng, colour, bits, width, height):
    per_pixel = images.SAMPLES[colour]
    wide = (width * per_pixel * bits + 7) // 8
    return rng.randbytes(wide * height)


def test_png_pixels_of_every_type():
    rng = random.Random(5)
    for colour, depths in images.BITS.items():
        for bits in depths:
            for width, height in ((1, 1), (13, 9), (8, 5)):
                raw = pixels(rng, colour, bits, width, height)
                palette = rng.randbytes(3 << bits) if colour == 3 else b""
                got = images.png_pixels(writers.png(width, height, raw, colour, bits, palette=palette))
                n = images.SAMPLES[colour]
                line = (width * n * bits + 7) // 8
                for y in range(height):
                    row = int.from_bytes(raw[y * line : (y + 1) * line], "big")
                    values = [row >> (line * 8 - bits * (k + 1)) & ((1 << bits) - 1) for k in range(width * n)]
                    if colour == 3:
                        want = [list(palette[3 * v : 3 * v + 3]) for v in values]
                    else:
                        scale = 255 // ((1 << bits) - 1) if bits < 8 else 1
                        want = [[v * scale for v in values[k : k + n]] for k in range(0, len(values), n)]
                    assert got[y].tolist() == want


def test_interlaced_and_damaged_images():
    import struct
    import zlib

    rng = random.Random(6)
    width, height = 11, 7
    image = np.frombuffer(rng.randbytes(width * height * 3), np.uint8).reshape(height, width, 3)
    raw = b"".join(b"\0" + image[y, x0::dx].tobytes() for x0, y0, dx, dy in images.PASSES for y in range(y0, height, dy) if x0 < width)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    data = images.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 1)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    assert (images.png_pixels(data) == image).all()
    for at in range(0, len(data), 7):
        bad = data[:at] + bytes([data[at] ^ 0x55]) + data[at + 1 :]
        assert images.described(bad)[-1] or at >= len(data) - 4
    for cut in range(0, len(data) - 1, 9):
        assert images.described(data[:cut])[-1]
    huge = images.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 1 << 30, 1 << 30, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"")) + chunk(b"IEND", b"")
    assert "over" in images.described(huge)[-1]


def test_hashes_of_near_copies_are_near():
    rng = np.random.default_rng(7)
    for _ in range(20):
        small = rng.integers(0, 256, (8, 9, 3), dtype=np.uint8)
        large = np.kron(small, np.ones((20, 20, 1), np.uint8))
        noisy = np.clip(large.astype(int) + rng.integers(-3, 4, large.shape), 0, 255).astype(np.uint8)
        other = np.kron(rng.integers(0, 256, (8, 9, 3), dtype=np.uint8), np.ones((20, 20, 1), np.uint8))
        apart = lambda a, b: bin((images.difference_hash(a) ^ images.difference_hash(b)) & (1 << 64) - 1).count("1")
        assert apart(large, small) == 0 and apart(large, noisy) <= 4 and apart(large, other) > 12
        assert apart(large, (large.astype(np.uint16) * 257)) == 0


def test_markdown_blocks_by_kind():
    text = """Title
=====

A *para* with `co*de*` and
[link](http://x) \\*no\\*.

Sub
---
1. one
   goes on
2) two
   - deep **bold**
- back

> quote
> more
>> deeper

| a | b \\| c |
|:--|---|
| 1 | `x` | extra |
| 2 |
after the table

    indented
      code

***
~~~ sql
SELECT 1 -- # no
```
~~~
### Last ###
#no heading
"""
    got = [(b.kind, b.level, b.text, b.first) for b in markdown.blocks(text)]
    assert got == [
        ("heading", 1, "Title", None), ("paragraph", 0, "A para with co*de* and\nlink *no*.", None), ("heading", 2, "Sub", None), ("item", 1, "one\ngoes on", "1."), ("item", 1, "two", "2)"), ("item", 2, "deep bold", None),
        ("item", 1, "back", None), ("quote", 1, "quote\nmore", None), ("quote", 2, "deeper", None), ("table row", 0, "a\tb | c", "head"), ("table row", 1, "1\tx", None), ("table row", 2, "2\t", None),
        ("paragraph", 0, "after the table", None), ("code", 0, "indented\n  code", None), ("rule", 0, "", None), ("code", 0, "SELECT 1 -- # no\n```", "sql"), ("heading", 3, "Last", None), ("paragraph", 0, "#no heading", None),
    ]
    assert list(markdown.blocks("")) == [] and [b.kind for b in markdown.blocks("```\nnever closed")] == ["code"]


def test_markdown_of_odd_texts(spark):
    import time

    began = time.monotonic()
    for text in ("*" * 20_000, "[" * 20_000, "`" * 20_000, "> " * 5000, "- " * 5000, "|" * 20_000 + "\n" + "-" * 20_000, "_a" * 10_000, "**a " * 5000, "\\" * 20_001):
        list(markdown.blocks(text))
    assert time.monotonic() - began < 60
    files = spark.createDataFrame([("a.md", "# x"), ("b.md", None), ("c.md", "")], "path string, text string")
    assert [tuple(r)[:4] for r in markdown.markdown_blocks(files).collect()] == [("a.md", 0, "heading", 1)]


# streams


def days(spark, n=30):
    """Events of users who come on one day in three, a batch for each ten days."""
    rows = spark.range(n * 40).select(F.col("id").alias("event_id"), (F.col("id") % 40 + F.floor(F.col("id") / 400) * 40).alias("user_id"), F.when(F.col("id") % 2 == 0, "click").otherwise("purchase").alias("event_type"))
    return rows.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("event_id") * 2160))


def batches(df):
    at = F.floor(F.col("event_id") / 400)
    return [df.where(at == k) for k in range(3)]


def test_state_of_a_stream_join_shrinks(spark):
    e, progress = days(spark), []
    sides = [events.in_turns(batches(e.where(F.col("event_type") == kind)), "ts", "1 hour") for kind in ("click", "purchase")]
    rows = events.drain(events.followed(*sides, "6 HOURS"), "append", progress)
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    assert rows.count() > 500 and held[-1] < 60 and max(held) > 300
    assert rows.where("then_id IS NULL").count() > 0 or rows.where("then_id IS NOT NULL").count() == rows.count()


def test_keys_of_silent_users_leave_the_state(spark):
    e, progress = days(spark), []
    rows = events.with_own_state(spark, lambda: events.drain(events.silences(events.in_turns(batches(e), "ts", "0 seconds"), 30), "append", progress))
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    users = {r["user_id"] for r in rows.collect()}
    assert {u for u in range(80)} <= users and held[-1] <= 2 * 60, held


def test_days_that_are_over_leave_the_state(spark):
    e, progress = days(spark), []
    rows = events.drain(events.distinct_by_day(events.in_turns(batches(e), "ts", "1 day")), "append", progress)
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    assert held[-1] < max(held) / 2 and rows.count() == rows.distinct().count()


def test_first_seen_forgets_by_the_clock(spark):
    """A time to live of a millisecond: what came in one batch is new in the next."""
    e = days(spark).where("event_id < 400")
    again = events.with_own_state(spark, lambda: events.drain(events.first_seen(events.in_turns([e, e], "ts", "0 seconds"), 1), "append"), events.BY_THE_CLOCK)
    once = events.with_own_state(spark, lambda: events.drain(events.first_seen(events.in_turns([e, e], "ts", "0 seconds"), 3_600_000), "append"), events.BY_THE_CLOCK)
    assert once.count() == 40 and again.count() == 80


@pytest.mark.parametrize("gap", [3600])
def test_table_argument_takes_any_table(spark, gap):
    from leafmill.plans.udfs import Sessions

    spark.udtf.register("sessions_of_test", F.udtf(Sessions, useArrow=True))
    spark.createDataFrame([("u", 1, "x"), ("u", 5000, "y"), ("w", 1, None)], "user string, at long, more string").select("user", F.timestamp_seconds("at").alias("ts"), "more").createOrReplaceTempView("of_test")
    got = spark.sql(f"SELECT user, session, place, more FROM sessions_of_test(TABLE(of_test) PARTITION BY (user) ORDER BY (ts), {gap})").collect()
    assert sorted(map(tuple, got), key=str) == [("u", 0, 0, "x"), ("u", 1, 0, "y"), ("w", 0, 0, None)]
    with pytest.raises(Exception, match="seconds"):
        spark.sql("SELECT * FROM sessions_of_test(TABLE(of_test) PARTITION BY (user) ORDER BY (ts), 'x')").collect()


def test_sessions_go_on_over_record_batches(spark):
    """Batches of three rows cut users anywhere; rows without a time are last and of the session before; rows without a user are a user's."""
    from leafmill.plans.udfs import numbered_sessions

    dice, users = random.Random(3), (None, "u", "v", "w")
    rows = [(dice.choice(users), dice.choice((None, *range(0, 40_000, 7))), i) for i in range(200)]
    times = {(user, at) for user, at, _ in rows}
    rows = [r for r in rows if r[:2] in times and (times.discard(r[:2]) or True)]  # one row each of a user's times, also of none
    want, last, session, place = {}, {}, {}, {}
    for user, at, i in sorted(rows, key=lambda r: (r[0] or "", r[1] is None, r[1] or 0)):
        new = user in last and None not in (at, last[user]) and at - last[user] > 600
        session[user] = session.get(user, 0) + new
        place[user] = 0 if new or user not in place else place[user] + 1
        want[i], last[user] = (session[user], place[user]), at
    table = spark.createDataFrame(rows, "user string, at long, i long").select("user", F.timestamp_seconds("at").alias("ts"), "i")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, 3)
    try:
        for name in ("ts", "ntz"):
            t = table if name == "ts" else table.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
            got = numbered_sessions(t, "user", 600)
            assert got.columns == ["user", "ts", "i", "session", "place"]
            assert {r["i"]: (r["session"], r["place"]) for r in got.collect()} == want and max(s for s, _ in want.values()) > 3
    finally:
        spark.conf.set(key, before)


def test_table_argument_passes_record_batches(spark):
    """Not a batch for each row, which is what a function of rows makes."""
    from leafmill.plans import registry
    from tests.conftest import SF_DIR

    df = registry.QUERIES["u_table_argument"](spark, SF_DIR)
    assert "BatchSessions" in df._jdf.queryExecution().executedPlan().toString() and df.select("event_id").distinct().count() == 10_000
