"""Sinks of streams, their parts, and states that users share."""

import random
from collections import Counter
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import functions as F

from leafmill.sources.scratch import new_path
from leafmill.streaming import events


def test_a_batch_run_again_leaves_its_rows_once(spark):
    out = new_path(spark, "again")
    for number, n in ((0, 5), (1, 7), (1, 7)):
        events.write_batch(spark.range(n), out, number)
    assert spark.read.option("recursiveFileLookup", "true").schema("id long").parquet(out).count() == 12


def test_turns_are_dealt_to_many_files(spark):
    """A batch for each part, also for one of fewer rows than files; no part is one task's."""
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("ts")
    parts, progress = [spark.range(n).select(F.lit(k).alias("part"), at) for k, n in enumerate((1000, 3, 0, 500))], []
    stream = events.in_turns(parts, "ts", "0 seconds").select("part", F.input_file_name().alias("file"))
    files = {r["part"]: r["n"] for r in events.drain(stream, "append", progress).groupBy("part").agg(F.count_distinct("file").alias("n")).collect()}
    assert [p["numInputRows"] for p in progress if p["numInputRows"]] == [1000, 3, 500] and files[0] > 1 and files[3] > 1, (files, progress)


def made(n=900):
    """Rows in the order of time, of users and types that may be null, and pauses of hours now and then."""
    dice, rows, us = random.Random(7), [], 1_700_000_000_000_000
    for i in range(n):
        us += dice.choice((1_000_001, 60_000_000, 2 * 3_600_000_000))
        rows.append((i, dice.choice((None, -5, *range(30))), dice.choice(("a", "b", None)), us))
    return rows


def stream_of(spark, rows, thirds=3):
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, us long").withColumn("ts", F.timestamp_micros("us")).drop("us")
    return events.in_turns([df.where(F.floor(F.col("event_id") * thirds / len(rows)) == k) for k in range(thirds)], "ts", "0 seconds")


def held(progress):
    return [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]


def test_first_seen_in_shared_states(spark):
    rows, progress = made(), []
    got = events.with_own_state(spark, lambda: events.drain(events.first_seen(stream_of(spark, rows), 3_600_000, buckets=3), "append", progress), events.BY_THE_CLOCK)
    assert Counter(map(tuple, got.collect())) == Counter({(user, kind) for _, user, kind, _ in rows})
    # 96 keys; those without a user have a state of their own; a state with a time to live has rows for that beside it
    assert held(progress)[-1] <= 3 * 4, progress


def test_keys_of_a_shared_state_are_forgotten_one_by_one():
    now, store = [0], []
    state = SimpleNamespace(exists=lambda: bool(store), get=lambda: store[-1], update=store.append)
    seen = events.Seen(100)
    seen.init(SimpleNamespace(getValueState=lambda *_, **__: state))
    clock = SimpleNamespace(getCurrentProcessingTimeInMs=lambda: now[0])
    told = []
    for now[0], users in ((0, [1, 1, 2]), (60, [2, 3]), (99, [1]), (100, [1, 3]), (150, [1, 2, 3]), (160, [3])):
        frame = pd.DataFrame({"user_id": users, "event_type": ["a"] * len(users)})
        told.append([u for out in seen.handleInputRows((0,), iter([frame]), clock) for u in out["user_id"]])
    assert told == [[1, 2], [3], [], [1], [2], [3]]


def test_streaks_in_shared_states(spark):
    rows, progress, want = made(), [], {}
    got = events.with_own_state(spark, lambda: events.drain(events.streaks(stream_of(spark, rows), buckets=3), "update", progress))
    for _, user, kind, _ in rows:
        n, longest, current, last = want.get(user, (0, 0, 0, None))
        current = current + 1 if kind == last else 1
        want[user] = (n + 1, max(longest, current), current, kind)
    ends = got.groupBy("user_id").agg(F.max("n"), F.max("longest")).collect()
    assert Counter(map(tuple, ends)) == Counter({(user, n, longest): 1 for user, (n, longest, _, _) in want.items()})
    assert held(progress)[-1] <= 4, progress


def test_silences_in_shared_states(spark):
    """Users of one state fall silent at times of their own: each is told once, by the next event or by the watermark."""
    rows, progress, gap, last, want = made(), [], 12 * 3_600_000_000, {}, Counter()
    rows += [(len(rows) + i, 100 + i, "a", rows[-1][3] + (i + 1) * 3_600_000_000) for i in range(40)]
    got = events.with_own_state(spark, lambda: events.drain(events.silences(stream_of(spark, rows), buckets=3), "append", progress))
    for _, user, _, us in rows:
        if user in last and us - last[user] > gap:
            want[user, last[user]] += 1
        last[user] = us
    want.update((user, us) for user, us in last.items() if us + gap < rows[-1][3])
    assert Counter(map(tuple, got.collect())) == want
    assert max(held(progress)) <= 3 * 4, progress
