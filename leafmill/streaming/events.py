"""Structured Streaming over the events table: windows, sessions, deduplication, late rows and state of one's own.

Each query reads all that is there (availableNow) and leaves its result as a table, so that streams can be
compared with batches; with another trigger and sink the same functions run on.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.group import GroupedData
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from leafmill.sources.scratch import new_path


def read_events(spark: SparkSession, sf_dir: str, delay: str = "10 minutes") -> DataFrame:
    """The events table as a stream with a watermark on ``ts``, a timestamp with time zone as watermarks need it."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


#: The state store that states of one's own and their timers need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


#: A state that lives by the clock asks for batches without data, without end; so a stream that is drained goes without them.
BY_THE_CLOCK = ("spark.sql.streaming.noDataMicroBatches.enabled", "false")


def with_own_state(spark: SparkSession, run: Callable[[], DataFrame], *more: tuple[str, str]) -> DataFrame:
    """What ``run`` gives with ``STORE`` and more settings set for it alone."""
    before = [(key, spark.conf.get(key)) for key, _ in (STORE, *more)]
    for key, value in (STORE, *more):
        spark.conf.set(key, value)
    try:
        return run()
    finally:
        for key, value in before:
            spark.conf.set(key, value)


def drain(stream: DataFrame, mode: str, progress: list[dict] | None = None) -> DataFrame:
    """Run a stream over what is there; its rows as a table.  complete: those of the last batch, else of all.

    ``progress`` gets a record of each batch.  Each batch overwrites a folder of its own number, so a batch that is run again after a failure leaves its rows
    once.
    """
    spark = stream.sparkSession
    out, checkpoint = new_path(spark, "stream"), new_path(spark, "stream-state")

    def write(batch: DataFrame, number: int) -> None:
        write_batch(batch, out, 0 if mode == "complete" else number)

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if progress is not None:
        progress.extend(json.loads(p.json) if hasattr(p, "json") else p for p in query.recentProgress)
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(out)


def write_batch(batch: DataFrame, out: str, number: int) -> None:
    batch.write.mode("overwrite").parquet(f"{out}/batch={number}")


def in_turns(parts: list[DataFrame], time: str, delay: str, files: int | None = None) -> DataFrame:
    """A stream that reads the parts one after the other, a batch each, with a watermark on ``time``.

    Each part is dealt to the same number of files, by default one for each core; the stream takes so many at a time, in the order of their writing.
    """
    spark = parts[0].sparkSession
    path, files = new_path(spark, "turns"), files or spark.sparkContext.defaultParallelism
    for number, part in enumerate(parts, 1):
        part.repartition(files).write.mode("append").parquet(path)
        # a part of few rows leaves some tasks without any, and those write no file
        for _ in range(number * files - len(spark.read.schema(part.schema).parquet(path).inputFiles())):
            part.limit(0).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", files).parquet(path)
    return stream.withWatermark(time, delay)


def tumbling(events: DataFrame, width: str = "1 hour") -> DataFrame:
    per = events.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return per.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "1 hour", slide: str = "15 minutes") -> DataFrame:
    per = events.groupBy(F.window("ts", width, slide), "event_type").agg(F.count("*").alias("n"))
    return per.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def session_windows(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    per = events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return per.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


def distinct_events(events: DataFrame) -> DataFrame:
    """First of each user and event type within the watermark."""
    return events.dropDuplicatesWithinWatermark(["user_id", "event_type"]).select("user_id", "event_type")


def distinct_by_day(events: DataFrame) -> DataFrame:
    """First of each user, event type and day; a day's keys leave the state once the watermark has passed its end."""
    day = F.window("ts", "1 day").alias("day")
    return events.select("user_id", "event_type", day).dropDuplicates(["user_id", "event_type", "day"]).select("user_id", "event_type", F.col("day.start").cast("timestamp_ntz").alias("day"))


def followed(first: DataFrame, then: DataFrame, within: str) -> DataFrame:
    """(event_id, user_id, ts, then_id): each first event with the user's events of the other stream up to ``within`` later.

    One that nothing follows comes with a null once both watermarks have passed its time by ``within``; the same condition lets either side
    leave the state.  Both streams need a watermark on ``ts``.
    """
    a, b = first.select("event_id", "user_id", "ts").alias("a"), then.select(F.col("event_id").alias("then_id"), F.col("user_id").alias("then_user"), F.col("ts").alias("then_ts")).alias("b")
    met = (F.col("user_id") == F.col("then_user")) & (F.col("then_ts") >= F.col("ts")) & (F.col("then_ts") <= F.col("ts") + F.expr(f"INTERVAL {within}"))
    return a.join(b, met, "left_outer").select("event_id", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "then_id")


def running_totals(events: DataFrame) -> DataFrame:
    """(user_id, n, total) whenever a user has events: state that lasts over batches."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for frame in frames:
            n, total = n + len(frame), total + float(frame["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [round(total, 4)]})

    schema = "user_id long, n long, total double"
    return events.groupBy("user_id").applyInPandasWithState(update, schema, "n long, total double", "update", GroupStateTimeout.NoTimeout)


def closed_days(events: DataFrame) -> DataFrame:
    """(start, n) of each day once the watermark has passed its end; rows that come later than that are dropped."""
    per = events.groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n"))
    return per.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


#: Visits to the state cost a key of its own some 2 ms, however little it holds, so users share so many states; each is read and written as a
#: whole when one of its users has events, so its users must fit a task's memory.
BUCKETS = 512


def by_bucket(rows: DataFrame, *keys: str, buckets: int = BUCKETS) -> GroupedData:
    """Rows grouped by ``bucket``, a hash of the keys; those without a user are bucket -1 with user 0, so that users stay whole numbers in pandas."""
    bucket = F.when(F.col("user_id").isNull(), -1).otherwise(F.pmod(F.hash(*keys), F.lit(buckets)))
    return rows.withColumn("bucket", bucket).withColumn("user_id", F.coalesce("user_id", F.lit(0))).groupBy("bucket")


def users_of(bucket: tuple, users: list[int]) -> list[int | None]:
    return [None] * len(users) if bucket[0] == -1 else users


def columns_of(held: dict[object, tuple]) -> tuple[list, ...]:
    """The tuples that a bucket holds as lists, one for each column: what its state takes."""
    return tuple(map(list, zip(*held.values(), strict=True)))


class Streaks(StatefulProcessor):
    """By user the number of events, and of the longest run of one type, over all batches; a state holds a bucket's users."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("streak", "users array<long>, n array<long>, longest array<long>, current array<long>, last array<string>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        held = {row[0]: row for row in zip(*self.state.get(), strict=True)} if self.state.exists() else {}
        frame = pd.concat(rows).sort_values(["us", "event_id"])
        for user, kind in zip(frame["user_id"].tolist(), frame["event_type"].tolist(), strict=True):
            _, n, longest, current, last = held.get(user, (user, 0, 0, 0, None))
            current = current + 1 if kind == last else 1
            held[user] = (user, n + 1, max(longest, current), current, kind)
        self.state.update(columns_of(held))
        users = frame["user_id"].unique().tolist()
        yield pd.DataFrame({"user_id": users_of(key, users), "n": [held[u][1] for u in users], "longest": [held[u][2] for u in users]})

    def close(self) -> None:
        pass


def streaks(events: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(user_id, n, longest) whenever a user has events; a batch mustn't hold events before those of an earlier one."""
    rows = events.select("event_id", "user_id", "event_type", F.unix_micros("ts").alias("us"), "ts")
    return by_bucket(rows, "user_id", buckets=buckets).transformWithStateInPandas(Streaks(), "user_id long, n long, longest long", "Update", "None")


class Silence(StatefulProcessor):
    """By user the time after which no event came for ``gap`` of event time, told when the next event or the timer comes.

    A state holds a bucket's users with their last events; the bucket's timer is that of the user silent for longest.
    """

    def __init__(self, gap_us: int):
        self.gap = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last", "users array<long>, us array<long>")

    def _held(self) -> dict[int, int]:
        return dict(zip(*self.state.get(), strict=True)) if self.state.exists() else {}

    def _timer(self, us: int) -> int:
        return -(-(us + self.gap) // 1000)

    def _keep(self, held: dict[int, int]) -> None:
        if held:
            self.state.update((list(held), list(held.values())))
            self.handle.registerTimer(self._timer(min(held.values())))
        else:
            self.state.clear()  # its users are gone until their next events

    def _told(self, key: tuple, told: list[tuple[int, int]]) -> Iterator[pd.DataFrame]:
        if told:
            yield pd.DataFrame({"user_id": users_of(key, [user for user, _ in told]), "last_us": [us for _, us in told]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        held, told = self._held(), []
        if held:
            self.handle.deleteTimer(self._timer(min(held.values())))
        frame = pd.concat(rows).sort_values("us")
        for user, us in zip(frame["user_id"].tolist(), frame["us"].tolist(), strict=True):
            last = held.get(user)
            if last is not None and us - last > self.gap:
                told.append((user, last))
            held[user] = us
        self._keep(held)
        yield from self._told(key, told)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        # all that the watermark has passed, not only the user whose timer it was
        until = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        held = self._held()
        told = [(user, us) for user, us in held.items() if self._timer(us) <= until]
        for user, _ in told:
            del held[user]
        self._keep(held)
        yield from self._told(key, told)

    def close(self) -> None:
        pass


def silences(events: DataFrame, hours: int = 12, buckets: int = BUCKETS) -> DataFrame:
    """(user_id, last_us): each event that none of its user follows for so many hours, up to the watermark.

    When the watermark passes the time of a user's last event by that, the user is dropped from the state, so the state holds the users of
    the last hours.  Batches mustn't go back in time.  Events without a time are passed over.
    """
    rows = events.where("ts IS NOT NULL").select("user_id", F.unix_micros("ts").alias("us"), "ts")
    return by_bucket(rows, "user_id", buckets=buckets).transformWithStateInPandas(Silence(hours * 3_600_000_000), "user_id long, last_us long", "Append", "EventTime")


class Seen(StatefulProcessor):
    """The first event of each key; the key is forgotten when its time to live, of the clock, is over.

    A state holds a bucket's keys, each with the time until which it lives; it is dropped as a whole with the last of them.
    """

    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("seen", "users array<long>, kinds array<string>, until array<long>", ttlDurationMs=self.ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        held = {row[:2]: row for row in zip(*self.state.get(), strict=True) if row[2] > now} if self.state.exists() else {}
        new = []
        for frame in rows:
            for user, kind in dict.fromkeys(zip(frame["user_id"].tolist(), frame["event_type"].tolist(), strict=True)):
                if (user, kind) not in held:
                    held[user, kind] = (user, kind, now + self.ttl)
                    new.append((user, kind))
        if new:
            self.state.update(columns_of(held))
            yield pd.DataFrame({"user_id": users_of(key, [user for user, _ in new]), "event_type": [kind for _, kind in new]})

    def close(self) -> None:
        pass


def first_seen(events: DataFrame, ttl_ms: int, buckets: int = BUCKETS) -> DataFrame:
    """(user_id, event_type) whenever it comes and wasn't seen for ``ttl_ms`` of processing time."""
    rows = by_bucket(events.select("user_id", "event_type", "ts"), "user_id", "event_type", buckets=buckets)
    return rows.transformWithStateInPandas(Seen(ttl_ms), "user_id long, event_type string", "Append", "ProcessingTime")
