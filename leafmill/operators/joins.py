"""Joins that Spark has no strategy of its own for, as rewrites into equi-joins and windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.operators.names import free, fresh


#: Rows of distinct ranges that are broadcast at most, repeats of a row that are made at once, and more partitions than a join has.
BROADCAST_ROWS, REPEATS, PARTITIONS = 200_000, 1 << 10, 1 << 20


def asof_join(left: DataFrame, right: DataFrame, on: Sequence[str], time: str, values: Sequence[str], tie: str | None = None, step: Column | None = None) -> DataFrame:
    """Each left row with the values of the last right row of its key at or before its time.

    One shuffle on the key: both sides are united and a window carries the last right row forward.  Right rows of
    equal time: the one with the greatest ``tie`` column counts, in that column's own order (nulls are least).  Unmatched rows get nulls.  Rows of null key or time match
    nothing, on either side.

    ``step`` cuts keys with very many rows: an expression over the time column that never falls as time grows, such as its day or hour.  A key's
    steps are then windows of their own, in as many tasks; left rows that nothing precedes within their step get the last right row
    of an earlier one, which is carried over one row a step.  Matches reach back any number of steps; the result is the same.
    """
    names = left.columns
    right = right.dropna(subset=[*on, time])
    c, side, rank, part, before = fresh([*names, *right.columns], "c", "side", "tie", "step", "before")
    carried, order = F.struct(*[F.col(v) for v in values]), F.col(tie) if tie else F.lit(None).cast("int")
    kinds = right.select(carried.alias(c), order.alias(rank)).schema
    a = left.select(*names, F.lit(None).cast(kinds[c].dataType).alias(c), F.lit(1).alias(side), F.lit(None).cast(kinds[rank].dataType).alias(rank))
    b = right.select(*[F.col(n) if n in (*on, time) else F.lit(None).cast(left.schema[n].dataType).alias(n) for n in names], carried.alias(c), F.lit(0).alias(side), order.alias(rank))
    both, keys = a.unionByName(b), list(on)
    if step is not None:
        both, keys = both.withColumn(part, step), [*on, part]
    w = Window.partitionBy(*keys).orderBy(time, side, rank).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn(c, F.last(c, ignorenulls=True).over(w)).where(F.col(side) == 1)
    if step is not None:
        # summed up by task first, so a hot key sends a row for each of its steps
        is_right = F.col(side) == 0
        ends = both.groupBy(*keys).agg(F.max_by(F.when(is_right, F.col(c)), F.when(is_right, F.struct(time, rank))).alias(before))
        earlier = Window.partitionBy(*on).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.withColumn(before, F.last(before, ignorenulls=True).over(earlier))
        found = found.join(ends, keys, "left").withColumn(c, F.coalesce(c, before))
    return found.select(*names, *[F.col(c)[v].alias(f"asof_{v}") for v in values])


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float, on: Sequence[str] = (), tasks: int | None = None, repeated: bool = False) -> DataFrame:
    """Points with every range [low, high) around them, as an equi-join on buckets of ``width``.

    A range is repeated once for each bucket it touches, so ``width`` should be about a range's usual length; a point
    has one bucket, so a pair is met once and the predicate is checked again.  Empty ranges match nothing, nor do nulls.

    Where pairs are far more than rows, give ``tasks``: buckets are dealt over so many, which Spark would merge by the bytes that it reads.
    ``repeated`` is for ranges that are mostly equal rows (of types that can be grouped): each distinct one is met once, with its number, and repeated behind the
    join.  If few are left they are broadcast and points are dealt evenly, whatever their bucket.  A task holds ``REPEATS`` of the repeated rows at most, however
    many pairs a point has, and a row for each ``REPEATS`` of its pairs.
    """
    if not width > 0:
        raise ValueError("width has to be positive")
    name, times, turn = fresh([*points.columns, *ranges.columns], "bucket", "times", "turn")
    bucket = lambda c: F.floor(F.col(c).cast("double") / width)
    held, keys = ranges.where(F.col(low) < F.col(high)), [*on, name]
    if repeated:
        held = held.groupBy(*ranges.columns).agg(F.count("*").alias(times))
    cut = held.withColumn(name, F.explode(F.sequence(bucket(low), bucket(high))))
    dealt = points.withColumn(name, bucket(point))
    if repeated and cut.count() <= BROADCAST_ROWS:
        dealt, cut = dealt.repartition(tasks) if tasks else dealt, F.broadcast(cut)
    elif tasks:
        dealt, cut = dealt.repartition(tasks, *keys), cut.repartition(tasks, *keys).hint("shuffle_hash")
    inside = (F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))
    met = dealt.join(cut, keys).where(inside).drop(name)
    if not repeated:
        return met
    # in two steps, so that the array of no number is long; coalesce merges nothing, it parts their generated code, which else holds all pairs of a point at once
    met = met.withColumn(turn, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / REPEATS))))
    rest = F.least(F.lit(REPEATS).cast("long"), F.col(times) - F.col(turn) * REPEATS).cast("int")
    names = [c for c in met.columns if c not in (times, turn)]
    met = met.select(*names, rest.alias(times)).coalesce(PARTITIONS)
    return met.select(*names, F.explode(F.sequence(F.lit(1), F.col(times))).alias(turn)).drop(turn)


def range_totals(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float, on: Sequence[str] = (), value: str | None = None) -> DataFrame:
    """Every row of ``ranges`` with ``n``, the points of its key in [low, high), and ``total``, the sum of their ``value``, without making the pairs.

    Both are differences of running sums over the distinct points and ends, so the work is that of a sort however many points a
    range holds.  Sums run within buckets of ``width`` and, one row a bucket, over the buckets of a key: choose it so that a
    bucket's distinct points fit a task and a key's buckets too.  Equal points are summed up before they are
    shuffled.  ``value`` should be of an exact type (integers, decimals), as sums are subtracted; its nulls add nothing.  Ranges that are empty or hold a null or NaN, and keys
    without points or null, give 0; points that are null or NaN are in no range.
    """
    if not width > 0:
        raise ValueError("width has to be positive")
    names, results = ranges.columns, [free(ranges.columns, "n"), *([free(ranges.columns, "total")] if value else [])]
    x, bucket, *own = fresh([*names, *points.columns, *results], "x", "bucket", *[f"{k}_{part}" for k in ("n", "total") for part in ("sum", "whole", "earlier", "low", "high")])
    n, total = own[0], own[5]
    # names of the parts of each sum
    part_of = {own[at]: dict(zip(("whole", "earlier", "low", "high"), own[at + 1 : at + 5], strict=True)) for at in (0, 5)}
    known = F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double"))
    sums, zero = {n: F.lit(1).cast("long")}, F.lit(0).cast("long")
    if value:
        sums[total] = F.coalesce(F.col(value), F.lit(0))
    rows = points.select(*on, F.col(point).alias(x), *[c.alias(k) for k, c in sums.items()]).where(known)
    ends = [ranges.select(*on, F.col(end).alias(x), *[zero.alias(k) for k in sums]).where(known) for end in (low, high)]
    steps = rows.unionByName(ends[0]).unionByName(ends[1]).groupBy(*on, x).agg(*[F.sum(k).alias(k) for k in sums])
    steps = steps.withColumn(bucket, F.floor(F.col(x).cast("double") / width))
    before = (Window.unboundedPreceding, -1)
    within = Window.partitionBy(*on, bucket).orderBy(x).rowsBetween(*before)
    earlier = Window.partitionBy(*on).orderBy(bucket).rowsBetween(*before)
    # sums before a place in its bucket, and those of the buckets before it
    whole = steps.groupBy(*on, bucket).agg(*[F.sum(k).alias(part_of[k]["whole"]) for k in sums])
    whole = whole.select(*on, bucket, *[F.coalesce(F.sum(part_of[k]["whole"]).over(earlier), zero).alias(part_of[k]["earlier"]) for k in sums])
    placed = steps.select(*on, x, bucket, *[F.coalesce(F.sum(k).over(within), zero).alias(k) for k in sums]).join(whole, [*on, bucket])
    out = ranges
    for end, mark in ((low, "low"), (high, "high")):
        out = out.join(placed.select(*on, F.col(x).alias(end), *[(F.col(k) + F.col(part_of[k]["earlier"])).alias(part_of[k][mark]) for k in sums]), [*on, end], "left")
    apart = lambda k: F.when(F.col(low) < F.col(high), F.col(part_of[k]["high"]) - F.col(part_of[k]["low"]))
    return out.select(*names, *[F.coalesce(apart(k), zero).alias(name) for k, name in zip(sums, results, strict=True)])


def interval_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_time: str, right_time: str, seconds: int) -> DataFrame:
    """Pairs of one key whose times are at most ``seconds`` apart; right rows visit their own and both next buckets.  Nulls match nothing."""
    if seconds < 0:
        raise ValueError("seconds can't be negative")
    (name,) = fresh([*left.columns, *right.columns], "bucket")
    bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / F.lit(max(1, seconds) * 1_000_000))
    a = left.withColumn(name, bucket(left_time))
    b = right.withColumn(name, F.explode(F.array(*[bucket(right_time) + k for k in (-1, 0, 1)])))
    apart = F.abs(F.unix_micros(F.col(left_time).cast("timestamp")) - F.unix_micros(F.col(right_time).cast("timestamp")))
    return a.join(b, [*on, name]).where(apart <= seconds * 1_000_000).drop(name)


def salted_join(big: DataFrame, small: DataFrame, on: Sequence[str], salts: int, spread: Column, how: str = "inner") -> DataFrame:
    """An equi-join whose hot keys are dealt over ``salts`` tasks: the small side is repeated, the big one isn't.

    ``spread`` is an expression over the big side that differs within a key, such as a hash of its id.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a repeated right side can't give a {how} join")
    (salt,) = fresh([*big.columns, *small.columns], "salt")
    a = big.withColumn(salt, F.pmod(F.xxhash64(spread), F.lit(salts)))
    b = small.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return a.join(b, [*on, salt], how).drop(salt)
