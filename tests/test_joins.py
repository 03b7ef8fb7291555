"""Join rewrites on small tables with ties, nulls and empty sides."""

import datetime as dt

from pyspark.sql import functions as F

from leafmill.operators import aggregates, joins

T = dt.datetime(2024, 1, 1)


def at(minutes):
    return T + dt.timedelta(minutes=minutes)


def test_asof_ties_nulls_and_empty(spark):
    left = spark.createDataFrame([(1, "a", at(0)), (2, "a", at(5)), (3, "a", at(9)), (4, "b", at(9)), (5, None, at(9)), (6, "a", None), (7, "c", at(9)), (8, "c", None)], "id int, k string, ts timestamp")
    right = spark.createDataFrame([("a", at(5), 10), ("a", at(5), 11), ("a", at(7), 12), (None, at(1), 13), ("a", None, 14), ("c", None, 15)], "k string, ts timestamp, v int")
    got = {r["id"]: r["asof_v"] for r in joins.asof_join(left, right, ["k"], "ts", ["v"], tie="v").collect()}
    assert got == {1: None, 2: 11, 3: 12, 4: None, 5: None, 6: None, 7: None, 8: None}
    assert joins.asof_join(left, right.limit(0), ["k"], "ts", ["v"]).where("asof_v is not null").count() == 0


def test_asof_ties_in_the_columns_own_order(spark):
    """9 comes before 10 as a number, after it as a string; nulls are least."""
    left = spark.createDataFrame([(1, "a", at(5)), (2, "b", at(5))], "id int, k string, ts timestamp")
    right = spark.createDataFrame([("a", at(5), 9), ("a", at(5), 10), ("a", at(5), None), ("b", at(4), None)], "k string, ts timestamp, v int")
    right = right.selectExpr("*", "coalesce(cast(v AS string), 'none') AS name")
    got = {r["id"]: r["asof_name"] for r in joins.asof_join(left, right, ["k"], "ts", ["name"], tie="v").collect()}
    assert got == {1: "10", 2: "none"}


def test_asof_by_steps_is_the_same(spark):
    """Steps that most matches lie before, against brute force: ties, nulls, keys without right rows, an empty side."""
    import random

    rnd = random.Random(5)
    some = lambda v: None if rnd.random() < 0.05 else v
    rows = [(i, some(rnd.choice("aaaab")), some(rnd.randrange(300))) for i in range(200)] + [(900, "z", 7)]
    values = [(some(rnd.choice("aaaab")), some(rnd.randrange(0, 300, 25)), i) for i in range(40)]
    left = spark.createDataFrame(rows, "id int, k string, step int")
    right = spark.createDataFrame(values, "k string, step int, v int").withColumn("before", F.lit("x"))
    want = {}
    for i, k, t in rows:
        past = [(rt, v) for rk, rt, v in values if None not in (k, t, rk, rt) and rk == k and rt <= t]
        want[i] = max(past)[1] if past else None
    for width in (1, 10, 1000):
        got = joins.asof_join(left, right, ["k"], "step", ["v"], tie="v", step=F.floor(F.col("step") / width))
        assert got.columns == ["id", "k", "step", "asof_v"]
        assert sorted((r["id"], r["asof_v"] or -1) for r in got.collect()) == sorted((i, v or -1) for i, v in want.items())
    none = joins.asof_join(left, right.limit(0), ["k"], "step", ["v"], step=F.floor(F.col("step") / 10))
    assert none.count() == len(rows) and none.where("asof_v is not null").count() == 0
    assert joins.asof_join(left.limit(0), right, ["k"], "step", ["v"], step=F.floor(F.col("step") / 10)).count() == 0


def test_callers_columns_stay(spark):
    """Columns that are called as an operator's own would be."""
    import pytest

    odd = ["_c", "c", "side", "_side", "tie", "bucket", "_bucket", "salt", "new", "_new"]
    left = spark.createDataFrame([(1, "a", at(5), 2.0)], "id int, k string, ts timestamp, p double").selectExpr("*", *[f"'{c}' AS {c}" for c in odd])
    right = spark.createDataFrame([("a", at(5), 9.0, 1.0, 3.0)], "k string, ts timestamp, v double, lo double, hi double")
    found = [joins.asof_join(left, right, ["k"], "ts", ["v"]), joins.range_join(left, right.select("lo", "hi"), "p", "lo", "hi", 1.0)]
    found += [joins.salted_join(left, right.select("k", "v"), ["k"], 3, F.col("id")), joins.interval_join(left, right.select("k", F.col("ts").alias("t")), ["k"], "ts", "t", 60)]
    found += [aggregates.sessions(left, ["k"], "ts", 60), aggregates.top_k(left, ["k"], [F.col("ts")], 1)]
    for df in found:
        (row,) = df.select(*odd).collect()
        assert list(row) == odd
    with pytest.raises(ValueError, match="rank"):
        aggregates.top_k(left.withColumn("RANK", F.lit(1)), ["k"], [F.col("ts")], 1)


def test_range_join_meets_each_pair_once(spark):
    points = spark.range(0, 100).select((F.col("id") * 1.0).alias("p"))
    ranges = spark.createDataFrame([(0.0, 35.0), (10.0, 10.0), (95.5, 200.0), (-5.0, 1.0)], "lo double, hi double")
    got = sorted(tuple(r) for r in joins.range_join(points, ranges, "p", "lo", "hi", 10.0).collect())
    want = sorted((float(p), lo, hi) for p in range(100) for lo, hi in ((0.0, 35.0), (10.0, 10.0), (95.5, 200.0), (-5.0, 1.0)) if lo <= p < hi)
    assert got == want


def test_range_join_of_repeated_ranges_is_the_same_dealt_evenly(spark, monkeypatch):
    points = spark.range(0, 400).select((F.col("id") % 2 * 1.0).alias("p"), "id")
    ranges = spark.createDataFrame([(0.0, 35.0)] * 7 + [(10.0, 10.0), (0.5, 200.0), (None, 3.0), (-5.0, 1.0)], "lo double, hi double")
    want = sorted(tuple(r) for r in joins.range_join(points, ranges, "p", "lo", "hi", 10.0).collect())
    monkeypatch.setattr(joins, "REPEATS", 3)
    for most in (joins.BROADCAST_ROWS, 0):
        monkeypatch.setattr(joins, "BROADCAST_ROWS", most)
        got = joins.range_join(points, ranges, "p", "lo", "hi", 10.0, tasks=16, repeated=True)
        assert got.columns == ["p", "id", "lo", "hi"] and sorted(tuple(r) for r in got.collect()) == want
        dealt = joins.range_join(points, ranges, "p", "lo", "hi", 0.25, tasks=16)
        assert dealt.rdd.getNumPartitions() == 16 and sorted(tuple(r) for r in dealt.collect()) == want
    # points of two buckets, all in one or two tasks before
    most = joins.range_join(points, ranges, "p", "lo", "hi", 10.0, tasks=16, repeated=True)
    assert most.rdd.getNumPartitions() == 16
    monkeypatch.undo()
    even = joins.range_join(points, ranges, "p", "lo", "hi", 10.0, tasks=16, repeated=True).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"))
    assert even.count() == 16 and even.agg(F.max("n")).first()[0] < 2 * len(want) / 16


def test_repeated_ranges_are_not_held_at_once(spark, monkeypatch):
    """Rows that are made for the first one to leave its task: all pairs of the first point before, however many."""
    points = spark.range(0, 40, 1, 2).select((F.col("id") % 2 * 1.0).alias("p"), "id")
    ranges = spark.createDataFrame([(0.0, 35.0)] * 50 + [(-5.0, 2.0)] * 20, "lo double, hi double")
    monkeypatch.setattr(joins, "REPEATS", 8)
    for tasks in (2, None):
        for most in (joins.BROADCAST_ROWS, 0):
            with monkeypatch.context() as m:
                m.setattr(joins, "BROADCAST_ROWS", most)
                got = joins.range_join(points, ranges, "p", "lo", "hi", 10.0, tasks=tasks, repeated=True)
            node = got._jdf.queryExecution().executedPlan()
            assert len(node.executeTake(1)) == 1
            node = node.executedPlan()
            while not node.nodeName().startswith("Generate"):
                node = node.plan() if node.nodeName() == "ResultQueryStage" else node.children().head()
            assert 0 < node.metrics().apply("numOutputRows").value() <= 8
            assert got.count() == 40 * 70


def test_range_totals_are_those_of_the_pairs(spark):
    """Against brute force: equal points, ends on points, repeated and empty ranges, nulls, NaN, infinite ends, keys, clashing names."""
    import random

    rnd, nan, inf = random.Random(3), float("nan"), float("inf")
    points = [(rnd.choice("aaab"), rnd.choice([None, nan, -0.0, *(rnd.randrange(-40, 40) / 2 for _ in range(9))]), rnd.choice([None, 1, 2, -3])) for _ in range(120)]
    ranges = [(i, rnd.choice(["a", "b", "c", None]), *(rnd.choice([None, nan, -inf, inf, 0.0, *(rnd.randrange(-50, 50) / 2 for _ in range(20))]) for _ in range(2))) for i in range(120)]
    ranges += ranges[:5]
    p = spark.createDataFrame(points, "k string, x double, v long")
    r = spark.createDataFrame(ranges, "bucket int, k string, lo double, hi double").selectExpr("*", "'y' AS n_sum", "'y' AS n_low", "'y' AS total_earlier", "'y' AS x")

    def want(keyed):
        for i, k, lo, hi in ranges:
            good = None not in (lo, hi) and lo == lo and hi == hi
            inside = [v for pk, x, v in points if good and x is not None and lo <= x < hi and (not keyed or pk == k)]
            yield i, len(inside), sum(v or 0 for v in inside)

    for on in ([], ["k"]):
        for width in (0.5, 7.0, 1e6):
            got = joins.range_totals(p, r, "x", "lo", "hi", width, on, "v")
            assert got.columns == [*r.columns, "n", "total"]
            assert sorted((g["bucket"], g["n"], g["total"]) for g in got.collect()) == sorted(want(bool(on)))
    assert joins.range_totals(p.limit(0), r, "x", "lo", "hi", 1.0).where("n <> 0").count() == 0
    assert joins.range_totals(p, r.limit(0), "x", "lo", "hi", 1.0).count() == 0


def test_widths_that_part_nothing(spark):
    import pytest

    a = spark.createDataFrame([(1, "a", at(5)), (2, "a", at(6)), (3, "a", None)], "id int, k string, ts timestamp")
    same = joins.interval_join(a, a.select("k", F.col("ts").alias("t")), ["k"], "ts", "t", 0)
    assert sorted(r["id"] for r in same.collect()) == [1, 2]
    for wrong in (lambda: joins.interval_join(a, a, ["k"], "ts", "ts", -1), lambda: joins.range_join(a, a, "id", "id", "id", 0.0), lambda: joins.range_join(a, a, "id", "id", "id", float("nan"))):
        with pytest.raises(ValueError):
            wrong()


def test_salted_join_keeps_all_kinds(spark):
    big = spark.createDataFrame([(i, i % 3) for i in range(50)], "id int, k int")
    small = spark.createDataFrame([(0, "x"), (1, "y"), (1, "z")], "k int, v string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = sorted(map(str, joins.salted_join(big, small, ["k"], 4, F.col("id"), how).collect()))
        assert got == sorted(map(str, big.join(small, "k", how).collect()))


def test_sessions_and_top_k(spark):
    e = spark.createDataFrame([("u", at(0)), ("u", at(10)), ("u", at(100)), ("w", at(0))], "u string, ts timestamp")
    got = sorted((r["u"], r["ts"], r["session"]) for r in aggregates.sessions(e, ["u"], "ts", 1800).collect())
    assert [s for _, _, s in got] == [0, 0, 1, 0]
    assert aggregates.top_k(e, ["u"], [F.col("ts").desc()], 1).where("u = 'u'").first()["ts"] == at(100)


def test_sessions_by_steps_are_the_same(spark):
    """Against brute force: pauses within and between steps, steps without rows, equal and null times, null keys, clashing names."""
    import random

    rnd = random.Random(11)
    rows = [(i, rnd.choice(["a", "a", "b", None]), None if rnd.random() < 0.03 else at(rnd.choice([rnd.randrange(400), 5 * rnd.randrange(1000)]))) for i in range(150)]
    df = spark.createDataFrame(rows, "last int, k string, ts timestamp").selectExpr("*", "'x' AS key", "'x' AS k0", "'x' AS us")
    want = {}
    for key in ("a", "b", None):
        number, past = 0, None
        for ts, i in sorted((ts or dt.datetime.min, i) for i, k, ts in rows if k == key):
            if past not in (None, dt.datetime.min) and ts - past > dt.timedelta(minutes=7):
                number += 1
            want[i], past = number, ts
    minute = F.unix_micros("ts") / 60_000_000
    for step in (None, F.floor(minute), F.floor(minute / 60), F.floor(minute / 1e9)):
        got = aggregates.sessions(df, ["k"], "ts", 420, step=step)
        assert got.columns == [*df.columns, "session"]
        assert {r["last"]: r["session"] for r in got.collect()} == want
    assert aggregates.sessions(df.limit(0), ["k"], "ts", 420, step=F.floor(minute)).count() == 0
