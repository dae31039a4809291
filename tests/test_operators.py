"""Operators on inline rows: nulls, ties, empty inputs."""

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import vectors
from tessera.operators import frames
from tessera.operators.asof import asof_join
from tessera.operators.intervals import intervals_over, point_in_interval
from tessera.operators.membership import not_in
from tessera.operators.nearest import nearest
from tessera.operators.running import exact_percentiles, rows_above, rows_within, running_sum


def at(minute):
    return dt.datetime(2024, 1, 1, 0, minute)


def test_asof_ties_nulls_and_tolerance(spark):
    left = spark.createDataFrame([(1, "a", at(10)), (2, "a", at(0)), (3, None, at(10)), (4, "a", None), (5, "b", at(10)), (5, "b", at(10))], "id int, k string, t timestamp_ntz")
    right = spark.createDataFrame([("a", at(5), 1), ("a", at(5), 7), ("a", at(11), 9), ("a", None, 8), (None, at(1), 6), ("b", at(10), 3)], "k string, u timestamp_ntz, v int")
    out = sorted((r["id"], r["v"]) for r in asof_join(left, right, "t", "u", ["k"], ["v"]).collect())
    assert out == [(1, 7), (2, None), (3, None), (4, None), (5, 3), (5, 3)]
    near = {r["id"]: r["v"] for r in asof_join(left, right, "t", "u", ["k"], ["v"], "INTERVAL 2 MINUTES").collect()}
    assert near[1] is None and near[5] == 3
    assert asof_join(left.limit(0), right, "t", "u", ["k"], ["v"]).count() == 0
    assert asof_join(left, right.limit(0), "t", "u", ["k"], ["v"]).where("v is null").count() == 6


def test_point_in_interval(spark):
    points = spark.createDataFrame([(k, float(k)) for k in range(50)] + [(99, None)], "p int, x double")
    spans = spark.createDataFrame([(1, 3.0, 20.0), (2, 10.0, 11.0), (3, 5.0, 5.0), (4, 9.0, 2.0), (5, None, 4.0)], "s int, lo double, hi double")
    out = sorted((r["p"], r["s"]) for r in point_in_interval(points, spans, F.col("x"), F.col("lo"), F.col("hi"), 4).collect())
    assert out == sorted([(k, 1) for k in range(3, 20)] + [(10, 2)])


def test_a_bin_with_all_points_is_shared_by_tasks(spark):
    points, spans = spark.range(4000).select(F.col("id").alias("p"), (6 + F.col("id") % 2 / 4).alias("x")), spark.range(3000).select(F.col("id").alias("s"), (F.col("id") % 8).cast("double").alias("lo"))
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = point_in_interval(points, spans, F.col("x"), F.col("lo"), F.col("lo") + 4, 10)
        counts = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert out.select("p", "s").distinct().count() == sum(counts) == 4000 * 3000 // 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert len(counts) > 1 and max(counts) < sum(counts) * 2 / 3


def test_points_just_below_an_interval_s_end_are_inside(spark):
    points = spark.createDataFrame([(1, 8.0000001), (2, 8.0000005), (3, 7.9999999), (4, 8.0)], "p int, x double")
    spans = spark.createDataFrame([(1, 3.0, 8.0000005), (2, 3.0, 8.0)], "s int, lo double, hi double")
    out = sorted((r["p"], r["s"]) for r in point_in_interval(points, spans, F.col("x"), F.col("lo"), F.col("hi"), 4).collect())
    assert out == [(1, 1), (3, 1), (3, 2), (4, 1)]
    assert point_in_interval(points.limit(0), spans, F.col("x"), F.col("lo"), F.col("hi"), 4).count() == 0


def test_dense_bins_are_not_multiplied_by_the_shuffle(spark):
    points, spans = spark.range(6000).select(F.col("id").alias("p"), (F.col("id") % 10).cast("double").alias("x")), spark.range(5000).select(F.col("id").alias("s"), (F.col("id") % 8).cast("double").alias("lo"))
    out = point_in_interval(points, spans, F.col("x"), F.col("lo"), F.col("lo") + 4, 10)
    assert out.columns == ["p", "x", "s", "lo"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan.split("_small")[0] and "rightHint=(strategy=broadcast)" in plan
    wanted = sum(lo <= x < lo + 4 for x in range(10) for lo in range(8)) * 600 * 625
    assert out.count() == out.select("p", "s").distinct().count() == wanted


def test_passes_and_cells_of_the_interval_join_agree(spark, monkeypatch):
    from tessera.operators import intervals as module

    points = spark.createDataFrame([(k, float(k % 97)) for k in range(700)] + [(999, None)], "p int, x double")
    spans = spark.createDataFrame([(k, float(k % 89), float(k % 89 + k % 7)) for k in range(500)], "s int, lo double, hi double")
    brute = sorted((k, j) for k in range(700) for j in range(500) if j % 89 <= k % 97 < j % 89 + j % 7)
    for broadcast, block, swapped in ((200_000, 1024, False), (300, 16, False), (300, 16, True), (20, 1024, False)):
        monkeypatch.setattr(module, "BROADCAST", broadcast)
        monkeypatch.setattr(module, "BLOCK", block)
        few = spans.where("s < 50") if swapped else spans
        out = point_in_interval(points, few, F.col("x"), F.col("lo"), F.col("hi"), 40)
        cells = "_rcell" in out._jdf.queryExecution().optimizedPlan().toString()
        assert cells == (broadcast == 20)
        assert sorted((r["p"], r["s"]) for r in out.collect()) == [b for b in brute if not swapped or b[1] < 50]


def test_intervals_over(spark):
    points = spark.createDataFrame([(k, float(k)) for k in range(50)] + [(7, 7.0), (99, None)], "p int, x double")
    bounds = [(3.0, 20.0), (10.0, 11.0), (10.0, 11.0), (5.0, 5.0), (9.0, 2.0), (None, 4.0), (-5.0, 100.0), (20.0, 30.5)]
    spans = spark.createDataFrame(bounds, "lo double, hi double")
    out = sorted((r["p"], r["n"]) for r in intervals_over(points, spans, F.col("x"), F.col("lo"), F.col("hi"), "n").collect())
    brute = lambda x: sum(lo is not None and lo <= x < hi for lo, hi in bounds)
    assert out == sorted([(k, brute(k)) for k in [*range(50), 7]] + [(99, 0)])
    assert intervals_over(points, spans.limit(0), F.col("x"), F.col("lo"), F.col("hi"), "n").where("n = 0").count() == 52


def test_every_pair_of_the_point_in_interval_join_is_counted(spark, sf_dir):
    import __spark_entry__ as entry

    counts = entry.queries()["point_in_interval_counts"](spark, sf_dir)
    assert counts.agg(F.sum("n")).first()[0] == entry.queries()["point_in_interval_join"](spark, sf_dir).count() == 37_465


def test_not_in_with_nulls_copies_and_no_members(spark):
    rows = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, None), (5, 2)], "id int, v int")
    rows.createOrReplaceTempView("_not_in_rows")
    for members in ([2, 2, 7], [2, None], [None], [], [9]):
        held = spark.createDataFrame([(m,) for m in members * 50], "m int")
        held.createOrReplaceTempView("_not_in_members")
        want = sorted(spark.sql("SELECT * FROM _not_in_rows WHERE v NOT IN (SELECT m FROM _not_in_members)").collect(), key=repr)
        assert sorted(not_in(rows, F.col("v"), held, F.col("m")).collect(), key=repr) == want
    spark.catalog.dropTempView("_not_in_rows")
    spark.catalog.dropTempView("_not_in_members")


def test_running_sum_is_gapless_in_groups(spark):
    df = spark.createDataFrame([("hot" if k % 3 else None if k % 2 else "cold", k, 1) for k in range(100)], "g string, k int, v int")
    rows = running_sum(df, ["g"], ["k"], "v", "at", 100).collect()
    for g in ("hot", "cold", None):
        own = sorted(r["at"] for r in rows if r["g"] == g)
        assert own == list(range(len(own)))
    again = running_sum(df.repartition(7), ["g"], ["k"], "v", "at", 100).collect()
    assert sorted(rows, key=repr) == sorted(again, key=repr)


def test_rows_above(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,), (None,)], "v double")
    assert sorted((r["v"] or 0, r["n"]) for r in rows_above(df, "v", "n").collect()) == [(0, 0), (1.0, 3), (2.0, 1), (2.0, 1), (3.0, 0)]
    assert rows_above(df.limit(0), "v", "n").count() == 0


def test_rows_within(spark):
    times = [0, 0, 1, 3, 3, 3, 8, 9, 13, 14, 20, 59, None, None]
    rows = [(g, None if t is None else at(t)) for g in ("a", "b", None) for t in times] + [("a", at(4))] * 300 + [("only null", None)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id int, g string, t timestamp_ntz").repartition(5)
    got = sorted(rows_within(df, "g", "t", "interval 5 minutes", "n").collect(), key=lambda r: r["id"])
    near = lambda t, u: u is None if t is None else u is not None and t - dt.timedelta(minutes=5) <= u <= t
    assert [(r["id"], r["n"]) for r in got] == [(k, sum(h == g and near(t, u) for h, u in rows)) for k, (g, t) in enumerate(rows)]
    assert rows_within(df.limit(0), "g", "t", "interval 5 minutes", "n").count() == 0


def test_rows_within_keeps_all_rows_when_its_counts_are_not_read(spark):
    df = spark.range(20_000).selectExpr("id", "cast(id % 500 as string) as g", "timestamp'2024-01-01' + make_dt_interval(0, 0, 0, id * 7) as t").repartition(5)
    set_to = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    kept = {k: spark.conf.get(k) for k in set_to}
    try:
        for k, v in set_to.items():
            spark.conf.set(k, v)
        out = rows_within(df, "g", "t", "interval 1 hour", "n")
        assert out.count() == out.select("id").distinct().count() == len(out.collect()) == 20_000
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_exact_percentiles(spark):
    import numpy as np

    rows = [("hot", float(k * k % 97)) for k in range(400)] + [("one", 5.0), ("two", 1.0), ("two", 2.0), (None, 3.0), (None, 3.0), ("none", None), ("hot", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    out = {r["g"]: (r["a"], r["b"], r["c"], r["d"]) for r in exact_percentiles(df, "g", "v", {"a": 0.0, "b": 0.25, "c": 0.9, "d": 1.0}).collect()}
    assert set(out) == {"hot", "one", "two", None}
    for g, got in out.items():
        assert np.allclose(got, np.quantile([v for h, v in rows if h == g and v is not None], [0, 0.25, 0.9, 1]))
    assert exact_percentiles(df.limit(0), "g", "v", {"a": 0.5}).count() == 0


def test_frames_with_nulls(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, None), ("a", 2, 7), ("b", 1, None)], "g string, o int, v int")
    w = Window.partitionBy("g").orderBy("o").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = df.select("g", "o", "v", frames.sum_without_current("v", w).alias("s"), frames.distinct_count("v", ["g"]).alias("d")).collect()
    assert sorted((r["g"], r["o"], r["v"] or 0, r["s"], r["d"]) for r in out) == [("a", 1, 5, 7, 2), ("a", 2, 0, 12, 2), ("a", 2, 7, 5, 2), ("b", 1, 0, None, None)]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0]), ([0.0, 0.0], [1.0, 2.0]), ([1.0], [1.0, 2.0]), (None, [1.0])], "a array<double>, b array<double>")
    out = df.select(vectors.dot(F.col("a"), F.col("b")).alias("d"), vectors.cosine(F.col("a"), F.col("b")).alias("c"), vectors.l2_distance(F.col("a"), F.col("b")).alias("l")).collect()
    assert [tuple(r) for r in out] == [(25.0, 1.0, 0.0), (0.0, None, 5.0**0.5), (None, None, None), (None, None, None)]


def test_nearest_in_blocks(spark, monkeypatch):
    from tessera.operators import nearest as module

    rows = spark.createDataFrame([(k, [1.0, k / 10]) for k in range(30)] + [(99, None), (98, [0.0, 0.0])], "id int, v array<double>")
    whole = sorted(nearest(rows, rows.where("id < 6"), "id", "v", 2).collect())
    monkeypatch.setattr(module, "BLOCK", 2)
    assert sorted(nearest(rows, rows.where("id < 6"), "id", "v", 2).collect()) == whole
    assert len(whole) == 12 and whole[0]["match_id"] == 1


def test_sketches_keep_to_their_bounds(spark, sf_dir):
    import __spark_entry__ as entry

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    want = {r["event_type"]: r for r in events.groupBy("event_type").agg(F.countDistinct("user_id").alias("u"), F.count("*").alias("n"), F.median("value").alias("m")).collect()}
    for r in entry.queries()["approximate_sketches"](spark, sf_dir).collect():
        if r["event_type"] == "all":
            assert abs(r["users"] / events.select("user_id").distinct().count() - 1) < 0.05
        else:
            w = want[r["event_type"]]
            assert abs(r["users"] / w["u"] - 1) < 0.05 and abs(r["ids"] / w["n"] - 1) < 0.2 and abs(r["mid"] - w["m"]) < 5
