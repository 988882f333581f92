"""Operators on hand-written rows: nulls, ties, empty tables and what the given tables can't reach."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace.functions import scalars
from millrace.operators import aggregates, joins, sets, windows
from millrace.sources import formats
from millrace.streaming import operators as streams
from millrace.streaming import runs


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_asof_takes_the_latest_and_keeps_unmatched(spark):
    left = spark.createDataFrame([("a", 5, "x"), ("a", 1, "y"), ("b", 9, None), (None, 3, "z")], "k string, t int, v string")
    right = spark.createDataFrame([("a", 2, 20), ("a", 5, 50), ("a", 5, 51), ("b", 10, 1)], "k string, t int, w int")
    assert rows(joins.asof(left, right, ["k"], "t", ["w"])) == [("a", 5, "x", 51)]
    assert rows(joins.asof(left, right, ["k"], "t", ["w"], how="left")) == sorted([("a", 5, "x", 51), ("a", 1, "y", None), ("b", 9, None, None), (None, 3, "z", None)], key=str)
    assert rows(joins.asof(left, right, ["k"], "t", ["w"], strict=True)) == [("a", 5, "x", 20)]


@pytest.mark.parametrize("reach", [1, 3, 10])
def test_within_equals_the_plain_join(spark, reach):
    left = spark.createDataFrame([(1, x) for x in range(0, 40, 3)], "k int, a int")
    right = spark.createDataFrame([(1, x) for x in range(-5, 40, 4)] + [(2, 3)], "k int, b int")
    got = joins.within(left, right, ["k"], F.col("a"), F.col("b"), reach).select("k", "a", "b")
    assert rows(got) == rows(left.join(right, "k").where(F.abs(F.col("a") - F.col("b")) <= reach).select("k", "a", "b"))


def test_ranges_equal_the_plain_join(spark):
    points = spark.createDataFrame([(x,) for x in range(50)], "p int")
    spans = spark.createDataFrame([(1, 0, 7), (2, 5, 30), (3, 30, 31), (4, 49, 90)], "s int, f int, t int")
    want = points.join(spans, (F.col("p") >= F.col("f")) & (F.col("p") < F.col("t"))).select("p", "s")
    assert rows(joins.ranges(points, spans, "p", "f", "t", 8).select("p", "s")) == rows(want)


def test_salted_join_and_sum_keep_repeated_rows(spark):
    left = spark.createDataFrame([(1, 2)] * 20 + [(2, 3)], "k int, v int")
    right = spark.createDataFrame([(1, "a"), (1, "b")], "k int, w string")
    assert rows(joins.salted(left, right, ["k"], 5)) == rows(left.join(right, "k"))
    assert rows(aggregates.salted_sum(left, ["k"], F.col("v"), 4, "n")) == [(1, 40), (2, 3)]
    assert rows(joins.small_or_shuffled(left, right, ["k"], most_rows=1)) == rows(left.join(right, "k"))


def test_top_per_group_and_empty_tables(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), (None, 7)], "k string, v int")
    assert rows(windows.top_per_group(df, ["k"], [F.desc("v")], 2)) == sorted([("a", 2, 1), ("a", 2, 2), (None, 7, 1)], key=str)
    none = df.limit(0)
    assert rows(windows.top_per_group(none, ["k"], [F.desc("v")], 2)) == []
    assert rows(joins.salted(none, df, ["k"], 3)) == []


def test_sessions_and_gaps(spark):
    at = lambda h: dt.datetime(2024, 1, 1, h)
    df = spark.createDataFrame([(1, at(0)), (1, at(2)), (1, at(5)), (2, at(1))], "u int, ts timestamp_ntz")
    assert [r["session"] for r in windows.sessions(df, ["u"], "ts", "2 hours").orderBy("u", "ts").collect()] == [1, 1, 2, 1]
    values = spark.createDataFrame([(1, at(0), 5), (1, at(3), 7)], "u int, ts timestamp_ntz, n int")
    assert [r["n"] for r in windows.gaps_filled(values, ["u"], "ts", "n", "1 hour").orderBy("ts").collect()] == [5, 5, 5, 7]


def test_changes_and_merge(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, None), (4, "d")], "k int, v string")
    assert rows(sets.changes(old, new, ["k"])) == [(1, "delete"), (2, "update"), (4, "insert")]
    assert rows(sets.merged(old, new, ["k"])) == rows(spark.createDataFrame([(1, "a"), (2, "c"), (3, None), (4, "d")], "k int, v string"))


def test_scalars(spark):
    df = spark.createDataFrame([([1, 2, 2], [2, 3], 1.005, 0.0), ([], [], None, 2.0)], "a array<int>, b array<int>, x double, y double")
    got = df.select(scalars.jaccard(F.col("a"), F.col("b")).alias("j"), scalars.safe_divide(F.col("x"), F.col("y")).alias("d"), scalars.dot(F.array(F.lit(2.0)), F.array(F.lit(3.0))).alias("p")).collect()
    assert [tuple(r) for r in got] == [(1 / 3, None, 6.0), (None, None, 6.0)]


@pytest.mark.parametrize("kind", sorted(formats.OPTIONS))
def test_formats_keep_nulls_and_quotes(spark, kind):
    df = spark.createDataFrame([(1, 'a "b", \\c', dt.datetime(2024, 1, 2, 3, 4, 5, 678901)), (2, None, None)], "k int, s string, t timestamp_ntz")
    assert rows(formats.round_trip(df, kind)) == rows(df)


def late_events(spark, folder):
    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    for k, batch in enumerate([[(1, at(1)), (1, at(5))], [(1, at(1, 30))], [(2, at(9))], [(2, at(2))]]):
        spark.createDataFrame(batch, "u bigint, ts timestamp_ntz").coalesce(1).write.parquet(f"{folder}/{k}")
    return f"{folder}/*"


def test_late_rows_are_left_out_behind_the_watermark(spark, tmp_path):
    pattern = late_events(spark, str(tmp_path))
    stream = spark.readStream.schema("u bigint, ts timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(pattern)
    counts = runs.drained(streams.windowed(streams.timed(stream, late="1 hour"), [], "1 hour"), "append")
    assert counts.agg(F.sum("n")).first()[0] < 5
    kept = runs.drained(streams.running_counts(spark.readStream.schema("u bigint, ts timestamp_ntz").parquet(pattern), "u"), "update")
    assert rows(kept.groupBy("u").agg(F.max("n"))) == [(1, 3), (2, 2)]


def test_plans_push_down_and_prune(spark, sf_dir):
    from millrace.plans.registry import QUERIES

    plan = QUERIES["pricing_summary"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate), LessThanOrEqual(l_shipdate" in plan
    assert "l_comment" not in plan and "l_partkey" not in plan


def test_asof_never_takes_null_keys_or_times(spark):
    left = spark.createDataFrame([(1, 5, "b"), (None, 5, "n"), (1, None, "t")], "k int, t int, v string")
    right = spark.createDataFrame([(1, None, "y"), (None, 4, "z")], "k int, t int, w string")
    assert rows(joins.asof(left, right, ["k"], "t", ["w"])) == []
    assert rows(joins.asof(left, right, ["k"], "t", ["w"], how="left")) == sorted([(1, 5, "b", None), (None, 5, "n", None), (1, None, "t", None)], key=str)


def test_changes_and_merge_with_nulls(spark):
    schema = "k int, a string, b string"
    old = spark.createDataFrame([(1, None, "x"), (None, "p", "q"), (2, "s", None)], schema)
    new = spark.createDataFrame([(1, "x", None), (None, "p", "r"), (2, "s", None)], schema)
    assert rows(sets.changes(old, new, ["k"])) == sorted([(1, "update"), (None, "update")], key=str)
    assert rows(sets.changes(old, old, ["k"])) == [] and rows(sets.changes(old.select("k"), new.select("k"), ["k"])) == []
    assert rows(sets.merged(old, new, ["k"])) == rows(new)


def test_salts_deal_equal_rows_too(spark):
    left = spark.createDataFrame([(1, "a")] * 4000, "k int, v string")
    right = spark.createDataFrame([(1, "w")], "k int, w string")
    plan = joins.salted(left, right, ["k"], 8)
    assert plan.count() == 4000
    dealt = left.withColumn("_salt", (F.monotonically_increasing_id() % 8).cast("int")).groupBy("_salt").count().collect()
    assert len(dealt) == 8 and max(r["count"] for r in dealt) < 600
    wide = left.select("k", F.lit(2).alias("x"), F.lit("unread").alias("y"))
    assert "unread" not in aggregates.salted_sum(wide, ["k"], F.col("x"), 4, "n")._jdf.queryExecution().executedPlan().toString()


def test_small_sides_are_known_by_rows_and_bytes(spark):
    left = spark.createDataFrame([(k, "v") for k in range(50)], "k int, v string")
    right = spark.createDataFrame([(k, "w" * 1000) for k in range(50)], "k int, w string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert "BroadcastHashJoin" in plan(joins.small_or_shuffled(left, right, ["k"]))
        assert "SortMergeJoin" in plan(joins.small_or_shuffled(left, right, ["k"], most_rows=10))
        assert "SortMergeJoin" in plan(joins.small_or_shuffled(left, right, ["k"], most_bytes=10_000))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_join_plans(spark, sf_dir):
    from millrace.plans.registry import QUERIES

    plan = lambda name: QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan("join_hinted")
    assert "BroadcastHashJoin" in plan("join_star")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert "SortMergeJoin" in plan("join_inner")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_errors_of_ansi_mode_are_raised(spark):
    from pyspark.errors import ArithmeticException, NumberFormatException

    df = spark.createDataFrame([(1, 0, "x")], "a int, b int, s string")
    with pytest.raises(ArithmeticException):
        df.select(F.col("a") / F.col("b")).collect()
    with pytest.raises(NumberFormatException):
        df.select(F.col("s").cast("int")).collect()
    assert df.select(F.try_divide("a", "b"), F.col("s").try_cast("int")).first() == (None, None)


def test_upper_case_of_german_text(spark):
    texts = ["straße", "öl", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(F.upper("t")).collect()] == [t if t is None else t.upper() for t in texts]


def test_sketches_stay_near_exact_counts(spark, sf_dir):
    from millrace.plans.registry import QUERIES

    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    exact = {r[0]: r for r in lines.groupBy("l_returnflag").agg(F.count_distinct("l_partkey"), F.count_distinct("l_suppkey"), F.sort_array(F.collect_list("l_extendedprice")).alias("p")).collect()}
    for r in QUERIES["approximate_distinct"](spark, sf_dir).collect():
        assert abs(r["parts"] / exact[r["l_returnflag"]][1] - 1) <= 0.06 and abs(r["suppliers"] / exact[r["l_returnflag"]][2] - 1) <= 0.05
    for r in QUERIES["approximate_percentiles"](spark, sf_dir).collect():
        prices = exact[r["l_returnflag"]]["p"]
        for share, cut in zip((0.1, 0.5, 0.9), r["cuts"], strict=True):
            assert prices[max(0, int((share - 0.01) * len(prices)))] <= cut <= prices[min(len(prices) - 1, int((share + 0.01) * len(prices)))]
    years = {r[0]: r[1] for r in lines.groupBy(F.year("l_shipdate")).agg(F.count_distinct("l_orderkey")).collect()}
    for r in QUERIES["merged_sketches"](spark, sf_dir).collect():
        assert abs(r["orders"] / years[r["year"]] - 1) <= 0.05
