"""The connector with commits, two-phase aggregates and closures, against plain forms on small tables."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import folds, graphs
from millrace.sources import lines

SCHEMA = "k bigint, s string, x double, t timestamp_ntz, d date, m decimal(10,2), b boolean"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def made(spark, n=500):
    rnd = random.Random(1)
    at = dt.datetime(2024, 1, 1)
    data = [(k, rnd.choice(["a", 'q "x"\n', "ü\\", None]), rnd.choice([k / 7, None]), at + dt.timedelta(microseconds=k * 999_983), at.date() + dt.timedelta(days=k), None, k % 2 == 0) for k in range(n)]
    return spark.createDataFrame(data + [(None,) * 7], SCHEMA).repartition(5).withColumn("m", (F.col("k") / 3).cast("decimal(10,2)"))


def test_lines_come_back_by_splits_and_filters(spark, tmp_path):
    lines.register(spark)
    df, path = made(spark), str(tmp_path / "t")
    df.write.format("millrace_lines").mode("append").save(path)
    read = lambda: spark.read.format("millrace_lines").schema(SCHEMA).load(path)
    assert rows(read()) == rows(df) and len(lines.listed(path)) == 5
    for test in (F.col("k") > 490, F.col("k") == 7, F.col("k") <= 3, F.col("s").isin("a"), F.col("x").isNotNull() & (F.col("x") >= 60), (F.col("k") < 5) | (F.col("k") > 400), F.col("t") < F.lit("2024-01-01 00:02:00").cast("timestamp_ntz"), F.col("d") == F.lit("2024-02-01").cast("date")):
        assert rows(read().where(test)) == rows(df.where(test))
    df.limit(3).write.format("millrace_lines").mode("append").save(path)
    assert read().count() == df.count() + 3
    df.limit(2).write.format("millrace_lines").mode("overwrite").save(path)
    assert read().count() == 2 and len(lines.commits(path)) == 3


def test_every_split_point_gives_each_line_once(spark, tmp_path):
    lines.register(spark)
    df, path = made(spark, 20).coalesce(1), str(tmp_path / "t")
    df.write.format("millrace_lines").mode("append").save(path)
    schema, (file,) = df.schema, lines.listed(path)
    whole = [r for s in lines.Lines(path, schema).splits([file]) for r in lines.Lines(path, schema).rows(s)]
    assert len(whole) == 21
    for size in (1, 7, 64, 100, 1000):
        got = [r for at in range(0, file.size, size) for r in lines.Lines(path, schema).rows(lines.Split(file.name, at, min(at + size, file.size)))]
        assert got == whole


def test_filters_reach_the_reader_and_spare_files(spark, tmp_path):
    lines.register(spark)
    path = str(tmp_path / "t")
    for k in range(4):
        spark.range(100 * k, 100 * k + 100).select(F.col("id").alias("k")).coalesce(1).write.format("millrace_lines").mode("append").save(path)
    df = spark.read.format("millrace_lines").schema("k bigint").load(path).where("k >= 250 and k < 260")
    assert rows(df) == [(k,) for k in range(250, 260)]
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in text  # the reader has taken all of them
    reader = lines.LinesReader(path, df.schema)
    reader.filters = [("k", "GreaterThanOrEqual", 250), ("k", "LessThan", 260)]
    assert len(reader.partitions()) == 1


def test_a_failed_task_leaves_no_rows(spark, tmp_path):
    lines.register(spark)
    path = str(tmp_path / "t")
    spark.range(5).select(F.col("id").alias("k")).write.format("millrace_lines").mode("append").save(path)
    bad = spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 99, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("bigint").alias("k"))
    with pytest.raises(Exception, match="no"):
        bad.write.format("millrace_lines").mode("append").save(path)
    assert spark.read.format("millrace_lines").schema("k bigint").load(path).count() == 5
    assert len(lines.commits(path)) == 1
    nothing = str(tmp_path / "none")
    assert spark.read.format("millrace_lines").schema("k bigint").load(nothing).collect() == []


def test_a_stream_reads_commits_once(spark, tmp_path):
    lines.register(spark)
    path, out, held = (str(tmp_path / x) for x in ("t", "out", "held"))

    def add(a, b):
        spark.range(a, b).select(F.col("id").alias("k")).write.format("millrace_lines").mode("append").save(path)

    def drain():
        stream = spark.readStream.format("millrace_lines").schema("k bigint").load(path)
        stream.writeStream.format("parquet").option("checkpointLocation", held).trigger(availableNow=True).start(out).awaitTermination()

    add(0, 10)
    drain()
    add(10, 15)
    add(15, 17)
    drain()
    drain()
    assert rows(spark.read.parquet(out)) == sorted([(k,) for k in range(17)], key=str)


def test_exact_sums_in_any_order(spark):
    rnd = random.Random(2)
    values = [rnd.choice([1e300, 1.0, -1e300, 1e-300, 5e-324, 0.1, 123456.789, 2**60 + 1.0]) * rnd.choice([1, -1]) for _ in range(2000)]
    data = [(rnd.choice(["hot", "hot", "hot", "cold", None]), x if rnd.random() < 0.95 else None) for x in values] + [("nothing", None), ("odd", math.inf), ("odd", 1.0), ("nan", math.nan)]
    data += [("big", 1.7e308), ("big", 1.7e308)]
    df = spark.createDataFrame(data, "g string, x double").repartition(6)
    got = {r["g"]: r["total"] for r in folds.folded(df, ["g"], "x", folds.ExactSum(), "total").collect()}
    want = {g: math.fsum(x for h, x in data if h == g and x is not None) for g, _ in data if g != "big"} | {"big": math.inf}
    assert math.isnan(got.pop("nan")) and math.isnan(want.pop("nan")) and got == want
    assert folds.folded(df.limit(0), ["g"], "x", folds.ExactSum(), "total").collect() == []


def test_closures_of_chains_circles_and_repeated_edges(spark):
    def brute(edges):
        near = {}
        for a, b in edges:
            if a is not None and b is not None:
                near.setdefault(a, set()).add(b)
        found = set()
        for a in near:
            seen, front, depth = {}, near[a], 1
            while front:
                seen |= dict.fromkeys(front, depth)
                front = {c for b in front for c in near.get(b, ())} - set(seen)
                depth += 1
            found |= {(a, b, d) for b, d in seen.items()}
        return found

    rnd = random.Random(3)
    for edges in ([(k, k + 1) for k in range(150)], [(k, (k + 1) % 9) for k in range(9)] + [(3, 3), (3, 3), (None, 1), (1, None)], [(rnd.randrange(40), rnd.randrange(40)) for _ in range(60)]):
        got = graphs.closure(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()
        assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute(edges)
    assert graphs.closure(spark.createDataFrame([], "a int, b int"), "a", "b").collect() == []
