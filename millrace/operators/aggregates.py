"""Aggregates beyond Spark's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut


def exact_sum(x: Column, digits: int = 2) -> Column:
    """A sum of doubles that hold decimals, the same in any order."""
    return F.sum(x.cast(f"decimal(18,{digits})")).cast("double")


def sample_skewness(x: Column) -> Column:
    n = F.count(x)
    return F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2)


def sample_kurtosis(x: Column) -> Column:
    """Excess kurtosis of a sample."""
    n = F.count(x)
    return ((n + 1) * F.kurtosis(x) + 6) * (n - 1) / ((n - 2) * (n - 3))


def salted_sum(df: DataFrame, by: list[str], value: Column, salts: int, name: str) -> DataFrame:
    """Sums in two steps, so that no task has all rows of a hot key even where partial sums don't help. Rows are dealt in
    turn, so that no column but the keys and the value is read."""
    rows = df.select(*by, value.alias("_value")).withColumn("_salt", F.monotonically_increasing_id() % salts)
    part = rows.groupBy(*by, "_salt").agg(F.sum("_value").alias("_part"))
    return part.groupBy(*by).agg(F.sum("_part").alias(name))


def histogram(df: DataFrame, value: Column, width: float) -> DataFrame:
    """Rows of (low, n): counts in cells of one width."""
    return df.groupBy((F.floor(value / width) * width).cast("double").alias("low")).agg(F.count("*").alias("n"))


def percentiles(df: DataFrame, by: list[str], value: Column, shares: dict[str, float], parts: int | None = None) -> DataFrame:
    """Exact percentiles of each group, between two values in proportion; `shares` names the columns.

    Selection by counted ranges: equal values of a group become one row with their number before anything else, these
    are sorted into ranges of (group, value) over all tasks, and the sizes of a group's ranges tell which one holds a
    wanted place. Only those ranges are run through, each by itself. So no task holds a group or its distinct values,
    and a value that most rows have is one row. Nulls don't count; a group without values has nulls; null is a group.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct(*by) if by else F.struct(F.lit(0).alias("one"))
    rows = df.select(key.alias("_key"), value.cast("double").alias("_value"))
    counts = rows.where("_value is not null").groupBy("_key", "_value").agg(F.count("*").alias("_n"))
    counts = cut(counts.repartitionByRange(n, "_key", "_value").withColumn("_part", F.spark_partition_id()))
    sizes = counts.groupBy("_key", "_part").agg(F.sum("_n").alias("_rows"))
    group = Window.partitionBy("_key")
    earlier = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_key", "_part", "_rows", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"), F.sum("_rows").over(group).alias("_all"))
    places = [F.struct(F.lit(name).alias("name"), F.lit(low).alias("low"), (F.floor if low else F.ceil)(F.lit(float(p)) * (F.col("_all") - 1)).alias("at"), (F.lit(float(p)) * (F.col("_all") - 1) % 1).alias("over")) for name, p in shares.items() for low in (True, False)]
    wanted = sizes.withColumn("_w", F.explode(F.array(*places))).where((F.col("_w.at") >= F.col("_before")) & (F.col("_w.at") < F.col("_before") + F.col("_rows")))
    wanted = wanted.groupBy("_key", "_part").agg(F.collect_list(F.struct((F.col("_w.at") - F.col("_before")).alias("at"), F.col("_w.name").alias("name"), F.col("_w.low").alias("low"), F.col("_w.over").alias("over"))).alias("_w"))
    so_far = F.sum("_n").over(Window.partitionBy("_key", "_part").orderBy("_value").rowsBetween(Window.unboundedPreceding, 0))
    held = counts.join(wanted, ["_key", "_part"]).withColumn("_to", so_far)
    held = held.select("_key", "_value", F.explode(F.filter("_w", lambda w: (w["at"] >= F.col("_to") - F.col("_n")) & (w["at"] < F.col("_to")))).alias("w"))
    at = lambda name, low: F.max(F.when((F.col("w.name") == name) & (F.col("w.low") == low), F.col("_value")))
    over = lambda name: F.max(F.when(F.col("w.name") == name, F.col("w.over")))
    found = held.groupBy("_key").agg(*((at(name, True) + (at(name, False) - at(name, True)) * over(name)).alias(name) for name in shares))
    out = rows.select("_key").distinct().join(found, "_key", "left") if by else found
    return out.select(*(F.col("_key")[c].alias(c) for c in by), *shares)
