"""Window patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scans

def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark keeps k of each task before it shuffles."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def sessions(df: DataFrame, by: list[str], at: str, gap: str, hot_rows: int = scans.HOT_ROWS) -> DataFrame:
    """Adds `session`, numbered from 1 for each key: a row that comes later than `gap` after the last begins one. Keys of
    more than `hot_rows` rows are run by many tasks."""

    def begins(last: Column) -> Column:
        return (last.isNull() | (F.col(at) > last + F.expr(f"interval {gap}"))).cast("int")

    def plain(rows: DataFrame) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(at)
        rows = rows.withColumn("_begins", begins(F.lag(at).over(order)))
        return rows.withColumn("session", F.sum("_begins").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_begins")

    def spread(rows: DataFrame) -> DataFrame:
        rows = scans.before(scans.dealt(rows, by, [at]), by, [at], at, "_last")
        rows = rows.withColumn("_begins", begins(F.col("_last"))).drop("_last")
        # Rows of one time stand in any order: the one that begins a session goes first.
        return scans.running_sum(rows.withColumn("_later", 1 - F.col("_begins")), by, [at, "_later"], "_begins", "session").drop("_part", "_begins", "_later")

    return scans.by_heat(df, by, hot_rows, plain, spread)


def gaps_filled(df: DataFrame, by: list[str], at: str, value: str, step: str, hot_rows: int = scans.HOT_ROWS) -> DataFrame:
    """One row for each step of time between a key's first and last, the last known value carried on. `at` holds
    times cut to the step, once for each key. Keys of more than `hot_rows` steps are run by many tasks."""
    grid = df.groupBy(*by).agg(F.min(at).alias("_a"), F.max(at).alias("_b")).select(*by, F.explode(F.sequence("_a", "_b", F.expr(f"interval {step}"))).alias(at))
    rows = grid.join(df.select(*by, at, value), [*by, at], "left")
    order = Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)

    def spread(rows: DataFrame) -> DataFrame:
        return scans.last_known(scans.dealt(rows, by, [at]), by, [at], value, "_known").drop("_part", value).withColumnRenamed("_known", value)

    return scans.by_heat(rows, by, hot_rows, lambda d: d.withColumn(value, F.last(value, ignorenulls=True).over(order)), spread)
