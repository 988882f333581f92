"""Running values over keys of any size: rows are dealt to ranges of (key, order), each range runs on its own, and what the
earlier ranges of a key end with is carried in.

A window runs a key's rows in one task. Here a key with all rows of a table is run by as many tasks as there are ranges;
between them goes one row for each key and range. `order` names columns that are read in rising order, nulls first; rows
that are equal in all of them stay in one range. Null keys are a key. Ranges are cut once and written (checkpoint), since
a range that was sampled anew could hold other rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..sources.tables import cut
from .joins import small_or_shuffled

#: Rows of a key up to which one task runs them.
HOT_ROWS = 4_000_000


def dealt(df: DataFrame, by: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """`df` with _part, the number of the range of (by, order) that a row lies in."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(n, *by, *order).withColumn("_part", F.spark_partition_id()))


def _key(by: list[str]) -> Column:
    return F.struct(*by) if by else F.struct(F.lit(0).alias("one"))


def _within(by: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy("_key", "_part").orderBy(*order)


def _with_carry(rows: DataFrame, edge: Column, carry: Callable[[WindowSpec], Column]) -> DataFrame:
    """Each row with _in: `carry` over what `edge` gives for each earlier range of its key."""
    edges = rows.groupBy("_key", "_part").agg(edge.alias("_edge"))
    earlier = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(edges.select("_key", "_part", carry(earlier).alias("_in")), ["_key", "_part"], "left")


def last_known(rows: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """`name`: the last `value` that isn't null, of this row and the earlier ones of its key. `rows` are dealt."""
    rows = rows.withColumn("_key", _key(by))
    edge = F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order)))
    rows = _with_carry(rows, edge, lambda w: F.last("_edge", ignorenulls=True).over(w))
    here = F.last(value, ignorenulls=True).over(_within(by, order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(name, F.coalesce(here, "_in")).drop("_key", "_in")


def running_sum(rows: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """`name`: the sum of `value` over this row and the earlier ones of its key. `rows` are dealt."""
    rows = rows.withColumn("_key", _key(by))
    rows = _with_carry(rows, F.sum(value), lambda w: F.sum("_edge").over(w))
    here = F.sum(value).over(_within(by, order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(name, F.coalesce(here, F.lit(0)) + F.coalesce(F.col("_in"), F.lit(0))).drop("_key", "_in")


def before(rows: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """`name`: `value` of the row in front of this one in its key, null for the first. `rows` are dealt."""
    rows = rows.withColumn("_key", _key(by))
    edge = F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order))
    rows = _with_carry(rows, edge, lambda w: F.last("_edge").over(w))
    window = _within(by, order)
    here = F.when(F.row_number().over(window) == 1, F.col("_in.v")).otherwise(F.lag(value).over(window))
    return rows.withColumn(name, here).drop("_key", "_in")


def by_heat(df: DataFrame, by: list[str], hot_rows: int, plain: Callable[[DataFrame], DataFrame], spread: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`plain` for keys of up to `hot_rows` rows, `spread` for the others; both give the same rows and columns. Keys are
    counted first, which reads only them; without keys all rows are one."""
    if not by:
        return spread(df)
    hot = cut(df.groupBy(F.struct(*by).alias("_key")).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows).select("_key"))
    if hot.isEmpty():
        return plain(df)
    keyed = df.withColumn("_key", F.struct(*by))
    cold, rest = (small_or_shuffled(keyed, hot, ["_key"], how=how).drop("_key") for how in ("left_anti", "left_semi"))
    return plain(cold).unionByName(spread(rest))
