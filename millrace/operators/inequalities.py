"""Joins on two inequalities, counted without making a pair."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scans import dealt


def earlier_above(a: np.ndarray, b: np.ndarray, point: np.ndarray) -> np.ndarray:
    """For each row that is no point the points of lesser `a` and greater `b`: by halves, each level of which sorts once."""
    order = np.lexsort((point, a))  # of equal a the points come last, so that what is counted is in front
    b, point = b[order], point[order]
    found = np.zeros(len(b), np.int64)
    at = np.arange(len(b))
    size = 1
    while size < len(b):
        block, later = at // (2 * size), (at // size) % 2 == 1
        turn = np.lexsort((point, -b, block))  # of equal b the points come last
        counts = np.cumsum(point[turn] & ~later[turn])
        first = np.flatnonzero(np.diff(block[turn], prepend=-1))
        base = np.repeat(np.append(0, counts)[first], np.diff(np.append(first, len(b))))
        found[turn] += np.where(later[turn], counts - base, 0)
        size *= 2
    out = np.empty(len(b), np.int64)
    out[order] = found
    return out


def _counted(a: str) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        n = earlier_above(rows.column(a).to_numpy(), rows.column("_b").to_numpy(), rows.column("_point").to_numpy(zero_copy_only=False))
        asks = np.flatnonzero(~rows.column("_point").to_numpy(zero_copy_only=False))
        return pa.table([rows.column("_id").take(pa.array(asks)), pa.array(n[asks])], ["_id", "_n"])

    return run


def below_and_above(left: DataFrame, right: DataFrame, id: str, low: tuple[str, str], high: tuple[str, str], name: str = "n", parts: int | None = None) -> DataFrame:
    """`id` and `name`: for each left row the number of right rows with right.low < left.low and right.high > left.high.
    `low` and `high` name the numeric columns (left, right); times go as microseconds. Left ids are whole numbers.

    Rows of both sides are dealt to ranges of the first column and to ranges of the second. Right rows of an earlier
    range and a higher one count by sums over the grid of ranges; those of the same first range are counted within it,
    and those of an earlier first range in the same second range within that one. So each row is read in two tasks of a
    range each and nothing is paired. A null compares with nothing: such left rows have 0. Repeated ids are summed up.
    Rows that are equal in a column stay in one range of it.
    """
    n = parts or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = left.select(F.col(id).cast("long").alias("_id"), F.col(low[0]).cast("double").alias("_a"), F.col(high[0]).cast("double").alias("_b"), F.lit(False).alias("_point"))
    points = right.select(F.lit(None).cast("long").alias("_id"), F.col(low[1]).cast("double").alias("_a"), F.col(high[1]).cast("double").alias("_b"), F.lit(True).alias("_point"))
    both = rows.unionByName(points).where("_a is not null and _b is not null")
    both = dealt(both, [], ["_a"], n).withColumnRenamed("_part", "_pa")
    both = dealt(both, [], ["_b"], n).withColumnRenamed("_part", "_pb")

    last = max(x or 0 for x in both.agg(F.max("_pa"), F.max("_pb")).first())
    held = both.where("_point").groupBy("_pa", "_pb").agg(F.count("*").alias("_n"))
    one = both.sparkSession.range(1)
    every = F.explode(F.sequence(F.lit(0), F.lit(last)))
    grid = one.select(every.alias("_pa")).select("_pa", every.alias("_pb")).join(held, ["_pa", "_pb"], "left").na.fill(0, ["_n"])
    grid = grid.withColumn("_n", F.sum("_n").over(Window.partitionBy("_pb").orderBy("_pa").rowsBetween(Window.unboundedPreceding, -1)))
    grid = grid.withColumn("_n", F.sum("_n").over(Window.partitionBy("_pa").orderBy(F.desc("_pb")).rowsBetween(Window.unboundedPreceding, -1))).where("_n > 0")

    far = both.where("not _point").join(grid, ["_pa", "_pb"]).select("_id", "_n")
    same = both.groupBy("_pa").applyInArrow(_counted("_a"), "_id long, _n long")
    level = both.groupBy("_pb").applyInArrow(_counted("_pa"), "_id long, _n long")
    nothing = rows.select("_id", F.lit(0).cast("long").alias("_n"))
    return nothing.unionByName(far).unionByName(same).unionByName(level).groupBy(F.col("_id").alias(id)).agg(F.sum("_n").alias(name))
