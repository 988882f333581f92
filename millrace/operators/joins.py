"""Joins that Spark has no operator for, as compositions of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: list[str], on: str, values: list[str], strict: bool = False, how: str = "inner", hot_rows: int | None = None) -> DataFrame:
    """Each left row with the right row of the same key that is latest at or before it (before it, if strict).

    Both sides go through one shuffle by key and one running window, so that neither is multiplied; among right rows
    of one time the greatest values win. `values` are the right columns that are taken. how: inner or left. A null key
    or time matches nothing. Rows of a key of more than `hot_rows` rows, or of all rows if `by` is empty, are dealt to
    ranges of time, with the latest right row carried from one range to the next; those of another key meet in one task,
    sorted, and are read once, never held.
    """
    from . import scans

    right = right.dropna("any", subset=[*by, on])
    payload = F.struct(*(F.col(v) for v in values))
    width = [c for c in left.columns if c not in by and c != on]
    rows = left.select(*by, on, F.lit(1).alias("_side"), F.struct(*(F.col(c) for c in width)).alias("_left"), F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType).alias("_right"))
    found = right.select(*by, on, F.lit(0).alias("_side"), F.lit(None).cast(rows.schema["_left"].dataType).alias("_left"), payload.alias("_right"))
    both = rows.unionByName(found).withColumn("_turn", -F.col("_side") if strict else F.col("_side"))
    order = [on, "_turn", "_right"]

    def plain(df: DataFrame) -> DataFrame:
        window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn("_hit", F.last("_right", ignorenulls=True).over(window))

    def spread(df: DataFrame) -> DataFrame:
        return scans.last_known(scans.dealt(df, by, order), by, order, "_right", "_hit").drop("_part")

    out = scans.by_heat(both, by, scans.HOT_ROWS if hot_rows is None else hot_rows, plain, spread).where("_side = 1")
    if how == "inner":
        out = out.where(F.col("_hit").isNotNull())
    return out.select(*by, on, *(F.col(f"_left.{c}").alias(c) for c in width), *(F.col(f"_hit.{v}").alias(v) for v in values))


def not_in(left: DataFrame, key: Column, right: DataFrame, other: Column) -> DataFrame:
    """Left rows for which `key NOT IN (SELECT other FROM right)` is true, by SQL's three values: all rows if the right
    side is empty, none if it has a null, else those with a key that it lacks. The right side is counted first; then its
    different keys meet the left's in an anti join, so nothing is sent whole for its nulls' sake and no loop is nested."""
    keys = right.select(other.alias("_other"))
    n, n_known = keys.agg(F.count("*"), F.count("_other")).first()
    if n == 0:
        return left
    if n > n_known:
        return left.where(F.lit(False))
    return left.where(key.isNotNull()).withColumn("_key", key).join(keys.distinct(), F.col("_key") == F.col("_other"), "left_anti").drop("_key")


def within(left: DataFrame, right: DataFrame, by: list[str], left_at: Column, right_at: Column, reach: float) -> DataFrame:
    """Pairs of equal keys whose numbers differ by at most `reach`: each side falls in cells of that width, and a left
    row meets three of them, so a hot key is dealt out by cell. Columns of the two sides have different names, but for
    the keys."""
    cell = F.floor(right_at / reach)
    cells = left.withColumn("_cell", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.floor(left_at / reach) + k)))
    return cells.join(right.withColumn("_cell", cell), [*by, "_cell"]).where(F.abs(left_at - right_at) <= reach).drop("_cell")


def ranges(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, width: int) -> DataFrame:
    """Points with all spans [start, end) around them, no other key being shared: spans are dealt to the cells of
    `width` that they touch, so this is an equi-join. Choose `width` near the usual length of a span."""
    touched = spans.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    return points.withColumn("_cell", F.floor(F.col(at) / width)).join(touched, "_cell").where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_cell")


def salted(left: DataFrame, right: DataFrame, by: list[str], salts: int) -> DataFrame:
    """An inner join for hot keys on the left: its rows are dealt in turn over `salts` copies of the right's, equal rows
    too. The left must give its rows in the same order if a task runs again, as files do; checkpoint it otherwise."""
    dealt = left.withColumn("_salt", (F.monotonically_increasing_id() % salts).cast("int"))
    copied = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copied, [*by, "_salt"]).drop("_salt")


def small_or_shuffled(left: DataFrame, right: DataFrame, by: list[str], most_rows: int = 100_000, how: str = "inner", most_bytes: int = 16 << 20) -> DataFrame:
    """Broadcasts the right side where its rows and their bytes are counted to be few, and leaves the choice to Spark
    beyond that."""
    size = F.sum(F.octet_length(F.to_json(F.struct("*"))))
    n, n_bytes = right.limit(most_rows + 1).agg(F.count("*"), F.coalesce(size, F.lit(0))).first()
    few = n <= most_rows and n_bytes <= most_bytes
    return left.join(F.broadcast(right) if few else right, by, how)
