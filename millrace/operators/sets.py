"""Set operations and changes between tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _same(key: list[str]) -> Column:
    """Equal keys of a row and one whose keys are named `_old_` and so on; null equals null."""
    return reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_old_{k}")) for k in key))


def changes(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of (key, change): insert, delete or update between two versions of a table with unique keys. Values are
    compared as they are, nulls too; a null key is a key."""
    rest = [c for c in old.columns if c not in key]
    values = F.struct(*(F.col(c) for c in rest)) if rest else F.lit(0)
    a = old.select(*(F.col(k).alias(f"_old_{k}") for k in key), values.alias("_a"), F.lit(True).alias("_in_a"))
    b = new.select(*key, values.alias("_b"), F.lit(True).alias("_in_b"))
    change = F.when(F.col("_in_a").isNull(), "insert").when(F.col("_in_b").isNull(), "delete").when(~F.col("_a").eqNullSafe(F.col("_b")), "update")
    keys = [F.coalesce(F.col(k), F.col(f"_old_{k}")).alias(k) for k in key]
    return b.join(a, _same(key), "full").withColumn("change", change).where("change is not null").select(*keys, "change")


def merged(base: DataFrame, news: DataFrame, key: list[str]) -> DataFrame:
    """The table after an upsert: rows of `news` replace those of their keys; a null key is a key."""
    keys = news.select(*(F.col(k).alias(f"_old_{k}") for k in key))
    return base.join(keys, _same(key), "left_anti").unionByName(news)
