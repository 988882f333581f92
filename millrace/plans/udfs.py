"""Each kind of user function once, where its rows can be held against SQL. Built-in functions are faster."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import folds
from .base import register, table


@register("udf_plain", "SELECT c_custkey, length(c_name) * 2 AS n FROM customer")
def plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    twice = F.udf(lambda s: None if s is None else len(s) * 2, "bigint")
    return table(spark, sf_dir, "customer").select("c_custkey", twice("c_name").alias("n"))


@register("udf_pandas", "SELECT p_partkey, p_size * 3 + 1 AS n FROM part")
def by_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    def tripled(x: pd.Series) -> pd.Series:
        return x * 3 + 1

    return table(spark, sf_dir, "part").select("p_partkey", F.pandas_udf(tripled, "int")("p_size").alias("n"))


@register("udf_arrow", "SELECT p_partkey, upper(p_name) AS name FROM part")
def by_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    def upper(x: pa.Array) -> pa.Array:
        return pc.utf8_upper(x)

    return table(spark, sf_dir, "part").select("p_partkey", F.arrow_udf(upper, "string")("p_name").alias("name"))


@register("udf_aggregate", "SELECT p_brand, max(p_size) - min(p_size) AS spread FROM part GROUP BY p_brand")
def aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    def spread(x: pd.Series) -> int:
        return int(x.max() - x.min())

    sizes = table(spark, sf_dir, "part").select("p_brand", "p_size").distinct()  # what a group hands to Python
    return sizes.groupBy("p_brand").agg(F.pandas_udf(spread, "int")("p_size").alias("spread"))


@register("udf_two_phase", "SELECT l_returnflag, l_linestatus, round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE), 2) AS total FROM lineitem GROUP BY ALL")
def two_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sum of doubles that is rounded once: partial states in the tasks, merged by key."""
    found = folds.folded(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", folds.ExactSum(), "total")
    return found.withColumn("total", F.round("total", 2))


@register("udf_groups","SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS place FROM orders")
def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A group is one customer's orders, which do not grow with the table."""

    def placed(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.sort_values("o_orderkey").assign(place=range(1, len(rows) + 1))

    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey").groupBy("o_custkey").applyInPandas(placed, "o_custkey bigint, o_orderkey bigint, place bigint")


@register("udf_cogroups", "SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)")
def cogroups(spark: SparkSession, sf_dir: str) -> DataFrame:
    def counted(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"n_nationkey": [key[0]], "customers": [int(a["n"].sum())], "suppliers": [int(b["n"].sum())]})

    # Counted before, so that a group is a row of each side.
    a = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    b = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"))
    return a.groupBy("c_nationkey").cogroup(b.groupBy("s_nationkey")).applyInPandas(counted, "n_nationkey int, customers bigint, suppliers bigint")


@register("udf_batches", "SELECT c_custkey, c_acctbal > 0 AS positive FROM customer")
def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    def positive(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(positive=part.c_acctbal > 0)[["c_custkey", "positive"]]

    return table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").mapInPandas(positive, "c_custkey bigint, positive boolean")


@register("udf_arrow_batches", "SELECT o_orderkey FROM orders WHERE o_totalprice > 150000")
def arrow_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    def dear(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield part.filter(pc.greater(part["o_totalprice"], 150000)).select(["o_orderkey"])

    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").mapInArrow(dear, "o_orderkey bigint")


@register("udf_table", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.udtf(returnType="word string")
    class Words:
        def eval(self, text: str) -> Iterator[tuple[str]]:
            for word in (text or "").split(" "):
                yield (word,)

    spark.udtf.register("millrace_words", Words)
    return spark.sql("SELECT p_partkey, word FROM {part}, LATERAL millrace_words(p_name)", part=table(spark, sf_dir, "part"))
