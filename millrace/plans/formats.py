"""Queries that write a table in a format and read it again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import connector, formats, lines
from ..sources.tables import fresh_folder
from .base import register, table


@register("format_lines", "SELECT * FROM orders WHERE o_totalprice > 200000 AND o_orderstatus IN ('F', 'P') AND o_orderdate >= TIMESTAMP '1995-01-01'")
def committed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders through the library's own connector, written by all tasks and read back with filters in the reader."""
    lines.register(spark)
    orders, path = table(spark, sf_dir, "orders"), fresh_folder(spark, "lines")
    orders.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).write.format("millrace_lines").mode("append").save(path)
    rows = spark.read.format("millrace_lines").schema(orders.schema).load(path)
    return rows.where((F.col("o_totalprice") > 200000) & F.col("o_orderstatus").isin("F", "P") & (F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp_ntz")))


def _round_trip(kind: str) -> None:
    @register(f"format_{kind}", "SELECT * FROM orders")
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return formats.round_trip(table(spark, sf_dir, "orders"), kind)


for _kind in formats.OPTIONS:
    _round_trip(_kind)


@register("format_text", "SELECT c_name AS value FROM customer")
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.lines(table(spark, sf_dir, "customer"), "c_name")


@register("format_partitioned", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderpriority")
def partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = formats.partitioned(table(spark, sf_dir, "orders"), "o_orderstatus")
    return rows.where("o_orderstatus = 'F'").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@register("format_bytes", "SELECT count(*) AS n_lines FROM customer")
def whole_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_folder(spark, "bytes")
    table(spark, sf_dir, "customer").select(F.col("c_name").alias("value")).write.text(path)
    rows = formats.files(spark, path, "*.txt").select((F.size(F.split(F.decode("content", "utf-8"), "\n")) - 1).cast("long").alias("n"))
    return rows.agg(F.sum("n").alias("n_lines"))


@register("format_bucketed", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
def bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = formats.bucketed(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), f"millrace_orders_{uuid.uuid4().hex}", "o_custkey", 8)
    return rows.groupBy("o_custkey").agg(F.count("*").alias("n"))


@register("format_connector", "SELECT p_partkey, p_name FROM part")
def own_connector(spark: SparkSession, sf_dir: str) -> DataFrame:
    connector.register(spark)
    parts = table(spark, sf_dir, "part")
    end = parts.agg(F.max("p_partkey")).first()[0] or 0
    numbers = spark.read.format("millrace_sequence").options(start=0, end=end + 1, partitions=spark.sparkContext.defaultParallelism).load()
    return parts.join(numbers, F.col("p_partkey") == F.col("value")).select("p_partkey", "p_name")
