"""Queries whose work must not gather in one task: shared passages, nearest rows, NOT IN, keys that hold all rows,
percentiles and inequalities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import aggregates, graphs, inequalities, joins, overlap, vectors, windows
from .base import register, table

WORDS = f"regexp_extract_all(translate(text, '{overlap.UPPER}', '{overlap.LOWER}'), '{overlap.WORD}')"


@register(
    "evaluation_overlap",
    f"""WITH d AS (SELECT DISTINCT doc_id, text, {WORDS} AS w FROM documents WHERE text IS NOT NULL),
    i AS (SELECT DISTINCT item_id, text, {WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
    dg AS (SELECT doc_id, text, p, array_to_string(w[p:p + {overlap.PASSAGE - 1}], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - {overlap.PASSAGE - 2})) AS p FROM d)),
    ig AS (SELECT item_id, text, p, array_to_string(w[p:p + {overlap.PASSAGE - 1}], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - {overlap.PASSAGE - 2})) AS p FROM i)),
    hits AS (SELECT dg.doc_id, dg.text, ig.item_id, ig.text AS item, dg.p - ig.p AS shift, dg.p FROM dg JOIN ig ON dg.g = ig.g),
    runs AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, text, item_id, item, shift ORDER BY p) AS run FROM hits),
    lengths AS (SELECT doc_id, item_id, contains(text, item) AS contained, min(p) - 1 AS doc_start, min(p) - shift - 1 AS item_start, count(*) + {overlap.PASSAGE - 1} AS n_words FROM runs GROUP BY doc_id, text, item_id, item, shift, run),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_words DESC, doc_start, item_start) AS place, bool_or(contained) OVER (PARTITION BY doc_id, item_id) AS any_contained FROM lengths)
    SELECT doc_id, item_id, n_words::INTEGER AS n_words, doc_start::INTEGER AS doc_start, item_start::INTEGER AS item_start, any_contained AS contained FROM ranked WHERE place = 1""",
)
def evaluation_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.shared_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


NEAREST = """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
pairs AS (SELECT a.vec_id, b.vec_id AS near_id, round(list_cosine_similarity(a.e, b.e), 6) AS similarity FROM v a JOIN v b ON b.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, near_id) AS INT) AS rank FROM pairs)
SELECT vec_id, rank, near_id, similarity FROM ranked WHERE rank <= 3"""


@register("nearest_three", NEAREST)
def nearest_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector whose id 100 divides against all vectors, in blocks."""
    return vectors.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 3, "vec_id", "embedding")


@register("nearest_three_cells")
def nearest_three_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by cells; what it finds differs where a neighbour lies in no cell that is looked into, so there is no SQL."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vectors.nearest(rows, F.col("vec_id") % 100 == 0, 3, "vec_id", "embedding", vectors.cells_for(rows, 3, "vec_id", "embedding"))


@register("filter_not_in", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40)")
def filter_not_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 40")
    return joins.not_in(table(spark, sf_dir, "part"), F.col("p_partkey"), lines, F.col("l_partkey")).select("p_partkey")


@register("filter_not_in_null", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT CASE WHEN s_suppkey > 5 THEN NULL ELSE s_suppkey END FROM supplier) OR c_acctbal > 5000")
def filter_not_in_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OR with another condition: its rows, and of the others those that are not in."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    rich = F.coalesce(F.col("c_acctbal") > 5000, F.lit(False))
    keys = table(spark, sf_dir, "supplier").select(F.expr("CASE WHEN s_suppkey > 5 THEN NULL ELSE s_suppkey END").alias("key"))
    return customers.where(rich).unionByName(joins.not_in(customers.where(~rich), F.col("c_custkey"), keys, F.col("key"))).select("c_custkey")


@register(
    "asof_one_key",
    """SELECT ts, event_id, view_id FROM (SELECT ts, event_id, event_type, max(n_view) OVER (ORDER BY ts RANGE UNBOUNDED PRECEDING) AS n FROM (
         SELECT *, CASE WHEN event_type = 'view' THEN row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) END AS n_view FROM events)) e
       JOIN (SELECT event_id AS view_id, row_number() OVER (ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'view') v ON v.n = e.n WHERE event_type = 'purchase'""",
)
def asof_one_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the latest view of any user: all rows are one key."""
    events = table(spark, sf_dir, "events")
    views = events.where("event_type = 'view'").select("ts", F.col("event_id").alias("view_id"))
    return joins.asof(events.where("event_type = 'purchase'").select("ts", "event_id"), views, [], "ts", ["view_id"])


@register(
    "sessions_of_types",
    """SELECT event_type, session, count(*) AS n, min(ts) AS began, max(ts) AS ended FROM (
         SELECT *, CAST(sum(b) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM (
           SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL 10 MINUTE THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)))
       GROUP BY event_type, session""",
)
def sessions_of_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few keys hold all rows, so each is run by many tasks."""
    rows = windows.sessions(table(spark, sf_dir, "events").select("event_type", "ts"), ["event_type"], "ts", "10 minutes", hot_rows=0)
    return rows.groupBy("event_type", "session").agg(F.count("*").alias("n"), F.min("ts").alias("began"), F.max("ts").alias("ended"))


@register("percentiles", "SELECT c_mktsegment, round(quantile_cont(c_acctbal, 0.25), 6) AS q1, round(median(c_acctbal), 6) AS q2, round(quantile_cont(c_acctbal, 0.9), 6) AS q9 FROM customer GROUP BY c_mktsegment")
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = aggregates.percentiles(table(spark, sf_dir, "customer"), ["c_mktsegment"], F.col("c_acctbal"), {"q1": 0.25, "q2": 0.5, "q9": 0.9})
    return found.select("c_mktsegment", *(F.round(c, 6).alias(c) for c in ("q1", "q2", "q9")))


@register("medians_of_lines", "SELECT l_returnflag, l_linestatus, round(median(l_extendedprice), 6) AS price, round(quantile_cont(l_extendedprice, 0.99), 6) AS dear FROM lineitem GROUP BY ALL")
def medians_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few groups of many different values."""
    found = aggregates.percentiles(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], F.col("l_extendedprice"), {"price": 0.5, "dear": 0.99})
    return found.select("l_returnflag", "l_linestatus", *(F.round(c, 6).alias(c) for c in ("price", "dear")))


@register(
    "closure_of_orders",
    """WITH RECURSIVE e AS (SELECT o_orderkey AS a, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders),
    t AS (SELECT a, b, CAST(1 AS BIGINT) AS depth FROM e WHERE b IS NOT NULL UNION ALL SELECT t.a, e.b, t.depth + 1 FROM t JOIN e ON e.a = t.b WHERE e.b IS NOT NULL)
    SELECT a AS earlier, b AS later, depth FROM t""",
)
def closure_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders follow each other for each customer: all pairs of an order and one that comes after it."""
    following = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    edges = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("earlier"), following.alias("later"))
    return graphs.closure(edges, "earlier", "later")


@register("dearer_before","SELECT a.o_orderkey, count(b.o_orderkey) AS n FROM orders a LEFT JOIN orders b ON b.o_orderdate < a.o_orderdate AND b.o_totalprice > a.o_totalprice GROUP BY a.o_orderkey")
def dearer_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each order the earlier orders that cost more: orders against orders on two inequalities."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("at"), "o_totalprice")
    return inequalities.below_and_above(orders, orders, "o_orderkey", ("at", "at"), ("o_totalprice", "o_totalprice"))
