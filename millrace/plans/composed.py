"""Queries by the DataFrame API and the library's own operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import aggregates, joins, sets, windows
from .base import register, table


@register(
    "pricing_summary",
    """SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_base_price,
       CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS avg_disc, count(*) AS count_order
       FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""",
)
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        aggregates.exact_sum(F.col("l_quantity")).alias("sum_qty"),
        aggregates.exact_sum(F.col("l_extendedprice")).alias("sum_base_price"),
        (aggregates.exact_sum(F.col("l_discount")) / F.count("*")).alias("avg_disc"),
        F.count("*").alias("count_order"),
    )


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, sf_dir, "events")
    views = events.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    buys = events.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    return buys, views


ASOF = """SELECT b.user_id, b.ts, b.event_id, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') b
{how} (SELECT * FROM events WHERE event_type = 'view') v ON b.user_id = v.user_id AND b.ts {op} v.ts"""


@register("asof_backward", ASOF.format(how="ASOF JOIN", op=">="))
def asof_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.asof(*_sides(spark, sf_dir), by=["user_id"], on="ts", values=["view_id"])


@register("asof_strict_left", ASOF.format(how="ASOF LEFT JOIN", op=">"))
def asof_strict_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.asof(*_sides(spark, sf_dir), by=["user_id"], on="ts", values=["view_id"], strict=True, how="left")


@register(
    "interval_pairs",
    """SELECT b.user_id, b.event_id AS buy, v.event_id AS viewed FROM events b JOIN events v ON b.user_id = v.user_id
       WHERE b.event_type = 'purchase' AND v.event_type = 'view' AND abs(epoch_us(b.ts) - epoch_us(v.ts)) <= 7200000000""",
)
def interval_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    buys, views = _sides(spark, sf_dir)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    left = buys.select("user_id", F.col("event_id").alias("buy"), F.col("ts").alias("bought_at"))
    right = views.select("user_id", F.col("view_id").alias("viewed"), F.col("ts").alias("viewed_at"))
    return joins.within(left, right, ["user_id"], micros("bought_at"), micros("viewed_at"), 7_200_000_000).select("user_id", "buy", "viewed")


@register(
    "range_spans",
    """SELECT p.p_partkey, s.s_suppkey FROM part p JOIN supplier s
       ON p.p_partkey * 10 >= s.s_suppkey * 90 AND p.p_partkey * 10 < s.s_suppkey * 90 + 250""",
)
def range_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 10).alias("at"))
    spans = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") * 90).alias("from"), (F.col("s_suppkey") * 90 + 250).alias("to"))
    return joins.ranges(points, spans, "at", "from", "to", 250).select("p_partkey", "s_suppkey")


@register("join_salted", "SELECT l_returnflag, n_name, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL")
def join_salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), "l_returnflag")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey"))
    named = joins.small_or_shuffled(joins.salted(lines, suppliers, ["s_suppkey"], 8), table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), ["n_nationkey"])
    return named.groupBy("l_returnflag", "n_name").agg(F.count("*").alias("n"))


@register("salted_sums", "SELECT l_returnflag, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total FROM lineitem GROUP BY l_returnflag")
def salted_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.salted_sum(table(spark, sf_dir, "lineitem"), ["l_returnflag"], F.col("l_quantity").cast("bigint"), 16, "total")


@register("shape_of_sample", "SELECT l_returnflag, round(skewness(l_extendedprice), 5) AS skew, round(kurtosis(l_extendedprice), 5) AS kurt FROM lineitem GROUP BY l_returnflag")
def shape_of_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(aggregates.sample_skewness(x), 5).alias("skew"), F.round(aggregates.sample_kurtosis(x), 5).alias("kurt"))


@register("histogram", "SELECT CAST(floor(o_totalprice / 25000) * 25000 AS DOUBLE) AS low, count(*) AS n FROM orders GROUP BY 1")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.histogram(table(spark, sf_dir, "orders"), F.col("o_totalprice"), 25000)


@register("top_per_group", "SELECT c_mktsegment, c_custkey, c_acctbal, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS INT) AS rank FROM customer) WHERE rank <= 5")
def top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", "c_acctbal")
    return windows.top_per_group(rows, ["c_mktsegment"], [F.desc("c_acctbal"), F.asc("c_custkey")], 5)


@register(
    "sessions",
    """SELECT user_id, session, count(*) AS n, min(ts) AS began, max(ts) AS ended FROM (
         SELECT *, CAST(sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM (
           SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)))
       GROUP BY user_id, session""",
)
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.sessions(table(spark, sf_dir, "events").select("user_id", "ts"), ["user_id"], "ts", "2 hours")
    return rows.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("began"), F.max("ts").alias("ended"))


@register("tumbling", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.window("ts", "1 hour")
    return table(spark, sf_dir, "events").groupBy(cell["start"].cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count("*").alias("n"))


@register("sliding", "SELECT b AS begin, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS b FROM events) GROUP BY b")
def sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.window("ts", "1 hour", "30 minutes")
    return table(spark, sf_dir, "events").groupBy(cell["start"].cast("timestamp_ntz").alias("begin")).agg(F.count("*").alias("n"))


@register(
    "session_windows",
    """SELECT user_id, began, ended, n FROM (SELECT user_id, session, count(*) AS n, min(ts) AS began, max(ts) + INTERVAL 2 HOUR AS ended FROM (
         SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM (
           SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)))
       GROUP BY user_id, session)""",
)
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("began"), F.col("w.end").cast("timestamp_ntz").alias("ended"), "n")


@register(
    "gaps_filled",
    """WITH days AS (SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n FROM events GROUP BY ALL),
       grid AS (SELECT user_id, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS day FROM days GROUP BY user_id)
       SELECT user_id, day, last_value(n IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING) AS n FROM grid LEFT JOIN days USING (user_id, day)""",
)
def gaps_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").groupBy("user_id", scalars.truncated("day", F.col("ts")).alias("day")).agg(F.count("*").alias("n"))
    return windows.gaps_filled(days, ["user_id"], "day", "n", "1 day")


CHANGED = """old AS (SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 5 <> 0),
new AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 6 <> 0)"""


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    newer = rows.where("c_custkey % 6 <> 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 7 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    return rows.where("c_custkey % 5 <> 0"), newer


@register(
    "changes",
    f"""WITH {CHANGED} SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN o.c_custkey IS NULL THEN 'insert' WHEN n.c_custkey IS NULL THEN 'delete' ELSE 'update' END AS change
        FROM old o FULL JOIN new n ON o.c_custkey = n.c_custkey WHERE o.c_custkey IS NULL OR n.c_custkey IS NULL OR o.c_acctbal <> n.c_acctbal""",
)
def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.changes(*_versions(spark, sf_dir), key=["c_custkey"])


@register("upsert", f"WITH {CHANGED} SELECT * FROM old WHERE c_custkey NOT IN (SELECT c_custkey FROM new) UNION ALL SELECT * FROM new")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.merged(*_versions(spark, sf_dir), key=["c_custkey"])


@register("union_by_name", "SELECT s_suppkey AS key, s_name AS name, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer")
def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    b = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("name"), F.col("c_custkey").alias("key"))
    return a.unionByName(b, allowMissingColumns=True)


@register("discounted", "SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * (1 - l_discount), 2) AS price, dayofweek(l_shipdate) AS weekday FROM lineitem")
def discounted(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = scalars.cents(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", price.alias("price"), scalars.iso_weekday(F.col("l_shipdate")).alias("weekday"))


@register("word_overlap", "SELECT p_partkey, CAST(len(list_intersect(a, b)) AS DOUBLE) / len(list_distinct(list_concat(a, b))) AS overlap FROM (SELECT p_partkey, string_split(p_name, ' ') AS a, string_split(lower(p_type), ' ') AS b FROM part)")
def word_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", scalars.jaccard(F.split("p_name", " "), F.split(F.lower("p_type"), " ")).alias("overlap"))


@register("dot_products", "SELECT a.vec_id AS x, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: CAST(p[1] AS DOUBLE) * p[2])), 5) AS product FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def dot_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("x"), F.col("embedding").alias("ea"))
    b = table(spark, sf_dir, "embeddings").select((F.col("vec_id") - 1).alias("x"), F.col("embedding").alias("eb"))
    return a.join(b, "x").select("x", F.round(scalars.dot(F.col("ea"), F.col("eb")), 5).alias("product"))


@register("lateral_api", "SELECT n_name, c_custkey, c_acctbal FROM nation, LATERAL (SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey = n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 3) t")
def lateral_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation")
    customers = table(spark, sf_dir, "customer")
    top = customers.where(F.col("c_nationkey") == F.col("n_nationkey").outer()).orderBy(F.desc("c_acctbal"), "c_custkey").limit(3).select("c_custkey", "c_acctbal")
    return nations.lateralJoin(top).select("n_name", "c_custkey", "c_acctbal")


# Sketches: other engines' estimates differ, so there is no SQL for them; tests hold them against exact counts.
@register("approximate_distinct")
def approximate_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"), F.hll_sketch_estimate(F.hll_sketch_agg("l_suppkey")).alias("suppliers"))


@register("merged_sketches")
def merged_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches kept by month are merged by year without going back to the rows."""
    months = table(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month")).agg(F.hll_sketch_agg("l_orderkey").alias("sketch"))
    return months.groupBy("year").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("orders"))


@register("approximate_percentiles")
def approximate_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.percentile_approx("l_extendedprice", [0.1, 0.5, 0.9], 1000).alias("cuts"))


@register("share_of_group", "SELECT o_orderkey, round(o_totalprice / max(o_totalprice) OVER (PARTITION BY o_custkey), 9) AS share FROM orders")
def share_of_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(F.col("o_totalprice") / F.max("o_totalprice").over(Window.partitionBy("o_custkey")), 9).alias("share"))
