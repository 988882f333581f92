"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, the expected number of its copies. Among all rates of at most `CAP`, those are taken that
stay closest, in relative entropy, to one even rate and give each source its target of words. The dual of this convex
problem is smooth; its solution tilts the even rate exponentially in a document's size, min(CAP, even * exp(t * size /
mean)), with one t for each source that Newton's steps find, kept in brackets that shrink. Sizes are first counted by
source and size, so that each step is a small aggregation over that table; the rates are then rounded to copies by
running sums in order of size, and the last words are set right by more or fewer copies of the best fitting sizes.

Only DataFrame functions are used. The driver sees single numbers: sums, and whether the steps have converged; if they
haven't after `STEPS`, an error says so. What is left after
`REPAIRS` such corrections stays.
The table of sizes of one source meets in one task: it has a row for each different size, not for each document.

Defined results: null text has size 0; a null source is a source of its own, last in order; sizes of 0 have copies
but no words; sources that can't give more than `CAP` times their words stop there and the excess is shared again by
weight; rows that are repeated are documents of their own; equal input gives equal copies, in any order of rows and
with any number of partitions (of documents with one id, source and size the digest of the text decides, and rows that
are equal in that too may change places); very long texts are one document of that size; an empty table gives no rows;
other columns are kept, and columns with the names of the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import columns, cut, free_name, table

WEIGHTS, SHARE, CAP, CLOSE, STEPS, REPAIRS = (3, 1, 2), 1.5, 2, 1e-6, 100, 6
#: Groups that the documents of one source and size are dealt to.
SALTS = 64
RESULTS = ("size", "source_size", "target", "copies", "taken")
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(rows: DataFrame, by: str, rank: str) -> DataFrame:
    """Adds the place of each row in the order of `by`, from 0: sorted ranges, and a count for each range."""
    dealt = cut(rows.repartitionByRange(by).withColumn("part", F.spark_partition_id()))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each partition
    before = dealt.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(by)) - 1
    return dealt.withColumn(rank, place).join(F.broadcast(before), "part").withColumn(rank, F.col(rank) + F.col("before")).drop("part", "before")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Adds `target` to rows of (key, source_size): sources in order of key weigh `weights`, repeating, and share
    `share` of all words; what exceeds `cap` times a source's size is shared again until nothing does."""
    rows = ranked(sources, "key", "place").withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("place") % len(weights) + 1).cast("int")))
    rows = cut(rows.withColumn("most", cap * F.col("source_size")))
    total = share * (rows.agg(F.sum("source_size")).first()[0] or 0)
    level, n_full = 0.0, -1
    while True:
        full = F.col("most") <= level * F.col("weight")
        n, kept, open_weight = rows.agg(F.coalesce(F.count_if(full), F.lit(0)), F.coalesce(F.sum(F.when(full, F.col("most"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        if n == n_full or not open_weight:
            break
        level, n_full = (total - float(kept)) / open_weight, n
    return rows.select("key", "source_size", F.least(level * F.col("weight"), F.col("most").cast("double")).alias("target"), (F.col("most") <= level * F.col("weight") if open_weight else F.lit(True)).alias("full"))


def _exact(x: Column) -> Column:
    """A sum that doesn't depend on the order of its terms."""
    return F.sum(x.cast("decimal(38,9)")).cast("double")


def tilts(counts: DataFrame, goals: DataFrame, even: float = SHARE, cap: float = CAP) -> DataFrame:
    """Solves the dual for each source: rows of (key, source_size, target, full, mean, tilt). counts: key, size, n."""
    mean = counts.groupBy("key").agg(F.greatest(F.sum(F.col("size") * F.col("n")) / F.sum("n"), F.lit(0.001)).alias("mean"))
    state = goals.join(mean, "key").withColumn("tilt", F.lit(0.0)).withColumn("low", F.lit(None).cast("double")).withColumn("high", F.lit(None).cast("double")).withColumn("off", F.lit(1.0))
    state = cut(state)
    for _ in range(STEPS):
        x = F.col("size") / F.col("mean")
        free = F.lit(float(even)) * F.exp(F.least(F.col("tilt") * x, F.lit(50.0)))
        rate = F.least(free, F.lit(float(cap)))
        sums = counts.join(state.where("not full").select("key", "mean", "tilt"), "key").groupBy("key").agg(_exact(F.col("n") * x * rate).alias("has"), _exact(F.when(free < cap, F.col("n") * x * x * rate).otherwise(0.0)).alias("slope"))
        goal = F.col("target") / F.col("mean")
        gap = F.col("has") - goal
        low, high = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low")), F.when(gap > 0, F.col("tilt")).otherwise(F.col("high"))
        step = state.join(sums, "key", "left").withColumn("low", low).withColumn("high", high).withColumn("newton", F.col("tilt") - F.when(F.col("slope") > 0, gap / F.col("slope")))
        inside = (F.col("newton") > F.coalesce("low", F.col("newton") - 1)) & (F.col("newton") < F.coalesce("high", F.col("newton") + 1))
        # Outside the bracket, or without a slope: halve it, or move its open end away.
        other = F.when(F.col("low").isNull(), F.col("high") - 1 - F.abs("high")).when(F.col("high").isNull(), F.col("low") + 1 + F.abs("low")).otherwise((F.col("low") + F.col("high")) / 2)
        close = F.col("full") | F.col("has").isNull() | (F.abs(gap) <= CLOSE * goal)
        step = step.withColumn("off", F.when(close, 0.0).otherwise(F.abs(gap) / goal)).withColumn("tilt", F.when(close, F.col("tilt")).when(inside, F.col("newton")).otherwise(other))
        state = cut(step.select("key", "source_size", "target", "full", "mean", "tilt", "low", "high", "off"))
        if state.where("off > 0").isEmpty():
            break
    else:
        raise RuntimeError(f"the mix has not converged after {STEPS} steps")
    return state.select("key", "source_size", "target", "full", "mean", "tilt")


def copies_by_size(counts: DataFrame, solved: DataFrame, even: float = SHARE, cap: float = CAP) -> DataFrame:
    """Rows of (key, size, n, total): the copies that all documents of a source and size have together."""
    rate = F.when(F.col("full"), float(cap)).otherwise(F.least(F.lit(float(even)) * F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(50.0))), F.lit(float(cap))))
    rows = counts.join(solved, "key").withColumn("rate", F.when(F.col("size") == 0, F.least(F.lit(float(even)), F.lit(float(cap)))).otherwise(rate))
    order = Window.partitionBy("key").orderBy("size")
    source = Window.partitionBy("key")
    rows = rows.withColumn("until", F.floor(F.sum(F.col("n") * F.col("rate")).over(order.rowsBetween(Window.unboundedPreceding, 0)) + 0.5))
    rows = rows.withColumn("total", F.greatest(F.lit(0), F.least(F.col("until") - F.coalesce(F.lag("until").over(order), F.lit(0)), cap * F.col("n"))))
    for _ in range(REPAIRS):
        left = F.round(F.col("target")) - F.sum(F.col("size") * F.col("total")).over(source)
        rows = rows.withColumn("left", left)
        change = F.greatest(-F.col("total"), F.least(cap * F.col("n") - F.col("total"), F.floor(F.col("left") / F.col("size") + 0.5))).cast("long")
        rows = rows.withColumn("change", F.when(F.col("size") > 0, change))
        gap = F.abs(F.col("left") - F.col("change") * F.col("size"))
        rows = rows.withColumn("best", F.min(F.when(F.col("change") != 0, F.struct(gap.alias("gap"), F.abs("change").alias("copies"), F.col("size").alias("size")))).over(source))
        better = (F.col("best.gap") < F.abs("left")) & (F.col("best.size") == F.col("size"))
        rows = rows.withColumn("total", F.when(better, F.col("total") + F.col("change")).otherwise(F.col("total"))).drop("left", "change", "best")
    return rows.select("key", "size", "n", F.col("total").cast("long").alias("total"))


def mix(docs: DataFrame, size: Column, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, tie: Column | None = None) -> DataFrame:
    """All columns of `docs` and size, source_size, target, copies, taken (copies times size).

    Documents of one source and size are dealt to salted groups, so that no group grows with a source; copies are
    shared out to the groups by count, and within a group by rank of the id's hash, then by `tie` (the text's digest,
    if there is a text)."""
    key, salt, hashed, ties = (free_name(docs, x) for x in ("key", "salt", "hash", "tie"))
    tie = F.md5("text") if tie is None and "text" in docs.columns else F.lit("") if tie is None else tie
    rows = docs.withColumn(ties, tie).withColumn("size", size).drop("source_size", "target", "copies", "taken")
    rows = rows.withColumn(key, F.when(F.col("source").isNull(), "t").otherwise(F.concat(F.lit("s"), F.col("source").cast("string"))))
    rows = rows.withColumn(hashed, F.xxhash64("doc_id")).withColumn(salt, F.pmod(F.col(hashed), F.lit(SALTS)))
    groups = cut(rows.groupBy(F.col(key).alias("key"), "size", F.col(salt).alias("salt")).agg(F.count("*").alias("m")))
    counts = cut(groups.groupBy("key", "size").agg(F.sum("m").alias("n")))
    goals = targets(counts.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, cap)
    solved = tilts(counts, goals, share, cap)
    totals = cut(copies_by_size(counts, solved, share, cap))
    order = Window.partitionBy("key", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, 0)
    shared = groups.join(totals, ["key", "size"]).withColumn("until", F.sum("m").over(order))
    part = lambda x: F.floor(F.col("total").cast("decimal(18,0)") * x.cast("decimal(18,0)") / F.col("n"))
    shared = shared.withColumn("c", (part(F.col("until")) - part(F.col("until") - F.col("m"))).cast("long"))
    shared = shared.select(F.col("key").alias(key), "size", F.col("salt").alias(salt), F.floor(F.col("c") / F.col("m")).alias("every"), (F.col("c") % F.col("m")).alias("extra"))
    shared = shared.join(solved.select(F.col("key").alias(key), "source_size", "target"), key)
    rank = F.row_number().over(Window.partitionBy(key, "size", salt).orderBy(hashed, "doc_id", ties))
    ranks = rows.withColumn("copies", rank)
    out = ranks.join(shared, [key, "size", salt]).withColumn("copies", F.col("every") + (F.col("copies") <= F.col("extra")).cast("long"))
    return out.withColumn("taken", F.col("copies") * F.col("size")).drop(key, salt, hashed, ties, "every", "extra")


def repeated(docs: DataFrame, size: Column) -> DataFrame:
    """Each document of `docs` as often as the mix takes it, with the columns of `docs`, also those with the names of the
    mix's results. `size` is made of other columns."""
    own = {c: free_name(docs, f"own_{c}") for c in docs.columns if c.lower() in RESULTS}
    mixed = mix(docs.withColumnsRenamed(own), size)
    copy = free_name(mixed, "copy")
    rows = mixed.where("copies > 0").withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop(copy, *RESULTS)
    return rows.withColumnsRenamed({new: c for c, new in own.items()}).select(*columns(docs))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"), F.md5("text").alias("digest"))
    out = mix(cut(docs), F.col("size"), tie=F.col("digest"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")
