"""Passages that texts share with the items of an evaluation set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut
from .joins import small_or_shuffled

#: Words of a gram, and of the shortest passage that counts.
GRAM, PASSAGE = 8, 13
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Runs of ASCII letters and digits and of signs beyond ASCII, A-Z in lower case."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(f"({WORD})"), 0)


def grams(hashes: Column, n: int) -> Column:
    """Hashes of all runs of n words, in order."""
    return F.when(F.size(hashes) >= n, F.transform(F.sequence(F.lit(0), F.size(hashes) - n), lambda k: F.xxhash64(*(F.get(hashes, k + j) for j in range(n))))).otherwise(F.array().cast("array<bigint>"))


def rarest(found: Column, width: int) -> Column:
    """Of an array of (often, gram, pos) in order of pos without gaps: the least of each `width` neighbours, once."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(found) - width + 1), lambda k: F.array_min(F.slice(found, k, F.lit(width)))))


def shared_passages(docs: DataFrame, items: DataFrame, passage: int = PASSAGE, gram: int = GRAM) -> DataFrame:
    """doc_id, item_id, n_words, doc_start, item_start, contained: for each text of `docs` (doc_id, text) and of `items`
    (item_id, text) that share `passage` words in a row or more, the longest passage (the first one in the text, then in
    the item, of several), and whether the text holds the item's text as it is.

    Items are indexed by grams of `gram` words. Texts keep the grams that the index has (the index is sent to all
    executors where it is counted to be small), in runs as long as a passage asks for; so nearly all text is gone before
    anything is shuffled. Of each passage's width of neighbouring grams only the rarest one in the index, by its
    frequency and then its hash, is looked up: two texts that share a passage share that gram too. So a gram that all
    items have meets nothing unless a passage is made of such grams only; hits are dealt out by text and gram. Passages
    are then measured along the diagonals that were hit, by comparing grams in place, without pairs of grams.

    Null and empty texts share nothing; repeated rows count once, rows of one id and other texts for themselves, the
    longest passage of the id winning; an empty table on either side gives no rows; other columns are left out. Grams
    are compared by 64-bit hashes; passages of equal hashes are equal words but for collisions.
    """
    width = passage - gram + 1
    # Hashes of words are a column of their own: inside the grams' function they would be made anew for each of them.
    hashes = F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("h")
    items = items.select("item_id", "text").distinct()
    index = items.select("item_id", F.xxhash64("text").alias("item_text"), hashes)
    index = cut(index.select("item_id", "item_text", grams(F.col("h"), gram).alias("grams")))
    often = index.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("often"))

    rows = docs.select("doc_id", "text").where("text is not null")
    found = rows.select("doc_id", F.xxhash64("text").alias("doc_text"), hashes)
    found = found.select("doc_id", "doc_text", F.posexplode(grams(F.col("h"), gram)).alias("pos", "gram"))
    found = small_or_shuffled(found, often, ["gram"], most_rows=2_000_000, most_bytes=256 << 20)
    # Runs of neighbouring grams that the index has: a text's rows are few by now, and its runs independent.
    by_doc = found.groupBy("doc_id", "doc_text").agg(F.array_sort(F.collect_set(F.struct("pos", "gram", "often"))).alias("g"))
    starts = F.filter(F.sequence(F.lit(0), F.size("g") - 1), lambda k: (k == 0) | (F.get("g", k - 1)["pos"] + 1 != F.get("g", k)["pos"]))
    runs = by_doc.withColumn("starts", starts).select("doc_id", "doc_text", "g", F.posexplode("starts").alias("n", "a"), "starts")
    stop = F.coalesce(F.get("starts", F.col("n") + 1), F.size("g"))
    runs = runs.select("doc_id", "doc_text", F.slice("g", F.col("a") + 1, stop - F.col("a")).alias("g")).where(F.size("g") >= width)
    runs = cut(runs.select("doc_id", "doc_text", F.get("g", F.lit(0))["pos"].alias("start"), F.transform("g", lambda x: F.struct(x["often"].alias("often"), x["gram"].alias("gram"), x["pos"].alias("pos"))).alias("g")))

    ranked = index.select("item_id", "item_text", F.posexplode("grams").alias("pos", "gram")).join(often, "gram")
    ranked = ranked.groupBy("item_id", "item_text").agg(F.array_sort(F.collect_list(F.struct("pos", "often", "gram"))).alias("g"))
    ranked = ranked.where(F.size("g") >= width).select("item_id", "item_text", F.transform("g", lambda x: F.struct(x["often"].alias("often"), x["gram"].alias("gram"), x["pos"].alias("pos"))).alias("g"))
    of_items = ranked.select("item_id", "item_text", F.explode(rarest(F.col("g"), width)).alias("r")).select("item_id", "item_text", F.col("r.gram").alias("gram"), F.col("r.pos").alias("item_pos"))
    of_docs = runs.select("doc_id", "doc_text", "start", F.explode(rarest(F.col("g"), width)).alias("r")).select("doc_id", "doc_text", "start", F.col("r.gram").alias("gram"), F.col("r.pos").alias("pos"))
    hits = small_or_shuffled(of_docs, of_items, ["gram"])
    hits = hits.select("doc_id", "doc_text", "start", "item_id", "item_text", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct()

    texts = runs.select("doc_id", "doc_text", "start", F.transform("g", lambda x: x["gram"]).alias("g"))
    key = lambda *names: F.struct(*names)  # noqa: E731  a null id is an id
    hits = hits.withColumn("d", key("doc_id", "doc_text", "start")).drop("doc_id", "doc_text", "start").withColumn("i", key("item_id", "item_text")).drop("item_id", "item_text")
    hits = small_or_shuffled(hits, index.select(key("item_id", "item_text").alias("i"), "grams"), ["i"])
    hits = hits.join(texts.select(key("doc_id", "doc_text", "start").alias("d"), "g"), "d")
    # Along one diagonal: the longest run of equal grams, the first of equals.
    at = F.col("d.start") - F.col("shift")
    none = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"), F.lit(0).alias("end"))

    def step(s: Column, k: Column) -> Column:
        now = F.when(F.get("g", k) == F.get("grams", k + at), s["now"] + 1).otherwise(F.lit(0))
        better = now > s["most"]
        return F.struct(now.alias("now"), F.when(better, now).otherwise(s["most"]).alias("most"), F.when(better, k).otherwise(s["end"]).alias("end"))

    best = F.aggregate(F.filter(F.sequence(F.lit(0), F.size("g") - 1), lambda k: (k + at >= 0) & (k + at < F.size("grams"))), none, step)
    measured = hits.select("d", "i", "shift", best.alias("b")).where(F.col("b.most") >= width)
    first = F.col("d.start") + F.col("b.end") - F.col("b.most") + 1
    measured = measured.select(F.col("d.doc_id").alias("doc_id"), F.col("d.doc_text").alias("doc_text"), F.col("i.item_id").alias("item_id"), F.col("i.item_text").alias("item_text"), F.struct(-(F.col("b.most") + gram - 1), first, first - F.col("shift")).alias("b"))
    pairs = cut(measured.groupBy("doc_id", "doc_text", "item_id", "item_text").agg(F.min("b").alias("b")))

    # Texts once more, but only those of pairs.
    pair = key("doc_id", "doc_text")
    held = rows.select(key("doc_id", F.xxhash64("text").alias("doc_text")).alias("d"), F.col("text").alias("whole"))
    named = items.withColumn("item_text", F.xxhash64("text")).select(key("item_id", "item_text").alias("i"), F.col("text").alias("part"))
    wanted = pairs.select(pair.alias("d"), key("item_id", "item_text").alias("i"), "b")
    held = small_or_shuffled(held, wanted.select("d").distinct(), ["d"], how="left_semi").distinct()
    full = small_or_shuffled(wanted.join(held, "d"), named, ["i"])
    full = full.select(F.col("d.doc_id").alias("doc_id"), F.col("i.item_id").alias("item_id"), "b", F.contains("whole", "part").alias("contained"))
    out = full.groupBy("doc_id", "item_id").agg(F.min("b").alias("b"), F.bool_or("contained").alias("contained"))
    return out.select("doc_id", "item_id", (-F.col("b.col1")).cast("int").alias("n_words"), F.col("b.col2").alias("doc_start"), F.col("b.col3").alias("item_start"), "contained")
