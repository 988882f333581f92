"""Near-duplicates by Order MinHash, verified by banded alignment.

A text is its words (runs of letters and digits, in lower case). Its five-word k-mers, each labelled with its number
of occurrence, are hashed `BANDS` times; of each hash the `SAMPLED` smallest are taken and kept in the order in which
they stand in the text, and make one bucket key. Two texts with a common key are candidates, whatever the bucket's
size. A pair is a near-duplicate if `SIMILARITY` of the words of the longer text align: the longest common subsequence
of words, by dynamic programming within the band of places that so many aligned words allow.

Texts move to blocks, not to pairs. Equal texts are one node, by their digest. First all texts of a bucket are compared
with one pivot, in blocks of at most about `CHUNK` texts or `CHUNK_WORDS` words, so that a bucket of copies costs one
comparison for each text. A bucket whose texts are of several classes then is one block if it fits in a chunk; members
of longer ones are dealt to chunks by length, and each two chunks that may hold near texts of different classes meet in
one block. There a bound by counts of words,
which no alignment exceeds, rules most pairs out before any is aligned, a pair is aligned in its first common bucket
only, and what leaves a block are links between its classes, fewer than it has texts.

Defined results: null counts as empty; texts without words are near only to equal texts; texts of fewer than five
words are one k-mer; rows of equal text are in one class, repeated ids too; the class is named by its least doc_id
(null if it has none); texts of any length are compared whole, in memory that grows with their length; an empty table
gives no rows; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import MULTIPLIER, U, arrow_column, cut, free_name, slices, span_hashes, table

K, SAMPLED, BANDS, SIMILARITY = 5, 2, 32, 0.8
#: Texts and words of a chunk, about; a block has one or two chunks, and one text more if that is longer.
CHUNK, CHUNK_WORDS = 512, 500_000
#: Counters of words for the bound, and bits of a text's places that are aligned at once.
COUNTERS, PLACES = 1024, 1024
SEEDS = np.array([(0xA0761D6478BD642F * (2 * k + 1)) & 0xFFFFFFFFFFFFFFFF for k in range(BANDS)], U)
#: Bytes that belong to a word: ASCII letters and digits, and all parts of other characters.
IN_WORD = np.zeros(256, bool)
IN_WORD[128:] = True
IN_WORD[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> U(30)) * U(0xBF58476D1CE4E5B9)
    x = (x ^ x >> U(27)) * U(0x94D049BB133111EB)
    return x ^ x >> U(31)


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and where each text's words begin."""
    raw = [t.lower().encode("utf-8", "replace") for t in texts]
    sizes = np.array([len(r) + 1 for r in raw], np.int64)
    b = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8) if raw else np.zeros(0, np.uint8)
    inside = IN_WORD[b]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside]).astype(np.int8)))
    start, stop = edge[::2], edge[1::2]  # a line feed ends the last text
    begin = np.searchsorted(start, np.concatenate([[0], np.cumsum(sizes)]))
    return mix(span_hashes(b, start, stop)), begin


def kmers(w: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labelled k-mers of all texts, and where each text's k-mers begin."""
    counts = np.diff(begin)
    n = np.where(counts >= K, counts - K + 1, np.minimum(counts, 1))
    first = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(n, out=first[1:])
    of = np.repeat(np.arange(len(counts)), n)
    at = np.arange(first[-1]) - first[of] + begin[of]
    end = begin[of + 1]
    padded = np.concatenate([w, np.zeros(K, U)])
    h = np.zeros(len(at), U)
    for k in range(K):
        h = h * U(0xD6E8FEB86659FD93) + np.where(at + k < end, padded[at + k], U(0))
    h = mix(h)
    key = of.astype(U) << U(44) | h >> U(20)
    key.sort()
    twice = np.unique((key[1:][key[1:] == key[:-1]] >> U(44)).astype(np.int64))
    for t in twice:
        own = h[first[t] : first[t + 1]]
        order = np.argsort(own, kind="stable")
        s = own[order]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        place = np.arange(len(s))
        occurrence = np.empty(len(s), np.int64)
        occurrence[order] = place - np.maximum.accumulate(np.where(new, place, 0))
        h[first[t] : first[t + 1]] = np.where(occurrence > 0, mix(own + occurrence.astype(U) * U(MULTIPLIER)), own)
    return h, first


def sketch(labels: np.ndarray) -> np.ndarray:
    """The bucket keys of one text's labelled k-mers, one for each band; none without k-mers."""
    n = len(labels)
    if not n:
        return np.zeros(0, np.int64)
    out = []
    for seeds in np.array_split(SEEDS, min(BANDS, 1 + BANDS * n // 250_000)):
        h = (labels[None] ^ seeds[:, None]) * U(0xBF58476D1CE4E5B9)
        h ^= h >> U(31)
        h *= U(0x94D049BB133111EB)
        chosen = np.argpartition(h, SAMPLED - 1, axis=1)[:, :SAMPLED] if n > SAMPLED else np.tile(np.arange(n), (len(seeds), 1))
        chosen.sort(axis=1)
        key = seeds.copy()
        for column in labels[chosen].T:
            key = mix(key * U(3) + column)
        out.append(key)
    return np.concatenate(out).view(np.int64)


Pattern = dict[int, list[tuple[int, int]]]


def pattern(a: list[int]) -> Pattern:
    """For each word the parts of the text that have it, with its places in each as bits."""
    out: dict[int, dict[int, int]] = {}
    for i, w in enumerate(a):
        at = out.setdefault(w, {})
        at[i // PLACES] = at.get(i // PLACES, 0) | 1 << i % PLACES
    return {w: list(at.items()) for w, at in out.items()}


def aligned(a: Pattern, na: int, b: list[int], least: int) -> int:
    """Aligned words of two texts, or 0 as soon as fewer than `least` are sure. Only places no farther apart than
    `least` allows are compared (the band, widened to whole parts). A part's bits are 1 where one more word of `a`
    aligns no more words of the part; the addition carries a word's alignment on to the places behind it."""
    band = max(na, len(b)) - least
    full = (1 << PLACES) - 1
    rows = [full] * (na // PLACES + 1)
    top = len(rows) - 1
    for j, w in enumerate(b):
        carry, after = 0, -1
        low, high = (j - band) // PLACES, (j + band) // PLACES
        for part, places in a.get(w, ()):
            if part < low:
                continue
            if part > high:
                break
            while carry and after < part:  # parts without the word only pass a carry on
                carry, rows[after] = (rows[after] + 1) >> PLACES, (rows[after] + 1) & full | rows[after]
                after += 1
            row = rows[part]
            up = row & places
            total = row + up + carry
            carry, rows[part] = total >> PLACES, total & full | (row - up)
            after = part + 1
        while carry and after <= min(top, high):
            carry, rows[after] = (rows[after] + 1) >> PLACES, (rows[after] + 1) & full | rows[after]
            after += 1
        if j % 64 == 63 and PLACES * len(rows) - sum(map(int.bit_count, rows)) + len(b) - 1 - j < least:
            return 0
    got = PLACES * len(rows) - sum(map(int.bit_count, rows))
    return got if got >= least else 0


def fewest(na: int, nb: int, least: float = SIMILARITY) -> int:
    """Aligned words that make two texts near."""
    return int(np.ceil(least * max(na, nb) - 1e-9))


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Aligned words by the words of the longer text; 0 if that is below `least`."""
    na, nb = len(a), len(b)
    if not max(na, nb):
        return 1.0
    if min(na, nb) < fewest(na, nb, least):
        return 0.0
    return aligned(pattern(a.tolist()), na, b.tolist(), fewest(na, nb, least)) / max(na, nb)


SKETCH = pa.struct([("words", pa.int64()), ("keys", pa.list_(pa.int64()))])


def _sketches(texts: list[str]) -> pa.Array:
    w, begin = words(texts)
    labels, first = kmers(w, begin)
    keys = [sketch(labels[first[k] : first[k + 1]]) for k in range(len(texts))]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
    flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
    return pa.StructArray.from_arrays([pa.array(np.diff(begin), pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64()))], fields=list(SKETCH))


def sketch_column() -> callable:
    return arrow_column(_sketches, "struct<words:bigint,keys:array<bigint>>")


LINK = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("similarity", pa.float64())])


def _links(rows: list[dict]) -> Iterator[tuple[bytes, bytes, float]]:
    """Links of a block: of each pair of a row of side 1 and another, or of two of side 2, that is near, unless the
    block's links join the two already. Rows of one label are not compared, and pairs only in their first common
    bucket."""
    w, begin = words([r["text"] or "" for r in rows])
    n = np.diff(begin)
    counts = np.zeros((len(rows), COUNTERS), np.uint16)
    for k in range(len(rows)):
        counts[k] = np.minimum(np.bincount((w[begin[k] : begin[k + 1]] >> U(20)).astype(np.int64) % COUNTERS, minlength=COUNTERS), 65535)
    name = {x: k for k, x in enumerate(dict.fromkeys(r["label"] for r in rows))}
    label = np.array([name[r["label"]] for r in rows])
    side = np.array([r["side"] for r in rows])
    keys = np.array([r["keys"] for r in rows]) if rows[0]["keys"] is not None else None
    home = list(range(len(name)))

    def root(x: int) -> int:
        while home[x] != x:
            home[x] = home[home[x]]
            x = home[x]
        return x

    order = np.argsort(n, kind="stable")
    for at, i in enumerate(order):
        if side[i] == 1:
            continue
        rest = np.flatnonzero(side == 1)
        if side[i] == 2:
            rest = np.concatenate([order[at + 1 :][side[order[at + 1 :]] == 2], rest])
        need = np.ceil(SIMILARITY * np.maximum(n[rest], n[i]) - 1e-9)
        keep = (label[rest] != label[i]) & (np.minimum(n[rest], n[i]) >= need)
        rest, need = rest[keep], need[keep]
        if keys is not None and len(rest):
            same = keys[rest] == keys[i]
            first = keys[i][np.argmax(same, axis=1)] == rows[i]["bucket"]
            rest, need = rest[first], need[first]
        for few in range(0, len(rest), 256):
            some, least = rest[few : few + 256], need[few : few + 256]
            some = some[np.minimum(counts[some], counts[i]).sum(axis=1, dtype=np.int64) >= np.minimum(least, 65535)]
            if not len(some):
                continue
            own = pattern(w[begin[i] : begin[i + 1]].tolist())
            for j in some.tolist():
                if root(label[i]) == root(label[j]):
                    continue
                got = aligned(own, int(n[i]), w[begin[j] : begin[j + 1]].tolist(), fewest(n[i], n[j]))
                if got:
                    home[root(label[i])] = root(label[j])
                    x, y = rows[i]["digest"], rows[j]["digest"]
                    yield max(x, y), min(x, y), got / int(max(n[i], n[j]))


def _in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of all blocks of a partition that is sorted by block."""
    block, rows = None, []

    def made() -> pa.RecordBatch:
        links = list(_links(rows)) if len(rows) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], LINK.field(k).type) for k in range(3)], schema=LINK)

    for batch in batches:
        for part in slices(batch):
            for row in part.to_pylist():
                if row["block"] != block:
                    yield made()
                    block, rows = row["block"], []
                rows.append(row)
    yield made()


def components(edges: DataFrame) -> DataFrame:
    """Of undirected edges (a, b): each node and the least node of its component. In each step a node goes to its
    least neighbour or itself, and on to where that one goes until it stays, twice as far each time; edges are then
    drawn between where their ends went, so that chains of any length end soon. Only whether anything is left to do
    reaches the driver."""
    left = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    labels = None
    while True:
        both = left.union(left.select("b", "a"))
        step = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
        while True:
            on = step.select(F.col("node").alias("label"), F.col("label").alias("further"))
            further = cut(step.join(on, "label").select("node", "label", "further"))
            if further.where("label <> further").isEmpty():
                break
            step = further.select("node", F.col("further").alias("label"))
        if labels is None:
            labels = step
        else:
            on = step.select(F.col("node").alias("label"), F.col("label").alias("further"))
            labels = cut(labels.join(on, "label", "left").select("node", F.coalesce("further", "label").alias("label")))
        one, two = (step.select(F.col("node").alias(x), F.col("label").alias(f"to_{x}")) for x in "ab")
        moved = left.join(one, "a").join(two, "b").select(F.greatest("to_a", "to_b").alias("a"), F.least("to_a", "to_b").alias("b"))
        left = cut(moved.where("a <> b").distinct())
        if left.isEmpty():
            return labels


def joined_labels(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels after more edges, which are drawn between the labels there are."""
    if edges.isEmpty():
        return labels
    ends = [labels.select(F.col("node").alias(x), F.col("label").alias(f"to_{x}")) for x in "ab"]
    drawn = edges.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("to_a", "a").alias("a"), F.coalesce("to_b", "b").alias("b"))
    on = components(drawn.where("a <> b")) if not (drawn := cut(drawn)).where("a <> b").isEmpty() else None
    if on is None:
        return labels
    further = on.select(F.col("node").alias("label"), F.col("label").alias("further"))
    old = labels.join(further, "label", "left").select("node", F.coalesce("further", "label").alias("label"))
    return cut(old.union(on.join(labels.select("node"), "node", "left_anti").select("node", "label")))


# Sums by a key are cut before they are joined to the rows of that key, so that both sides are shuffled for the join and a
# hot key's rows can be split.

#: Digests that are sent to all executors at most, 16 bytes each; more are joined by shuffle.
SENT_DIGESTS = 100_000


def _linked(placed: DataFrame, rows: DataFrame) -> DataFrame:
    """Links (a, b, similarity) of rows (block, side, bucket, digest, label, keys). Of the texts only those that are
    placed are moved, each once by its digest, then to its blocks."""
    wanted = placed.select("digest").distinct()
    if wanted.count() <= SENT_DIGESTS:
        wanted = F.broadcast(wanted)
    texts = rows.join(wanted, "digest", "left_semi").groupBy("digest").agg(F.first("text").alias("text"))
    full = placed.join(texts, "digest").repartition("block").sortWithinPartitions("block")
    return cut(full.mapInArrow(_in_blocks, "a binary, b binary, similarity double"))


def _chunks(n: Column, n_words: Column) -> Column:
    return F.ceil(F.greatest(n / CHUNK, n_words / CHUNK_WORDS, F.lit(1.0))).cast("int")


def _fits(x: Column, y: Column) -> Column:
    return F.least(x, y) >= F.lit(SIMILARITY) * F.greatest(x, y)


def _with_pivots(members: DataFrame) -> DataFrame:
    """Blocks of pivots with the texts that share a bucket with them."""
    fits = (F.col("digest") != F.col("pivot")) & _fits(F.col("words"), F.col("pivot_words"))
    pairs = cut(members.where(fits).select("pivot", "digest", "words").distinct())
    sizes = cut(pairs.groupBy("pivot").agg(_chunks(F.count("*"), F.sum("words")).alias("chunks")))
    block = F.xxhash64("pivot", "k").alias("block")
    common = [F.lit(None).cast("bigint").alias("bucket"), F.lit(None).cast("array<bigint>").alias("keys")]
    others = pairs.join(sizes, "pivot").withColumn("k", F.pmod(F.xxhash64("digest"), "chunks").cast("int"))
    pivots = sizes.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return cut(
        pivots.select(block, F.lit(0).alias("side"), *common, F.col("pivot").alias("digest"), F.col("pivot").alias("label")).unionByName(
            others.select(block, F.lit(1).alias("side"), *common, "digest", F.col("digest").alias("label"))
        )
    )


def _mixed(members: DataFrame, labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """Blocks of the buckets that have several classes. A bucket that fits in a chunk is one block, and each of its texts
    one row. Of longer ones the texts are filed in strips by length: neighbouring bands (each reaches to 1 / SIMILARITY of
    its lower end) that fit in a chunk together are one strip, and a strip over a chunk is dealt to several. Strips meet if
    they may hold near texts; those of the largest class are apart if it fills a chunk, since they needn't meet each other."""
    named = members.select("bucket", "digest", "words").join(labels.withColumnRenamed("node", "digest"), "digest", "left").withColumn("label", F.coalesce("label", "digest"))
    by_class = named.groupBy("bucket", "label").agg(F.count("*").alias("n"), F.sum("words").alias("n_words"))
    by_bucket = by_class.groupBy("bucket").agg(F.count("*").alias("classes"), F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("n"), F.sum("n_words").alias("n_words"))
    one_block = (F.col("n") <= CHUNK) & (F.col("n_words") <= CHUNK_WORDS)
    largest = F.when(F.col("most.n") >= CHUNK, F.col("most.label"))
    mixed = cut(by_bucket.where("classes > 1").select("bucket", one_block.alias("fits"), largest.alias("largest")))
    log = F.floor(F.log(F.greatest("words", F.lit(1)).cast("double")) / F.log(F.lit(1 / SIMILARITY)) + 1e-9).cast("int")
    band = F.when(F.col("fits"), 0).otherwise(log)
    big = F.when(F.col("fits"), False).otherwise(F.coalesce(F.col("label") == F.col("largest"), F.lit(False)))
    rest = cut(named.join(mixed, "bucket").select("bucket", "digest", "words", "label", band.alias("band"), big.alias("big")))
    cells = rest.groupBy("bucket", "band", "big").agg(F.count("*").alias("n"), F.sum("words").alias("n_words"), F.min("label").alias("low"), F.max("label").alias("high"), F.min("words").alias("least"), F.max("words").alias("most"))
    # A few rows for each bucket and band of lengths, so that a bucket's run through one window.
    before = Window.partitionBy("bucket", "big").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    filled = [F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("n", "n_words")]
    cells = cut(cells.withColumn("strip", F.floor(F.greatest(filled[0] / CHUNK, filled[1] / CHUNK_WORDS)).cast("int")))
    cell = ["bucket", "strip", "big"]
    strips = cut(cells.groupBy(*cell).agg(_chunks(F.sum("n"), F.sum("n_words")).alias("chunks"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("least").alias("least"), F.max("most").alias("most")))
    chunks = strips.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    two = chunks.select("bucket", *(F.col(c).alias(f"{c}_2") for c in ("strip", "big", "k", "low", "high", "least", "most")))
    ordered = F.struct("strip", "big", "k") <= F.struct(F.col("strip_2"), F.col("big_2"), F.col("k_2"))
    alike = (F.col("most_2") >= F.lit(SIMILARITY) * F.col("least") - 1e-9) & (F.col("most") >= F.lit(SIMILARITY) * F.col("least_2") - 1e-9)
    differ = F.least("low", "low_2") != F.greatest("high", "high_2")
    block = F.xxhash64("bucket", "strip", "big", "k", "strip_2", "big_2", "k_2")
    met = chunks.join(two, "bucket").where(ordered & alike & differ & ~(F.col("big") & F.col("big_2"))).withColumn("block", block)
    same = (F.col("strip") == F.col("strip_2")) & (F.col("big") == F.col("big_2")) & (F.col("k") == F.col("k_2"))
    met = cut(met.withColumn("same", same).select("block", "same", "bucket", "strip", "big", "k", "strip_2", "big_2", "k_2"))
    # A chunk's texts meet each other in one of the blocks where they meet others, if there is one.
    host = met.groupBy(*cell, "k").agg(F.min(F.when(~F.col("same"), F.col("block"))).alias("host"), F.max("same").alias("own"))
    left = met.join(host, [*cell, "k"]).where(~F.col("same") | F.col("host").isNull())
    left = left.select("block", F.when(F.col("same") | F.col("own") & (F.col("block") == F.col("host")), 2).otherwise(0).alias("side"), *cell, "k")
    right = met.where(~F.col("same")).select("block", F.lit(1).alias("side"), "bucket", F.col("strip_2").alias("strip"), F.col("big_2").alias("big"), F.col("k_2").alias("k"))
    dealing = cut(cells.select("bucket", "band", "big", "strip").join(strips.select(*cell, "chunks"), cell))
    filed = rest.join(dealing, ["bucket", "band", "big"])
    dealt = filed.join(nodes.select("digest", "keys"), "digest").withColumn("k", F.pmod(F.xxhash64("digest"), "chunks").cast("int"))
    placed = dealt.join(left.unionByName(right), [*cell, "k"])
    return cut(placed.select("block", "side", "bucket", "keys", "digest", "label"))


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (node, label) for each text digest that is near to another text, where label is the least digest of its
    class; and the links (a, b, similarity) that join the classes."""
    rows = docs.select(F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")))).alias("digest"), F.col("text"))
    found = rows.withColumn("s", sketch_column()(F.col("text"))).select("digest", F.col("s")["words"].alias("words"), F.col("s")["keys"].alias("keys"))
    nodes = cut(found.groupBy("digest").agg(F.first("words").alias("words"), F.first("keys").alias("keys")))
    members = nodes.select("digest", "words", F.explode("keys").alias("bucket"))
    buckets = cut(members.groupBy("bucket").agg(F.count("*").alias("size"), F.min(F.struct("digest", "words")).alias("pivot")).where("size > 1"))
    members = cut(members.join(buckets, "bucket").select("bucket", "digest", "words", F.col("pivot.digest").alias("pivot"), F.col("pivot.words").alias("pivot_words")))
    links = _linked(_with_pivots(members), rows)
    labels = components(links)
    more = _linked(_mixed(members, labels, nodes), rows)
    return joined_labels(labels, more), links.unionByName(more).distinct()


def with_class(docs: DataFrame, found: str = "class_id", similarity: str | None = None) -> DataFrame:
    """All columns of `docs` and `found`: the least doc_id of the row's class. A column of that name is replaced.
    `similarity`, if asked for: the greatest aligned share among the links of the row's text (null without any)."""
    digest, doc_id, label, most = (free_name(docs, x) for x in ("text_digest", "least_id", "class_label", "most_alike"))
    new = [found, similarity] if similarity else [found]
    rows = docs.drop(*new).withColumn(digest, F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")))))
    labels, links = classes(docs.select("text"))
    named = rows.groupBy(digest).agg(F.min("doc_id").alias(doc_id)).join(labels.select(F.col("node").alias(digest), F.col("label").alias(label)), digest, "left")
    named = named.withColumn(label, F.coalesce(label, digest))
    named = cut(named)
    least = cut(named.groupBy(label).agg(F.min(doc_id).alias(found)))
    named = named.join(least, label)
    if similarity:
        ends = links.select(F.col("a").alias(digest), "similarity").unionByName(links.select(F.col("b").alias(digest), "similarity"))
        named = named.join(ends.groupBy(digest).agg(F.max("similarity").alias(most)), digest, "left").withColumn(similarity, F.col(most))
    return rows.join(cut(named.select(digest, *new)), digest).drop(digest)


def first_of_each_class(docs: DataFrame) -> DataFrame:
    """One row of each class: its least doc_id (a null one only if there is no other), of equal ids the least digest,
    and of rows equal in both any one. The others are found without their texts and taken away."""
    digest, found, rank = (free_name(docs, x) for x in ("text_digest", "class_found", "row_rank"))
    rows = docs.withColumn(digest, F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")))))
    labels = classes(docs.select("text"))[0].select(F.col("node").alias(digest), F.col("label").alias(found))
    ids = rows.select("doc_id", digest).groupBy("doc_id", digest).agg(F.count("*").alias(rank))
    named = cut(ids.join(labels, digest, "left").withColumn(found, F.coalesce(found, digest)))
    first = cut(named.groupBy(found).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", digest)).alias("first")))
    winners = named.join(first, found).where(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col(digest) == F.col(f"first.{digest}"))).select("doc_id", digest, rank)
    losers = named.join(first, found).where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col(digest) == F.col(f"first.{digest}"))))
    lost_id, lost = free_name(docs, "lost_id"), free_name(docs, "lost_digest")
    losers = losers.select(F.col("doc_id").alias(lost_id), F.col(digest).alias(lost))
    kept = rows.join(losers, F.col("doc_id").eqNullSafe(F.col(lost_id)) & (F.col(digest) == F.col(lost)), "left_anti")
    twice = winners.where(F.col(rank) > 1).select(F.col("doc_id").alias(lost_id), F.col(digest).alias(lost))
    same = F.col("doc_id").eqNullSafe(F.col(lost_id)) & (F.col(digest) == F.col(lost))
    if twice.isEmpty():
        return kept.drop(digest)
    return kept.join(twice, same, "left_anti").unionByName(kept.join(twice, same, "left_semi").dropDuplicates(["doc_id", digest])).drop(digest)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = with_class(docs, similarity="similarity").select("doc_id", "class_id", "similarity")
    return out.withColumn("kept", F.col("doc_id") == F.col("class_id"))
