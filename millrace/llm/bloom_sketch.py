"""Document fingerprints by invertible Bloom lookup sketches.

A text's paragraphs are its lines, cut behind the end of a sentence and after every `WORDS` words, so that short
texts have several. Each paragraph's digest, with its number of occurrence, goes to one cell in each of three parts
of a sketch; a cell has a count, a sum of digests and a sum of check hashes. Two sketches subtract cell by cell: what
both texts have cancels, and peeling (taking out cells that hold one digest) recovers the digests that differ. Where
peeling doesn't end, both texts are sketched in four times as many cells and tried again. Likeness is the number of
shared digests by that of all digests, exactly.

Defined results: null counts as empty; two texts without paragraphs have likeness 1; equal texts have equal
fingerprints and likeness 1; words longer than `LONG` are cut; a paragraph that occurs again counts again; texts of
any length are sketched whole; of rows with one id that with the least hash of its text comes first, and equal rows
follow each other; ids are whole numbers; an empty table gives no rows; columns but doc_id and text are left out.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WORDS, LONG, PARTS, BASE_WIDTH, GROWTH = 4, 64, 3, 8, 4
PARAGRAPH = re.compile(rf"\S{{1,{LONG}}}(?:(?<![.!?])[^\S\n]+\S{{1,{LONG}}}){{0,{WORDS - 1}}}")
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    x = (x ^ x >> U(30)) * U(0xBF58476D1CE4E5B9)
    x = (x ^ x >> U(27)) * U(0x94D049BB133111EB)
    return x ^ x >> U(31)


def digests(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Of all paragraphs of all texts: the digest that counts occurrences, and where each text's digests begin."""
    digest = xxhash.xxh3_64_intdigest
    lists = [[digest(p) for p in PARAGRAPH.findall(t or "")] for t in texts]
    begin = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=begin[1:])
    flat = np.array([h for x in lists for h in x], U)
    of = np.repeat(np.arange(len(lists)), np.diff(begin))
    order = np.lexsort((flat, of))
    h, o = flat[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    at = np.arange(len(h))
    occurrence = at - np.maximum.accumulate(np.where(new, at, 0))
    return mix(h + occurrence.astype(U) * U(0x9E3779B97F4A7C15)), begin


def places(keys: np.ndarray, width: int) -> np.ndarray:
    """The three cells of each key, one in each part."""
    return np.stack([(mix(keys ^ U(0x51ED270B7A1F9D35 * (p + 1) & 0xFFFFFFFFFFFFFFFF)) % U(width)).astype(np.int64) + p * width for p in range(PARTS)])


def sketch(keys: np.ndarray, of: np.ndarray, n: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, sums of keys and sums of checks, for `n` sketches of PARTS * width cells each."""
    cells = n * PARTS * width
    count, total, check = np.zeros(cells, np.int64), np.zeros(cells, U), np.zeros(cells, U)
    tag = mix(keys + U(0xD6E8FEB86659FD93))
    for place in places(keys, width):
        at = of * (PARTS * width) + place
        count += np.bincount(at, minlength=cells)
        np.add.at(total, at, keys)
        np.add.at(check, at, tag)
    return count, total, check


def peel(count: np.ndarray, total: np.ndarray, check: np.ndarray, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """From `n` differences of sketches: how many digests peeling recovers of each, and whether nothing is left."""
    size = PARTS * width
    found = np.zeros(n, np.int64)
    look = np.flatnonzero(np.abs(count) == 1)
    while len(look):
        sign = count[look]
        keys = np.where(sign > 0, total[look], U(0) - total[look])
        tag = mix(keys + U(0xD6E8FEB86659FD93))
        pure = tag == np.where(sign > 0, check[look], U(0) - check[look])
        owner, keys, sign = look[pure] // size, keys[pure], sign[pure]
        order = np.lexsort((keys, owner))
        owner, keys, sign = owner[order], keys[order], sign[order]
        first = np.ones(len(keys), bool)
        first[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
        owner, keys, sign = owner[first], keys[first], sign[first]
        if not len(keys):
            break
        found += np.bincount(owner, minlength=n)
        tag = mix(keys + U(0xD6E8FEB86659FD93))
        signed_keys, signed_tags = np.where(sign > 0, keys, U(0) - keys), np.where(sign > 0, tag, U(0) - tag)
        touched = []
        for place in places(keys, width):
            at = owner * size + place
            np.subtract.at(count, at, sign)
            np.subtract.at(total, at, signed_keys)
            np.subtract.at(check, at, signed_tags)
            touched.append(at)
        look = np.unique(np.concatenate(touched))
        look = look[np.abs(count[look]) == 1]
    left = (count != 0) | (total != 0) | (check != 0)
    return found, ~left.reshape(n, size).any(axis=1)


def _chosen(begin: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the digests of the chosen texts, and for each its number among these."""
    sizes = begin[which + 1] - begin[which]
    of = np.repeat(np.arange(len(which)), sizes)
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(begin[which], sizes)
    return at, of


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For pairs of text numbers (left of `a`, right of `b`): shared digests by all digests."""
    sizes = (a[1][left + 1] - a[1][left]) + (b[1][right + 1] - b[1][right])
    differ = np.zeros(len(left), np.int64)
    todo, width = np.flatnonzero(sizes > 0), BASE_WIDTH
    while len(todo):
        again = []
        for part in np.array_split(todo, max(1, len(todo) * PARTS * width // 2_000_000)):
            (x, of_x), (y, of_y) = _chosen(a[1], left[part]), _chosen(b[1], right[part])
            one, two = sketch(a[0][x], of_x, len(part), width), sketch(b[0][y], of_y, len(part), width)
            found, whole = peel(*(p - q for p, q in zip(one, two, strict=True)), len(part), width)
            differ[part[whole]] = found[whole]
            again.append(part[~whole])
        todo, width = np.concatenate(again), width * GROWTH
        if len(todo) and width > 64 * sizes[todo].max() + 4096:
            raise RuntimeError("digests that don't peel in ample cells")
    return np.where(sizes > 0, (sizes - differ) / np.maximum(sizes + differ, 1), 1.0)


def fingerprints(keys: np.ndarray, begin: np.ndarray) -> list[str]:
    """Each text's sketch of PARTS * BASE_WIDTH cells: the number of digests, counts, sums and checks in base 64."""
    n = len(begin) - 1
    of = np.repeat(np.arange(n), np.diff(begin))
    count, total, check = (x.reshape(n, -1) for x in sketch(keys, of, n, BASE_WIDTH))
    return [base64.b64encode(np.int64(size).tobytes() + c.astype(np.int32).tobytes() + t.tobytes() + h.astype(np.uint32).tobytes()).decode() for size, c, t, h in zip(np.diff(begin), count, total, check, strict=True)]


def edited(text: str, other: str) -> str:
    """The last third of `text` (code points, rounded down) replaced by as many of the first of `other`, or all."""
    k = len(text) // 3
    return text[: len(text) - k] + other[:k]


RESULT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_text", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _compared(ids: list, texts: list[str], following: list[str]) -> pa.RecordBatch:
    """texts[k + 1] is what follows texts[k] wherever `following` says so; the two are looked up by place."""
    changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    own, new, others = digests(texts), digests(changed), digests(following)
    at = np.arange(len(texts))
    columns = [ids, [len(t) for t in texts], changed, fingerprints(*own), fingerprints(*new), likeness(own, new, at, at), likeness(own, others, at, at)]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, RESULT, strict=True)], schema=RESULT)


#: Characters of texts compared at once.
CHUNK_CHARS = 3_000_000


def _partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket and place; a row's next one is the row behind it. The last row of a bucket is a guest."""
    ids: list = []
    texts: list[str] = []
    following: list[str] = []
    held: tuple | None = None
    size = 0
    for batch in batches:
        for bucket, doc_id, text, guest in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            text = text or ""
            if held and held[0] == bucket:
                ids.append(held[1])
                texts.append(held[2])
                following.append(text)
                size += len(text)
            held = None if guest else (bucket, doc_id, text)
            if size > CHUNK_CHARS:
                yield _compared(ids, texts, following)
                ids, texts, following, size = [], [], [], 0
    if ids:
        yield _compared(ids, texts, following)


#: Bytes of texts in a bucket, about, and ranges of ids that are told apart by their quantiles.
BUCKET_BYTES, RANGES = 64 << 20, 256


def _bucketed(rows: DataFrame, buckets: int | None) -> tuple[DataFrame, int]:
    """Rows (doc_id, text, h) with their buckets by descending id, and the number of these. Ranges between quantiles are
    cut evenly where they are large; an id with more rows than two buckets hold, and a null id, is cut by hashes."""
    spark = rows.sparkSession
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)) + 64
    cuts = [k / RANGES for k in range(1, RANGES)]
    total, nulls, low, high, quantiles = rows.agg(F.sum(n_bytes), F.sum(F.when(F.col("doc_id").isNull(), n_bytes)), F.min("doc_id"), F.max("doc_id"), F.percentile_approx("doc_id", cuts, 10_000)).first()
    per = max(1, (total or 0) // buckets) if buckets else min(BUCKET_BYTES, max(1, (total or 0) // spark.sparkContext.defaultParallelism))
    n_ranges = max(1, min(RANGES, -(-(total or 0) // per)))
    # A row for each id that fills two buckets.
    hot = {r["doc_id"]: r["n"] for r in rows.where("doc_id is not null").groupBy("doc_id").agg(F.sum(n_bytes).alias("n")).where(F.col("n") > 2 * per).collect()}
    edges = sorted({quantiles[k * RANGES // n_ranges - 1] for k in range(1, n_ranges) if quantiles} | {e for k in hot for e in (k, k + 1)})
    tops = [high, *(e - 1 for e in reversed(edges)), None]  # of each range, the highest first, nulls last
    bottoms = [*reversed(edges), low, None]
    even = -(-(total or 0) // n_ranges // per)
    parts = [-(-hot[b] // per) if b in hot and t == b else max(1, even) for t, b in zip(tops[:-1], bottoms[:-1], strict=True)] + [max(1, -(-(nulls or 0) // per))]
    by_hash = [b in hot and t == b for t, b in zip(tops, bottoms, strict=True)][:-1] + [True]
    first = [sum(parts[:k]) for k in range(len(parts))]
    pick = lambda values, kind: F.element_at(F.array(*map(F.lit, values)).cast(f"array<{kind}>"), F.col("range") + 1)
    found = F.lit(len(edges)) - F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col("doc_id"))) if edges else F.lit(0)
    rows = rows.withColumn("range", F.when(F.col("doc_id").isNull(), len(edges) + 1).otherwise(found))
    width = [max(1, t - b + 1) if t is not None and b is not None else 1 for t, b in zip(tops, bottoms, strict=True)]
    share = F.when(pick(by_hash, "boolean"), F.col("h") / F.lit(2.0**64) + 0.5).otherwise((pick(tops, "bigint") - F.col("doc_id")) / pick(width, "double"))
    part = F.least(F.greatest(F.floor(share * pick(parts, "int")), F.lit(0)), pick(parts, "int") - 1)
    return rows.withColumn("bucket", (pick(first, "int") + part).cast("int")).drop("range"), sum(parts)


def compare_with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Of each row (doc_id bigint, text): fingerprints of the text and of the edited text, and their likeness to the
    text; and the text's likeness to the next one, by descending doc_id, the first following the last. Rows with equal
    doc_id follow each other by text; rows with a null doc_id come last.

    Rows are dealt to buckets of doc_id ranges, in one shuffle of the texts. Each bucket gets a copy of the first row
    of the next one as a guest, found by a small table of one row for each bucket. buckets: about how many; by default
    as many as the bytes of the texts ask for.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows, n_buckets = _bucketed(rows.withColumn("h", F.xxhash64("text")), buckets)
    # The first row of each bucket: by the highest id, then the smallest text by hash and by itself.
    place = [F.desc_nulls_last("doc_id"), F.asc("h"), F.asc_nulls_first("text")]
    heads = rows.groupBy("bucket").agg(F.max("doc_id").alias("doc_id"), F.max_by(F.struct("h"), F.struct("doc_id", -F.col("h").cast("decimal(20,0)")))["h"].alias("h")).collect()  # a row for each bucket
    order = sorted(r["bucket"] for r in heads)
    if not order:
        return spark.createDataFrame([], "doc_id bigint, n_chars bigint, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    before = {b: order[k - 1] for k, b in enumerate(order)}
    first = spark.createDataFrame([(r["doc_id"], r["h"], before[r["bucket"]], r["bucket"]) for r in heads], "head_id bigint, head_h bigint, host int, head_bucket int")
    guests = rows.join(F.broadcast(first), F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("h") == F.col("head_h")) & (F.col("bucket") == F.col("head_bucket")))
    guests = guests.select(F.col("host").alias("bucket"), "doc_id", "text", "h", F.lit(1).alias("guest"))
    both = rows.select("bucket", "doc_id", "text", "h", F.lit(0).alias("guest")).unionByName(guests)
    dealt = both.repartitionById(n_buckets, F.col("bucket")).sortWithinPartitions("bucket", "guest", *place)
    return dealt.select("bucket", "doc_id", "text", "guest").mapInArrow(_partition, "doc_id bigint, n_chars bigint, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compare_with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
