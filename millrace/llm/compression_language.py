"""Language by compression: the language whose dictionary makes the text smallest.

For each language a zstandard raw-content dictionary is made of a bounded sample of labelled texts. A text, in lower
case and with one space for each run of other signs than letters and digits, is compressed whole with each of them,
in blocks, so that the dictionary counts as much at the end of a long text as at its start. The choice is rejected
where the margin to the second smallest is narrow.

Learning takes, for each language, the `DOCS_PER_LANGUAGE` different labelled texts with the smallest hash, whole, as
long as they have `BYTES_PER_LANGUAGE` bytes together; texts of more than an even part of these bytes come last. These
bounds on rows and bytes are the only sample; every text is classified, and whole.

Defined results: a text that is null or has no letter (Unicode's categories L) is `und` with score 0 and rejected, and
so is every text if no language was learned; a tie goes to the language first in order; with one language learned the
score is 1; very long texts are compressed as one; a language whose every text is over `BYTES_PER_LANGUAGE` isn't
learned; rows with a null language teach nothing; repeated rows teach once;
an empty table gives no rows; other columns are kept as they are.
"""

from __future__ import annotations

import re

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_column, cut, free_name, held_out, table

DOCS_PER_LANGUAGE, LEVEL, NARROW, BLOCK_BYTES = 64, 6, 0.01, 4096
#: Bytes of UTF-8 that are learned from for each language.
BYTES_PER_LANGUAGE = 4 << 20
LETTER = regex.compile(r"\p{L}")
SIGNS = re.compile(r"[\W_]+")
#: Rows of the sample that are sent to all executors at most, a language and two numbers each.
SENT_ROWS = 100_000
#: Groups of partitions that are ranked on their own.
PARTS = 64
FOUND = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("margin", pa.float64()), ("rejected", pa.bool_())])


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", docs_per_language: int = DOCS_PER_LANGUAGE, bytes_per_language: int = BYTES_PER_LANGUAGE) -> dict[str, bytes]:
    """Raw dictionary content by language. Hashes are ranked first, so that only the sample's texts move; at most
    `docs_per_language` texts and `bytes_per_language` bytes of each language reach the driver."""
    rows = docs.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text")).where("lang is not null and text is not null and text rlike '[\\\\p{L}]'")
    rows = rows.withColumn("h", F.xxhash64("text"))
    order = [F.col("bytes") > bytes_per_language // docs_per_language, F.col("h")]
    ranked = lambda df, *by: df.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("n") <= docs_per_language)
    sizes = rows.select("lang", "h", F.octet_length("text").cast("bigint").alias("bytes")).where(F.col("bytes") <= bytes_per_language)
    # First within groups of partitions, so that no task gets what all partitions have of one language.
    kept = ranked(ranked(sizes.distinct().withColumn("part", F.spark_partition_id() % PARTS), "lang", "part").drop("part"), "lang")
    kept = kept.withColumn("sum", F.sum("bytes").over(Window.partitionBy("lang").orderBy("n"))).where(F.col("sum") <= bytes_per_language).select("lang", "h", "n")
    kept = cut(kept)
    if kept.count() <= SENT_ROWS:
        kept = F.broadcast(kept)
    samples: dict[str, dict[str, None]] = {}
    for r in rows.join(kept, ["lang", "h"]).groupBy("lang", "h", "n").agg(F.min("text").alias("text")).orderBy("lang", F.desc("n")).collect():
        samples.setdefault(r["lang"], {})[plain(r["text"])] = None
    return {k: "\n".join(v).encode("utf-8", "replace") for k, v in samples.items()}


def plain(text: str) -> str:
    return SIGNS.sub(" ", text.lower())


_compressors: dict[tuple, list] = {}


def _by_language(contents: dict[str, bytes], level: int) -> list:
    import zstandard

    key = (level, *((k, hash(v)) for k, v in contents.items()))
    if key not in _compressors:
        _compressors.clear()
        made = []
        for name in sorted(contents):
            content = zstandard.ZstdCompressionDict(contents[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=level)
            made.append((name, zstandard.ZstdCompressor(level=level, dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False).compress))
        _compressors[key] = made
    return _compressors[key]


def classify(text: str | None, contents: dict[str, bytes], level: int = LEVEL, narrow: float = NARROW) -> tuple[str, float, float, bool]:
    """Language, score, margin and whether the choice is rejected."""
    if not contents or not text or not LETTER.search(text):
        return "und", 0.0, 0.0, True
    raw = plain(text).encode("utf-8", "replace")
    blocks = [raw[k : k + BLOCK_BYTES] for k in range(0, len(raw), BLOCK_BYTES)]
    sizes = sorted((sum(len(compress(b)) for b in blocks), name) for name, compress in _by_language(contents, level))
    best = sizes[0]
    if len(sizes) == 1:
        return best[1], 1.0, 1.0, False
    margin = 1 - best[0] / sizes[1][0]
    return best[1], 0.5 + 0.5 * min(1.0, margin / (margin + 0.05)), margin, margin < narrow


def language_column(spark: SparkSession, contents: dict[str, bytes], level: int = LEVEL, narrow: float = NARROW) -> callable:
    known = spark.sparkContext.broadcast(contents)  # bounded by learn()'s parameters for each language

    def rows(texts: list[str]) -> pa.Array:
        found = [classify(t, known.value, level, narrow) for t in texts]
        return pa.array([dict(zip(("lang", "score", "margin", "rejected"), x, strict=True)) for x in found], FOUND)

    return arrow_column(rows, "struct<lang:string,score:double,margin:double,rejected:boolean>")


def identify(docs: DataFrame, contents: dict[str, bytes], text: str = "text", found: str = "language") -> DataFrame:
    """All columns of `docs` and `found`: struct<lang, score, margin, rejected>. A column of that name is replaced."""
    return docs.withColumn(found, language_column(docs.sparkSession, contents)(F.col(f"`{text}`").cast("string")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out: Column = held_out(F.col("doc_id"))
    contents = learn(docs.where(~out))
    name = free_name(docs, "language")
    found = identify(docs.select("doc_id", "text"), contents, found=name)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col(name)["lang"].alias("lang_pred"), F.col(name)["score"].alias("score"), F.col(name)["margin"].alias("margin"), F.col(name)["rejected"].alias("rejected"))
