"""Licence scans by canonical digests.

A text is brought to a canonical form: lines that only state a copyright go, then case, spellings that count as one,
punctuation and white space are made even. The digest of the whole canonical text is looked up among the digests of
known licence texts by a hash join; so is each line that speaks of a licence, among those of known notices.

Only DataFrame functions are used. The known table is fixed and has under a hundred rows (texts with and
without their titles and appendices, and notices), so it is sent to all executors.

Defined results: null and empty texts have no licence; a text that is a known one but for a word has none; a notice
that occurs on several lines is named once and counted each time; a notice that is the whole text is both; of several
licences with one canonical text the first name counts; very long texts are digested and read line by line whole;
repeated rows give repeated results; an empty table gives no rows; other columns are kept.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, table
from .license_texts import EQUAL_SPELLINGS, KNOWN

#: A line that only states a copyright.
COPYRIGHT = r"^[^a-z0-9©]*(?:copyright[^a-z0-9©]*(?:\(c\)|©|[0-9]{4})|\(c\)[^a-z0-9]*[0-9]{4}|©|all rights reserved[^a-z0-9]*$)"
#: What each known notice has in it, so that other lines need no digest.
HINT = "licen[sc]e"
MANY_SPELLINGS = "|".join(re.sub(r"\((?!\?)", "(?:", p) for p, _ in EQUAL_SPELLINGS)


def canonical(text: Column) -> Column:
    """The canonical form of a text in lower case without copyright lines."""
    even = text
    for pattern, by in EQUAL_SPELLINGS:
        even = F.regexp_replace(even, pattern, by.replace("\\1", "$1").replace("\\2", "$2"))
    even = F.when(text.rlike(MANY_SPELLINGS), even).otherwise(text)
    return F.trim(F.regexp_replace(even, r"[^\p{L}\p{N}]+", " "))


def without_copyright(text: Column) -> Column:
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda line: ~line.rlike(COPYRIGHT)), "\n")


def digest(text: Column) -> Column:
    return F.sha2(canonical(without_copyright(F.lower(F.coalesce(text, F.lit(""))))), 256)


def known(spark: SparkSession) -> DataFrame:
    """Rows of (digest, license) of the fixed table."""
    return spark.createDataFrame(KNOWN, "license string, text string").select(digest(F.col("text")).alias("digest"), "license").groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of `docs` and `license` (of the whole text), `notices` (names in order), `n_notices` (lines)."""
    spark = docs.sparkSession
    table_ = F.broadcast(known(spark))
    d, row = free_name(docs, "license_digest"), free_name(docs, "row_number_here")
    docs = docs.drop("license", "notices", "n_notices")
    whole = docs.withColumn(d, digest(F.col(f"`{text}`"))).join(table_.withColumnRenamed("digest", d), d, "left").drop(d)
    # Lines are looked up by a map of the fixed table, so that no row has to be put together again.
    pairs = {k: v for k, v in known(spark).collect()}
    by_digest = F.create_map(*[F.lit(x) for pair in sorted(pairs.items()) for x in pair])
    lines = F.filter(F.split(F.lower(F.coalesce(F.col(f"`{text}`"), F.lit(""))), "\n", -1), lambda x: x.rlike(HINT))
    named = F.filter(F.transform(lines, lambda x: by_digest[F.sha2(canonical(x), 256)]), lambda x: x.isNotNull())
    return whole.withColumn(row, F.when(F.lower(F.col(f"`{text}`")).rlike(HINT), named).otherwise(F.array().cast("array<string>"))).withColumn("notices", F.array_join(F.array_sort(F.array_distinct(row)), ",")).withColumn("n_notices", F.size(row).cast("long")).drop(row)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs).select("doc_id", "license", "notices", "n_notices")


def _sql_canonical(x: str) -> str:
    for pattern, by in EQUAL_SPELLINGS:
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
    return f"trim(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def _values() -> str:
    return ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in KNOWN)


_TEXT = f"array_to_string(list_filter(string_split(lower(coalesce(text, '')), chr(10)), lambda x: NOT regexp_matches(x, '{COPYRIGHT}')), chr(10))"
ORACLE = f"""WITH given(license, text) AS (VALUES {_values()}),
known AS (SELECT {_sql_canonical(_TEXT)} AS canon, min(license) AS license FROM given GROUP BY 1),
docs AS (SELECT row_number() OVER () AS r, doc_id, text, {_sql_canonical(_TEXT)} AS canon FROM documents),
lines AS (SELECT r, unnest(string_split(lower(coalesce(text, '')), chr(10))) AS line FROM docs),
found AS (SELECT r, k.license FROM lines JOIN known k ON {_sql_canonical('line')} = k.canon WHERE regexp_matches(line, '{HINT}')),
per AS (SELECT r, string_agg(DISTINCT license, ',' ORDER BY license) AS notices, count(*) AS n FROM found GROUP BY r)
SELECT d.doc_id, k.license AS license, coalesce(p.notices, '') AS notices, coalesce(p.n, 0) AS n_notices
FROM docs d LEFT JOIN known k ON d.canon = k.canon LEFT JOIN per p ON p.r = d.r"""
