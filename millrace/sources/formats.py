"""Writing a table in a format and reading it again with its schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import fresh_folder

#: Options by format. Timestamps are written without a zone.
OPTIONS = {
    "parquet": {},
    "orc": {},
    "csv": {"header": "true", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS", "nullValue": "\\N", "escape": '"'},
    "json": {"timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"},
    "xml": {"rowTag": "row", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"},
}


def write(df: DataFrame, path: str, kind: str, partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    writer = df.write.format(kind).options(**OPTIONS[kind]).mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def read(spark: SparkSession, path: str, kind: str, like: DataFrame) -> DataFrame:
    """Rows with the schema of `like`: nothing is inferred, so no pass over the data is spent on it."""
    return spark.read.format(kind).options(**OPTIONS[kind]).schema(like.schema).load(path).select(*like.columns)


def round_trip(df: DataFrame, kind: str) -> DataFrame:
    path = fresh_folder(df.sparkSession, kind)
    write(df, path, kind)
    return read(df.sparkSession, path, kind, df)


def partitioned(df: DataFrame, by: str) -> DataFrame:
    """A table written in folders by the values of a column; filters on it skip folders."""
    path = fresh_folder(df.sparkSession, "partitioned")
    write(df, path, "parquet", [by])
    return read(df.sparkSession, path, "parquet", df)


def lines(df: DataFrame, column: str) -> DataFrame:
    """One string column as a text file's lines."""
    path = fresh_folder(df.sparkSession, "text")
    df.select(F.col(column).alias("value")).write.text(path)
    return df.sparkSession.read.text(path)


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Whole files as bytes: path, modificationTime, length, content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """A table bucketed and sorted by a key: joins and aggregates on the key need no shuffle."""
    df.write.format("parquet").mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return df.sparkSession.table(name)
