"""Running a stream over what there is, into files that driver and executors share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import fresh_folder


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
IDLE = "spark.sql.streaming.noDataMicroBatches.enabled"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def source(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A file stream with the schema of the files that are there: one file, or a directory of them."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern may name a single file, a plain path may not


def closing(spark: SparkSession, path: str, at: str) -> tuple[DataFrame, Callable[[], None]]:
    """A file stream, and a call that sends its closing event: a row of a time long after all others and nulls beside.
    It moves the watermark past all windows, so that append mode gives them and their state ends."""
    rows = spark.read.parquet(path)
    folder = fresh_folder(spark, "closing")
    rows.limit(0).write.parquet(folder)
    last = rows.agg((F.max(at) + F.expr("interval 1000 days")).alias(at))
    blank = [F.col(at) if f.name == at else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema]
    return source(spark, path).union(spark.readStream.schema(rows.schema).parquet(folder)), lambda: last.select(*blank).write.mode("append").parquet(folder)


def drained(stream: DataFrame, mode: str = "append", close: Callable[[], None] | None = None, rocks: bool = False, quiet: bool = False, **options: str) -> DataFrame:
    """What the stream has given once all input is read: all batches in append mode, the last one in complete mode.
    `close` is called when all is read, and what it adds is read by going on from the checkpoint. Each batch is written
    under its number, so that a batch which runs again replaces itself. rocks: state is kept by RocksDB. quiet: no batch
    runs without new rows, as state with processing times would ask for without end."""
    spark = stream.sparkSession
    provider = spark.conf.get(PROVIDER)
    out, state = fresh_folder(spark, "stream"), fresh_folder(spark, "state")
    last: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        last.append(number)

    for before in (None, close) if close else (None,):
        if before:
            before()
        spark.conf.set(PROVIDER, ROCKS if rocks else provider)
        idle = spark.conf.get(IDLE)
        spark.conf.set(IDLE, "false" if quiet else idle)
        try:
            query = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", state).options(**options).trigger(availableNow=True).start()
            query.awaitTermination()
        finally:
            spark.conf.set(PROVIDER, provider)
            spark.conf.set(IDLE, idle)
    if not last:
        return spark.createDataFrame([], stream.schema)
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(f"{out}/batch={max(last)}")
    return spark.read.schema(stream.schema).parquet(*(f"{out}/batch={k}" for k in sorted(set(last))))
