"""A connector of the user's own: numbers made by the Python data source API, for keys that a table may lack."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Slice(InputPartition):
    def __init__(self, start: int, end: int, step: int) -> None:
        self.start, self.end, self.step = start, end, step


class SequenceReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.start, self.end = int(options.get("start", 0)), int(options["end"])
        self.step, self.parts = int(options.get("step", 1)), int(options.get("partitions", 8))

    def partitions(self) -> list[Slice]:
        n = max(0, -(-(self.end - self.start) // self.step))
        edges = [n * k // self.parts for k in range(self.parts + 1)]
        return [Slice(self.start + a * self.step, self.start + b * self.step, self.step) for a, b in zip(edges, edges[1:], strict=False) if b > a]

    def read(self, partition: Slice) -> Iterator[tuple]:
        for x in range(partition.start, partition.end, partition.step):
            yield (x,)


class SequenceSource(DataSource):
    """Numbers from start to end by step, dealt over partitions: options start, end, step, partitions."""

    @classmethod
    def name(cls) -> str:
        return "millrace_sequence"

    def schema(self) -> str:
        return "value bigint"

    def reader(self, schema) -> SequenceReader:  # noqa: ANN001
        return SequenceReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SequenceSource)
