"""A connector of the user's own: a folder of JSON lines with commits, by the Python data source API.

A row is a line with a JSON array. A write puts its files beside each other in the folder, where nothing reads them, and
then becomes true as a whole with one small commit file, which lists the files with their rows and the range of each
column; a task or a job that fails leaves no rows, and its files are deleted. Readers follow the commits in order.

Reading splits files by bytes, so that a large file is many tasks. Filters are pushed into the reader: files whose ranges
can't hold a row are not opened, and rows are tested before they are handed over. A stream's offset is the number of
commits that have been read. Paths go through Arrow's file systems, local or remote.
"""

from __future__ import annotations

import datetime as dt
import decimal
import json
import operator
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import DataType, DateType, DecimalType, StructType, TimestampNTZType

#: Bytes of a split, and rows that are handed over at once.
SPLIT_BYTES, BATCH = 32 << 20, 8192
COMMITS = "_commits"
TESTS: dict[type, Callable] = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}


def decoder(kind: DataType) -> Callable[[Any], Any]:
    if isinstance(kind, TimestampNTZType):
        return dt.datetime.fromisoformat
    if isinstance(kind, DateType):
        return dt.date.fromisoformat
    if isinstance(kind, DecimalType):
        return decimal.Decimal
    if kind.typeName() in ("string", "long", "integer", "short", "byte", "double", "float", "boolean"):
        return lambda x: x
    raise ValueError(f"{kind.simpleString()} has no form in lines")


def encoded(x: Any) -> Any:
    return x.isoformat() if isinstance(x, dt.date) else str(x) if isinstance(x, decimal.Decimal) else x


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class File(WriterCommitMessage):
    name: str
    rows: int
    size: int
    ranges: dict[str, list] = field(default_factory=dict)


@dataclass
class Split(InputPartition):
    name: str
    start: int
    end: int

    def __post_init__(self) -> None:
        self.value = (self.name, self.start, self.end)


def commits(path: str) -> list[dict]:
    """All commits in order."""
    files, root = opened(path)
    if files.get_file_info(f"{root}/{COMMITS}").type == fs.FileType.NotFound:
        return []
    names = sorted(f.path for f in files.get_file_info(fs.FileSelector(f"{root}/{COMMITS}")) if f.path.endswith(".json"))
    return [json.loads(files.open_input_stream(n).read()) for n in names]


def listed(path: str, after: int = 0, upto: int | None = None) -> list[File]:
    """Files of the commits from `after` on, those that a later one replaces left out."""
    found: list[File] = []
    for commit in commits(path)[after:upto]:
        found = ([] if commit["replaces"] else found) + [File(**f) for f in commit["files"]]
    return found


class Lines:
    """Reads splits of files, testing rows."""

    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.schema, self.filters = path, schema, []

    def splits(self, files: list[File]) -> list[Split]:
        return [Split(f.name, at, min(at + SPLIT_BYTES, f.size)) for f in files if all(self.may_hold(f, x) for x in self.filters) for at in range(0, f.size, SPLIT_BYTES)]

    def may_hold(self, file: File, test: tuple[str, str, Any]) -> bool:
        name, kind, value = test
        low, high = file.ranges.get(name, (None, None))
        if low is None:
            return not file.rows or name not in file.ranges
        code = decoder(self.schema[name].dataType)
        low, high = code(low), code(high)
        if kind == "In":
            return any(low <= v <= high for v in value)
        return {"EqualTo": lambda: low <= value <= high, "GreaterThan": lambda: high > value, "GreaterThanOrEqual": lambda: high >= value, "LessThan": lambda: low < value, "LessThanOrEqual": lambda: low <= value}.get(kind, lambda: True)()

    def tests(self) -> list[tuple[int, Callable[[Any], bool]]]:
        made = []
        for name, kind, value in self.filters:
            at = self.schema.fieldNames().index(name)
            if kind == "IsNotNull":
                made.append((at, lambda x: x is not None))
            elif kind == "In":
                made.append((at, lambda x, value=value: x in value))
            else:
                test = next(f for t, f in TESTS.items() if t.__name__ == kind)
                made.append((at, lambda x, test=test, value=value: x is not None and test(x, value)))
        return made

    def rows(self, split: Split) -> Iterator[list]:
        """Rows of the lines that begin within the split."""
        files, root = opened(self.path)
        codes, tests = [decoder(f.dataType) for f in self.schema.fields], self.tests()
        with files.open_input_file(f"{root}/{split.name}") as f:
            f.seek(max(0, split.start - 1))
            at, held, first = f.tell(), b"", split.start > 0
            while at < split.end or held:
                part = f.read(1 << 20)
                pieces = (held + part).split(b"\n")
                begin, held = at - len(held), pieces.pop()
                at += len(part)
                for line in pieces:
                    if first:  # the end of the line before
                        first = False
                    elif begin >= split.end:
                        return
                    else:
                        row = [None if x is None else code(x) for code, x in zip(codes, json.loads(line), strict=True)]
                        if all(test(row[k]) for k, test in tests):
                            yield row
                    begin += len(line) + 1
                if not part:
                    return

    def batches(self, split: Split) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, held = to_arrow_schema(self.schema), []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

        for row in self.rows(split):
            held.append(row)
            if len(held) == BATCH:
                yield batch()
                held = []
        if held:
            yield batch()


class LinesReader(Lines, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            known = len(f.attribute) == 1 if hasattr(f, "attribute") else False
            if known and isinstance(f, (*TESTS, In, IsNotNull)):
                self.filters.append((f.attribute[0], type(f).__name__, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[Split]:
        return self.splits(listed(self.path)) or [Split("", 0, 0)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        return self.batches(partition) if partition.name else iter(())


class LinesStreamReader(Lines, DataSourceStreamReader):
    def initialOffset(self) -> dict:  # noqa: N802
        return {"commits": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"commits": len(commits(self.path))}

    def partitions(self, start: dict, end: dict) -> list[Split]:
        return self.splits(listed(self.path, start["commits"], end["commits"]))

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        return self.batches(partition)


class LinesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, replaces: bool) -> None:
        self.path, self.replaces, self.job = path, replaces, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> File:
        """A file of its own for each attempt, so that a repeated task disturbs nothing."""
        files, root = opened(self.path)
        files.create_dir(root, recursive=True)
        made = File(f"part-{self.job}-{uuid.uuid4().hex}.jsonl", 0, 0)
        with files.open_output_stream(f"{root}/{made.name}") as out:
            for batch in iterator:
                columns = [c.to_pylist() for c in batch.columns]
                for name, values in zip(batch.schema.names, columns, strict=True):
                    known = [v for v in values if v is not None and v == v]
                    if known:
                        old = made.ranges.get(name)
                        made.ranges[name] = [min([*known, *old[:1]] if old else known), max([*known, *old[1:]] if old else known)]
                    else:
                        made.ranges.setdefault(name, made.ranges.get(name) or [])
                text = "".join(json.dumps([encoded(x) for x in row], ensure_ascii=False, separators=(",", ":")) + "\n" for row in zip(*columns, strict=True)).encode()
                out.write(text)
                made.rows += batch.num_rows
                made.size += len(text)
        made.ranges = {k: [encoded(x) for x in v] if v else [None, None] for k, v in made.ranges.items()}
        return made

    def commit(self, messages: list[File]) -> None:
        files, root = opened(self.path)
        files.create_dir(f"{root}/{COMMITS}", recursive=True)
        held = [vars(m) for m in messages if m and m.rows]
        name = f"{root}/{COMMITS}/{len(commits(self.path)):012d}-{self.job}"
        with files.open_output_stream(f"{name}.tmp") as out:
            out.write(json.dumps({"replaces": self.replaces, "files": held}).encode())
        files.move(f"{name}.tmp", f"{name}.json")

    def abort(self, messages: list[File]) -> None:
        files, root = opened(self.path)
        for f in files.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if f.base_name.startswith(f"part-{self.job}-"):
                files.delete_file(f.path)


class LinesSource(DataSource):
    """Format `millrace_lines` with a path; the schema is the reader's to give."""

    @classmethod
    def name(cls) -> str:
        return "millrace_lines"

    def schema(self) -> str:
        raise ValueError("give a schema")

    def reader(self, schema: StructType) -> LinesReader:
        return LinesReader(self.options["path"], schema)

    def streamReader(self, schema: StructType) -> LinesStreamReader:  # noqa: N802
        return LinesStreamReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> LinesWriter:
        return LinesWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session and lets it get filters."""
    spark.dataSource.register(LinesSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
