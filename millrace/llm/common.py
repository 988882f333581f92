"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python worker turns into results at once.
SLICE_BYTES = 1 << 20


U = np.uint64
MULTIPLIER = 0x9E3779B97F4A7C15
#: Bytes whose hashes are summed up at once.
PIECE = 1 << 16


def _powers(base: int) -> np.ndarray:
    x = np.full(PIECE + 1, base, U)
    x[0] = 1
    return np.cumprod(x, dtype=U)


UP, DOWN = _powers(MULTIPLIER), _powers(pow(MULTIPLIER, -1, 1 << 64))


def span_hashes(b: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of the bytes b[start:stop], both rising: equal bytes have equal hashes wherever they stand. The sums are
    made piece by piece, so that beside the hashes little memory is taken."""
    found, shift = np.zeros(len(start), U), np.zeros(len(start), U)
    base, scale, back = np.zeros(1, U), np.ones(1, U), np.ones(1, U)
    for at in range(0, len(b) + 1, PIECE):
        piece = b[at : at + PIECE]
        total = np.zeros(len(piece) + 1, U)
        np.cumsum((piece.astype(U) + U(1)) * UP[: len(piece)], out=total[1:])
        total = base + scale * total
        i, j = np.searchsorted(start, (at, at + PIECE))
        found[i:j] -= total[start[i:j] - at]
        shift[i:j] = back * DOWN[start[i:j] - at]
        i, j = np.searchsorted(stop, (at, at + PIECE))
        found[i:j] += total[stop[i:j] - at]
        base, scale, back = total[-1:], scale * UP[PIECE], back * DOWN[PIECE]
    found *= shift
    return found


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.Array, limit: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Cuts an Arrow batch so that a slice of ordinary rows stays near `limit` bytes."""
    step = max(1, len(batch) * limit // max(limit, batch.nbytes, 1))
    for start in range(0, len(batch), step):
        yield batch.slice(start, step)


def arrow_column(rows: Callable[[list[str]], pa.Array], returns: str) -> Callable[..., Column]:
    """A column function over one string column: `rows` maps texts (null as empty) to an Arrow array."""

    @F.arrow_udf(returns)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            if not len(batch):
                yield rows([])
            for part in slices(batch):
                yield rows([x or "" for x in part.to_pylist()])

    return run


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; a new local folder where it isn't set and all is local."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="millrace-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaning(spark: SparkSession) -> Iterator[None]:
    """Plans that are made and run inside have their shuffle files deleted when they have run, so that a job of several
    rounds needs the disk of one. Only for plans that run once."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a written table in the shared folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def columns(df: DataFrame) -> list[Column]:
    """The columns of `df`, whatever signs their names have."""
    return [F.col(f"`{name.replace('`', '``')}`") for name in df.columns]


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores in front until no column of `df` has it (case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def held_out(doc_id: Column) -> Column:
    """Rows that learn nothing: crc32 of the id as text leaves 2 modulo 4. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
