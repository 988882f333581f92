"""Nearest rows by the angle between vectors, exactly or by cells of a coarse quantiser."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut
from .windows import top_per_group

#: Rows and rounds that the quantiser is fitted on, the most cells, and the queries that its probes are chosen on.
SAMPLE, ROUNDS, MOST_CELLS, TRIAL = 16_384, 8, 1024, 512
#: Rows and queries that one task compares, and the rows that are compared at once.
BLOCK_ROWS, BLOCK_QUERIES, TILE = 65_536, 4_096, 8_192
#: Digits of a similarity: what differs less is a tie, and goes by the lesser id.
DIGITS = 6


@dataclass
class Cells:
    """Directions of the cells, and how many of them a query looks into."""

    centres: np.ndarray
    probes: int


def units(rows: DataFrame, id: str, vector: str) -> DataFrame:
    """_id and _unit (doubles of length 1). Null vectors, those with a null or of length zero have no direction and go."""
    v = F.transform(vector, lambda x: x.cast("double"))
    rows = rows.select(F.col(id).cast("long").alias("_id"), v.alias("_v")).where(F.forall("_v", lambda x: x.isNotNull()))
    rows = rows.withColumn("_length", F.sqrt(F.aggregate("_v", F.lit(0.0), lambda s, x: s + x * x))).where("_length > 0")
    return rows.select("_id", F.transform("_v", lambda x: x / F.col("_length")).alias("_unit"))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def fit(rows: DataFrame, k: int, cells: int | None = None, sample: int = SAMPLE, goal: float = 0.97) -> Cells:
    """Cells for `rows` (_id, _unit), fitted on the `sample` rows of the least hashes: spherical k-means from the first
    ones. As many cells as the root of the rows, `MOST_CELLS` at most. A query looks into as many cells as find `goal` of
    the `k` nearest of the sample's first rows within the sample."""
    n = rows.count()
    held = matrix(rows.orderBy(F.xxhash64("_id"), "_id").limit(sample).toArrow().column("_unit"))
    cells = min(len(held), cells or max(1, min(MOST_CELLS, int(n**0.5))))
    centres = held[:cells].copy()
    for _ in range(ROUNDS):
        near = np.argmax(held @ centres.T, axis=1)
        for c in range(cells):
            total = held[near == c].sum(axis=0)
            if np.linalg.norm(total) > 0:
                centres[c] = total / np.linalg.norm(total)
    trial = held[:TRIAL]
    alike = trial @ held.T
    alike[np.arange(len(trial)), np.arange(len(trial))] = -2
    nearest = np.argsort(-alike, axis=1)[:, :k]
    turn = np.argsort(np.argsort(-(trial @ centres.T), axis=1), axis=1)
    needed = np.sort(np.take_along_axis(turn, np.argmax(held @ centres.T, axis=1)[nearest], axis=1).reshape(-1)) + 1
    return Cells(centres, int(needed[min(len(needed) - 1, int(goal * len(needed)))]) if len(needed) else 1)


def in_cells(rows: DataFrame, cells: Cells, several: bool) -> DataFrame:
    """`rows` with _cell: the nearest one, or a row for each of the probes."""
    known = rows.sparkSession.sparkContext.broadcast(cells)  # MOST_CELLS directions at most

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = matrix(batch.column(1)) @ known.value.centres.T if len(batch) else np.zeros((0, 1))
            n = known.value.probes if several else 1
            cell = np.argsort(-alike, axis=1, kind="stable")[:, :n]
            taken = batch.take(pa.array(np.repeat(np.arange(len(batch)), cell.shape[1])))
            yield pa.record_batch([taken.column(0), taken.column(1), pa.array(cell.reshape(-1).astype(np.int32))], ["_id", "_unit", "_cell"])

    return rows.select("_id", "_unit").mapInArrow(assign, "_id long, _unit array<double>, _cell int")


def compared(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The k best rows of a block for each query of a block, tile by tile."""

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if queries.num_rows and rows.num_rows:
            q, q_id = matrix(queries.column("_unit")), queries.column("_id").to_numpy()
            best_id, best = np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0))
            for at in range(0, rows.num_rows, TILE):
                part = rows.slice(at, TILE)
                r_id = part.column("_id").to_numpy()
                alike = np.round(q @ matrix(part.column("_unit")).T, DIGITS) + 0.0
                alike[q_id[:, None] == r_id[None, :]] = -np.inf
                best_id = np.concatenate([best_id, np.broadcast_to(r_id, alike.shape)], axis=1)
                best = np.concatenate([best, alike], axis=1)
                order = np.lexsort((best_id, -best))[:, :k]
                best_id, best = np.take_along_axis(best_id, order, axis=1), np.take_along_axis(best, order, axis=1)
            m = np.isfinite(best)
            found.append((np.broadcast_to(q_id[:, None], best.shape)[m], best_id[m], best[m]))
        x = found[0] if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table([pa.array(x[0]), pa.array(x[1]), pa.array(x[2])], ["_id", "near_id", "similarity"])

    return run


def nearest(rows: DataFrame, asked: Column, k: int, id: str = "id", vector: str = "vector", cells: Cells | None = None) -> DataFrame:
    """`id`, rank (from 1), near_id, similarity: for the rows that `asked` marks the k rows of the greatest cosine, rounded to
    `DIGITS`, other than rows of the same id; ties go to the lesser id. Ids are whole numbers.

    With `cells`, a query meets the rows of the cells nearest to it, else all rows. Rows of a cell and its queries are
    dealt to blocks by hashes, as many as their counts ask for, and each pair of blocks is compared by one task, which
    keeps k rows a query; so a cell that holds most rows is many tasks. Rows without a direction ask and are found
    nowhere; equal vectors are neighbours of each other; with fewer than k other rows there are fewer rows.
    """
    found = units(rows, id, vector)
    chosen = units(rows.where(asked), id, vector)
    one = F.lit(0).alias("_cell")
    held = cut(in_cells(found, cells, several=False) if cells else found.select("_id", "_unit", one))
    asks = cut(in_cells(chosen, cells, several=True) if cells else chosen.select("_id", "_unit", one))
    # At most MOST_CELLS rows each.
    sizes = held.groupBy("_cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("_blocks"))
    loads = asks.groupBy("_cell").agg(F.ceil(F.count("*") / BLOCK_QUERIES).alias("_loads"))
    grid = F.broadcast(sizes.join(loads, "_cell"))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    held = held.join(grid, "_cell").withColumn("_block", F.pmod(F.xxhash64("_id"), "_blocks")).withColumn("_load", every("_loads"))
    asks = asks.join(grid, "_cell").withColumn("_load", F.pmod(F.xxhash64("_id"), "_loads")).withColumn("_block", every("_blocks"))
    key = ["_cell", "_block", "_load"]
    best = asks.select(*key, "_id", "_unit").groupBy(*key).cogroup(held.select(*key, "_id", "_unit").groupBy(*key)).applyInArrow(compared(k), "_id long, near_id long, similarity double")
    best = top_per_group(best, ["_id"], [F.desc("similarity"), F.asc("near_id")], k)
    return best.select(F.col("_id").alias(id), "rank", "near_id", "similarity")


def cells_for(rows: DataFrame, k: int, id: str = "id", vector: str = "vector") -> Cells:
    """Cells fitted on a bounded sample of `rows`; see `fit`."""
    return fit(units(rows, id, vector), k)

