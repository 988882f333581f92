"""Aggregates of the user's own in two phases: partial states in the tasks that read, merged by key."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Keys whose states a task holds, and the groups in which a key's states are merged first.
KEYS, SALTS = 100_000, 64


class Fold(Protocol):
    """An aggregate: states are picklable, small, and merge in any order to the same result."""

    def zero(self) -> Any: ...
    def add(self, state: Any, values: np.ndarray) -> Any: ...
    def merge(self, a: Any, b: Any) -> Any: ...
    def finish(self, state: Any) -> Any: ...


class ExactSum:
    """The sum of doubles, rounded once: equal for any order of rows, infinite beyond the range. A state has a whole
    number for each binary exponent that occurs, and what isn't finite."""

    def zero(self) -> tuple[dict[int, int], float]:
        return {}, 0.0

    def add(self, state: tuple, values: np.ndarray) -> tuple:
        totals, odd = state
        finite = np.isfinite(values)
        odd += float(values[~finite].sum())
        part, exponent = np.frexp(values[finite])
        whole = np.ldexp(part, 53).astype(np.int64)
        kinds, place = np.unique(exponent, return_inverse=True)
        # Halves of 26 bits, so that sums of many stay within 64.
        for k, e in enumerate(kinds.tolist()):
            w = whole[place == k]
            totals[e] = totals.get(e, 0) + (int((w >> 26).sum()) << 26) + int((w & ((1 << 26) - 1)).sum())
        return totals, odd

    def merge(self, a: tuple, b: tuple) -> tuple:
        return {e: a[0].get(e, 0) + b[0].get(e, 0) for e in a[0] | b[0]}, a[1] + b[1]

    def finish(self, state: tuple) -> float:
        totals, odd = state
        if odd != 0 or math.isnan(odd):
            return odd
        low = min(totals, default=0)
        whole = sum(n << (e - low) for e, n in totals.items())
        scale = low - 53
        try:
            return float(whole << scale) if scale >= 0 else whole / (1 << -scale)
        except OverflowError:
            return math.copysign(math.inf, whole)


def folded(df: DataFrame, by: list[str], value: str, fold: Fold, name: str, returns: str = "double") -> DataFrame:
    """`by` and `name`: `fold` over the values of each group that aren't null; null is a group, and one without values has
    the fold of nothing. Each task adds its rows to a state for each key and hands on states, not rows; those of a key are
    merged in groups by task and then with each other, so that a group with most rows, or with states of very many
    tasks, is dealt out as well."""
    rows = df.select(*by, value)
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    states = f"{keys}, _salt int, _state binary"

    def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Any] = {}
        salt = TaskContext.get().partitionId() % SALTS

        def flush(schema: pa.Schema) -> pa.RecordBatch:
            columns = list(zip(*held, strict=True)) if held else [()] * len(by)
            made = [*(pa.array(c, schema.field(b).type) for c, b in zip(columns, by, strict=True)), pa.array([salt] * len(held), pa.int32()), pa.array([pickle.dumps(s) for s in held.values()], pa.binary())]
            held.clear()
            return pa.record_batch(made, [*by, "_salt", "_state"])

        schema = None
        for batch in batches:
            schema = batch.schema
            lists = pa.Table.from_batches([batch]).group_by(by).aggregate([(value, "list")])
            for *key, values in zip(*(lists.column(b).to_pylist() for b in by), lists.column(f"{value}_list"), strict=True):
                key = tuple(key)
                state = held[key] if key in held else fold.zero()
                held[key] = fold.add(state, values.values.drop_null().to_numpy(zero_copy_only=False))
            if len(held) >= KEYS:
                yield flush(schema)
        if held:
            yield flush(schema)

    def total(part: pa.Table) -> Any:
        state = fold.zero()
        for s in part.column("_state").to_pylist():
            state = fold.merge(state, pickle.loads(s))
        return state

    def merged(part: pa.Table) -> pa.Table:
        return part.slice(0, 1).set_column(len(by) + 1, "_state", pa.array([pickle.dumps(total(part))], pa.binary()))

    def finished(part: pa.Table) -> pa.Table:
        return part.slice(0, 1).select(by).append_column(name, pa.array([fold.finish(total(part))]))

    made = rows.mapInArrow(partials, states).groupBy(*by, "_salt").applyInArrow(merged, states)
    return made.groupBy(*by).applyInArrow(finished, f"{keys}, `{name}` {returns}")
