"""Aggregates of the user's own, with partial states: no group ever meets in one task.

Every task folds the rows of each group that it reads into one state. States
are merged in two steps, first by group and part of the tasks, then by group,
so a merge sees about the square root of the number of tasks, however many
rows the group has.
"""

from __future__ import annotations

import math
import pickle
import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .answer import _present

register_pickle_by_value(sys.modules[__name__])

STATE, PART = "__state", "__part"
# Groups held at a time by a task; with more, states are passed on early.
HELD = 50_000


@dataclass(frozen=True)
class Fold:
    """An aggregate: a state to start with, and how rows, states and the end change it.

    ``update(state, rows)`` gets rows of one group as an Arrow table; ``merge``
    must not depend on the order of its states beyond rounding.
    """

    init: Callable[[], Any]
    update: Callable[[Any, pa.Table], Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], Any]


def _by_group(batch: pa.RecordBatch, keys: Sequence[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """The rows of each group of a batch."""
    codes = np.zeros(len(batch), np.int64)
    for key in keys:
        coded = batch.column(batch.schema.get_field_index(key)).dictionary_encode()
        codes = codes * (len(coded.dictionary) + 1) + coded.indices.to_numpy(zero_copy_only=False)
        codes = np.unique(codes, return_inverse=True)[1]
    order = np.argsort(codes, kind="stable")
    table = pa.Table.from_batches([batch]).take(pa.array(order))
    starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
    for lo, hi in zip(starts, [*starts[1:], len(codes)]):
        rows = table.slice(lo, hi - lo)
        yield tuple(rows.column(k)[0].as_py() for k in keys), rows.drop_columns(list(keys))


def partial_states(df: DataFrame, keys: Sequence[str], fold: Fold, inputs: Sequence[str]) -> DataFrame:
    """One row per group and task (or per HELD groups of it): the keys, the state, the task."""
    schema = T.StructType(
        [*[df.schema[k] for k in keys], T.StructField(STATE, T.BinaryType()), T.StructField(PART, T.LongType())]
    )
    layout = to_arrow_schema(schema)

    def states_of(held: dict[tuple, Any]) -> pa.RecordBatch:
        part = TaskContext.get().partitionId()
        rows = [(*key, pickle.dumps(state), part) for key, state in held.items()]
        columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), layout)]
        return pa.RecordBatch.from_arrays(columns, schema=layout)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Any] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            for key, rows in _by_group(batch, keys):
                held[key] = fold.update(held[key] if key in held else fold.init(), rows)
            if len(held) >= HELD:
                yield states_of(held)
                held = {}
        if held:
            yield states_of(held)

    present = df
    for key in keys:
        present = present.filter(_present(df, key))
    return present.select(*keys, *[c for c in inputs if c not in keys]).mapInArrow(run, schema)


def fold_groups(
    df: DataFrame, keys: str | Sequence[str], fold: Fold, inputs: Sequence[str], returns: str, name: str = "value"
) -> DataFrame:
    """The keys and ``name``, the finished state of each group, of the SQL type ``returns``.

    Rows without a key form no group, as in ``group_agg``. ``inputs`` are the columns
    that ``fold`` reads, nulls and NaN included.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    states = partial_states(df, keys, fold, inputs)
    fan = max(1, math.isqrt(df.rdd.getNumPartitions()))
    merged = T.StructType([*[df.schema[k] for k in keys], T.StructField(STATE, T.BinaryType())])
    done = T.StructType([*merged.fields[:-1], T.StructField(name, T._parse_datatype_string(returns))])

    def merging(schema: T.StructType, last: Callable[[Any], Any]):
        layout = to_arrow_schema(schema)

        def run(group: pa.Table) -> pa.Table:
            if PART in group.column_names:
                group = group.sort_by(PART)
            state = None
            for k, raw in enumerate(group.column(STATE)):
                one = pickle.loads(raw.as_py())
                state = one if k == 0 else fold.merge(state, one)
            values = [[group.column(key)[0].as_py()] for key in keys] + [[last(state)]]
            return pa.table([pa.array(v, f.type) for v, f in zip(values, layout)], schema=layout)

        return run

    salted = states.groupBy(*keys, F.col(PART) % fan)
    few = salted.applyInArrow(merging(merged, pickle.dumps), merged)
    return few.groupBy(*keys).applyInArrow(merging(done, fold.finish), done)
