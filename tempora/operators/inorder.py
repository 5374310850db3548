"""Work on rows of a group in their order, where each row's result depends on those before it.

Rows come sorted by group and stream through a task in batches of many groups; a task holds what one group carries on from row to row,
not the group, and small groups cost no call of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import StructType


def group_starts(columns: list[pa.Array]) -> np.ndarray:
    """Where rows begin whose keys differ from those of the row before."""
    new = np.zeros(len(columns[0]), dtype=bool)
    new[0] = True
    for c in columns:
        codes = c.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def in_order(df: DataFrame, keys: list[str], order: list[Column | str], told: list[str], fresh: Callable[[], Any], step: Callable[..., Any], out: str) -> DataFrame:
    """df with a column out (name and type): what step(state, *values of told) gives each row, in order; fresh makes a group's state."""
    columns = [*keys, *[c for c in df.columns if c not in keys]]
    schema = StructType.fromDDL(", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*columns).schema.fields] + [out]))
    at = [columns.index(c) for c in told]
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = group_starts(batch.columns[: len(keys)])
            key = lambda i: [c[i].as_py() for c in batch.columns[: len(keys)]]
            if key(0) == last:
                starts = starts[1:]
            begins = set(starts.tolist())
            found = []
            for i, values in enumerate(zip(*[batch.column(k).to_pylist() for k in at], strict=True)):
                if i in begins:
                    state = fresh()
                found.append(step(state, *values))
            last = key(batch.num_rows - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kinds)], names)

    kinds = {"int": pa.int32(), "boolean": pa.bool_()}[out.split()[-1]]
    return df.select(*columns).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
