"""Left folds over the ordered rows of each key, whose memory is the state and never the group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def fold_sorted(df: DataFrame, keys: list[str], order: list[str | Column], fresh: Callable[[], list], step: Callable[[list, tuple], list[tuple]], finish: Callable[[list], list[tuple]], fields: StructType) -> DataFrame:
    """Rows of a key are sorted (nulls first) and streamed through one task; Spark's sort spills, so no group is held whole.

    ``step`` changes the state (a list) by one row of the columns that are no keys and returns rows of ``fields``;
    ``finish`` returns those that a key gives at its end. Returns the keys and ``fields``.
    """
    n, schema = len(keys), StructType([df.schema[k] for k in keys] + fields.fields)
    df = df.select(*keys, *[c for c in df.columns if c not in keys])
    arrow = to_arrow_schema(schema)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for b in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if state is None or row[:n] != at:
                    if state is not None:
                        out += [at + r for r in finish(state)]
                    at, state = row[:n], fresh()
                out += [at + r for r in step(state, row[n:])]
            if out:
                yield batch(out)
        if state is not None and (last := [at + r for r in finish(state)]):
            yield batch(last)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
