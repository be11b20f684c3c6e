"""Many small groups in one call: rows are dealt and sorted by key and read on, so that a group costs what its rows cost."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

ROWS = 1 << 14


def each_group(df: DataFrame, keys: list[str], order: list[str], run: Callable[[tuple, dict[str, np.ndarray]], Iterable[tuple]], schema: str) -> DataFrame:
    """The rows (tuples by schema) that run(key, columns) makes of each group; columns are arrays over its rows, sorted by `order`.

    Like applyInPandas, a group must fit into a task; unlike it, no frames are made for each. Numbers with nulls come as floats with NaN, and NaN goes out as null.
    """
    names, to = df.columns, to_arrow_schema(StructType.fromDDL(schema))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [[] for _ in to]
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type, from_pandas=True) for c, f in zip(columns, to)], schema=to)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, out = None, [], []

        def closed() -> Iterable[tuple]:
            whole = parts[0] if len(parts) == 1 else [np.concatenate(c) for c in zip(*parts)]
            return run(key, dict(zip(names, whole)))

        for b in batches:
            if not b.num_rows:
                continue
            at = list(zip(*(b.column(names.index(k)).to_pylist() for k in keys)))
            columns = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            cuts = [0, *(n for n in range(1, len(at)) if at[n] != at[n - 1]), len(at)]
            for a, z in zip(cuts, cuts[1:]):
                if parts and at[a] != key:
                    out.extend(closed())
                    parts = []
                key = at[a]
                parts.append([c[a:z] for c in columns])
            if len(out) >= ROWS:
                yield batch(out)
                out = []
        if parts:
            out.extend(closed())
        yield batch(out)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(over, schema)
