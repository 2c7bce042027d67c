"""Ordered folds: rows of a key in order through a Python state, streamed so that no key is held as a whole."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def ordered_fold(df: DataFrame, keys: list[str], order: list, columns: list[str], schema: str, fold: Callable[[tuple, Iterator[tuple]], Iterator[tuple]]) -> DataFrame:
    """`fold(key, rows)` for each key, its rows (of `columns`) sorted by `order`; it yields rows of `schema`.

    One shuffle by the keys and one sort. Rows arrive one by one: a fold's memory is what its own state holds.
    """
    width, out = len(keys), to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        held: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], f.type) for i, f in enumerate(out)], schema=out)

        for key, group in groupby(rows, key=lambda row: row[:width]):
            for made in fold(key, (row[width:] for row in group)):
                held.append(made)
                if len(held) >= 4096:
                    yield batch()
                    held = []
        if held:
            yield batch()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, *columns).mapInArrow(run, schema)
