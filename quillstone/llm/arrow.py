"""Row-wise Python functions over Arrow batches, in bounded slices."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import from_arrow_type

from quillstone.llm.common import spread

#: Rows that are turned into Python objects at once.
SLICE = 256


def ddl(fields: list[pa.Field]) -> str:
    return ", ".join(f"`{f.name}` {from_arrow_type(f.type).simpleString()}" for f in fields)


def map_rows(df: DataFrame, columns: list[str], fields: list[pa.Field], make: Callable[[], Callable[..., tuple]]) -> DataFrame:
    """columns[0] unchanged, then the fields that the function `make()` returns gives for the values of columns[1:].

    `make` runs once a task, so tables and models are set up there. No shuffle, but for small inputs: see spread().
    """
    key = df.select(columns[0]).schema[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                made = [row(*values) for values in zip(*(c.to_pylist() for c in part.columns[1:]))]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([m[k] for m in made], f.type) for k, f in enumerate(fields))], names=["key", *(f.name for f in fields)])

    picked = spread(df.select(*(df[c].alias(f"in{k}") for k, c in enumerate(columns))))
    return picked.mapInArrow(run, f"key {key.dataType.simpleString()}, {ddl(fields)}").withColumnRenamed("key", columns[0])
