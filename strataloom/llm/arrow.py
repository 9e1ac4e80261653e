"""Helpers for operators that see whole record batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType
from pyspark.sql.pandas.types import to_arrow_schema


def map_batches(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, object]]], schema: StructType | str) -> DataFrame:
    """mapInArrow with columns as Python lists. make() runs once per task and returns the function of a batch.

    The function returns columns by name; lists of equal length, in the schema's types."""
    out = df.sparkSession.createDataFrame([], schema).schema if isinstance(schema, str) else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = to_arrow_schema(out)
        f = make()
        for b in batches:
            if b.num_rows:
                got = f({n: c.to_pylist() for n, c in zip(b.schema.names, b.columns)})
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t.type) for t in fields for x in [got[t.name]]], schema=fields)

    return df.mapInArrow(run, out)
