"""Helpers for Arrow batch functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def map_batches(df: DataFrame, schema: str, work: Callable[[dict[str, pa.Array]], dict[str, list]]) -> DataFrame:
    """``mapInArrow`` with ``work`` from a dict of columns to a dict of columns, batch by batch."""
    target = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    fields = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = work({n: batch.column(i) for i, n in enumerate(batch.schema.names)})
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in fields], schema=fields)

    return df.mapInArrow(run, target)
