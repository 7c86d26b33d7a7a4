"""Arrow batches from Python columns, typed by a Spark schema (nulls and empty columns keep their types)."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def batch(schema: T.StructType, columns: dict[str, Sequence], rows: int | None = None) -> pa.RecordBatch:
    """A record batch of ``schema``; columns left out are null."""
    kinds = to_arrow_schema(schema)
    n = rows if rows is not None else (len(next(iter(columns.values()))) if columns else 0)
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in kinds], schema=kinds)


def from_rows(schema: T.StructType, rows: Sequence[tuple], names: Sequence[str] | None = None) -> pa.RecordBatch:
    names = list(names) if names is not None else [f.name for f in schema]
    columns = list(zip(*rows)) if rows else [() for _ in names]
    return batch(schema, dict(zip(names, columns)), len(rows))
