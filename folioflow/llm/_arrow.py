"""Batch plumbing shared by the operators that run Python on the executors."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


ROWS = 1024  # of a batch as Python objects at a time


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most `ROWS` rows; after each batch, freed memory goes back to the system.

    Workers live on from task to task and stage to stage, and would keep it.
    """
    for batch in batches:
        for at in range(0, max(1, batch.num_rows), ROWS):
            yield batch.slice(at, ROWS)
        del batch
        release()


def release() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_columns(df: DataFrame, make: Callable[[], Callable[..., list]], schema: str) -> DataFrame:
    """Run a batch function over all columns of `df`, in Arrow batches.

    `make` is called once per task and returns a function of as many lists as
    `df` has columns; that function returns one list per field of `schema`.
    """
    fields = _parse_datatype_string(schema)
    assert isinstance(fields, StructType)
    arrow = to_arrow_schema(fields)

    def run(batches):
        work = make()
        for batch in slices(batches):
            made = work(*[c.to_pylist() for c in batch.columns])
            yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(made, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, fields)


def with_column(df: DataFrame, name: str, kind: str, column: str, make: Callable[[], Callable[[list], list]]) -> DataFrame:
    """`df` with the column `name` (put last, or in its place) computed from `column` by a batch function; the others pass as they are."""
    (field,) = _parse_datatype_string(f"`{name}` {kind}")
    fields = StructType([field if f.name == name else f for f in df.schema] + [field] * (name not in df.columns))
    arrow, places = to_arrow_schema(fields), (df.columns.index(column), fields.names.index(name))

    def run(batches):
        work = make()
        for batch in slices(batches):
            made = pa.array(work(batch.column(places[0]).to_pylist()), type=arrow.field(places[1]).type)
            columns = [*batch.columns]
            columns[places[1] : places[1] + 1] = [made]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, fields)
