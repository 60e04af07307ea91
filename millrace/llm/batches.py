"""Arrow batches in small slices, so that long texts never pile up as Python objects in a worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

SLICE_ROWS = 256


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[list[list]]:
    """The columns of each slice as Python lists."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            yield [column.to_pylist() for column in part.columns]


def map_slices(df: DataFrame, make: Callable[[], Callable[..., dict[str, object]]], schema: str) -> DataFrame:
    """Apply ``make()(*columns)`` to every slice of ``df``; it returns the columns of ``schema`` by name.

    ``make`` runs once in each task, for what a task sets up but does not share.
    """
    out = _parse_datatype_string(schema)
    assert isinstance(out, StructType)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for columns in slices(batches):
            made = work(*columns)
            yield pa.RecordBatch.from_arrays(
                [pa.array(made[field.name], type=field.type) for field in arrow], schema=arrow
            )

    return df.mapInArrow(run, out)
