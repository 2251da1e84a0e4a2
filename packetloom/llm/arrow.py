"""Running a Python function over whole rows in Arrow batches of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SLICE_BYTES = 1 << 20
#: What operators keep in a Python worker from task to task, and how it is dropped when the worker goes on to another operator.
HELD: dict[str, Callable[[], None]] = {}


def as_schema(schema: str | T.StructType) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)


def slices(batch: pa.RecordBatch, at_most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``at_most`` bytes; a longer row is a part of its own."""
    rows = batch.num_rows
    if not rows:
        return
    step = max(1, int(rows * at_most / max(1, batch.nbytes)))
    for i in range(0, rows, step):
        yield batch.slice(i, step)


def give_back() -> None:
    """Return freed memory to the machine: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str | T.StructType, slice_bytes: int = SLICE_BYTES, keeps: str = "") -> DataFrame:
    """``fn`` gets bounded record batches and yields dicts of columns; each becomes a batch of ``schema``. ``keeps`` names its entry of ``HELD``."""
    struct = as_schema(schema)
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name in [n for n in HELD if n != keeps]:
            HELD.pop(name)()
        for columns in fn(part for b in batches for part in slices(b, slice_bytes)):
            yield pa.RecordBatch.from_arrays([c if isinstance(c := columns[f.name], pa.Array) and c.type == f.type else c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for f in arrow], schema=arrow)
        give_back()

    return df.mapInArrow(run, struct)


def raw_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of a text column; nulls are empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [x or "" for x in batch.column(column).to_pylist()]
