"""Adding columns to rows by Arrow batches, in small slices so that long texts don't pile up."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator, Sequence
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows and bytes of text of a slice at most (one row may be larger).
SLICE_ROWS, SLICE_BYTES = 512, 2 << 20


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if i > start and (held + n > SLICE_BYTES or i - start >= SLICE_ROWS):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if batch.num_rows > start:
        yield batch.slice(start)


def add_columns(
    df: DataFrame,
    text: str,
    new: Sequence[T.StructField],
    make: Callable[[], Callable[[pa.Array], list]],
    keep_text: bool = True,
) -> DataFrame:
    """``df`` with ``new`` columns (which replace namesakes). ``make()`` is called once for each task and returns a function
    from the text column of a slice to the new columns, lists or arrays in the order of ``new``."""
    names = {f.name.lower() for f in new}
    df = df.drop(*[c for c in df.columns if c.lower() in names])
    kept = [f for f in df.schema.fields if keep_text or f.name != text]
    schema = T.StructType([*kept, *new])
    types = [to_arrow_type(f.dataType) for f in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        work = make()
        for batch in batches:
            column = batch.schema.get_field_index(text)
            for part in slices(batch, column):
                made = work(part.column(column))
                columns = [part.column(part.schema.get_field_index(f.name)) for f in kept]
                columns += [x if isinstance(x, pa.Array) else pa.array(x, type=t) for x, t in zip(made, types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        del work
        _release()

    return df.mapInArrow(run, schema)


def _release() -> None:
    """Gives the memory of what a task held (models, tables of words) back to the system: its worker stays for other tasks."""
    gc.collect()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
