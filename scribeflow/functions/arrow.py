"""Row functions over Arrow batches, a few rows at a time.

Spark sends up to 10,000 rows or 64 MB in a batch.  A pandas function turns all of them
into Python texts, and all results, before it gives any back.  Here only a few rows are
Python objects at once, so that what a task holds beside the batch and its result is
small, however large the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import functions as F

#: Rows and bytes that are Python objects at once; a row is never cut.
ROWS, BYTES = 64, 1 << 20


def few(columns: list[pa.Array]) -> Iterator[list[list]]:
    """Columns as Python values, some rows at a time."""
    n = len(columns[0])
    size = max(1, min(ROWS, n * BYTES // max(1, sum(c.nbytes for c in columns))))
    for at in range(0, n, size):
        yield [c.slice(at, size).to_pylist() for c in columns]


def mapped(fold: Callable, columns: list[pa.Array], kind: pa.DataType) -> pa.Array:
    """A fold over the rows of columns."""
    parts = [pa.array([fold(*row) for row in zip(*values)], kind) for values in few(columns)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def row_function(fold: Callable, kind: pa.DataType, schema: str, columns: int = 1):
    """An Arrow function of one or two columns; the fold sees nulls as None."""
    if columns == 1:

        def run(x: pa.Array) -> pa.Array:
            return mapped(fold, [x], kind)

    else:

        def run(x: pa.Array, y: pa.Array) -> pa.Array:
            return mapped(fold, [x, y], kind)

    run.__annotations__ = dict.fromkeys(run.__annotations__, pa.Array)
    return F.arrow_udf(run, schema)


def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut so that few rows are Python objects at once."""
    for b in batches:
        size = max(1, min(ROWS, b.num_rows * BYTES // max(1, b.nbytes)))
        for at in range(0, b.num_rows, size):
            yield b.slice(at, size)
