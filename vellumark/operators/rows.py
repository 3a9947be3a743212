"""Python functions over rows whose memory follows a slice of a batch, and not the batch.

Spark hands Python up to 10,000 rows or 64 MB at once. They stay in Arrow; a slice of them is made into Python values,
worked on and put out before the next one is begun.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

SLICE_BYTES, SLICE_ROWS = 1 << 20, 512


def slices(columns: tuple[pa.Array, ...], most: int = SLICE_BYTES) -> Iterator[tuple[pa.Array, ...]]:
    """The rows of the columns in order, in slices of at most `most` bytes; a larger row is a slice by itself."""
    left = [(0, len(columns[0]))]
    while left:
        start, count = left.pop()
        part = tuple(c.slice(start, count) for c in columns)
        if count > 1 and (count > SLICE_ROWS or sum(c.nbytes for c in part) > most):
            half = count // 2
            left += [(start + half, count - half), (start, half)]
        elif count:
            yield part


def each_row(function: Callable, kind: str, *columns: Column) -> Column:
    """function(values of the columns) of each row, as a column of the type `kind`; structs are tuples in the order of their fields."""
    arrow = to_arrow_type(DataType.fromDDL(kind))

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            for part in slices(batch if isinstance(batch, tuple) else (batch,)):  # one column comes by itself
                yield pa.array([function(*values) for values in zip(*(c.to_pylist() for c in part), strict=True)], arrow)
            pa.default_memory_pool().release_unused()  # an idle worker shall not hold what a batch has needed

    return F.arrow_udf(run, kind)(*columns)
