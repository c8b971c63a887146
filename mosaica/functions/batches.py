"""Kernels over Arrow batches, some rows at a time: what a worker holds as Python objects doesn't grow with the batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_BYTES, MOST_ROWS = 1 << 20, 1000


def slices(column: pa.Array, most: int = MOST_BYTES, rows: int = MOST_ROWS) -> Iterator[tuple[int, int]]:
    """Start and length of row ranges of about ``most`` bytes of a column of strings or binaries; a longer row is a range of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = done = 0
    while first < len(ends):
        last = int(np.searchsorted(ends, done + most, "right"))
        last = min(max(last, first + 1), first + rows, len(ends))
        yield first, last - first
        first, done = last, int(ends[last - 1])


def kernel(f: Callable, returns: str) -> Callable[..., Column]:
    """``f`` of one row's values as a column function; the first column is of strings, by whose bytes the rows are dealt."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = to_arrow_schema(T.StructType([T.StructField("v", T._parse_datatype_string(returns))])).field(0).type

    def run(*columns: pa.Array) -> pa.Array:
        done = [pa.array([f(*row) for row in zip(*(c.slice(a, n).to_pylist() for c in columns), strict=True)], kind) for a, n in slices(columns[0])]
        return pa.concat_arrays(done) if done else pa.array([], kind)

    return F.arrow_udf(run, returns, F.ArrowUDFType.SCALAR)
