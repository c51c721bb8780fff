"""Arrow functions that go over a batch in slices, so that what a Python worker holds does not grow with the rows of a batch."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

#: Bytes of text that become Python values at a time; a longer single text is a slice of its own.
SLICE_BYTES = 1 << 20


def cuts(columns: tuple[pa.Array, ...], limit: int) -> Iterator[tuple[int, int]]:
    """Begin and end of runs of rows whose texts hold at most ``limit`` bytes together, at least one row and at most 4,096 each."""
    n = len(columns[0])
    ends = np.zeros(n, np.int64)
    for c in columns:
        if not pa.types.is_null(c.type):
            ends += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = ends.cumsum()
    at = 0
    while at < n:
        to = min(max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right"))), at + 4096)
        yield at, to
        at = to


def give_back() -> None:
    """Hand free memory of a Python worker back to the system, as workers are kept and used again."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def sliced(kind: DataType):
    """An Arrow function of texts or bodies: ``fn`` takes lists of the values of a slice, and gives a list or an Arrow array."""
    arrow = to_arrow_type(kind)

    def over(fn: Callable):
        def run(*columns: pa.Array) -> pa.Array:
            out = [pa.array([], arrow)]
            for low, high in cuts(columns, SLICE_BYTES):
                made = fn(*(c.slice(low, high - low).to_pylist() for c in columns))
                out.append(made if isinstance(made, pa.Array) else pa.array(made, arrow))
            whole = pa.concat_arrays(out)
            del out
            give_back()
            return whole

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        return F.arrow_udf(run, kind)

    return over
