"""Arrow batches in steps, so that what a function holds besides its batch doesn't grow with the batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa

#: Bytes of a batch's columns that are worked on at a time; a row of more is a step of its own.
STEP_BYTES = 2 << 20


def steps(columns: list[pa.Array]) -> Iterator[tuple[int, int]]:
    """First row and number of rows of each step."""
    rows = len(columns[0]) if columns else 0
    start = 0
    while start < rows:
        n = rows - start
        # halved until it fits: sizes of slices are those of their buffers' parts
        while n > 1 and sum(c.slice(start, n).nbytes for c in columns) > STEP_BYTES:
            n = (n + 1) // 2
        yield start, n
        start += n


def in_steps(work: Callable[..., pa.Array], *columns: pa.Array) -> pa.Array:
    """work(*columns) of each step, put together."""
    made = [work(*[c.slice(a, n) for c in columns]) for a, n in steps(list(columns))]
    return pa.concat_arrays(made) if made else work(*columns)
