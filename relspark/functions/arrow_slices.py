"""Arrow batches worked off in slices.

Spark hands over batches of a number of rows, whatever their bytes. Python objects made of a whole batch take many
times its size; made of one slice at a time, they take a fixed amount but for the longest single row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of a slice, besides its first row, which may be longer.
SLICE_BYTES = 1 << 20


def slices(values: pa.Array, most_bytes: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Parts of a string or binary array in order, of about `most_bytes` each."""
    sizes = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    # a row's own 64 bytes count, so that short rows do not add up to long lists
    place = np.cumsum(sizes + 64) // most_bytes
    cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(values)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield values.slice(a, b - a)


def by_slices(
    make: Callable[[pa.Array], pa.Array], values: pa.Array, most_bytes: int = SLICE_BYTES
) -> pa.Array:
    """`make` of each slice, put together again."""
    parts = [make(part) for part in slices(values, most_bytes)]
    return parts[0] if len(parts) == 1 else pa.concat_arrays(parts or [make(values)])


def in_slices(
    make: Callable[[pa.Array], pa.Array], batches: Iterator[pa.Array], most_bytes: int = SLICE_BYTES
) -> Iterator[pa.Array]:
    """`make` of each slice of each batch, handed on one by one: what a whole batch gives is never held."""
    for values in batches:
        yield from map(make, slices(values, most_bytes))
