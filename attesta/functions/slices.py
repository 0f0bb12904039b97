"""Python results of a batch's rows, a slice at a time."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of texts whose results are held as Python objects at once, and what a row counts for beside its text.
MOST_HELD, A_ROW = 1 << 18, 64


def cuts(texts: pa.Array) -> list[tuple[int, int]]:
    """Where slices begin and end: of MOST_HELD bytes of texts at most; a longer text is a slice of its own."""
    starts, held = [0], 0
    for k, size in enumerate(pc.binary_length(texts).to_pylist()):
        if held and held + (size or 0) > MOST_HELD:
            starts.append(k)
            held = 0
        held += (size or 0) + A_ROW
    return list(zip(starts, [*starts[1:], len(texts)]))


def by_slices(of: Callable, made: pa.DataType, texts: pa.Array, *others: pa.Array) -> pa.Array:
    """``of`` of each row, as Arrow.

    Objects of nested results are many times the size of their text, and a batch has
    thousands of rows; so only those of a slice are there at once.
    """
    return pa.concat_arrays([pa.array([of(*row) for row in zip(*(c.slice(a, b - a).to_pylist() for c in (texts, *others)))], made) for a, b in cuts(texts)])
