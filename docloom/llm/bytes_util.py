"""Texts of Arrow batches as byte arrays, in bounded pieces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that are worked on at once; a longer text comes in several pieces.
PIECE = 1 << 18
#: Bytes of context before each text and each piece.
CONTEXT = 3
_START = b"\n" * CONTEXT


def pieces(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, rows, starts, ends): the texts of a string column, null as empty, about PIECE bytes at a time.

    Text k of a piece belongs to rows[k] and is bytes[starts[k]:ends[k]]; CONTEXT bytes come before it: line
    feeds, or the bytes before it if it goes on with a text that an earlier piece began. Empty texts are left out.
    """
    parts, rows, starts, ends, size = [], [], [], [], 0

    def flush():
        return np.frombuffer(b"".join(parts), np.uint8), np.array(rows), np.array(starts), np.array(ends)

    for row, value in enumerate(column):
        text = (value.as_py() or "").encode()
        for at in range(0, len(text), PIECE):
            part = text[at : at + PIECE]
            parts += [text[at - CONTEXT : at] if at else _START, part]
            rows.append(row)
            starts.append(size + CONTEXT)
            size += CONTEXT + len(part)
            ends.append(size)
            if size >= PIECE:
                yield flush()
                parts, rows, starts, ends, size = [], [], [], [], 0
    if rows:
        yield flush()


def sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of values[starts[k]:ends[k]] for each k, along the first axis; the stretches are in order, apart and not empty."""
    bounds = np.stack([starts, ends], axis=1).reshape(-1)
    if bounds[-1] == len(values):
        bounds = bounds[:-1]
    return np.add.reduceat(values, bounds, axis=0, dtype=np.float64)[::2]
