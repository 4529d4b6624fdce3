"""Lossless compact binary form of coordinate frames, for shuffles and intermediate tables.

A frame whose coordinates are whole thousandths below 32.767 is stored as 16-bit thousandths; any other as 64-bit floats. The length of
the value tells which. Decoding gives back the very same doubles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SCALE = 1000.0


def from_lists(column: pa.Array, n_atoms: int) -> tuple[np.ndarray, np.ndarray]:
    """(row mask, coordinates) of the rows that hold exactly ``n_atoms`` complete points; null, short or incomplete rows are missing data."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    keep = pc.fill_null(pc.equal(pc.list_value_length(column), n_atoms), False).to_numpy(zero_copy_only=False)
    if not keep.any():
        return keep, np.empty((0, n_atoms, 3))
    points = column.filter(pa.array(keep)).flatten()
    whole = pc.fill_null(pc.equal(pc.list_value_length(points), 3), False).to_numpy(zero_copy_only=False).reshape(-1, n_atoms)
    if not whole.all():
        rows = whole.all(axis=1)
        keep[np.flatnonzero(keep)[~rows]] = False
        points = points.filter(pa.array(np.repeat(rows, n_atoms)))
    values = points.flatten()
    x = values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, n_atoms, 3)
    if values.null_count:
        rows = ~pc.is_null(values).to_numpy(zero_copy_only=False).reshape(len(x), -1).any(axis=1)
        keep[np.flatnonzero(keep)[~rows]] = False
        x = x[rows]
    return keep, x


def pack(x: np.ndarray) -> pa.Array:
    """(n, atoms, 3) doubles to a binary Arrow column."""
    n = len(x)
    flat = x.reshape(n, -1)
    width = flat.shape[1]
    with np.errstate(invalid="ignore", over="ignore"):
        ticks = np.rint(flat * SCALE)
        exact = ((np.abs(ticks) <= 32767) & (ticks / SCALE == flat)).all(axis=1)
    sizes = np.where(exact, 2 * width, 8 * width)
    offsets = np.zeros(n + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    if exact.all():
        data = ticks.astype("<i2").tobytes()
    else:
        buf = np.empty(offsets[-1], np.uint8)
        for rows, raw in ((exact, ticks[exact].astype("<i2")), (~exact, np.ascontiguousarray(flat[~exact], "<f8"))):
            if rows.any():
                raw = raw.view(np.uint8)
                buf[offsets[:-1][rows][:, None] + np.arange(raw.shape[1])] = raw
        data = buf.tobytes()
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])


def unpack(column: pa.Array, n_atoms: int) -> np.ndarray:
    """Binary Arrow column (no nulls) back to (n, atoms, 3) doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n, width = len(column), 3 * n_atoms
    if n == 0:
        return np.empty((0, n_atoms, 3))
    large = pa.types.is_large_binary(column.type)
    _, obuf, dbuf = column.buffers()
    offsets = np.frombuffer(obuf, np.int64 if large else np.int32)[column.offset : column.offset + n + 1]
    data = np.frombuffer(dbuf, np.uint8)
    short = np.diff(offsets) == 2 * width
    out = np.empty((n, width))
    if short.all():
        out[:] = data[offsets[0] : offsets[-1]].view("<i2").reshape(n, width)
        out /= SCALE
    else:
        for rows, kind, size in ((short, "<i2", 2 * width), (~short, "<f8", 8 * width)):
            if rows.any():
                raw = data[offsets[:-1][rows].astype(np.int64)[:, None] + np.arange(size)]
                out[rows] = np.ascontiguousarray(raw).view(kind) / (SCALE if size == 2 * width else 1)
    return out.reshape(n, n_atoms, 3)
