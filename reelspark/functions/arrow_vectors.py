"""Arrow list columns to NumPy matrices and back, without touching single values in Python."""

from __future__ import annotations


def matrix(column, dim: int, dtype="float32"):
    """Arrow list<float> column -> (matrix [n, dim], usable [n]).

    Usable: not NULL, of ``dim`` elements, none NULL or NaN or infinite, not all zero.  Other rows are zero.
    """
    import numpy as np
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    out = np.zeros((n, dim), dtype)
    if not n:
        return out, np.zeros(0, bool)
    offsets = column.offsets.to_numpy()
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    right = valid & (np.diff(offsets) == dim)
    values = column.values.to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    if right.all() and offsets[-1] - offsets[0] == n * dim:
        out = np.array(values[offsets[0] : offsets[-1]].reshape(n, dim))
    elif right.any():
        rows = np.flatnonzero(right)
        out[rows] = values[offsets[rows][:, None] + np.arange(dim)]
    usable = right & np.isfinite(out).all(1) & (out != 0).any(1)
    out[~usable] = 0
    return out, usable


def unit(x):
    """Rows scaled to length one; zero rows stay zero."""
    import numpy as np

    n = np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64))
    return (x / np.where(n > 0, n, 1.0)[:, None]).astype(x.dtype)


def binary(rows):
    """2-D array -> Arrow binary column of its rows' bytes."""
    import numpy as np
    import pyarrow as pa

    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int64) * width
    if offsets[-1] >= 2**31 - 1:
        raise ValueError("batch too large")
    return pa.Array.from_buffers(
        pa.binary(), len(rows), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(rows.tobytes())]
    )


def from_binary(column, dim: int, dtype):
    """Inverse of :func:`binary` (no NULLs)."""
    import numpy as np
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, dim), dtype)
    o = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[o[0] : o[-1]].view(dtype).reshape(len(column), dim)


def ints(column, missing: int = 0):
    """Arrow integer column -> int64 array; NULL becomes ``missing``."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, missing)
    return column.to_numpy(zero_copy_only=False)


def doubles(column):
    """Arrow double column -> float64 array; NULL becomes NaN."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.to_numpy(zero_copy_only=False).astype(float, copy=False)
