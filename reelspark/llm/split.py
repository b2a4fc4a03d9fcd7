"""Oversized sequences cut into overlapping pieces at natural boundaries.

Lexical-cohesion segmentation over vectors: the similarity of the ``block`` items before and after each gap is
slid along the sequence; valleys mark boundaries.  Within the window of gaps that keep a piece under the limit
the cut falls on the latest or on the deepest valley, else on the last item that fits; the next piece repeats
the last ``overlap`` items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.functions.arrow_vectors import matrix


def gap_similarity(x, ok, block: int):
    """sim[g]: cosine of the means of the up to ``block`` usable items on either side of the gap after item g.

    NaN where one side has no usable item (no evidence for a boundary).
    """
    import numpy as np

    n = len(x)
    if n < 2:
        return np.zeros(0)
    u = x / np.maximum(np.sqrt((x * x).sum(1)), 1e-300)[:, None]
    u[~ok] = 0
    s = np.vstack([np.zeros((1, x.shape[1])), np.cumsum(u, 0)]) if block > 1 else None
    c = np.r_[0, np.cumsum(ok)]
    g = np.arange(1, n)
    lo, hi = np.maximum(g - block, 0), np.minimum(g + block, n)
    a, b = (u[g - 1], u[g]) if block == 1 else (s[g] - s[lo], s[hi] - s[g])
    na, nb = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
    there = (c[g] - c[lo] > 0) & (c[hi] - c[g] > 0) & (na > 1e-12) & (nb > 1e-12)
    return np.where(there, (a * b).sum(1) / np.maximum(na * nb, 1e-300), np.nan)


def valley_depth(sim):
    """Depth of each gap below the nearest peaks on both sides (0 where it is no valley)."""
    import numpy as np

    v = np.nan_to_num(sim, nan=1.0)
    left, right = np.empty_like(v), np.empty_like(v)
    for out, order in ((left, range(len(v))), (right, range(len(v) - 1, -1, -1))):
        peak, before = -np.inf, np.inf
        for i in order:  # climb while the values rise on the way out
            peak = max(peak, before) if before > v[i] and np.isfinite(before) else v[i] if v[i] >= before else peak
            peak = max(peak, v[i])
            out[i] = peak
            before = v[i]
    return np.maximum(left - v, 0) + np.maximum(right - v, 0)


def cut_points(cost, boundary, depth, limit: float, overlap: int, choose: str):
    """Pieces (first, last, kind) of a sequence; kind: whole, boundary, size or end."""
    import numpy as np

    n = len(cost)
    total = np.r_[0.0, np.cumsum(cost)]
    tol = 1e-9 * max(1.0, abs(limit))
    if n == 0 or total[-1] <= limit + tol:
        return [(0, n - 1, "whole")] if n else []
    pieces, start, fresh = [], 0, 0
    while True:
        while start < fresh and total[fresh + 1] - total[start] > limit + tol:
            start += 1  # the overlap gives way rather than the limit
        if total[n] - total[start] <= limit + tol:
            pieces.append((start, n - 1, "end"))
            return pieces
        last = int(np.searchsorted(total, total[start] + limit + tol, "right")) - 2
        last = max(last, fresh)  # an item above the limit stands alone
        gaps = np.arange(fresh, min(last, n - 2) + 1)
        gaps = gaps[boundary[gaps]]
        end, kind = last, "size"
        if len(gaps):
            kind = "boundary"
            end = int(gaps[-1]) if choose == "latest" else int(gaps[len(gaps) - 1 - np.argmax(depth[gaps][::-1])])
        pieces.append((start, end, kind))
        if end >= n - 1:
            return pieces
        start, fresh = max(start, end - overlap + 1), end + 1


def split_oversized(
    df: DataFrame,
    key: str,
    items: str,
    limit: float,
    overlap: int = 2,
    default_cost: float = 30.0,
    threshold: float | None = 0.2,
    block: int = 1,
    choose: str = "latest",
    min_depth: float = 0.1,
    dim: int = 64,
) -> DataFrame:
    """Pieces of each sequence whose cost exceeds ``limit``.

    ``items`` is an array of structs with node_id, frame_index, token_cost and embedding.  Columns: key,
    piece, first_index, last_index, n_items, cost, cut.  A gap is a boundary if its block similarity is below
    ``threshold``, or, with ``threshold=None``, if it is a valley at least ``min_depth`` deep.  Items go by
    (frame_index, node_id); repeated items and repeated rows count once.  NULL or NaN costs count as
    ``default_cost``, negative ones as 0; items with a NULL frame_index are left out; a NULL or empty array gives no row.
    """
    slim = df.where(F.col(key).isNotNull()).select(
        F.col(key).cast("bigint").alias("key"), F.col(f"{items}.frame_index").cast("array<bigint>").alias("idx"),
        F.col(f"{items}.node_id").cast("array<bigint>").alias("node"), F.col(f"{items}.token_cost").cast("array<double>").alias("cost"),
        F.col(f"{items}.embedding").alias("emb"),
    )
    # most sequences fit: they never leave the JVM (an upper bound, as repeated items are still in it)
    upper = F.aggregate("cost", F.lit(0.0), lambda a, c: a + F.when(c.isNull() | F.isnan(c), F.lit(default_cost)).otherwise(F.greatest(c, F.lit(0.0))))
    slim = slim.where(upper > limit)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out = [[] for _ in range(7)]
            for r in range(batch.num_rows):
                if not batch.column(1)[r].is_valid:
                    continue
                idx = batch.column(1)[r].values.to_numpy(zero_copy_only=False).astype(float)
                node = batch.column(2)[r].values.to_numpy(zero_copy_only=False).astype(float)
                cost = batch.column(3)[r].values.to_numpy(zero_copy_only=False).astype(float)
                x, ok = matrix(batch.column(4)[r].values, dim, "float64")
                order = np.lexsort((node, idx))
                order = order[~np.isnan(idx[order])]
                i, d = idx[order], np.nan_to_num(node[order], nan=-1.0)
                order = order[np.r_[True, (i[1:] != i[:-1]) | (d[1:] != d[:-1])]] if len(order) else order
                if not len(order):
                    continue
                idx, x, ok = idx[order].astype(np.int64), x[order], ok[order]
                c = cost[order]
                c = np.maximum(np.where(np.isnan(c), default_cost, c), 0.0)
                if c.sum() <= limit:
                    continue
                sim = gap_similarity(x, ok, block)
                depth = valley_depth(sim) if threshold is None or choose == "deepest" else sim
                with np.errstate(invalid="ignore"):
                    boundary = sim < threshold if threshold is not None else depth >= min_depth
                for p, (a, b, kind) in enumerate(cut_points(c, boundary, depth, limit, overlap, choose)):
                    if kind == "whole":
                        continue
                    row = (batch.column(0)[r].as_py(), p, int(idx[a]), int(idx[b]), b - a + 1, float(c[a : b + 1].sum()), kind)
                    for o, v in zip(out, row):
                        o.append(v)
            kinds = [pa.int64()] * 5 + [pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, kinds)], ["key", "piece", "first_index", "last_index", "n_items", "cost", "cut"])

    pieces = slim.mapInArrow(run, "key bigint, piece bigint, first_index bigint, last_index bigint, n_items bigint, cost double, cut string")
    return pieces.dropDuplicates(["key", "piece", "first_index", "last_index"]).withColumnRenamed("key", key)
