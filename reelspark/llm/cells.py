"""Vector cells: a bounded sample trains centres, every vector is then placed in all cells near it.

Vectors that are similar share a cell with high probability, because a vector goes not only to its nearest
centre but to every centre whose cosine is within the best one's ``slack`` of the best.  The slack is set on the sample so that
a row is placed about ``copies`` times on average, whatever the number of centres: the shuffle grows as the rows.  The number of
centres grows with the collection, so a cell keeps its size; centres follow density, so a region that holds a third of all
rows gets a third of the centres.  Its gaps are tiny, so every centre has at least the slack that the rows around it need.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.functions.arrow_vectors import matrix, unit

SAMPLE_ROWS = 32_768  # bound of what the driver holds: 32 768 x 64 doubles are 16 MB
AROUND = 64  # held-out rows around a centre that its slack is read from
MAX_CELLS = 4_096  # bound of the broadcast centres: 4 096 x 64 floats are 1 MB


@dataclass
class Cells:
    centres: object  # float32 [k, dim], unit rows
    slack: object  # float32 [k]
    most: int

    def place(self, x):
        """(row, cell) for every cell within the ``slack`` of a row's best one, at most ``most`` of them."""
        import numpy as np

        rows, cells = [], []
        for s in range(0, len(x), 2048):
            sim = x[s : s + 2048] @ self.centres.T
            near = sim >= (sim.max(1) - self.slack[sim.argmax(1)])[:, None]
            many = np.flatnonzero(near.sum(1) > self.most)
            if len(many):
                top = np.argpartition(-sim[many], self.most - 1, axis=1)[:, : self.most]
                near[many] = False
                near[many[:, None], top] = True
            r, c = np.nonzero(near)
            rows.append(r + s)
            cells.append(c)
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(rows), np.concatenate(cells)


def vector_length(df: DataFrame, vector: str) -> int:
    """The number of elements of all vectors that are not NULL or empty; vectors of different lengths raise an error; 1 if there are none."""
    low, high = df.where(F.size(vector) > 0).agg(F.min(F.size(vector)), F.max(F.size(vector))).first()
    if low != high:
        raise ValueError(f"{vector} holds vectors of {low} to {high} elements")
    return low or 1


def bounded_sample(df: DataFrame, row_id: str, vector: str, n: int, dim: int, size: int = SAMPLE_ROWS, seed: int = 7):
    """Usable vectors of about ``size`` of the ``n`` rows, drawn by a hash of their id: the same ones however the files lie.

    Each id is drawn on its own, so the number drawn stays within a few times sqrt(size) of ``size`` whatever the rows hold.
    """
    import numpy as np
    import pyarrow.compute as pc

    share = min(1.0, size / max(n, 1))
    lot = F.pmod(F.xxhash64(row_id, F.lit(seed)), F.lit(1 << 31))
    drawn = df.where(F.col(row_id).isNotNull() & F.col(vector).isNotNull() & (lot < int(share * (1 << 31))))
    got = drawn.select(F.col(row_id).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).toArrow()
    got = got.take(pc.sort_indices(got, [("id", "ascending")]))
    x, ok = matrix(got.column("v"), dim, "float64")
    ids = got.column("id").to_numpy()
    first = np.r_[True, ids[1:] != ids[:-1]] if len(ids) else np.zeros(0, bool)
    return x[ok & first]


def train_centres(x, k: int, rounds: int = 6, seed: int = 7):
    """Spherical k-means on the sample; float32 [<= k, dim]."""
    import numpy as np

    x = unit(x.astype(np.float32))
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    if len(distinct) <= k:
        return distinct
    c = distinct[rng.choice(len(distinct), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([(x[s : s + 4096] @ c.T).argmax(1) for s in range(0, len(x), 4096)])
        order = np.argsort(near, kind="stable")
        n = np.bincount(near, minlength=k)
        starts = np.r_[0, np.cumsum(n)[:-1]]
        full = n > 0
        total = np.zeros_like(c)
        total[full] = np.add.reduceat(x[order], starts[full], axis=0)
        if (~full).any():
            total[~full] = distinct[rng.choice(len(distinct), int((~full).sum()))]
        c = unit(total)
    return c


def cell_count(n: int, per_cell: int, sample: int) -> int:
    return int(max(1, min(MAX_CELLS, n // per_cell, max(1, sample // 8))))


def make_cells(x, n: int, per_cell: int, copies: float, most: int) -> Cells:
    """Cells for ``n`` rows from the sample x (unit rows), with the slack that places a row ``copies`` times on average.

    The slack is at least that over all rows, and at least that over the ``AROUND`` rows nearest to the centre: a dense
    region, which uses up the average with its small gaps, takes nothing from the others.

    An eighth of the sample is kept from training: rows that made the centres lie nearer to them than others do.
    """
    import numpy as np

    x = x.astype(np.float32)
    held = np.arange(len(x)) % 8 == 0
    learn, test = (x[~held], x[held]) if len(x) >= 64 else (x, x)
    centres = train_centres(learn, cell_count(n, per_cell, len(learn)))
    some = test @ centres.T
    k = min(most, some.shape[1])
    top = -np.sort(np.partition(-some, k - 1, axis=1)[:, :k], axis=1)
    gaps = np.sort((top[:, :1] - top[:, 1:]).ravel())
    place = int((copies - 1) * len(some))
    slack = np.full(len(centres), gaps[place] if place < len(gaps) else 2.1, np.float32)
    if len(some) > AROUND and place < len(gaps):
        near = np.argpartition(-some, AROUND - 1, axis=0)[:AROUND].T
        own = np.sort((top[:, :1] - top[:, 1:])[near].reshape(len(centres), -1), axis=1)
        slack = np.maximum(slack, own[:, int((copies - 1) * AROUND)])
    return Cells(centres, slack, most)
