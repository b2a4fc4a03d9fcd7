"""Irregular readings onto a regular grid: continuous-time Kalman smoother per source.

State: level and trend of each value (integrated Wiener process plus a little level noise), observed at the
readings' own times.  A forward filter and a Rauch-Tung-Striebel pass run over the readings; the state at a
grid time follows in closed form from the filtered state before it and the smoothed state after it, so long gaps
cost no sequential steps.  Sources are cut into chunks of readings with a halo on both sides: the smoother
forgets readings that far away, and a hot source is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.operators.ordering import by_chunk, group_bounds, stream_groups, with_halo, with_positions

STRIDE = 0.04166666666
WINDOW = 0.08333333333


def smooth(t, y, r, q, q0):
    """t[n, m] times, y[n, m] readings (NaN: none), r, q, q0[n]: noise of reading, trend, level.

    Returns filtered (level, trend, P00, P01, P11) and smoothed ones, each [n, m].
    """
    import numpy as np

    n, m = t.shape
    seen = ~np.isnan(y)
    first = np.where(seen.any(1), seen.argmax(1), 0)
    x0 = np.nan_to_num(y[np.arange(n), first])
    big = 1e4 * r + 1e-6
    L, T = x0.copy(), np.zeros(n)
    a, b, c = big.copy(), np.zeros(n), q * 100 + 1e-9
    fl, pr = np.empty((m, 5, n)), np.empty((m, 5, n))
    for i in range(m):
        if i:
            d = np.maximum(t[:, i] - t[:, i - 1], 0.0)
            L = L + d * T
            a, b, c = a + 2 * d * b + d * d * c + q * d**3 / 3 + q0 * d, b + d * c + q * d * d / 2, c + q * d
        pr[i] = L, T, a, b, c
        s = a + r
        k0, k1 = a / s, b / s
        e = np.where(seen[:, i], np.nan_to_num(y[:, i]) - L, 0.0)
        w = seen[:, i]
        L, T = L + k0 * e, T + k1 * e
        a, b, c = np.where(w, a - k0 * a, a), np.where(w, b - k0 * b, b), np.where(w, c - k1 * b, c)
        fl[i] = L, T, a, b, c
    sm = np.empty((m, 5, n))
    sm[m - 1] = fl[m - 1]
    for i in range(m - 2, -1, -1):
        sm[i] = back(fl[i], pr[i + 1], sm[i + 1], np.maximum(t[:, i + 1] - t[:, i], 0.0))
    return fl, sm


def back(f, p, s, d):
    """State before, given its filtered moments f, the prediction p and smoothed moments s a time d later."""
    import numpy as np

    L, T, a, b, c = f
    # cross covariance of the state with the later one: P F'
    g00, g01, g10, g11 = a + d * b, b, b + d * c, c
    det = p[2] * p[4] - p[3] * p[3]
    det = np.where(np.abs(det) < 1e-300, 1e-300, det)
    i00, i01, i11 = p[4] / det, -p[3] / det, p[2] / det
    k00, k01 = g00 * i00 + g01 * i01, g00 * i01 + g01 * i11
    k10, k11 = g10 * i00 + g11 * i01, g10 * i01 + g11 * i11
    dl, dt = s[0] - p[0], s[1] - p[1]
    da, db, dc = s[2] - p[2], s[3] - p[3], s[4] - p[4]
    u00, u01 = k00 * da + k01 * db, k00 * db + k01 * dc
    u10, u11 = k10 * da + k11 * db, k10 * db + k11 * dc
    return np.array(
        [
            L + k00 * dl + k01 * dt,
            T + k10 * dl + k11 * dt,
            np.maximum(a + u00 * k00 + u01 * k01, 0.0),
            b + u00 * k10 + u01 * k11,
            np.maximum(c + u10 * k10 + u11 * k11, 0.0),
        ]
    )


def noise(step):
    """Variance of the readings' noise and of trend and level steps, from the source's median step between neighbouring readings."""
    import numpy as np

    scale = np.maximum(np.where(np.isfinite(step), step, 1.0) / 0.9539, 1e-6)  # median of |N(0, 2 sd^2)| is 0.9539 sd
    return scale**2, 0.5 * scale**2, 0.5 * scale**2


def regular_grid(
    df: DataFrame,
    source: str,
    ts: str,
    values: dict[str, tuple[float, float]],
    stride: float = STRIDE,
    window: float = WINDOW,
    chunk: int = 1024,
    halo: int = 48,
) -> DataFrame:
    """One row per source and slot between its first and last slot that hold a reading.

    Slot k >= 0 has the target k * stride and holds the readings with target - window/2 <= ts < target + window/2.
    Columns: source, slot, target_timestamp, is_synthetic (no reading in the slot) and for each of ``values``
    (column -> lowest and highest possible value) <value>_est and <value>_sd at the target.

    Readings with NULL, NaN or negative ``ts``, or one of 1e15 s or more, are in no slot.  Readings at the same time count as one
    (their mean), so repeated rows change nothing.  Impossible values are taken as missing; a source without any
    value gets NULL estimates but keeps its slots.  A NULL source is a source of its own.  Empty in, empty out.
    """
    names = list(values)
    t = F.col(ts).cast("double")
    slim = df.select(F.col(source).alias("src"), t.alias("t"), *[F.col(v).cast("double").alias(f"v_{i}") for i, v in enumerate(names)])
    slim = slim.where(F.col("t").isNotNull() & ~F.isnan("t") & (F.col("t") >= 0) & (F.col("t") < F.lit(1e15)))
    good = [
        F.avg(F.when(~F.isnan(f"v_{i}") & F.col(f"v_{i}").between(*map(float, values[v])), F.col(f"v_{i}"))).alias(f"v_{i}")
        for i, v in enumerate(names)
    ]
    obs = slim.groupBy("src", "t").agg(*good)
    vs = [f"v_{i}" for i in range(len(names))]
    placed = with_positions(obs, "src", ["t"], F.floor(F.col("t") / 64.0).cast("bigint"), before=tuple(vs))
    # the noise is the source's, whatever its chunks: partial aggregates, one row a source
    steps = placed.groupBy(F.col("src").alias("_src")).agg(*[F.percentile_approx(F.abs(F.col(v) - F.col(f"before_{v}")), 0.5, 10000).alias(f"step_{v}") for v in vs])
    placed = placed.drop(*[f"before_{v}" for v in vs]).join(steps, F.col("src").eqNullSafe(F.col("_src"))).drop("_src")
    chunks = by_chunk(with_halo(placed, "pos", chunk, halo), ["src", "chunk"], ["pos"])
    est = "".join(f", `{v}_est` double, `{v}_sd` double" for v in names)
    out = f"{source} bigint, slot bigint, target_timestamp double, is_synthetic boolean{est}"
    half = window / 2

    def run(batches):
        import numpy as np
        import pandas as pd

        for pdf in stream_groups(batches, ["src", "chunk"], 32 * chunk):
            b = group_bounds(pdf, ["src", "chunk"])
            n, m = len(b) - 1, int(np.diff(b).max())
            size = np.diff(b)
            row = np.repeat(np.arange(n), size)
            col = np.arange(len(pdf)) - np.repeat(b[:-1], size)
            tt = pdf["t"].to_numpy(dtype=float)
            T = np.repeat(tt[b[1:] - 1][:, None], m, 1)  # padding: no time passes after the last reading
            T[row, col] = tt
            fits = []
            for i in range(len(names)):
                Y = np.full((n, m), np.nan)
                Y[row, col] = pdf[f"v_{i}"].to_numpy(dtype=float, na_value=np.nan)
                r, q, q0 = noise(pdf[f"step_v_{i}"].to_numpy(dtype=float, na_value=np.nan)[b[:-1]])
                fits.append((*smooth(T, Y, r, q, q0), q, q0, ~np.isnan(Y).all(1)))
            core, pos, last = pdf["core"].to_numpy(dtype=bool), pdf["pos"].to_numpy(), pdf["last_pos"].to_numpy()
            for g in range(n):
                lo, hi = b[g], b[g + 1]
                own = np.flatnonzero(core[lo:hi])
                if not len(own):
                    continue
                times = tt[lo:hi]
                # the grid times from this chunk's first reading to the next chunk's first belong to it
                i0, i1 = own[0], own[-1]
                first_of_all, last_of_all = pos[lo + i0] == 0, pos[lo + i1] == last[lo + i1]
                k0 = int(max(0, np.floor((times[i0] - half) / stride) - 2 if first_of_all else np.floor(times[i0] / stride) - 1))
                k1 = int(np.floor((times[i1] + half) / stride) + 2 if last_of_all else np.ceil(times[i1 + 1] / stride) + 1)
                for s0 in range(k0, k1 + 1, 65536):
                    k = np.arange(s0, min(s0 + 65536, k1 + 1), dtype=np.int64)
                    target = k * stride
                    a = np.searchsorted(times, target - half, "left")
                    z = np.searchsorted(times, target + half, "left")
                    filled = z > a
                    mine = np.ones(len(k), bool)
                    if first_of_all:
                        mine &= (target + half) > times[i0]
                    else:
                        mine &= target >= times[i0]
                    if last_of_all:
                        mine &= (target - half) <= times[i1]
                    else:
                        mine &= target < times[i1 + 1]
                    if not mine.any():
                        continue
                    k, target, filled = k[mine], target[mine], filled[mine]
                    res = {source: pdf["src"].iloc[lo], "slot": k, "target_timestamp": target, "is_synthetic": ~filled}
                    j = np.searchsorted(times, target, "right") - 1
                    for name, (fl, sm, q, q0, any_value) in zip(names, fits):
                        mean, var = at_times(times, j, target, fl[:, :, g], sm[:, :, g], q[g], q0[g], hi - lo)
                        if not any_value[g]:
                            mean, var = np.full(len(k), np.nan), np.full(len(k), np.nan)
                        res[f"{name}_est"], res[f"{name}_sd"] = mean, np.sqrt(var)
                    frame = pd.DataFrame(res)
                    if pd.isna(res[source]):
                        frame[source] = pd.array([None] * len(frame), dtype="Int64")
                    yield frame

    def at_times(times, j, target, fl, sm, q, q0, m):
        import numpy as np

        def ahead(f, d):
            L, T_, a, b, c = f
            return np.array([L + d * T_, T_, a + 2 * d * b + d * d * c + q * d**3 / 3 + q0 * d, b + d * c + q * d * d / 2, c + q * d])

        # before the first reading the state is drawn back from it, after the last one carried on
        lo, hi = np.clip(j, 0, m - 1), np.clip(j + 1, 0, m - 1)
        here = ahead(fl[lo].T, np.maximum(target - times[lo], 0.0))
        d = np.maximum(times[hi] - target, 0.0)
        state = back(here, ahead(here, d), sm[hi].T, d)
        tail, front = j >= m - 1, j < 0
        mean = np.where(tail, here[0], state[0])
        var = np.where(tail, here[2], state[2])
        if front.any():
            d0 = times[0] - target
            mean = np.where(front, sm[0, 0] - d0 * sm[0, 1], mean)
            var = np.where(front, sm[0, 2] - 2 * d0 * sm[0, 3] + d0**2 * sm[0, 4] + q * np.abs(d0) ** 3 / 3 + q0 * np.abs(d0), var)
        return mean, np.maximum(var, 0.0)

    # slots at the edge of the first window can lie outside it only by rounding; the exact test above holds
    return chunks.select("src", "chunk", "pos", "core", "t", "last_pos", *vs, *[f"step_{v}" for v in vs]).mapInPandas(run, out)
