"""Rolling operators over each video's candidates, computed in chunks with a look-back halo.

A window over a whole video would sort a hot video in one task; chunks of positions with the rows before them as
context give the same values from many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspark.functions.vectors import clip_norm, ewma
from reelspark.operators.ordering import by_chunk, group_bounds, stream_groups, tasks, with_halo, with_positions

PERCENTILE_WINDOW = 120
CHUNK = 4096


def chunked(df: DataFrame, order: list[str], bucket: Column, halo: int, key: str = "video_id", chunk: int = CHUNK):
    """(rows with ``pos``, ``chunk`` and ``core``, window spec by position); keep ``core`` rows after use."""
    placed = with_positions(df, key, order, bucket)
    return with_halo(placed, "pos", chunk, halo), Window.partitionBy(key, "chunk").orderBy("pos")


def floor_percentiles(x, ends, n: int, shares: tuple[float, ...]):
    """For each end the elements at floor(share (m - 1)) of the sorted last m <= n values up to it."""
    import numpy as np

    pad = np.concatenate([np.full(n - 1, np.inf), x])  # missing values sort behind the others
    out = np.empty((len(shares), len(ends)))
    for s in range(0, len(ends), 8192):
        e = ends[s : s + 8192]
        window = np.sort(np.lib.stride_tricks.sliding_window_view(pad, n)[e], axis=1)
        m = np.minimum(e + 1, n)
        for k, share in enumerate(shares):
            out[k, s : s + 8192] = window[np.arange(len(e)), np.floor(share * (m - 1)).astype(int)]
    return out


def rolling_percentiles(candidates: DataFrame, values: list[str], n: int = PERCENTILE_WINDOW) -> DataFrame:
    """Adds <value>_p25 and <value>_p75 of the last ``n`` candidate values up to the end of each candidate's slot.

    Candidates count once per slot that holds them; all of a slot's candidates enter before any is scored.  A window is
    sorted once per slot; built-in window lists would carry and sort ``n`` values with every row.  Columns must be scalars.
    """
    rows, _ = chunked(candidates, ["slot", "ts", "frame_idx"], F.floor(F.col("slot") / 1024).cast("bigint"), n + 63)
    new = [f"{v}_{p}" for v in values for p in ("p25", "p75")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in candidates.schema.fields) + "".join(f", `{c}` double" for c in new)
    keep = candidates.columns

    def run(batches):
        import numpy as np
        import pandas as pd

        for pdf in stream_groups(batches, ["video_id", "chunk"]):
            bounds = group_bounds(pdf, ["video_id", "chunk"])
            slot, core = pdf["slot"].to_numpy(), pdf["core"].to_numpy(dtype=bool)
            cols = {v: pdf[v].to_numpy(dtype=float) for v in values}
            got = {c: np.empty(len(pdf)) for c in new}
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                ends = np.append(np.flatnonzero(slot[lo : hi - 1] != slot[lo + 1 : hi]), hi - lo - 1)
                at = np.searchsorted(ends, np.arange(hi - lo))
                for v in values:
                    p25, p75 = floor_percentiles(cols[v][lo:hi], ends, n, (0.25, 0.75))
                    got[f"{v}_p25"][lo:hi], got[f"{v}_p75"][lo:hi] = p25[at], p75[at]
            yield pd.concat([pdf[keep], pd.DataFrame(got)], axis=1)[core]

    return by_chunk(rows, ["video_id", "chunk"], ["pos"]).select(*keep, "chunk", "core").mapInPandas(run, schema)


def normalised(candidates: DataFrame, names: dict[str, str], n: int = PERCENTILE_WINDOW, eps: float = 1e-5) -> DataFrame:
    """Adds each value (column -> new name) clip-normalised by its rolling percentiles: the sharpness and motion terms."""
    out = rolling_percentiles(candidates, list(names), n)
    for v, name in names.items():
        out = out.withColumn(name, clip_norm(F.col(v), F.col(f"{v}_p25"), F.col(f"{v}_p75"), eps)).drop(f"{v}_p25", f"{v}_p75")
    return out


def ewma_scalar(frames: DataFrame, value: str, alpha: float = 0.3, order: str = "frame_idx", memory: int = 128) -> DataFrame:
    """Adds ``ewma`` along each video.  Values more than ``memory`` rows back weigh below (1 - alpha)^memory (1e-20)."""
    rows, w = chunked(frames, [order], F.floor(F.col(order) / CHUNK).cast("bigint"), memory)
    return rows.withColumn("ewma", ewma(F.collect_list(value).over(w.rowsBetween(-(memory - 1), 0)), alpha)).where("core").drop("chunk", "core", "pos", "last_pos")


def ewma_vector(frames: DataFrame, vector: str, alpha: float = 0.3, order: str = "frame_idx", memory: int = 128) -> DataFrame:
    """(video_id, order, ewma vector) along each video, chunk by chunk."""
    rows, _ = chunked(frames.select("video_id", order, vector), [order], F.floor(F.col(order) / CHUNK).cast("bigint"), memory, chunk=1024)

    def run(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("pos")
        x = np.stack(pdf[vector].to_numpy())
        out = np.empty_like(x)
        s = x[0]
        for i, v in enumerate(x):
            s = v if i == 0 else alpha * v + (1 - alpha) * s
            out[i] = s
        keep = pdf["core"].to_numpy(dtype=bool)
        return pd.DataFrame({"video_id": pdf["video_id"][keep], order: pdf[order][keep], "ewma": out[keep].tolist()})

    return rows.repartition(tasks(rows.sparkSession), "video_id", "chunk").groupBy("video_id", "chunk").applyInPandas(run, f"video_id bigint, {order} bigint, ewma array<double>")


def topk_novelty(frames: DataFrame, vector: str, k: int = 5, order: str = "frame_idx", block: int = 16_384) -> DataFrame:
    """(video_id, order, novelty): max(0, 1 - mean of the k largest inner products with the video's earlier unit vectors).

    The first frame has novelty 1.  Exact, so the work is quadratic in a video: blocks of frames meet the blocks before them as
    matrix products, each pair of blocks yields k products a frame, and these short lists are merged.  A vector travels once
    for each block of its video; blocks are large so that these are few, and are multiplied a thousand rows at a time.
    """
    placed = with_positions(frames.select("video_id", order, vector), "video_id", [order], F.floor(F.col(order) / CHUNK).cast("bigint"))
    own = F.floor(F.col("pos") / block).cast("int")
    last = F.floor(F.col("last_pos") / block).cast("int")
    placed = placed.withColumn("own", own).withColumn("last", last)
    asks = placed.withColumn("bank", F.explode(F.sequence(F.lit(0), F.col("own")))).select("video_id", F.col("own").alias("ask"), "bank", "pos", order, vector, F.lit(True).alias("q"))
    banks = placed.withColumn("ask", F.explode(F.sequence(F.col("own"), F.col("last")))).select("video_id", "ask", F.col("own").alias("bank"), "pos", order, vector, F.lit(False).alias("q"))

    def run(pdf):
        import numpy as np
        import pandas as pd

        x = np.stack(pdf[vector].to_numpy())
        x = x / (np.sqrt((x * x).sum(1)) + 1e-8)[:, None]
        q, pos, idx = pdf["q"].to_numpy(dtype=bool), pdf["pos"].to_numpy(), pdf[order].to_numpy()
        asked, bank, asked_pos, bank_pos = x[q], x[~q], pos[q], pos[~q]
        m = min(k, len(bank))
        top = np.empty((len(asked), m))
        for a in range(0, len(asked), 1024):
            s = asked[a : a + 1024] @ bank.T
            s[bank_pos[None] >= asked_pos[a : a + 1024, None]] = -np.inf
            top[a : a + 1024] = -np.sort(np.partition(-s, m - 1, axis=1)[:, :m], axis=1)
        keep = np.isfinite(top)
        r, _ = np.nonzero(keep)
        first = pos[q] == 0
        vid = pdf["video_id"].iloc[0]
        a = pd.DataFrame({"video_id": vid, order: idx[q][r], "sim": top[keep]})
        b = pd.DataFrame({"video_id": vid, order: idx[q][first], "sim": np.nan})
        return pd.concat([a, b], ignore_index=True) if first.any() else a

    both = asks.unionByName(banks)
    short = both.repartition(tasks(both.sparkSession), "video_id", "ask", "bank").groupBy("video_id", "ask", "bank").applyInPandas(run, f"video_id bigint, {order} bigint, sim double")
    best = F.slice(F.sort_array(F.collect_list(F.when(~F.isnan("sim"), F.col("sim"))), False), 1, k)
    merged = short.groupBy("video_id", order).agg(best.alias("top"))
    mean = F.aggregate("top", F.lit(0.0), lambda s, x: s + x) / F.size("top")
    return merged.select("video_id", order, F.when(F.size("top") == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - mean)).alias("novelty"))
