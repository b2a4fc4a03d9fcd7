"""Candidate scoring: the terms that do not depend on earlier choices, and the composite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.functions.vectors import TINY, sigmoid_gate
from reelspark.operators.ordering import group_bounds, spread, stream_groups

# fixed values: default weights of the score terms
WEIGHTS = {"semantic": 1.0, "blur": 0.5, "motion": 0.8, "entity": 0.4, "consistency": 0.3, "diversity": 0.2}


def normalise_weights(weights: dict[str, float] | None = None) -> dict[str, float]:
    """Weights that sum to one; an empty dict means the defaults, keys that are not given weigh 0."""
    w = dict(weights) if weights else WEIGHTS
    total = sum(w.values())
    return {k: w.get(k, 0.0) / total for k in WEIGHTS}


def composite(n: Column, q: Column, m: Column, e: Column, c: Column, d: Column, tau: Column, temperature: Column, weights=None) -> dict[str, Column]:
    """The score map's columns: semantic, blur, motion, entity, consistency, diversity, gate, total."""
    w = normalise_weights(weights)
    gate = sigmoid_gate(n, tau, temperature)
    shared = w["motion"] * m + w["entity"] * e
    sem, blur = w["semantic"] * n + shared, w["blur"] * q + shared
    total = gate * sem + (1 - gate) * blur - (w["consistency"] * c + w["diversity"] * d)
    return {"semantic": sem, "blur": blur, "motion": m, "entity": e, "consistency": c, "diversity": d, "gate": gate, "total": total}


def _slot_products(candidates: DataFrame, vector: str, work, schema: str) -> DataFrame:
    """One shuffle of the candidates by (video, 64 slots); ``work(rows, unit, usable, sims)`` gets the slots of one size at a time.

    rows [slots, size] are positions in the frame, sims [slots, size, size] the cosines of each slot's candidates, in pieces of
    bounded size where a slot is large: then rows holds one slot and sims some of its rows, from ``first`` on.
    """
    slim = candidates.select("video_id", "slot", "frame_idx", F.col(vector).cast("array<double>").alias("v"))
    parts = spread(slim, "video_id", F.floor(F.col("slot") / 64)).sortWithinPartitions("video_id", "slot", "frame_idx")

    def run(batches):
        import numpy as np

        for pdf in stream_groups(batches, ["video_id", "slot"], 16384):
            b = group_bounds(pdf, ["video_id", "slot"])
            dim = next((len(v) for v in pdf["v"] if v is not None), 0)
            x = np.stack([np.zeros(dim) if v is None else v for v in pdf["v"]])
            size = np.sqrt((x * x).sum(1))
            usable = size >= TINY
            unit = np.where(usable[:, None], x / np.maximum(size, 1e-300)[:, None], 0.0)
            n = np.diff(b)
            for m in np.unique(n):
                starts = b[:-1][n == m]
                step = max(1, 4_000_000 // (m * m))
                for s in range(0, len(starts), step):
                    rows = starts[s : s + step][:, None] + np.arange(m)
                    if m <= 2000:
                        yield from work(pdf, rows, 0, usable, np.einsum("gid,gjd->gij", unit[rows], unit[rows]))
                    else:
                        for f in range(0, m, 1000):
                            yield from work(pdf, rows, f, usable, (unit[rows[0, f : f + 1000]] @ unit[rows[0]].T)[None])

    return parts.mapInPandas(run, schema)


def cosine_matrix(candidates: DataFrame, vector: str) -> DataFrame:
    """(video_id, slot, frame_idx, other_idx, similarity): the cosine matrix of each slot's vectors, diagonal included.

    Zero and missing vectors have 0 with everything, themselves too.  A slot spans two strides, so its matrix is small.
    """

    def work(pdf, rows, first, usable, sims):
        import numpy as np
        import pandas as pd

        vid, slot, idx = (pdf[c].to_numpy() for c in ("video_id", "slot", "frame_idx"))
        g, i, j = (a.ravel() for a in np.indices(sims.shape))
        at, other = rows[g, i + first], rows[g, j]
        yield pd.DataFrame({"video_id": vid[at], "slot": slot[at], "frame_idx": idx[at], "other_idx": idx[other], "similarity": sims.ravel()})

    return _slot_products(candidates, vector, work, "video_id bigint, slot bigint, frame_idx bigint, other_idx bigint, similarity double")


def diversity(candidates: DataFrame, vector: str) -> DataFrame:
    """(video_id, slot, frame_idx, d_val): greatest similarity to another candidate, in slots of three or more, else 0.

    Similarity is 1 - cosine_distance, so a zero or missing vector is like anything.
    """

    def work(pdf, rows, first, usable, sims):
        import numpy as np
        import pandas as pd

        vid, slot, idx = (pdf[c].to_numpy() for c in ("video_id", "slot", "frame_idx"))
        at = rows[:, first : first + sims.shape[1]]
        most = np.zeros(at.shape)
        if rows.shape[1] >= 3:
            sims = np.where(usable[at][:, :, None] & usable[rows][:, None, :], sims, 1.0)
            own = np.arange(sims.shape[1])
            sims[:, own, own + first] = -np.inf
            most = sims.max(2)
        at = at.ravel()
        yield pd.DataFrame({"video_id": vid[at], "slot": slot[at], "frame_idx": idx[at], "d_val": most.ravel()})

    return _slot_products(candidates, vector, work, "video_id bigint, slot bigint, frame_idx bigint, d_val double")


def argmax_select(scored: DataFrame, total: str) -> DataFrame:
    """(video_id, slot, frame_idx, best): the highest score of each slot, the earliest of equals; NaN never wins."""
    ok = scored.where(F.col(total).isNotNull() & ~F.isnan(total))
    return ok.groupBy("video_id", "slot").agg(
        F.max_by("frame_idx", F.struct(total, (-F.col("ts")).alias("t"), (-F.col("frame_idx")).alias("i"))).alias("frame_idx"), F.max(total).alias("best")
    )
