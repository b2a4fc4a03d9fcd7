"""Streaming selection: the batch selector as a keyed stateful operator.

Rows arrive in micro-batches; the state of a video (its pending frames, trackers and next slot) is kept between them.
Inside a micro-batch rows are sorted by (ts, frame_idx), so "last pushed" is the greatest time of the batch: the one
intended difference for out-of-order input.  Late frames, older than the open slot's window, are dropped and counted.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left, bisect_right
from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.operators.regrid import STRIDE, WINDOW
from reelspark.operators.select import Selector, clip_norm, detections, distances, floor_pct, pairs

OUT = "video_id bigint, slot bigint, frame_idx bigint, native_timestamp double, is_synthetic boolean, total double, late bigint"
STATE = "blob binary"


class Engine:
    """One video: a buffer of frames in order of time, of which each slot takes the stretch that its window covers."""

    def __init__(self, clip_dim: int = 64, dino_dim: int = 16, window: int = 120):
        self.selector = Selector(clip_dim, dino_dim)
        self.times: list[tuple[float, int]] = []  # (ts, frame_idx) of the buffered frames, in order, and the frames
        self.frames: list[tuple] = []
        self.sharp: deque = deque(maxlen=window)
        self.moving: deque = deque(maxlen=window)
        self.slot, self.late = 0, 0

    def opens(self) -> float:
        return self.slot * STRIDE - WINDOW / 2

    def push(self, frame: tuple) -> list[tuple]:
        """frame: (frame_idx, ts, clip, dino, blur, flow, entities); closed slots as (slot, frame_idx, ts, synthetic, total, late).

        A frame before the open slot's window comes too late for any slot: it is counted and dropped.
        """
        at = (frame[1], frame[0])
        if at[0] < self.opens():
            self.late += 1
            return []
        place = bisect_right(self.times, at)
        self.times.insert(place, at)
        self.frames.insert(place, frame)
        out = []
        while at[0] >= self.slot * STRIDE + WINDOW / 2:
            out.append((self.slot, *self._choose(self.frames[: bisect_left(self.times, (self.slot * STRIDE + WINDOW / 2,))]), self.late))
            self.slot += 1
            gone = bisect_left(self.times, (self.opens(),))
            del self.times[:gone], self.frames[:gone]
        return out

    def _choose(self, inside: list[tuple]) -> tuple:
        import numpy as np

        if not inside:
            self.selector.empty()
            return None, None, True, None
        idx, ts, clip, dino, blur, flow, entities = zip(*inside)
        hats = []
        for seen, values in ((self.sharp, blur), (self.moving, flow)):
            seen.extend(values)
            low, high = floor_pct(seen, 0.25), floor_pct(seen, 0.75)
            hats.append([clip_norm(v, low, high) for v in values])
        x = np.stack(clip)
        alike = [0.0] * len(x)
        if len(x) >= 3:
            near = np.stack([1.0 - distances(x, v) for v in x])
            np.fill_diagonal(near, -np.inf)
            alike = near.max(1).tolist()
        i, scores = self.selector.select(x, np.stack(dino), *hats, alike, entities)
        return idx[i], ts[i], False, float(scores[-1])


def select_stream(frames: DataFrame, clip_dim: int = 64, dino_dim: int = 16) -> DataFrame:
    """Closed slots of a stream of frames (video_id, frame_idx, ts, blur, flow, clip_emb, dino_emb, entities).

    Works on streaming frames with ``outputMode('append')`` and on batch frames alike.
    """
    kind, box = detections(F.col("entities"))
    rows = frames.select("video_id", "frame_idx", "ts", "blur", "flow", "clip_emb", "dino_emb", kind.alias("kind"), box.alias("box"))

    def step(key, batches, state):
        import numpy as np
        import pandas as pd

        engine = pickle.loads(state.get[0]) if state.exists else Engine(clip_dim, dino_dim)
        pdf = pd.concat(list(batches), ignore_index=True).sort_values(["ts", "frame_idx"])
        out = []
        for r in pdf.itertuples(index=False):
            dino = np.zeros(dino_dim) if r.dino_emb is None else np.asarray(r.dino_emb, float)
            ents = pairs(r.kind, r.box)
            out += engine.push((r.frame_idx, r.ts, np.asarray(r.clip_emb, float), dino, r.blur, r.flow, ents))
        state.update((pickle.dumps(engine),))
        frame = pd.DataFrame(out, columns=["slot", "frame_idx", "native_timestamp", "is_synthetic", "total", "late"])
        frame.insert(0, "video_id", key[0])
        frame["frame_idx"] = frame["frame_idx"].astype("Int64")
        yield frame

    return rows.groupBy("video_id").applyInPandasWithState(step, OUT, STATE, "append", "NoTimeout")
