"""Frame selection: the sequential part of the engine, one state machine per video.

``Selector`` scores a slot's candidates against frozen state, commits the winner, and rewrites the recent history when
a short gap closes.  Batch (``select_frames``) and streaming (``reelspark.streaming.select``) run the same class.
"""

from __future__ import annotations

import math
from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.operators.ordering import group_bounds, spread, stream_groups
from reelspark.operators.score import normalise_weights

EPS = 1e-5
BLOCK = 128  # slots whose candidates meet the bank in one matrix product
NAMES = ("semantic", "blur", "motion", "entity", "consistency", "diversity", "gate", "total")


def floor_pct(values, p: float) -> float:
    s = sorted(values)
    return s[int(p * (len(s) - 1))] if s else 0.0


def clip_norm(v: float, p25: float, p75: float, eps: float = EPS) -> float:
    return min(2.0, max(0.0, (v - p25) / ((p75 - p25) + eps)))


def distances(x, v):
    """Cosine distance of each row of x to v; 0 where either is shorter than 1e-8."""
    import numpy as np

    rows, size = np.sqrt((x * x).sum(1)), np.sqrt(v @ v)
    ok = (rows >= 1e-8) & (size >= 1e-8)
    return np.where(ok, 1.0 - (x @ v) / np.where(ok, rows * size, 1.0), 0.0)


def _iou(a, b) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inter = max(0.0, w) * max(0.0, h)
    area = lambda r: max(0.0, r[2] - r[0]) * max(0.0, r[3] - r[1])
    union = area(a) + area(b) - inter
    return inter / (union + 1e-8) if union > 0 else 0.0


def entity_delta(a, b) -> float:
    """Share of unmatched detections; (class_id, bbox) lists, matched greedily in the first list's order."""
    if not a and not b:
        return 0.0
    if not a or not b:
        return 1.0
    free = dict(enumerate(b))
    for cls, box in a:
        overlap = [(-_iou(box, o[1]), j) for j, o in free.items() if o[0] == cls]
        if overlap and -min(overlap)[0] > 0.3:
            free.pop(min(overlap)[1])
    return 1.0 - (len(b) - len(free)) / (max(len(a), len(b)) + EPS)


def _lags():
    import numpy as np

    return np.array([0.6, 0.3, 0.1])  # weights of the structural vectors 1, 5 and 10 slots back


LAGS = _lags()


class Bank:
    """Unit vectors of the winners so far, in a buffer that doubles; with ``cap`` no more are added once so many are held."""

    def __init__(self, dim: int, cap: int | None = None):
        import numpy as np

        self.x, self.n, self.cap = np.empty((256, dim)), 0, cap
        self.ahead = None

    def add(self, v) -> None:
        import numpy as np

        if self.cap is not None and self.n >= self.cap:
            return
        if self.n == len(self.x):
            self.x = np.concatenate([self.x, np.empty_like(self.x)])
        self.x[self.n] = v / (np.sqrt(v @ v) + 1e-8)
        self.n += 1

    def look_ahead(self, q, k: int = 5) -> None:
        """Rows that will be asked about: their ``k`` largest inner products with all that is in the bank now, as matrix products.

        Then :meth:`novelty` of some of them compares only with what was added since.
        """
        import numpy as np

        unit = q / (np.sqrt((q * q).sum(1)) + 1e-8)[:, None]
        best = np.full((len(q), k), -np.inf)
        for s in range(0, self.n, 8192):
            near = unit @ self.x[s : min(s + 8192, self.n)].T
            if near.shape[1] > k:
                near.partition(near.shape[1] - k, axis=1)
            best = np.concatenate([best, near[:, -k:]], axis=1)
            best.partition(best.shape[1] - k, axis=1)
            best = best[:, -k:]
        self.ahead = unit, best, self.n

    def novelty(self, q, k: int = 5, at: slice | None = None):
        """Per row of q: max(0, 1 - mean of the k largest inner products); 1 while the bank is empty.

        ``at``: q is these rows of the last :meth:`look_ahead`.
        """
        import numpy as np

        if not self.n:
            return np.ones(len(q))
        if at is None:
            s = (q / (np.sqrt((q * q).sum(1)) + 1e-8)[:, None]) @ self.x[: self.n].T
        else:
            unit, best, n = self.ahead
            s = np.concatenate([best[at], unit[at] @ self.x[n : self.n].T], axis=1) if self.n > n else best[at].copy()
        m = min(k, self.n)
        if s.shape[1] > m:
            s.partition(s.shape[1] - m, axis=1)
        return np.maximum(0.0, 1.0 - s[:, -m:].sum(1) / m)


class Selector:
    """State of one video: trackers, vector bank, the last ten structural vectors, the open gap."""

    def __init__(self, clip_dim: int, dino_dim: int, weights=None, alpha: float = 0.3, window: int = 120, cap: int | None = None, eps: float = EPS):
        self.eps = eps
        self.clip_dim, self.dino_dim, self.alpha = clip_dim, dino_dim, alpha
        self.w = normalise_weights(weights)
        self.context = self.entity = None
        self.bank = Bank(clip_dim, cap)
        self.novelties: deque = deque(maxlen=window)
        self.history: deque = deque(maxlen=10)
        self.lengths: deque = deque(maxlen=10)  # norms of the history's vectors
        self.previous: list = []
        self.last_real, self.gap = None, 0

    def empty(self) -> None:
        import numpy as np

        self.history.append(np.zeros(self.dino_dim))
        self.lengths.append(0.0)
        self.gap += 1

    def select(self, clip, dino, q_hat, m_hat, d_val, entities, at: slice | None = None):
        """(winner, scores by ``NAMES``) among the candidates (rows in push order); commits the winner.  ``at``: their rows in ``bank.look_ahead``."""
        import numpy as np

        seen = sorted(self.novelties)
        p25, p75 = (seen[int(p * (len(seen) - 1))] for p in (0.25, 0.75)) if seen else (0.0, 0.0)
        temperature = max(p75 - p25, self.eps)
        novel = 0.5 * self.bank.novelty(clip, at=at) + 0.5 * (1.0 if self.context is None else distances(clip, self.context))
        novel = novel.tolist()
        away = [0.0] * len(clip)
        if self.history:
            back = [max(0, len(self.history) - k) for k in (1, 5, 10)]
            size = np.sqrt((dino * dino).sum(1))[:, None] * np.array([self.lengths[j] for j in back])
            dots = dino @ np.stack([self.history[j] for j in back], 1)
            ok = size >= 1e-16
            if ok.any():
                ok &= (np.array([self.lengths[j] for j in back]) >= 1e-8) & (np.sqrt((dino * dino).sum(1)) >= 1e-8)[:, None]
                away = (np.where(ok, 1.0 - dots / np.where(ok, size, 1.0), 0.0) @ LAGS).tolist()
        best = None
        for i in range(len(clip)):
            raw = entity_delta(self.previous, entities[i])
            e = raw if self.entity is None else self.alpha * raw + (1 - self.alpha) * self.entity
            novelty, c = novel[i], away[i]
            n = clip_norm(novelty, p25, p75, self.eps)
            gate = 1 / (1 + math.exp(-min(30.0, max(-30.0, (n - p75) / (temperature + EPS)))))
            shared = self.w["motion"] * m_hat[i] + self.w["entity"] * e
            sem, blur = self.w["semantic"] * n + shared, self.w["blur"] * q_hat[i] + shared
            total = gate * sem + (1 - gate) * blur - (self.w["consistency"] * c + self.w["diversity"] * d_val[i])
            if best is None or total > best[1][-1]:
                best = i, (sem, blur, m_hat[i], e, c, d_val[i], gate, total), novelty, raw
        i, scores, novelty, raw = best
        self.novelties.append(novelty)
        self.entity = raw if self.entity is None else self.alpha * raw + (1 - self.alpha) * self.entity
        self.previous = entities[i]
        self.context = clip[i].copy() if self.context is None else self.alpha * clip[i] + (1 - self.alpha) * self.context
        self.bank.add(clip[i])
        self.history.append(dino[i])
        self.lengths.append(float(np.sqrt(dino[i] @ dino[i])))
        self._close_gap(dino[i])
        return i, scores

    def _close_gap(self, now) -> None:
        # a gap of one or two slots after a real one is filled in the history as it will be in the output
        import numpy as np

        if self.last_real is not None and 1 <= self.gap <= 2:
            n = len(self.history)
            for j in range(1, self.gap + 1):
                a = j / (self.gap + 1.0)
                v = (1 - a) * self.last_real + a * now
                size = np.sqrt(v @ v)
                at = n - 1 - (self.gap + 1 - j)
                if at >= 0:
                    self.history[at] = v / size if size > 1e-8 else v
                    self.lengths[at] = 1.0 if size > 1e-8 else float(size)
        self.last_real, self.gap = now, 0


def select_frames(scored: DataFrame, slots: DataFrame, clip_dim: int = 64, dino_dim: int = 16, weights=None, alpha: float = 0.3, window: int = 120, cap: int | None = None, eps: float = EPS) -> DataFrame:
    """One row per slot: video_id, slot, target_timestamp, frame_idx, native_timestamp, is_synthetic, scores.

    ``scored``: candidates with q_hat, m_hat, d_val, clip_emb, dino_emb and entities; ``slots``: all closed slots.  A video's
    choices depend on all earlier ones, so a video is one group; its rows stream in slot order and only the bank, history and
    trackers are held.  A NULL structural vector counts as zero.  ``cap`` bounds the bank; by default it grows, as novelty means all of it.
    """
    kind, box = detections(F.col("entities"))
    rows = slots.select("video_id", "slot").join(
        scored.select("video_id", "slot", "ts", "frame_idx", "q_hat", "m_hat", "d_val", "clip_emb", "dino_emb", kind.alias("kind"), box.alias("box")), ["video_id", "slot"], "left"
    )
    sorted_rows = spread(rows, "video_id").sortWithinPartitions("video_id", "slot", "ts", "frame_idx")
    schema = "video_id bigint, slot bigint, frame_idx bigint, native_timestamp double, is_synthetic boolean" + "".join(f", s_{n} double" for n in NAMES)

    def run(batches):
        import numpy as np
        import pandas as pd

        names = ["video_id", "slot", "frame_idx", "native_timestamp", "is_synthetic", *[f"s_{n}" for n in NAMES]]
        nothing = (None,) * len(NAMES)
        video, state = None, None
        for pdf in stream_groups(batches, ["video_id", "slot"], 4096):
            bounds = group_bounds(pdf, ["video_id", "slot"])
            vid, slot, ts = pdf["video_id"].to_numpy(), pdf["slot"].to_numpy(), pdf["ts"].to_numpy(dtype=float)
            idx = pdf["frame_idx"].to_numpy(dtype=float, na_value=np.nan)
            real = ~np.isnan(ts)
            clip, dino = np.zeros((len(pdf), clip_dim)), np.zeros((len(pdf), dino_dim))
            if real.any():
                clip[real] = np.stack(pdf["clip_emb"].to_numpy()[real])
            has = pdf["dino_emb"].notna().to_numpy()
            if has.any():
                dino[has] = np.stack(pdf["dino_emb"].to_numpy()[has])
            hats = [pdf[c].to_numpy(dtype=float) for c in ("q_hat", "m_hat", "d_val")]
            kinds, boxes = pdf["kind"].to_numpy(), pdf["box"].to_numpy()
            done = []
            # of a video's rows so many are looked up in the bank at once
            begins = bounds[:-1]
            starts = [0, *(np.flatnonzero(vid[begins[1:]] != vid[begins[:-1]]) + 1).tolist(), len(begins)]
            for v0, v1 in zip(starts[:-1], starts[1:]):
                if vid[begins[v0]] != video:
                    video, state = vid[begins[v0]], Selector(clip_dim, dino_dim, weights, alpha, window, cap, eps)
                for s0 in range(v0, v1, BLOCK):
                    s1 = min(s0 + BLOCK, v1)
                    base, end = bounds[s0], bounds[s1]
                    state.bank.look_ahead(clip[base:end])
                    for s in range(s0, s1):
                        a, b = bounds[s], bounds[s + 1]
                        if not real[a]:
                            state.empty()
                            done.append((video, slot[a], None, None, True, *nothing))
                            continue
                        ents = [pairs(kinds[i], boxes[i]) for i in range(a, b)]
                        i, scores = state.select(clip[a:b], dino[a:b], *(h[a:b] for h in hats), ents, slice(a - base, b - base))
                        done.append((video, slot[a], int(idx[a + i]), ts[a + i], False, *scores))
            frame = pd.DataFrame(done, columns=names)
            frame["frame_idx"] = frame["frame_idx"].astype("Int64")
            yield frame

    got = sorted_rows.mapInPandas(run, schema)
    scores = F.map_from_arrays(F.array(*map(F.lit, NAMES)), F.array(*[f"s_{n}" for n in NAMES]))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    return got.select("video_id", "slot", "frame_idx", "native_timestamp", "is_synthetic", F.when(F.col("is_synthetic"), none).otherwise(scores).alias("scores"))


def detections(entities):
    """(class ids, corners in a row) of the detections that have a box of four corners, as flat lists."""
    whole = F.filter(F.coalesce(entities, F.array()), lambda e: e["bbox"].isNotNull() & (F.size(e["bbox"]) == 4))
    return F.transform(whole, lambda e: F.coalesce(e["class_id"], F.lit(-(2**31)))), F.flatten(F.transform(whole, lambda e: e["bbox"]))


def pairs(kind, box) -> list[tuple[int, list[float]]]:
    """Detections as the selector takes them, from flat lists."""
    flat = box.tolist()
    return [(k, flat[4 * j : 4 * j + 4]) for j, k in enumerate(kind.tolist())]
