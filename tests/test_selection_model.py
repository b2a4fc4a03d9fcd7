"""The selector against a plain model that keeps everything: whole history, whole bank, whole trackers."""

import numpy as np
import pytest

from reelspark.operators.score import WEIGHTS
from reelspark.operators.select import NAMES, Selector

W = WEIGHTS


def dist(a, b):
    na, nb = np.linalg.norm(a), np.linalg.norm(b)
    return 0.0 if na < 1e-8 or nb < 1e-8 else 1 - a @ b / na / nb


def pct(v, p):
    return sorted(v)[int(p * (len(v) - 1))] if len(v) else 0.0


def model(slots):
    """slots: lists of (clip, dino, q, m, d, number of entities as one box each) or empty; yields (winner, total)."""
    total_w = sum(W.values())
    w = {k: v / total_w for k, v in W.items()}
    history, kinds, novelty, bank, context, ent, prev = [], [], [], [], None, None, None
    for cands in slots:
        if not cands:
            history.append(np.zeros(4))
            kinds.append("S")
            yield None
            continue
        last = novelty[-120:]
        p25, p75 = pct(last, 0.25), pct(last, 0.75)
        rows = []
        for clip, dino, q, m, d, e in cands:
            raw = 0.0 if not prev and not e else 1.0 if not prev or not e else 1 - 1 / (1 + 1e-5)
            eh = raw if ent is None else 0.3 * raw + 0.7 * ent
            sims = sorted((clip / (np.linalg.norm(clip) + 1e-8) @ b for b in bank), reverse=True)[:5]
            nv = 0.5 * (1.0 if context is None else dist(clip, context)) + 0.5 * (max(0.0, 1 - np.mean(sims)) if bank else 1.0)
            n = min(2.0, max(0.0, (nv - p25) / (p75 - p25 + 1e-5)))
            c = sum(k * dist(dino, history[max(0, len(history) - s)]) for k, s in ((0.6, 1), (0.3, 5), (0.1, 10))) if history else 0.0
            gate = 1 / (1 + np.exp(-np.clip((n - p75) / (max(p75 - p25, 1e-5) + 1e-5), -30, 30)))
            sem = w["semantic"] * n + w["motion"] * m + w["entity"] * eh
            blur = w["blur"] * q + w["motion"] * m + w["entity"] * eh
            rows.append((gate * sem + (1 - gate) * blur - w["consistency"] * c - w["diversity"] * d, nv, raw))
        i = max(range(len(rows)), key=lambda k: (rows[k][0], -k))
        clip, dino, *_, e = cands[i]
        novelty.append(rows[i][1])
        ent = rows[i][2] if ent is None else 0.3 * rows[i][2] + 0.7 * ent
        prev = e
        context = clip if context is None else 0.3 * clip + 0.7 * context
        bank.append(clip / (np.linalg.norm(clip) + 1e-8))
        history.append(dino)
        kinds.append("R")
        gap = 0
        while len(kinds) - 2 - gap >= 0 and kinds[len(kinds) - 2 - gap] == "S":
            gap += 1
        before = len(kinds) - 2 - gap
        if 1 <= gap <= 2 and before >= 0:
            for j in range(1, gap + 1):
                v = (1 - j / (gap + 1)) * history[before] + j / (gap + 1) * dino
                history[before + j] = v / np.linalg.norm(v)
        yield i, rows[i][0]


@pytest.mark.parametrize("seed", range(4))
def test_selector_like_the_model(seed):
    r = np.random.default_rng(seed)
    slots, base = [], r.normal(size=6)
    while len(slots) < 300:
        if r.random() < 0.15:
            slots += [[]] * int(r.integers(1, 5))
            continue
        base = base + r.normal(0, 0.3, 6)
        slots.append([(base + r.normal(0, 0.2, 6), r.normal(size=4), r.random() * 2, r.random() * 2, r.random(), bool(r.random() < 0.7)) for _ in range(int(r.integers(1, 5)))])
    s = Selector(6, 4)
    box = [(1, [0.0, 0.0, 4.0, 4.0])]
    for cands, want in zip(slots, model(slots)):
        if not cands:
            s.empty()
            continue
        i, scores = s.select(np.stack([c[0] for c in cands]), np.stack([c[1] for c in cands]), *([c[k] for c in cands] for k in (2, 3, 4)), [box if c[5] else [] for c in cands])
        assert i == want[0] and abs(scores[NAMES.index("total")] - want[1]) < 1e-9
