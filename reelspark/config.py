"""Engine settings: defaults, and a YAML file that overrides them."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from reelspark.operators.grouping import Grouping
from reelspark.operators.regrid import STRIDE, WINDOW
from reelspark.operators.score import WEIGHTS


@dataclass(frozen=True)
class Config:
    target_fps: float = 24.0  # of the clips; the timeline goes by stride_sec
    stride_sec: float = STRIDE
    window_sec: float = WINDOW
    eps: float = 1e-5
    bank_bound: int = 10_000
    enforce_bank_bound: bool = False  # novelty means all earlier choices unless the bound is asked for
    clip_dim: int = 512
    dino_dim: int = 384
    ewma_alpha: float = 0.3
    percentile_window: int = 120
    smoothing_threshold: float = 0.85
    weights: dict = field(default_factory=lambda: dict(WEIGHTS))
    grouping_enabled: bool = True
    grouping_embedding: str | None = None  # "clip_emb" groups by the selected vectors
    grouping: Grouping = Grouping()


def from_dict(tree: dict | None) -> Config:
    """Sections pipeline, dimensions, memory, scoring and clip_grouping; what is missing keeps its default."""
    t = tree or {}
    get = lambda section: t.get(section) or {}
    g, d = get("clip_grouping"), Grouping()
    grouping = Grouping(
        limit=float(g.get("effective_context_limit", d.limit)), merge_threshold=float(g.get("base_merge_threshold", d.merge_threshold)),
        visual_cost=float(g.get("default_visual_token_cost", d.visual_cost)), entity_cost=float(g.get("entity_token_cost", d.entity_cost)),
        subtitle_cost=float(g.get("subtitle_token_cost", d.subtitle_cost)), max_drop=float(g.get("max_drop_ratio", d.max_drop)),
        dynamic=bool(g.get("dynamic_threshold", d.dynamic)), fps=float(g.get("fps", d.fps)), min_sec=float(g.get("min_duration_sec", d.min_sec)), max_sec=float(g.get("max_duration_sec", d.max_sec)),
    )
    c = Config()
    return Config(
        target_fps=float(get("pipeline").get("target_fps", c.target_fps)), clip_dim=int(get("dimensions").get("clip", c.clip_dim)),
        dino_dim=int(get("dimensions").get("dino", c.dino_dim)), ewma_alpha=float(get("memory").get("ewma_alpha", c.ewma_alpha)),
        percentile_window=int(get("memory").get("percentile_window", c.percentile_window)),
        smoothing_threshold=float(get("scoring").get("conditional_smoothing_threshold", c.smoothing_threshold)),
        weights=dict(get("scoring").get("weights") or WEIGHTS), grouping_enabled=g.get("enabled", True) is not False,
        grouping_embedding=g.get("embedding"), grouping=grouping, stride_sec=float(get("pipeline").get("stride_sec", c.stride_sec)),
        window_sec=float(get("pipeline").get("target_window_sec", c.window_sec)), eps=float(get("scoring").get("eps", c.eps)),
        bank_bound=int(get("memory").get("faiss_max_elements", c.bank_bound)), enforce_bank_bound=bool(get("memory").get("enforce_bound", False)),
    )


def load(path: str | None = None) -> Config:
    if path is None:
        return Config()
    import yaml

    return from_dict(yaml.safe_load(Path(path).read_text()))
