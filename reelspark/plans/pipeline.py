"""The whole engine: frames to selected slots, telemetry and clip manifest."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.config import Config
from reelspark.operators import emit, grouping, rolling
from reelspark.operators import score as S
from reelspark.operators import timeline as T
from reelspark.operators.select import select_frames
from reelspark.session import cut_lineage
from reelspark.sources.sinks import telemetry, write_json


def outputs(frames: DataFrame, cfg: Config) -> DataFrame:
    """One row per closed slot: choice or synthetic mark, filled and smoothed vectors, scores, pixels' key.

    ``frames`` as from ``sources.frames.clean_frames``: video_id, frame_idx, ts, blur, flow, clip_emb, dino_emb, entities.
    """
    frames = cut_lineage(frames.select("video_id", "frame_idx", "ts", "blur", "flow", "clip_emb", "dino_emb", "entities"))
    chosen = select(frames, cfg)
    vectors = frames.select("video_id", "frame_idx", "clip_emb", "dino_emb")
    rows = cut_lineage(chosen.join(vectors, ["video_id", "frame_idx"], "left").withColumn("real", ~F.col("is_synthetic")))
    filled = emit.filled(rows).withColumn("target_timestamp", F.col("slot") * F.lit(cfg.stride_sec))
    zero = lambda c, d: F.coalesce(c, F.array_repeat(F.lit(0.0), d))
    filled = filled.withColumn("clip_emb", zero("clip_emb", cfg.clip_dim)).withColumn("dino_emb", zero("dino_emb", cfg.dino_dim))
    filled = cut_lineage(filled)
    soft = emit.smoothed(filled, "clip_emb", cfg.smoothing_threshold)
    return filled.drop("clip_emb").join(soft, ["video_id", "slot"]).select(
        "video_id", "slot", "frame_idx", "target_timestamp", "native_timestamp", "is_synthetic", "kind", "scores", "clip_emb", "dino_emb"
    )


def select(frames: DataFrame, cfg: Config) -> DataFrame:
    """One row per closed slot with the chosen frame: terms that depend on no choice in parallel, then the fold."""
    slots = {"stride": cfg.stride_sec, "window": cfg.window_sec}
    n = cfg.percentile_window
    hats = rolling.normalised(T.candidates(frames.select("video_id", "frame_idx", "ts", "blur", "flow"), **slots), {"blur": "q_hat", "flow": "m_hat"}, n, cfg.eps)
    near = S.diversity(T.candidates(frames.select("video_id", "frame_idx", "ts", "clip_emb"), **slots), "clip_emb")
    wide = frames.select("video_id", "frame_idx", "clip_emb", "dino_emb", "entities")
    scored = hats.join(near, ["video_id", "slot", "frame_idx"]).join(wide, ["video_id", "frame_idx"])
    cap = cfg.bank_bound if cfg.enforce_bank_bound else None
    return select_frames(scored, T.all_slots(frames.select("video_id", "ts"), **slots), cfg.clip_dim, cfg.dino_dim, cfg.weights, cfg.ewma_alpha, n, cap, cfg.eps)


def clips(out: DataFrame, cfg: Config, clip_dir: str = "clips") -> DataFrame:
    """Clip manifest of the slots of each video.  Slots carry no entities or subtitles; without ``grouping_embedding``
    they carry no vector either, and every slot stays a clip of its own."""
    vector = F.col(cfg.grouping_embedding) if cfg.grouping_embedding else F.lit(None).cast("array<double>")
    nodes = out.select(
        F.xxhash64("video_id", "slot").alias("node_id"), "video_id", F.col("slot").cast("int").alias("frame_index"), F.lit(cfg.grouping.visual_cost).alias("token_cost"),
        "scores", F.lit(None).cast("array<struct<bbox:array<double>,confidence:double,class_id:int,class_name:string>>").alias("entities"),
        F.array().cast("array<string>").alias("subtitles"), vector.alias("embedding"),
    )
    nodes = cut_lineage(nodes)
    members = nodes.join(grouping.group_frames(nodes, cfg.grouping).drop("video_id"), "node_id")
    return grouping.manifest(members, replace(cfg.grouping, fps=cfg.target_fps), clip_dir)


def run(spark: SparkSession, frames: DataFrame, output_dir: str, cfg: Config | None = None) -> dict[str, str]:
    """Write ``scores`` and, unless there is nothing to group, ``clips`` under ``output_dir``; returns their paths."""
    cfg = cfg or Config()
    out = cut_lineage(outputs(frames, cfg))
    paths = {"scores": f"{output_dir}/scores"}
    write_json(telemetry(out), paths["scores"])
    if out.isEmpty() or not cfg.grouping_enabled:
        return paths
    paths["clips"] = f"{output_dir}/clips"
    write_json(clips(out, cfg, f"{output_dir}/clips"), paths["clips"])
    return paths
