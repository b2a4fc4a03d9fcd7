"""spark-submit entry: frame table or videos in, telemetry and clip manifest out."""

from __future__ import annotations

import argparse
import importlib


def named(path: str):
    """The object that ``module:name`` names."""
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="reelspark")
    source = p.add_mutually_exclusive_group(required=True)
    source.add_argument("--frames_path", help="folder that holds native_frames.parquet")
    source.add_argument("--video_path", help="video files; needs --decoder")
    p.add_argument("--decoder", help="module:function(path, content) that yields a dict for each frame, with the columns of sources.frames.FRAMES")
    p.add_argument("--audio_path", help="sound tracks, with the videos' file names; by default the videos' own; needs --probe")
    p.add_argument("--probe", help="module:function(path) -> seconds of sound, or None")
    p.add_argument("--output_dir", default="outputs/")
    p.add_argument("--config", help="YAML file")
    return p


def main(argv: list[str] | None = None) -> dict[str, str]:
    p = parser()
    a = p.parse_args(argv)
    if a.video_path and not a.decoder:
        p.error("--video_path needs --decoder")

    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from reelspark.config import load
    from reelspark.plans.pipeline import run
    from reelspark.session import ship_package
    from reelspark.sources import frames as S

    spark = SparkSession.builder.appName("reelspark").getOrCreate()
    ship_package(spark)
    raw = spark.read.parquet(f"{a.frames_path}/native_frames.parquet") if a.frames_path else S.decode_with(S.video_files(spark, a.video_path), named(a.decoder), S.FRAMES)
    out = a.output_dir.rstrip("/")
    paths = run(spark, S.usable_frames(raw), out, load(a.config))
    if a.probe and (a.audio_path or a.video_path):
        sound = S.probe_durations(S.video_files(spark, a.audio_path or a.video_path).drop("content"), named(a.probe))
        paths["audio"] = f"{out}/audio"
        sound.withColumn("has_sound", F.col("duration").isNotNull()).write.mode("overwrite").json(paths["audio"])
    print(paths)
    return paths


if __name__ == "__main__":
    main()
