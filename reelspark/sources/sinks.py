"""Score telemetry and clip manifest as JSON, and an optional encoder hook."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def telemetry(outputs: DataFrame, *more: str) -> DataFrame:
    """target, native, is_synthetic and scores of each slot, and the columns ``more``: neither vectors nor entities."""
    return outputs.select(
        "video_id", "slot", F.col("target_timestamp").alias("target"), F.col("native_timestamp").alias("native"),
        F.col("native_timestamp").isNull().alias("is_synthetic"), "scores", *more,
    )


def write_json(df: DataFrame, path: str, by: str = "video_id") -> None:
    """JSON lines in one folder per video; an empty table still leaves a readable folder."""
    df.write.mode("overwrite").partitionBy(by).json(path)


def encode_clips(frames: DataFrame, encoder, schema: str) -> DataFrame:
    """Hand each clip's frames, in slot order, to ``encoder(clip_id, rows) -> row dict``; a clip is bounded by its token limit."""

    def run(pdf):
        import pandas as pd

        return pd.DataFrame([encoder(pdf["clip_id"].iloc[0], pdf.sort_values("slot"))])

    return frames.groupBy("clip_id").applyInPandas(run, schema)
