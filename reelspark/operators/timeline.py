"""Alignment to the target timeline: slots, candidates (bucketed range join), empty slots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.operators.regrid import STRIDE, WINDOW


def slot_count(max_ts, stride: float = STRIDE, window: float = WINDOW):
    """Number of slots k = 0, 1, ... with k * stride + window/2 <= max_ts."""
    guess = F.greatest(F.lit(0), F.floor((max_ts - window / 2) / F.lit(stride)).cast("bigint") + 2)
    # the guess is at most two too high; step down by the exact test
    fits = lambda n: (n - 1) * F.lit(stride) + window / 2 <= max_ts
    return F.when((guess > 0) & fits(guess), guess).when((guess > 1) & fits(guess - 1), guess - 1).otherwise(F.greatest(guess - 2, F.lit(0)))


def video_slots(frames: DataFrame, stride: float = STRIDE, window: float = WINDOW) -> DataFrame:
    """(video_id, n_slots): the slots that close before the stream ends; pending frames are never evaluated."""
    return frames.groupBy("video_id").agg(F.max("ts").alias("_m")).select("video_id", slot_count(F.col("_m"), stride, window).alias("n_slots"))


def candidates(frames: DataFrame, stride: float = STRIDE, window: float = WINDOW) -> DataFrame:
    """Frames with each closed slot whose half-open window holds them: an equi-join key instead of a range join."""
    near = F.floor(F.col("ts") / F.lit(stride)).cast("bigint")
    reach = int(window / stride / 2) + 1
    spread = frames.withColumn("slot", F.explode(F.sequence(F.greatest(F.lit(0), near - reach), near + reach)))
    target = F.col("slot") * F.lit(stride)
    held = spread.where((F.col("ts") >= target - window / 2) & (F.col("ts") < target + window / 2))
    return held.join(video_slots(frames, stride, window), "video_id").where(F.col("slot") < F.col("n_slots")).drop("n_slots")


def all_slots(frames: DataFrame, block: int = 8192, stride: float = STRIDE, window: float = WINDOW) -> DataFrame:
    """(video_id, slot, target_ts) of every closed slot, in bounded steps however late a video's times are."""
    n = video_slots(frames, stride, window).where("n_slots > 0")
    # a late time means many blocks: they are listed in two steps, so no array holds more than some thousands
    size = lambda k: F.floor((F.col("n_slots") - 1) / k).cast("bigint")
    wide = n.withColumn("_a", F.explode(F.sequence(F.lit(0).cast("bigint"), size(block * block))))
    least = F.col("_a") * F.lit(block).cast("bigint")
    blocks = wide.withColumn("_b", F.explode(F.sequence(least, F.least(least + (block - 1), size(block)))))
    last = F.least(F.col("n_slots"), (F.col("_b") + 1) * F.lit(block).cast("bigint")) - 1
    return blocks.select("video_id", F.explode(F.sequence(F.col("_b") * F.lit(block).cast("bigint"), last)).alias("slot")).withColumn(
        "target_ts", F.col("slot") * F.lit(stride)
    )


def slot_flags(frames: DataFrame) -> DataFrame:
    """(video_id, slot, n_candidates, is_synthetic)."""
    c = candidates(frames).groupBy("video_id", "slot").agg(F.count(F.lit(1)).alias("n"))
    out = all_slots(frames).join(c, ["video_id", "slot"], "left")
    return out.select("video_id", "slot", F.coalesce("n", F.lit(0)).alias("n_candidates"), F.col("n").isNull().alias("is_synthetic"))
