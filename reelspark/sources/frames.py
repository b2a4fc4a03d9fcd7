"""Frame tables as sources: repeated rows merged, unusable readings left out; and video sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.session import table


def usable(vector: Column) -> Column:
    """Not NULL, no NULL or NaN in it, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


# what a decoder yields of each frame for the whole engine
FRAMES = """video_id bigint, frame_id bigint, frame_idx bigint, ts double, clip_emb array<double>, dino_emb array<double>, blur_variance double,
optical_flow_mag double, entities array<struct<bbox:array<double>,confidence:double,class_id:int,class_name:string>>"""


def clean_frames(spark: SparkSession, sf_dir: str, vectors: bool = True) -> DataFrame:
    """:func:`usable_frames` of the table native_frames."""
    return usable_frames(table(spark, sf_dir, "native_frames"), vectors)


def usable_frames(f: DataFrame, vectors: bool = True) -> DataFrame:
    """One row per (video_id, frame_idx) of a frame table whose time and readings are usable.

    Repeated rows agree but for lost entities: the longest list stands.  The time must be a number >= 0, both
    readings finite and >= 0, and the clip vector not NULL; other frames cannot be scored.
    """
    ok = F.col("video_id").isNotNull() & F.col("frame_idx").isNotNull()
    for c in ("ts", "blur_variance", "optical_flow_mag"):
        ok &= F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) >= 0) & (F.col(c) < float("inf"))
    if vectors:
        ok &= F.col("clip_emb").isNotNull()
    aggs = [F.max("frame_id").alias("frame_id"), F.max("ts").alias("ts"), F.max("blur_variance").alias("blur"), F.max("optical_flow_mag").alias("flow")]
    if vectors:
        aggs += [
            F.any_value("clip_emb", True).alias("clip_emb"), F.any_value("dino_emb", True).alias("dino_emb"),
            F.max_by("entities", F.coalesce(F.size("entities"), F.lit(-1))).alias("entities"),
        ]
    return f.where(ok).groupBy("video_id", "frame_idx").agg(*aggs)


def clean_outputs(spark: SparkSession, sf_dir: str, pixels: bool = False) -> DataFrame:
    """One row per (video_id, slot) of output_frames; a slot is synthetic exactly if it has no native time.

    ``frame_data`` is the size of a slot's picture; only with ``pixels`` its bytes travel with it.
    """
    o = table(spark, sf_dir, "output_frames").where("video_id IS NOT NULL AND slot IS NOT NULL")
    if not pixels:
        size = F.struct("frame_data.height", "frame_data.width", "frame_data.n_channels")
        o = o.withColumn("frame_data", F.when(F.col("frame_data").isNotNull(), size))
    return o.groupBy("video_id", "slot").agg(
        F.max("target_timestamp").alias("target_timestamp"), F.max("native_timestamp").alias("native_timestamp"),
        F.any_value("clip_emb", True).alias("clip_emb"), F.any_value("dino_emb", True).alias("dino_emb"),
        F.any_value("scores", True).alias("scores"), F.any_value("frame_data", True).alias("frame_data"),
    ).withColumn("real", F.col("native_timestamp").isNotNull())


def resolve_fps(container: Column, override: Column) -> Column:
    """The container's rate if positive and nothing overrides it, else the override, else 30."""
    return F.when((container > 0) & override.isNull(), container).otherwise(F.coalesce(F.nullif(override, F.lit(0.0)), F.lit(30.0)))


def frame_times(frames: DataFrame, fps: Column, duration: Column) -> DataFrame:
    """ts = frame_idx / fps, up to and including ``duration``."""
    t = frames.withColumn("ts", F.col("frame_idx") / fps)
    return t.where(duration.isNull() | (F.col("ts") <= duration))


def video_files(spark: SparkSession, path: str) -> DataFrame:
    """Encoded files with their bytes, for a pluggable decoder (``decode_with``)."""
    return spark.read.format("binaryFile").load(path)


def image_folder(spark: SparkSession, path: str) -> DataFrame:
    """Decoded still frames of a folder: origin, height, width, channels, BGR bytes."""
    return spark.read.format("image").load(path).select("image.origin", "image.height", "image.width", F.col("image.nChannels").alias("n_channels"), F.col("image.data").alias("pixels"))


def decode_with(files: DataFrame, decoder, schema: str) -> DataFrame:
    """Run ``decoder(path, content) -> iterator of row dicts`` on every file; frames stream out in bounded batches."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                held = []
                for row in decoder(path, content):
                    held.append(row)
                    if len(held) >= 256:
                        yield pd.DataFrame(held)
                        held = []
                if held:
                    yield pd.DataFrame(held)

    return files.select("path", "content").mapInPandas(run, schema)


def infer_with(frames: DataFrame, load, vector: str, dim: int, pixels: tuple[str, ...] = ("pixels", "height", "width", "n_channels")) -> DataFrame:
    """Adds ``vector``: what a model makes of each row's picture, cyclically resized to ``dim`` elements and scaled to length one.

    ``load()`` runs once in each Python worker and returns ``model(list of images) -> list of vectors``; images are arrays of
    height x width x channels.  Rows without a picture, or with one of the wrong size, get NULL.  Batches stream through.
    """
    names = [*frames.columns, vector]
    schema = frames.withColumn(vector, F.lit(None).cast("array<double>")).schema

    def run(batches):
        import numpy as np
        import pyarrow as pa

        model = load()
        for batch in batches:
            data, h, w, c = (batch.column(p).to_pylist() for p in pixels)
            at = [i for i, d in enumerate(data) if d is not None and None not in (h[i], w[i], c[i]) and len(d) == h[i] * w[i] * c[i] and len(d)]
            got: list = [None] * batch.num_rows
            if at:
                for i, v in zip(at, model([np.frombuffer(data[i], np.uint8).reshape(h[i], w[i], c[i]) for i in at])):
                    v = np.resize(np.asarray(v, np.float64), dim)
                    got[i] = (v / (np.sqrt(v @ v) + 1e-8)).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.list_(pa.float64()))], names)

    return frames.mapInArrow(run, schema)


def probe_durations(files: DataFrame, probe) -> DataFrame:
    """(path, duration): ``probe(path) -> seconds or None`` of each file; any failure gives NULL."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for path in pdf["path"]:
                try:
                    d = probe(path)
                    out.append(None if d is None else float(d))
                except Exception:  # an unreadable file has no known duration
                    out.append(None)
            yield pd.DataFrame({"path": pdf["path"], "duration": pd.Series(out, dtype="float64")})

    return files.select("path").mapInPandas(run, "path string, duration double")
