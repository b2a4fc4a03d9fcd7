"""Reconstruction arithmetic: audio tempo plan, run summary, output size; pixel functions as Arrow-batched UDFs."""


import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType, DoubleType

from reelspark.operators.ordering import by_chunk, neighbourhoods, stream_groups

DRIFT = 0.1


def tempo_plan(video: Column, audio: Column) -> dict[str, Column]:
    """How the audio is stretched to the video: drift, ratio, number of filters and the ratio of each (NULL: mapped as is)."""
    drift = F.abs(video - audio)
    ratio = F.when(video > 0, audio / video).otherwise(F.lit(1.0))
    chain = F.ceil(F.log(ratio) / F.log(F.lit(0.5))).cast("bigint")
    n = F.when(audio.isNull() | (drift <= DRIFT), F.lit(0).cast("bigint")).when(ratio < 0.5, chain).otherwise(F.lit(1).cast("bigint"))
    each = F.when(n == 0, None).when(ratio < 0.5, F.pow(ratio, 1 / n)).otherwise(F.least(F.lit(100.0), ratio))
    return {"drift": drift, "ratio": ratio, "n_filters": n, "filter_ratio": each}


def run_summary(outputs: DataFrame) -> DataFrame:
    """Slots, synthetic slots and progress marks (one every 30 slots) of each video."""
    return outputs.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("n_slots"), F.count_if(~F.col("real")).alias("n_synthetic"), F.floor(F.count(F.lit(1)) / 30).cast("bigint").alias("progress_marks")
    )


def output_size(outputs: DataFrame) -> DataFrame:
    """(video_id, height, width) of the first slot that has pixels; videos without any are left out."""
    d = outputs.where("frame_data IS NOT NULL")
    return d.groupBy("video_id").agg(F.min_by(F.struct("frame_data.height", "frame_data.width"), "slot").alias("s")).select("video_id", "s.height", "s.width")


def resize_rule(height: Column, width: Column, size: int = 224) -> Column:
    """Interpolation of a square resize: area only where both sides shrink."""
    return F.when((height > size) & (width > size), "area").otherwise("lanczos4")


def _image(pixels, h, w, c):
    import numpy as np

    return np.frombuffer(pixels, np.uint8).reshape(h, w, c)


def gray(image):
    """BGR to luminance in 15-bit fixed point, as image libraries do it; two-dimensional images pass."""
    import numpy as np

    if image.ndim == 2 or image.shape[2] == 1:
        return image.reshape(image.shape[:2])
    # fixed values: 0.114, 0.587 and 0.299 times 2^15
    b, g, r = (image[..., k].astype(np.int64) for k in range(3))
    return ((3735 * b + 19235 * g + 9798 * r + (1 << 14)) >> 15).astype(np.uint8)


def laplacian_variance(g) -> float:
    """Population variance of the 3x3 Laplacian with reflected borders."""
    import numpy as np

    p = np.pad(g.astype(float), 1, mode="reflect") if min(g.shape) > 1 else np.pad(g.astype(float), 1, mode="edge")
    lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]
    return float(lap.var())


@pandas_udf(DoubleType())
def sharpness(pixels: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series) -> pd.Series:
    return pd.Series(
        [None if p is None or len(p) != h * w * c else laplacian_variance(gray(_image(p, int(h), int(w), int(c)))) for p, h, w, c in zip(pixels, height, width, channels)],
        dtype="float64",
    )


@pandas_udf(BinaryType())
def to_gray(pixels: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series) -> pd.Series:
    return pd.Series([None if p is None or len(p) != h * w * c else gray(_image(p, int(h), int(w), int(c))).tobytes() for p, h, w, c in zip(pixels, height, width, channels)], dtype=object)


@pandas_udf(BinaryType())
def to_rgb(pixels: pd.Series, channels: pd.Series) -> pd.Series:
    import numpy as np

    return pd.Series([None if p is None or len(p) % int(c) else np.frombuffer(p, np.uint8).reshape(-1, int(c))[:, ::-1].tobytes() for p, c in zip(pixels, channels)], dtype=object)


@pandas_udf(BinaryType())
def blend_pixels(a: pd.Series, b: pd.Series, alpha: pd.Series) -> pd.Series:
    """(1 - alpha) a + alpha b per byte, rounded and saturated; NULL if the sizes differ."""
    import numpy as np

    out = []
    for x, y, t in zip(a, b, alpha):
        if x is None or y is None or t is None or t != t or len(x) != len(y):
            out.append(None)
            continue
        mix = (1 - t) * np.frombuffer(x, np.uint8) + t * np.frombuffer(y, np.uint8)
        out.append(np.clip(np.rint(mix), 0, 255).astype(np.uint8).tobytes())
    return pd.Series(out, dtype=object)


def detections_above(entities: Column, confidence: float = 0.35) -> Column:
    """Detections of at least ``confidence``; a missing class name is the class id as text; NULL gives an empty list."""
    kept = F.filter(F.coalesce(entities, F.array()), lambda e: e["confidence"] >= confidence)
    return F.transform(
        kept, lambda e: F.struct(e["bbox"].alias("bbox"), e["confidence"].alias("confidence"), e["class_id"].alias("class_id"), F.coalesce(e["class_name"], e["class_id"].cast("string")).alias("class_name"))
    )


def resized(image, height: int, width: int, rule: str = "area"):
    """Image of another size.  area: each new pixel is the mean of what it covers; lanczos4: eight-tap windowed sinc per axis, edges repeated."""
    import numpy as np

    def weights(old: int, new: int):
        scale = old / new
        out = np.zeros((new, old))
        for i in range(new):
            if rule == "area":
                a, b = i * scale, (i + 1) * scale
                for j in range(int(a), min(old, int(np.ceil(b - 1e-9)))):
                    out[i, j] = min(b, j + 1) - max(a, j)
            else:
                x = (i + 0.5) * scale - 0.5
                j = np.arange(int(np.floor(x)) - 3, int(np.floor(x)) + 5)
                np.add.at(out[i], np.clip(j, 0, old - 1), np.sinc(x - j) * np.sinc((x - j) / 4))
        return out / out.sum(1, keepdims=True)

    flat = image.reshape(*image.shape[:2], -1).astype(float)
    got = np.einsum("ya,xb,abc->yxc", weights(image.shape[0], height), weights(image.shape[1], width), flat)
    return np.clip(np.rint(got), 0, 255).astype(np.uint8).reshape(height, width, *image.shape[2:])


def model_input(size: int = 224):
    """Arrow-batched column function (pixels, height, width, channels) -> square image bytes, by the rule of ``resize_rule``."""

    @pandas_udf(BinaryType())
    def run(pixels: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series) -> pd.Series:
        out = []
        for p, h, w, c in zip(pixels, height, width, channels):
            if p is None or len(p) != h * w * c:
                out.append(None)
                continue
            out.append(resized(_image(p, int(h), int(w), int(c)), size, size, "area" if h > size and w > size else "lanczos4").tobytes())
        return pd.Series(out, dtype=object)

    return run


def dense_flow(before, after, window: int = 7, levels: int = 3):
    """Mean length of the dense motion between two grey images: Lucas-Kanade in windows, from coarse to fine."""
    import numpy as np

    def box(a):
        p = np.pad(a, window // 2, mode="edge").cumsum(0).cumsum(1)
        p = np.pad(p, ((1, 0), (1, 0)))
        return p[window:, window:] - p[:-window, window:] - p[window:, :-window] + p[:-window, :-window]

    pyramid = [(before.astype(float), after.astype(float))]
    while len(pyramid) < levels and min(pyramid[-1][0].shape) >= 16:
        pyramid.append(tuple(resized(i, i.shape[0] // 2, i.shape[1] // 2).astype(float) for i in pyramid[-1]))
    u = v = np.zeros(pyramid[-1][0].shape)
    for a, b in reversed(pyramid):
        h, w = a.shape
        if u.shape != a.shape:
            y, x = np.minimum(np.arange(h) // 2, u.shape[0] - 1), np.minimum(np.arange(w) // 2, u.shape[1] - 1)
            u, v = 2 * u[np.ix_(y, x)], 2 * v[np.ix_(y, x)]
        for _ in range(3):
            yy, xx = np.mgrid[:h, :w]
            sy, sx = np.clip(yy + v, 0, h - 1), np.clip(xx + u, 0, w - 1)
            y0, x0 = np.floor(sy).astype(int), np.floor(sx).astype(int)
            y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
            fy, fx = sy - y0, sx - x0
            moved = (b[y0, x0] * (1 - fx) + b[y0, x1] * fx) * (1 - fy) + (b[y1, x0] * (1 - fx) + b[y1, x1] * fx) * fy
            gy, gx = np.gradient(moved)
            d = moved - a
            xx2, yy2, xy, xt, yt = box(gx * gx), box(gy * gy), box(gx * gy), box(gx * d), box(gy * d)
            det = (xx2 + 1e-3) * (yy2 + 1e-3) - xy * xy
            u = u - np.clip(((yy2 + 1e-3) * xt - xy * yt) / det, -2, 2)
            v = v - np.clip(((xx2 + 1e-3) * yt - xy * xt) / det, -2, 2)
    return float(np.sqrt(u * u + v * v).mean())


def flow_with(frames: DataFrame, flow=dense_flow, size: tuple[int, int] = (160, 120), chunk: int = 256) -> DataFrame:
    """(video_id, frame_idx, optical_flow_mag): ``flow(previous, current) -> float`` on the grey pictures of neighbouring frames.

    frames: video_id, frame_idx, pixels, height, width, n_channels.  Pictures are shrunk to ``size`` (width, height) and turned grey where they are
    read, so 19 kB a frame travel; a video is cut into chunks, each with the frame before it.  A video's first frame and
    frames without a picture on either side have 0.
    """

    @pandas_udf(BinaryType())
    def small(pixels: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series) -> pd.Series:
        out = []
        for p, h, w, c in zip(pixels, height, width, channels):
            bad = p is None or len(p) != h * w * c
            out.append(None if bad else resized(gray(_image(p, int(h), int(w), int(c))), size[1], size[0]).tobytes())
        return pd.Series(out, dtype=object)

    slim = frames.select("video_id", F.col("frame_idx").cast("bigint").alias("frame_idx"), small("pixels", "height", "width", "n_channels").alias("g"))
    rows, _ = neighbourhoods(slim, ["frame_idx"], 1, chunk=chunk)

    def run(batches):
        import numpy as np

        for pdf in stream_groups(batches, ["video_id", "chunk"], chunk):
            grey = [None if g is None else np.frombuffer(g, np.uint8).reshape(size[1], size[0]) for g in pdf["g"]]
            pos, core = pdf["pos"].to_numpy(), pdf["core"].to_numpy(dtype=bool)
            mag = [0.0 if i == 0 or pos[i] == 0 or pos[i - 1] != pos[i] - 1 or grey[i] is None or grey[i - 1] is None else float(flow(grey[i - 1], grey[i])) if core[i] else 0.0 for i in range(len(pdf))]
            yield pd.DataFrame({"video_id": pdf["video_id"][core], "frame_idx": pdf["frame_idx"][core], "optical_flow_mag": np.array(mag)[core]})

    cut = by_chunk(rows, ["video_id", "chunk"], ["pos"]).select("video_id", "chunk", "pos", "core", "frame_idx", "g")
    return cut.mapInPandas(run, "video_id bigint, frame_idx bigint, optical_flow_mag double")


def fill_pixels(pictures: DataFrame, plan: DataFrame, key: str = "video_id") -> DataFrame:
    """(key, slot, how, height, width, pixels): every slot's picture by a ``emit.blend_plan``.

    ``pictures``: key, slot, frame_data of the slots that have one.  Only they are looked up, by slot; where a whole key has none its slots are
    black, of NULL size.  A blend of pictures of different sizes is NULL.
    """
    own = pictures.where("frame_data IS NOT NULL").select(key, "slot", "frame_data.height", "frame_data.width", "frame_data.pixels")
    size = own.groupBy(key).agg(F.min_by(F.struct("height", "width"), "slot").alias("size"))
    side = lambda n: own.select(key, F.col("slot").alias(f"{n}_slot"), F.struct("height", "width", "pixels").alias(f"_{n}"))
    plan = plan.withColumn("prev_slot", F.when(F.col("how") == "own", F.col("slot")).otherwise(F.col("prev_slot")))
    d = plan.join(side("prev"), [key, "prev_slot"], "left").join(side("next"), [key, "next_slot"], "left").join(size, key, "left")
    one = F.coalesce("_prev", "_next")
    pixels = (
        F.when(F.col("how") == "blend", blend_pixels(F.col("_prev.pixels"), F.col("_next.pixels"), F.col("alpha")))
        .when(F.col("how") == "black", F.unhex(F.repeat(F.lit("00"), F.coalesce(F.col("size.height") * F.col("size.width") * 3, F.lit(0)))))
        .otherwise(one["pixels"])
    )
    return d.select(key, "slot", "how", F.coalesce(one["height"], "size.height").alias("height"), F.coalesce(one["width"], "size.width").alias("width"), pixels.alias("pixels"))
