"""Emission over slot order: which gaps are filled, linear fill, trailing hold, conditional smoothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelspark.functions.vectors import cosine_distance, lerp
from reelspark.operators.ordering import by_chunk, carried, group_bounds, neighbourhoods, stream_groups

# fixed values: five Gaussian taps of sigma 0.5
TAPS = (0.00026386508, 0.10645079720, 0.78657072589, 0.10645079720, 0.00026386508)


def gap_kinds(outputs: DataFrame) -> DataFrame:
    """Adds ``kind`` (R real, L filled, H held, Z left empty), the neighbours' row numbers where it is filled or held, and ``alpha``.

    A gap of at most two slots between real ones is filled; of the last three slots a synthetic one after a real
    one is held instead.  ``outputs`` has one row per slot (video_id, slot, real).
    """
    rows, w = neighbourhoods(outputs, ["slot"], 2)
    near = lambda f: F.when(f("real", 1).over(w), 1).when(f("real", 2).over(w), 2)
    d = rows.withColumn("_p", near(F.lag)).withColumn("_n", near(F.lead)).where("core").withColumn("rn", (F.col("pos") + 1).cast("int"))
    fill = ~F.col("real") & F.coalesce(F.col("_p") + F.col("_n") <= 3, F.lit(False))
    hold = ~F.col("real") & (F.col("pos") > F.greatest(F.lit(0), F.col("last_pos") - 2)) & F.coalesce(F.col("_p") == 1, F.lit(False))
    kind = F.when(F.col("real"), "R").when(hold, "H").when(fill, "L").otherwise("Z")
    alpha = F.col("_p") / (F.col("_p") + F.col("_n")).cast("double")
    d = d.withColumn("kind", kind).withColumn("alpha", F.when(fill, alpha))
    return d.select(*outputs.columns, "rn", "kind", "alpha", (F.col("rn") - F.col("_p")).alias("prev_rn"), (F.col("rn") + F.col("_n")).alias("next_rn"))


def filled(outputs: DataFrame, vectors: tuple[str, ...] = ("clip_emb", "dino_emb")) -> DataFrame:
    """Slots with their vectors filled (L), held (H) or zero (Z), and the score map that marks how.

    Only filled and held slots look up their neighbours' vectors, by (video, row number).
    """
    kinds = gap_kinds(outputs.select("video_id", "slot", "real")).select("video_id", "slot", "rn", "kind", "alpha", "prev_rn", "next_rn")
    d = outputs.join(kinds, ["video_id", "slot"])
    ends = d.where("real").select("video_id", F.col("rn"), *vectors)
    gaps = d.where("kind IN ('L', 'H')").select("video_id", "slot", "kind", "alpha", "prev_rn", "next_rn")
    prev = ends.select("video_id", F.col("rn").alias("prev_rn"), *[F.col(v).alias(f"_p_{v}") for v in vectors])
    nxt = ends.select("video_id", F.col("rn").alias("next_rn"), *[F.col(v).alias(f"_n_{v}") for v in vectors])
    new = gaps.join(prev, ["video_id", "prev_rn"]).join(nxt, ["video_id", "next_rn"], "left")
    mixed = [F.when(F.col("kind") == "L", lerp(F.col(f"_p_{v}"), F.col(f"_n_{v}"), F.col("alpha"))).otherwise(F.col(f"_p_{v}")).alias(f"_f_{v}") for v in vectors]
    d = d.join(new.select("video_id", "slot", *mixed), ["video_id", "slot"], "left")
    for v in vectors:
        zero = F.transform(v, lambda x: F.lit(0.0))
        d = d.withColumn(v, F.when(F.col("kind") == "R", F.col(v)).when(F.col("kind") == "Z", zero).otherwise(F.col(f"_f_{v}"))).drop(f"_f_{v}")
    marks = F.create_map(F.lit("total"), F.lit(0.0), F.lit("lerped"), F.lit(1.0))
    held = F.create_map(F.lit("total"), F.lit(0.0), F.lit("lerped"), F.lit(1.0), F.lit("trailing"), F.lit(1.0))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    return d.withColumn("scores", F.when(F.col("kind") == "R", F.col("scores")).when(F.col("kind") == "L", marks).when(F.col("kind") == "H", held).otherwise(none))


def smoothed(outputs: DataFrame, vector: str = "clip_emb", threshold: float = 0.85, chunk: int = 1024, halo: int = 64) -> DataFrame:
    """(video_id, slot, vector, smoothed): a row whose five neighbours are alike becomes their weighted mean, scaled to length one.

    Row t uses the smoothed rows t-2 and t-1 and the raw rest, so it depends on all rows before it; but each step back weighs a
    tenth, and after ``halo`` rows nothing of it is left in double precision.  So chunks of a video answer like the whole, and many
    chunks are worked through at once.  The first and last two rows of a video stay as they are.
    """
    rows, _ = neighbourhoods(outputs.select("video_id", "slot", vector), ["slot"], halo, chunk=chunk)

    def run(batches):
        import numpy as np
        import pandas as pd

        taps = np.array(TAPS)
        for pdf in stream_groups(batches, ["video_id", "chunk"], 16 * chunk):
            b = group_bounds(pdf, ["video_id", "chunk"])
            n, t = len(b) - 1, int(np.diff(b).max())
            row = np.repeat(np.arange(n), np.diff(b))
            col = np.arange(len(pdf)) - np.repeat(b[:-1], np.diff(b))
            raw = np.stack(pdf[vector].to_numpy())
            y = np.zeros((t, n, raw.shape[1]))
            y[col, row] = raw
            fits = np.zeros((t, n), bool)
            pos, last = pdf["pos"].to_numpy(), pdf["last_pos"].to_numpy()
            size = np.diff(b)[row]
            fits[col, row] = (pos >= 2) & (pos <= last - 2) & (col >= 2) & (col <= size - 3)
            unit = y / (np.sqrt((y * y).sum(2)) + 1e-8)[..., None]
            changed = np.zeros((t, n), bool)
            for i in range(2, t - 2):
                # the mean of all cosines of five unit vectors is the squared length of their mean
                total = unit[i - 2 : i + 3].sum(0)
                hit = fits[i] & ((total * total).sum(1) / 25 > threshold)
                if hit.any():
                    mix = np.einsum("k,knd->nd", taps, y[i - 2 : i + 3, hit])
                    y[i, hit] = mix / (np.sqrt((mix * mix).sum(1)) + 1e-8)[:, None]
                    unit[i, hit] = y[i, hit] / (np.sqrt((y[i, hit] ** 2).sum(1)) + 1e-8)[:, None]
                    changed[i] = hit
            core = pdf["core"].to_numpy(dtype=bool)
            yield pd.DataFrame(
                {
                    "video_id": pdf["video_id"][core], "slot": pdf["slot"][core], vector: list(y[col[core], row[core]]),
                    "smoothed": changed[col[core], row[core]],
                }
            )

    cut = by_chunk(rows, ["video_id", "chunk"], ["pos"]).select("video_id", "chunk", "slot", "pos", "last_pos", "core", vector)
    return cut.mapInPandas(run, f"video_id bigint, slot bigint, {vector} array<double>, smoothed boolean")


def continuity(outputs: DataFrame, vector: str = "dino_emb") -> DataFrame:
    """(video_id, slot, c_val): distance to the vectors 1, 5 and 10 slots back (the oldest where there are fewer)."""
    rows, w = neighbourhoods(outputs.select("video_id", "slot", F.col(vector).alias("v")), ["slot"], 10)
    # the first ten slots of a video lie in its first chunk, whose first row is the video's
    d = rows.withColumn("first", F.first("v").over(w))
    for k in (1, 5, 10):
        d = d.withColumn(f"h{k}", F.when(F.col("pos") >= k, F.lag("v", k).over(w)).otherwise(F.col("first")))
    c = sum((F.lit(a) * cosine_distance(F.col("v"), F.col(f"h{k}")) for a, k in ((0.6, 1), (0.3, 5), (0.1, 10))), F.lit(0.0))
    return d.where("core").select("video_id", "slot", F.when(F.col("pos") == 0, F.lit(0.0)).otherwise(c).alias("c_val"))


def blend_plan(outputs: DataFrame, key: str = "video_id") -> DataFrame:
    """(key, slot, how, alpha, prev_slot, next_slot): pixels of slots without any: own, blend, copy_prev, copy_next or black.

    prev_slot and next_slot are the nearest slots with pixels, or the slot itself where there is none.  ``alpha`` counts rows.
    No pixels travel: only whether a slot has any.
    """
    has = outputs.select(key, "slot", F.col("frame_data").isNotNull().alias("has"))
    rows, w = neighbourhoods(has, ["slot"], 0, key)
    mark = F.when(F.col("has"), F.struct("pos", "slot"))
    ends = carried(rows, {"at": mark}, key)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(key, "chunk").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    d = rows.withColumn("p", F.last(mark, True).over(back)).withColumn("q", F.last(mark, True).over(ahead))
    d = d.join(ends.withColumnsRenamed({key: "_k", "chunk": "_c"}), F.col(key).eqNullSafe(F.col("_k")) & (F.col("chunk") == F.col("_c")))
    d = d.withColumn("p", F.coalesce("p", "before_at")).withColumn("q", F.coalesce("q", "after_at"))
    both = F.col("p").isNotNull() & F.col("q").isNotNull()
    how = F.when(F.col("has"), "own").when(both, "blend").when(F.col("p").isNotNull(), "copy_prev").when(F.col("q").isNotNull(), "copy_next").otherwise("black")
    alpha = F.when(how == "blend", (F.col("pos") - F.col("p.pos")) / (F.col("q.pos") - F.col("p.pos")))
    return d.select(
        key, "slot", how.alias("how"), alpha.alias("alpha"), F.coalesce("p.slot", "slot").alias("prev_slot"), F.coalesce("q.slot", "slot").alias("next_slot")
    )
