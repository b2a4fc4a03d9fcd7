"""Queries p3 and p4: faulty readings and the regular timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.operators.regrid import regular_grid
from reelspark.operators.spikes import SpikeRule, flag_readings
from reelspark.session import table

BLUR_MAX, FLOW_MAX = 1_040_400.0, 200.0
READINGS = {
    "blur_variance": SpikeRule(high=BLUR_MAX),
    "optical_flow_mag": SpikeRule(high=FLOW_MAX, zero_at_first_index=True),
}


def p3_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every faulty reading with its kind and the model's probability."""
    frames = table(spark, sf_dir, "native_frames")
    return flag_readings(frames, "video_id", "frame_idx", "frame_id", READINGS).select(
        F.col("row_id").alias("frame_id"), "metric", "flag", F.round("probability", 6).alias("probability")
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The faulty readings alone: TESTDATA.md defines them exactly, so no model is fitted or run for them."""
    frames = table(spark, sf_dir, "native_frames")
    return flag_readings(frames, "video_id", "frame_idx", "frame_id", READINGS, model=False).select(F.col("row_id").alias("frame_id"), "metric")


def p4_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regular timeline of every video with smoothed readings, their uncertainty and the synthetic mark."""
    frames = table(spark, sf_dir, "native_frames")
    return regular_grid(
        frames, "video_id", "ts", {"blur_variance": (0.0, BLUR_MAX), "optical_flow_mag": (0.0, FLOW_MAX)}
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_grid(spark, sf_dir).where("is_synthetic").select("video_id", "slot")


QUERIES = {"p3_found": p3_found, "p3_readings": p3_readings, "p4_found": p4_found, "p4_grid": p4_grid}

_P4 = """
WITH f AS (SELECT DISTINCT video_id, ts FROM native_frames WHERE ts IS NOT NULL AND NOT isnan(ts) AND ts >= 0 AND ts < 1e15),
h AS (SELECT DISTINCT video_id, k AS slot
      FROM (SELECT video_id, ts, unnest(range(greatest(0, CAST(floor(ts / CAST(0.04166666666 AS DOUBLE)) AS BIGINT) - 2),
                                              CAST(floor(ts / CAST(0.04166666666 AS DOUBLE)) AS BIGINT) + 3)) AS k FROM f)
      WHERE k * CAST(0.04166666666 AS DOUBLE) - CAST(0.08333333333 AS DOUBLE) / 2 <= ts
        AND ts < k * CAST(0.04166666666 AS DOUBLE) + CAST(0.08333333333 AS DOUBLE) / 2),
r AS (SELECT video_id, unnest(range(min(slot), max(slot) + 1)) AS slot FROM h GROUP BY video_id)
SELECT r.video_id, r.slot FROM r LEFT JOIN h ON h.video_id IS NOT DISTINCT FROM r.video_id AND h.slot = r.slot WHERE h.slot IS NULL
"""

_P3 = """
WITH d AS (SELECT video_id, frame_idx, frame_id, max(blur_variance) AS blur_variance, max(optical_flow_mag) AS optical_flow_mag
           FROM native_frames WHERE frame_id IS NOT NULL AND frame_idx IS NOT NULL GROUP BY ALL),
u AS (SELECT video_id, frame_idx, frame_id, 'blur_variance' AS metric, blur_variance AS x, 1040400.0 AS hi FROM d
      UNION ALL SELECT video_id, frame_idx, frame_id, 'optical_flow_mag', optical_flow_mag, 200.0 FROM d),
q AS (SELECT *, row_number() OVER w AS pos, x IS NOT NULL AND (isnan(x) OR isinf(x) OR x < 0 OR x > hi) AS bad,
             CASE WHEN x IS NULL OR isnan(x) OR isinf(x) OR x < 0 OR x > hi THEN NULL ELSE x END AS v
      FROM u WINDOW w AS (PARTITION BY video_id, metric ORDER BY frame_idx, frame_id)),
s AS (SELECT *, CASE WHEN v = lag(v) OVER (PARTITION BY video_id, metric ORDER BY pos) THEN 0 ELSE 1 END AS new FROM q),
g AS (SELECT *, sum(new) OVER (PARTITION BY video_id, metric ORDER BY pos) AS run FROM s),
c AS (SELECT *, CASE WHEN v IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY video_id, metric, run) END AS n FROM g),
k AS (SELECT *, CASE WHEN n < 6 THEN v END AS y FROM c),
m AS (SELECT *, median(y) OVER (PARTITION BY video_id, metric ORDER BY pos ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING EXCLUDE CURRENT ROW) AS y0,
             median(v) OVER (PARTITION BY video_id, metric ORDER BY pos ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING EXCLUDE CURRENT ROW) AS v0 FROM k),
a AS (SELECT *, v IS NOT NULL AND coalesce(y0, v0) IS NOT NULL AND (v > 3 * coalesce(y0, v0) OR v * 3 < coalesce(y0, v0)) AS away FROM m),
e AS (SELECT *, sum(CASE WHEN away THEN 0 ELSE 1 END) OVER (PARTITION BY video_id, metric ORDER BY pos) AS isle FROM a),
l AS (SELECT *, sum(CASE WHEN away THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, metric, isle) AS len FROM e)
SELECT frame_id, metric FROM l
WHERE (bad OR n >= 6 OR (away AND len <= 3)) AND NOT (metric = 'optical_flow_mag' AND coalesce(x = 0, FALSE) AND frame_idx = 0)
"""

ORACLE = {"p3_found": _P3, "p4_found": _P4}
