"""Queries on pixels, and their SQL: bytes as lists of integers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.operators import emit, recon
from reelspark.plans.reference import _O, r6
from reelspark.session import table
from reelspark.sources.frames import clean_outputs

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _bytes(blob: str) -> str:
    return f"list_transform(range(0, octet_length({blob})), lambda i: CAST('0x' || substr(hex({blob}), 2 * i + 1, 2) AS INT))"


def _hex(values: str) -> str:
    return f"array_to_string(list_transform({values}, lambda x: printf('%02X', CAST(x AS INT))), '')"


_AT = lambda y, x: f"g[1 + ({y}) * w + ({x})]"
_UP, _DOWN = "CASE WHEN k // w = 0 THEN least(1, h - 1) ELSE k // w - 1 END", "CASE WHEN k // w = h - 1 THEN greatest(h - 2, 0) ELSE k // w + 1 END"
_LEFT, _RIGHT = "CASE WHEN k % w = 0 THEN least(1, w - 1) ELSE k % w - 1 END", "CASE WHEN k % w = w - 1 THEN greatest(w - 2, 0) ELSE k % w + 1 END"
_LAP = f"{_AT(_UP, 'k % w')} + {_AT(_DOWN, 'k % w')} + {_AT('k // w', _LEFT)} + {_AT('k // w', _RIGHT)} - 4 * {_AT('k // w', 'k % w')}"


@query(f"""WITH f AS (SELECT frame_id, any_value(frame_data) AS d FROM native_frames WHERE frame_data IS NOT NULL GROUP BY frame_id),
p AS (SELECT frame_id, d.height AS h, d.width AS w, d.n_channels AS c, {_bytes('d.pixels')} AS b FROM f),
q AS (SELECT *, list_transform(range(0, h * w), lambda k: (3735 * b[1 + k * c] + 19235 * b[2 + k * c] + 9798 * b[3 + k * c] + 16384) // 32768) AS g FROM p)
SELECT frame_id, round(list_aggregate(list_transform(range(0, h * w), lambda k: CAST({_LAP} AS DOUBLE)), 'var_pop'), 6) AS blur_variance, {_hex('g')} AS gray,
  {_hex('list_transform(range(0, len(b)), lambda i: b[1 + (i // c) * c + (c - 1 - i % c)])')} AS rgb, CASE WHEN h > 224 AND w > 224 THEN 'area' ELSE 'lanczos4' END AS resize FROM q""")
def image_features(spark: SparkSession, sf: str) -> DataFrame:
    """Sharpness, grey and colour forms and resize rule of the frames that carry pixels."""
    f = table(spark, sf, "native_frames").where("frame_data IS NOT NULL").select("frame_id", "frame_data.*").dropDuplicates(["frame_id"])
    return f.select(
        "frame_id", r6(recon.sharpness("pixels", "height", "width", "n_channels")).alias("blur_variance"), F.hex(recon.to_gray("pixels", "height", "width", "n_channels")).alias("gray"),
        F.hex(recon.to_rgb("pixels", "n_channels")).alias("rgb"), recon.resize_rule(F.col("height"), F.col("width")).alias("resize"),
    )


@query(f"""WITH {_O}, b AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY slot) AS rn FROM o),
d AS (SELECT video_id, slot, rn, frame_data AS f, last_value(CASE WHEN frame_data IS NOT NULL THEN rn END IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p,
  first_value(CASE WHEN frame_data IS NOT NULL THEN rn END IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY slot ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS q FROM b),
s AS (SELECT video_id, arg_min(frame_data.height, slot) AS h, arg_min(frame_data.width, slot) AS w FROM o WHERE frame_data IS NOT NULL GROUP BY video_id),
x AS (SELECT d.*, s.h, s.w, bp.frame_data.pixels AS pp, bq.frame_data.pixels AS qp, (d.rn - d.p) / CAST(d.q - d.p AS DOUBLE) AS a FROM d LEFT JOIN s ON s.video_id = d.video_id
  LEFT JOIN b bp ON bp.video_id = d.video_id AND bp.rn = d.p LEFT JOIN b bq ON bq.video_id = d.video_id AND bq.rn = d.q)
SELECT video_id, slot, CASE WHEN f IS NOT NULL THEN hex(f.pixels) WHEN p IS NOT NULL AND q IS NOT NULL THEN
  {_hex(f"list_transform(list_zip({_bytes('pp')}, {_bytes('qp')}), lambda z: round_even((1 - a) * z[1] + a * z[2], 0))")}
  WHEN p IS NOT NULL THEN hex(pp) WHEN q IS NOT NULL THEN hex(qp) ELSE repeat('00', CAST(coalesce(h * w * 3, 0) AS INT)) END AS pixels FROM x""")
def pixel_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Every slot's picture: its own, a blend of its neighbours', a copy, or black."""
    plan = emit.blend_plan(clean_outputs(spark, sf).select("video_id", "slot", "frame_data"))
    pictures = clean_outputs(spark, sf, pixels=True).select("video_id", "slot", "frame_data")
    return recon.fill_pixels(pictures, plan).select("video_id", "slot", F.hex("pixels").alias("pixels"))


@query()
def motion(spark: SparkSession, sf: str) -> DataFrame:
    """Mean motion of each frame against the one before it, from the pixels of both."""
    f = table(spark, sf, "native_frames").where("video_id IS NOT NULL AND frame_idx IS NOT NULL").select("video_id", "frame_idx", "frame_data.*").dropDuplicates(["video_id", "frame_idx"])
    return recon.flow_with(f, size=(16, 12)).withColumn("optical_flow_mag", r6("optical_flow_mag"))
