"""Queries of the frame engine's own operators over the project's tables, each with SQL that states the same.

Vectors are compared through scalars (norms, single elements, similarities) rounded to six decimals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.config import Config
from reelspark.functions import entities as E
from reelspark.functions import vectors as V
from reelspark.operators import emit, grouping, recon, rolling
from reelspark.operators import score as S
from reelspark.operators import timeline as T
from reelspark.operators.ordering import neighbourhoods
from reelspark.plans import pipeline
from reelspark.session import table
from reelspark.sources.frames import clean_frames, clean_outputs, frame_times, resolve_fps
from reelspark.sources.sinks import telemetry

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def r6(c):
    return F.round(c, 6)


# sums of short decimals fall on rounding ties, which two engines break differently; this shift keeps off them
_OFF = 3.31e-8


def r6_off(c):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + F.lit(_OFF), 6)


# ---- SQL pieces ----------------------------------------------------------------------------------------------------

_F = """f AS (SELECT video_id, frame_idx, max(frame_id) AS frame_id, max(ts) AS ts, max(blur_variance) AS blur, max(optical_flow_mag) AS flow,
  any_value(clip_emb) AS clip_emb, any_value(dino_emb) AS dino_emb, arg_max(entities, coalesce(len(entities), -1)) AS entities
  FROM native_frames WHERE video_id IS NOT NULL AND frame_idx IS NOT NULL AND clip_emb IS NOT NULL
  AND ts IS NOT NULL AND NOT isnan(ts) AND ts >= 0 AND NOT isinf(ts)
  AND blur_variance IS NOT NULL AND NOT isnan(blur_variance) AND blur_variance >= 0 AND NOT isinf(blur_variance)
  AND optical_flow_mag IS NOT NULL AND NOT isnan(optical_flow_mag) AND optical_flow_mag >= 0 AND NOT isinf(optical_flow_mag)
  GROUP BY video_id, frame_idx)"""
_STRIDE, _HALF = "CAST(0.04166666666 AS DOUBLE)", "CAST(0.08333333333 AS DOUBLE) / 2"
_K = f"""k AS (SELECT video_id, slot, slot * {_STRIDE} AS target_ts FROM (
  SELECT video_id, m, unnest(range(0, greatest(0, CAST(floor(m / {_STRIDE}) AS BIGINT) + 2))) AS slot FROM (SELECT video_id, max(ts) AS m FROM f GROUP BY video_id))
  WHERE slot * {_STRIDE} + {_HALF} <= m)"""
_C = f"""c AS (SELECT k.video_id, k.slot, f.frame_idx, f.frame_id, f.ts, f.blur, f.flow, f.clip_emb, f.dino_emb, f.entities
  FROM k JOIN f ON f.video_id = k.video_id AND f.ts >= k.target_ts - {_HALF} AND f.ts < k.target_ts + {_HALF})"""
_O = """o AS (SELECT video_id, slot, max(target_timestamp) AS target_timestamp, max(native_timestamp) AS native_timestamp, any_value(clip_emb) AS clip_emb,
  any_value(dino_emb) AS dino_emb, any_value(scores) AS scores, any_value(frame_data) AS frame_data, max(native_timestamp) IS NOT NULL AS real
  FROM output_frames WHERE video_id IS NOT NULL AND slot IS NOT NULL GROUP BY video_id, slot)"""
_N = """n0 AS (SELECT node_id, max(video_id) AS video_id, max(frame_index) AS frame_index, max(token_cost) AS tc, any_value(scores) AS scores,
  any_value(entities) AS entities, any_value(subtitles) AS subs, any_value(embedding) AS e FROM frame_nodes WHERE node_id IS NOT NULL GROUP BY node_id),
n AS (SELECT node_id, video_id, frame_index, coalesce(tc, 30.0) AS token_cost, scores, entities,
  coalesce(list_filter(subs, lambda x: x IS NOT NULL AND trim(x) <> ''), []) AS subtitles,
  CASE WHEN e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x))) = 0 THEN e END AS embedding FROM n0)"""


def _vec(v: str) -> str:
    """A vector's elements to five digits as text."""
    return f"array_to_string(list_transform({v}, lambda z: CAST(round((z + {_OFF}) * 100000) AS BIGINT)), ',')"


def vec(c):
    return F.array_join(F.transform(c, lambda z: F.round((z + F.lit(_OFF)) * 100000).cast("bigint").cast("string")), ",")


def _sc(key: str, m: str = "scores") -> str:
    return f"coalesce({m}['{key}'], 0.0)"


def _norm(v: str) -> str:
    return f"sqrt(list_inner_product({v}, {v}))"


def _dist(a: str, b: str) -> str:
    return (
        f"CASE WHEN {a} IS NULL OR {b} IS NULL OR {_norm(a)} < 1e-8 OR {_norm(b)} < 1e-8 THEN 0.0 "
        f"ELSE 1 - list_inner_product({a}, {b}) / ({_norm(a)} * {_norm(b)}) END"
    )


def _simg(a: str, b: str) -> str:
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN 0.0 ELSE 1 - ({_dist(a, b)}) END"


# ---- sources and timeline ------------------------------------------------------------------------------------------


@query("""SELECT video_id, CAST(CASE WHEN cf > 0 AND ov IS NULL THEN cf ELSE coalesce(nullif(ov, 0.0), 30.0) END AS DOUBLE) AS fps FROM (
SELECT DISTINCT video_id, CASE video_id % 3 WHEN 0 THEN 25.0 WHEN 1 THEN 0.0 END AS cf, CASE video_id % 5 WHEN 0 THEN 24.0 WHEN 1 THEN 0.0 END AS ov FROM native_frames WHERE video_id IS NOT NULL)""")
def fps_rule(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "native_frames").where("video_id IS NOT NULL").select("video_id").distinct()
    container = F.when(F.col("video_id") % 3 == 0, F.lit(25.0)).when(F.col("video_id") % 3 == 1, F.lit(0.0))
    override = F.when(F.col("video_id") % 5 == 0, F.lit(24.0)).when(F.col("video_id") % 5 == 1, F.lit(0.0))
    return v.select("video_id", resolve_fps(container, override).alias("fps"))


@query("SELECT DISTINCT video_id, frame_idx, round(frame_idx / 25.0, 6) AS ts FROM native_frames WHERE video_id IS NOT NULL AND frame_idx IS NOT NULL")
def ingest_timestamps(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "native_frames").where("video_id IS NOT NULL AND frame_idx IS NOT NULL").select("video_id", "frame_idx").distinct()
    return frame_times(f, F.lit(25.0), F.lit(None).cast("double")).withColumn("ts", r6("ts"))


@query(f"WITH {_F}, {_K}, {_C} SELECT video_id, slot, frame_idx FROM c")
def range_join_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return T.candidates(clean_frames(spark, sf).select("video_id", "frame_idx", "ts")).select("video_id", "slot", "frame_idx")


@query(f"WITH {_F}, {_K}, {_C} SELECT k.video_id, k.slot, count(c.frame_idx) AS n_candidates, count(c.frame_idx) = 0 AS is_synthetic FROM k LEFT JOIN c ON c.video_id = k.video_id AND c.slot = k.slot GROUP BY k.video_id, k.slot")
def slot_empty_flag(spark: SparkSession, sf: str) -> DataFrame:
    return T.slot_flags(clean_frames(spark, sf).select("video_id", "frame_idx", "ts"))


@query(f"WITH {_F}, {_K}, {_C} SELECT video_id, slot, count(*) AS n_candidates, arg_max(frame_idx, {{'b': blur, 't': -ts, 'i': -frame_idx}}) AS frame_idx FROM c GROUP BY video_id, slot")
def best_by_sharpness(spark: SparkSession, sf: str) -> DataFrame:
    c = T.candidates(clean_frames(spark, sf).select("video_id", "frame_idx", "ts", "blur"))
    order = F.struct("blur", (-F.col("ts")).alias("t"), (-F.col("frame_idx")).alias("i"))
    return c.groupBy("video_id", "slot").agg(F.count(F.lit(1)).alias("n_candidates"), F.max_by("frame_idx", order).alias("frame_idx"))


# ---- vectors -------------------------------------------------------------------------------------------------------


@query(f"WITH {_F}, u AS (SELECT frame_id, clip_emb AS v, {_norm('clip_emb')} + 1e-8 AS n FROM f) SELECT frame_id, {_vec('list_transform(v, lambda e: e / n)')} AS unit FROM u")
def l2_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return clean_frames(spark, sf).select("frame_id", vec(V.l2_normalize(F.col("clip_emb"))).alias("unit"))


@query(f"""WITH {_F}, v AS (SELECT frame_id, list_concat(clip_emb, clip_emb[1:32]) AS w, clip_emb[1:24] AS s FROM f),
n AS (SELECT frame_id, w, s, {_norm('w')} + 1e-8 AS nw, {_norm('s')} + 1e-8 AS ns FROM v)
SELECT frame_id, {_vec('list_transform(w, lambda e: e / nw)')} AS wide, {_vec('list_transform(s, lambda e: e / ns)')} AS short FROM n""")
def vector_resize(spark: SparkSession, sf: str) -> DataFrame:
    return clean_frames(spark, sf).select("frame_id", vec(V.vector_resize(F.col("clip_emb"), 96)).alias("wide"), vec(V.vector_resize(F.col("clip_emb"), 24)).alias("short"))


def _neighbours(nodes: DataFrame) -> DataFrame:
    rows, w = neighbourhoods(nodes.select("video_id", "frame_index", "node_id", "embedding"), ["frame_index", "node_id"], 1)
    return rows.withColumn("before", F.lag("embedding").over(w)).where("core")


def _pair_sql(expr: str) -> str:
    return f"WITH {_N}, p AS (SELECT node_id, embedding AS a, lag(embedding) OVER (PARTITION BY video_id ORDER BY frame_index, node_id) AS b FROM n) SELECT node_id, round({expr}, 6) AS value FROM p"


@query(_pair_sql(_dist("a", "b")))
def cosine_distance(spark: SparkSession, sf: str) -> DataFrame:
    n = _neighbours(grouping.build_nodes(table(spark, sf, "frame_nodes")))
    return n.select("node_id", r6(V.cosine_distance(F.col("embedding"), F.col("before"))).alias("value"))


@query(_pair_sql(_simg("a", "b")))
def cosine_grouping(spark: SparkSession, sf: str) -> DataFrame:
    n = _neighbours(grouping.build_nodes(table(spark, sf, "frame_nodes")))
    return n.select("node_id", r6(V.similarity_grouping(F.col("embedding"), F.col("before"))).alias("value"))


@query(_pair_sql(f"CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN {_norm('a')} = 0 OR {_norm('b')} = 0 THEN 0.0 ELSE list_inner_product(a, b) / ({_norm('a')} * {_norm('b')}) END"))
def cosine_strict(spark: SparkSession, sf: str) -> DataFrame:
    n = _neighbours(grouping.build_nodes(table(spark, sf, "frame_nodes")))
    return n.select("node_id", r6(V.similarity_strict(F.col("embedding"), F.col("before"))).alias("value"))


_V5 = f"CASE WHEN {_norm('a.clip_emb')} = 0 OR {_norm('b.clip_emb')} = 0 THEN 0.0 ELSE list_inner_product(a.clip_emb, b.clip_emb) / ({_norm('a.clip_emb')} * {_norm('b.clip_emb')}) END"


@query(f"""WITH {_F}, {_K}, {_C} SELECT a.video_id, a.slot, a.frame_idx, b.frame_idx AS other_idx, round({_V5}, 6) + 0.0 AS similarity
FROM c a JOIN c b ON a.video_id = b.video_id AND a.slot = b.slot""")
def cosine_matrix(spark: SparkSession, sf: str) -> DataFrame:
    c = T.candidates(clean_frames(spark, sf).select("video_id", "frame_idx", "ts", "clip_emb"))
    return S.cosine_matrix(c, "clip_emb").withColumn("similarity", r6("similarity") + F.lit(0.0))


_HATS = ", ".join(f"{_sc(k)} AS {k}" for k in ("semantic", "blur", "motion", "entity", "consistency", "diversity", "gate"))


@query(f"WITH {_O}, s AS (SELECT video_id, slot, {_HATS} FROM o) SELECT video_id, slot, round(least(2.0, greatest(0.0, (semantic - 0.4) / (((0.4 + abs(blur)) - 0.4) + 0.00001))), 6) AS value FROM s")
def clip_norm(spark: SparkSession, sf: str) -> DataFrame:
    o = clean_outputs(spark, sf).select("video_id", "slot", V.score(F.col("scores"), "semantic").alias("a"), V.score(F.col("scores"), "blur").alias("b"))
    return o.select("video_id", "slot", r6(V.clip_norm(F.col("a"), F.lit(0.4), F.lit(0.4) + F.abs("b"))).alias("value"))


@query(f"WITH {_O}, s AS (SELECT video_id, slot, {_HATS} FROM o) SELECT video_id, slot, round(1 / (1 + exp(-greatest(-30.0, least(30.0, (semantic - blur) / (gate + 0.00001))))), 6) AS value FROM s")
def sigmoid_gate(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("scores")
    return clean_outputs(spark, sf).select("video_id", "slot", r6(V.sigmoid_gate(V.score(s, "semantic"), V.score(s, "blur"), V.score(s, "gate"))).alias("value"))


# ---- trackers and terms --------------------------------------------------------------------------------------------

_ROLL = f"""WITH {_F}, {_K}, {_C},
r AS (SELECT video_id, slot, frame_idx, ts, blur, flow, clip_emb, row_number() OVER w AS pos, list(blur) OVER w120 AS lb, list(flow) OVER w120 AS lf FROM c
  WINDOW w AS (PARTITION BY video_id ORDER BY slot, ts, frame_idx), w120 AS (PARTITION BY video_id ORDER BY slot, ts, frame_idx ROWS BETWEEN 119 PRECEDING AND CURRENT ROW)),
p AS (SELECT video_id, slot, frame_idx, ts, blur, flow, clip_emb, list_sort(last_value(lb) OVER s) AS sb, list_sort(last_value(lf) OVER s) AS sf FROM r
  WINDOW s AS (PARTITION BY video_id, slot ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
q AS (SELECT *, sb[1 + CAST(floor(0.25 * (len(sb) - 1)) AS INT)] AS b25, sb[1 + CAST(floor(0.75 * (len(sb) - 1)) AS INT)] AS b75,
  sf[1 + CAST(floor(0.25 * (len(sf) - 1)) AS INT)] AS m25, sf[1 + CAST(floor(0.75 * (len(sf) - 1)) AS INT)] AS m75 FROM p)"""
_QHAT = "least(2.0, greatest(0.0, (blur - b25) / ((b75 - b25) + CAST(0.00001 AS DOUBLE))))"
_MHAT = "least(2.0, greatest(0.0, (flow - m25) / ((m75 - m25) + CAST(0.00001 AS DOUBLE))))"


def _cands(spark: SparkSession, sf: str, *extra: str) -> DataFrame:
    return T.candidates(clean_frames(spark, sf).select("video_id", "frame_idx", "ts", "blur", "flow", *extra))


@query(_ROLL + " SELECT video_id, slot, frame_idx, round(b25, 6) AS p25, round(b75, 6) AS p75 FROM q")
def rolling_percentile(spark: SparkSession, sf: str) -> DataFrame:
    p = rolling.rolling_percentiles(_cands(spark, sf), ["blur"])
    return p.select("video_id", "slot", "frame_idx", r6("blur_p25").alias("p25"), r6("blur_p75").alias("p75"))


@query(_ROLL + f" SELECT video_id, slot, frame_idx, round({_QHAT}, 6) AS q_hat FROM q")
def q_hat(spark: SparkSession, sf: str) -> DataFrame:
    return rolling.normalised(_cands(spark, sf), {"blur": "q_hat"}).select("video_id", "slot", "frame_idx", r6("q_hat").alias("q_hat"))


@query(_ROLL + f" SELECT video_id, slot, frame_idx, round({_MHAT}, 6) AS m_hat FROM q")
def m_hat(spark: SparkSession, sf: str) -> DataFrame:
    return rolling.normalised(_cands(spark, sf), {"flow": "m_hat"}).select("video_id", "slot", "frame_idx", r6("m_hat").alias("m_hat"))


@query(f"""WITH {_F}, {_K}, {_C}, n AS (SELECT video_id, slot, count(*) AS n FROM c GROUP BY ALL),
d AS (SELECT a.video_id, a.slot, a.frame_idx, max(1 - ({_dist('a.clip_emb', 'b.clip_emb')})) AS d FROM c a JOIN c b ON a.video_id = b.video_id AND a.slot = b.slot AND a.frame_idx <> b.frame_idx GROUP BY ALL)
SELECT c.video_id, c.slot, c.frame_idx, round(CASE WHEN n.n >= 3 THEN coalesce(d.d, 0.0) ELSE 0.0 END, 6) AS d_val
FROM c JOIN n ON n.video_id = c.video_id AND n.slot = c.slot LEFT JOIN d ON d.video_id = c.video_id AND d.slot = c.slot AND d.frame_idx = c.frame_idx""")
def d_val(spark: SparkSession, sf: str) -> DataFrame:
    return S.diversity(_cands(spark, sf, "clip_emb"), "clip_emb").withColumn("d_val", r6("d_val"))


@query(f"""WITH RECURSIVE {_F}, p AS (SELECT video_id, frame_idx, blur, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) AS i FROM f),
e AS (SELECT video_id, frame_idx, i, blur AS s FROM p WHERE i = 1 UNION ALL SELECT p.video_id, p.frame_idx, p.i, 0.3 * p.blur + 0.7 * e.s FROM e JOIN p ON p.video_id = e.video_id AND p.i = e.i + 1)
SELECT video_id, frame_idx, round(s + {_OFF}, 6) AS ewma FROM e""")
def ewma_scalar(spark: SparkSession, sf: str) -> DataFrame:
    f = clean_frames(spark, sf).select("video_id", "frame_idx", "blur")
    return rolling.ewma_scalar(f, "blur").select("video_id", "frame_idx", r6_off("ewma").alias("ewma"))


@query(f"""WITH RECURSIVE {_F}, p AS (SELECT video_id, frame_idx, clip_emb AS v, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) AS i FROM f),
e AS (SELECT video_id, frame_idx, i, v FROM p WHERE i = 1 UNION ALL
  SELECT p.video_id, p.frame_idx, p.i, list_transform(list_zip(p.v, e.v), lambda z: 0.3 * z[1] + 0.7 * z[2]) FROM e JOIN p ON p.video_id = e.video_id AND p.i = e.i + 1)
SELECT video_id, frame_idx, {_vec('v')} AS ewma FROM e""")
def ewma_vector(spark: SparkSession, sf: str) -> DataFrame:
    e = rolling.ewma_vector(clean_frames(spark, sf).select("video_id", "frame_idx", "clip_emb"), "clip_emb")
    return e.select("video_id", "frame_idx", vec(F.col("ewma")).alias("ewma"))


@query(f"""WITH {_F}, u AS (SELECT video_id, frame_idx, list_transform(clip_emb, lambda x: x / ({_norm('clip_emb')} + 1e-8)) AS v FROM f),
s AS (SELECT a.video_id, a.frame_idx, list_inner_product(a.v, b.v) AS s, row_number() OVER (PARTITION BY a.video_id, a.frame_idx ORDER BY list_inner_product(a.v, b.v) DESC) AS r
  FROM u a JOIN u b ON a.video_id = b.video_id AND b.frame_idx < a.frame_idx),
t AS (SELECT video_id, frame_idx, greatest(0.0, 1 - avg(s)) AS nov FROM s WHERE r <= 5 GROUP BY ALL)
SELECT u.video_id, u.frame_idx, round(coalesce(t.nov, 1.0), 6) AS novelty FROM u LEFT JOIN t ON t.video_id = u.video_id AND t.frame_idx = u.frame_idx""")
def topk_novelty(spark: SparkSession, sf: str) -> DataFrame:
    n = rolling.topk_novelty(clean_frames(spark, sf).select("video_id", "frame_idx", "clip_emb"), "clip_emb")
    return n.withColumn("novelty", r6("novelty"))


# ---- entities ------------------------------------------------------------------------------------------------------

_PREV = "x AS (SELECT video_id, frame_idx, frame_id, coalesce(entities, []) AS e, coalesce(lag(entities) OVER (PARTITION BY video_id ORDER BY frame_idx), []) AS p FROM f)"


def _entity_pairs(spark: SparkSession, sf: str) -> DataFrame:
    f, w = neighbourhoods(clean_frames(spark, sf).select("video_id", "frame_idx", "frame_id", "entities"), ["frame_idx"], 1)
    empty = F.array().cast(f.schema["entities"].dataType)
    pairs = f.withColumn("p", F.coalesce(F.lag("entities").over(w), empty)).withColumn("e", F.coalesce("entities", empty))
    return pairs.where("core").select("frame_id", "p", "e")


@query(f"""WITH {_F}, {_PREV}, b AS (SELECT frame_id, p[1].bbox AS a, e[1].bbox AS b FROM x WHERE len(p) > 0 AND len(e) > 0),
t AS (SELECT frame_id, greatest(0.0, least(a[3], b[3]) - greatest(a[1], b[1])) * greatest(0.0, least(a[4], b[4]) - greatest(a[2], b[2])) AS i,
  greatest(0.0, a[3] - a[1]) * greatest(0.0, a[4] - a[2]) + greatest(0.0, b[3] - b[1]) * greatest(0.0, b[4] - b[2]) AS s FROM b)
SELECT frame_id, round(CASE WHEN s - i > 0 THEN i / (s - i + 1e-8) ELSE 0.0 END, 6) AS iou FROM t""")
def bbox_iou(spark: SparkSession, sf: str) -> DataFrame:
    d = _entity_pairs(spark, sf).where("size(p) > 0 AND size(e) > 0")
    return d.select("frame_id", r6(E.iou(F.col("p")[0]["bbox"], F.col("e")[0]["bbox"])).alias("iou"))


@query(f"""WITH {_F}, {_PREV}, s AS (SELECT frame_id, list_distinct(list_transform(p, lambda z: z.class_id)) AS p, list_distinct(list_transform(e, lambda z: z.class_id)) AS e FROM x)
SELECT frame_id, round(CASE WHEN len(p) = 0 AND len(e) = 0 THEN 0.0 WHEN len(p) = 0 OR len(e) = 0 THEN 1.0
  ELSE 1 - len(list_intersect(p, e)) / (len(list_distinct(list_concat(p, e))) + 0.00001) END, 6) AS delta FROM s""")
def entity_delta_set(spark: SparkSession, sf: str) -> DataFrame:
    d = _entity_pairs(spark, sf)
    ids = lambda c: F.transform(c, lambda x: x["class_id"])
    return d.select("frame_id", r6(E.delta_set(ids(F.col("p")), ids(F.col("e")))).alias("delta"))


def _iou(a: str, b: str) -> str:
    side = lambda box, i, j: f"greatest(0.0, {box}[{j}] - {box}[{i}])"
    inter = f"(greatest(0.0, least({a}[3], {b}[3]) - greatest({a}[1], {b}[1])) * greatest(0.0, least({a}[4], {b}[4]) - greatest({a}[2], {b}[2])))"
    union = f"({side(a, 1, 3)} * {side(a, 2, 4)} + {side(b, 1, 3)} * {side(b, 2, 4)} - {inter})"
    return f"CASE WHEN {union} > 0 THEN {inter} / ({union} + 1e-8) ELSE 0.0 END"


def _greedy(source: str, name: str = "delta") -> str:
    """CTEs g0 ... over ``source`` (id, p, e): the share of detections that a greedy matching leaves, as ``delta`` of table ``name``."""
    free = "list_contains(used, j) OR e[j].class_id IS DISTINCT FROM p[k + 1].class_id"
    return f"""g1 AS (SELECT id, p, e, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS used FROM {source} WHERE len(p) > 0 AND len(e) > 0
  UNION ALL SELECT id, p, e, k + 1, CASE WHEN list_max(o) > 0.3 THEN list_append(used, list_position(o, list_max(o))) ELSE used END
  FROM (SELECT *, list_transform(range(1, len(e) + 1), lambda j: CASE WHEN {free} THEN 0.0 ELSE {_iou('p[k + 1].bbox', 'e[j].bbox')} END) AS o FROM g1 WHERE k < len(p))),
{name} AS (SELECT s.id, CASE WHEN len(s.p) = 0 AND len(s.e) = 0 THEN 0.0 WHEN len(s.p) = 0 OR len(s.e) = 0 THEN 1.0
  ELSE 1 - len(g1.used) / (greatest(len(s.p), len(s.e)) + 0.00001) END AS delta FROM {source} s LEFT JOIN g1 ON g1.id = s.id AND g1.k = len(s.p))"""


@query(f"WITH RECURSIVE {_F}, {_PREV}, xi AS (SELECT frame_id AS id, p, e FROM x), {_greedy('xi')} SELECT id AS frame_id, round(delta, 6) AS delta FROM delta")
def entity_delta_greedy(spark: SparkSession, sf: str) -> DataFrame:
    return _entity_pairs(spark, sf).select("frame_id", r6(E.delta_greedy(F.col("p"), F.col("e"))).alias("delta"))


@query(f"WITH {_F} SELECT frame_id, len(list_filter(coalesce(entities, []), lambda z: z.confidence >= 0.35)) AS n FROM f")
def detection_filter(spark: SparkSession, sf: str) -> DataFrame:
    return clean_frames(spark, sf).select("frame_id", F.size(recon.detections_above(F.col("entities"))).cast("bigint").alias("n"))


# ---- scores and selection ------------------------------------------------------------------------------------------

_GATE = "1 / (1 + exp(-greatest(-30.0, least(30.0, (semantic - 0.5) / (0.25 + 0.00001)))))"


@query(f"""WITH {_O}, s AS (SELECT video_id, slot, {_HATS} FROM o), t AS (SELECT *, {_GATE} AS g FROM s)
SELECT video_id, slot, round(g * (0.3125 * semantic + 0.25 * motion + 0.125 * entity) + (1 - g) * (0.15625 * blur + 0.25 * motion + 0.125 * entity) - (0.09375 * consistency + 0.0625 * diversity), 6) AS total, round(g, 6) AS gate FROM t""")
def composite_score(spark: SparkSession, sf: str) -> DataFrame:
    o = clean_outputs(spark, sf)
    h = [V.score(F.col("scores"), k) for k in ("semantic", "blur", "motion", "entity", "consistency", "diversity")]
    c = S.composite(*h, F.lit(0.5), F.lit(0.25))
    return o.select("video_id", "slot", r6(c["total"]).alias("total"), r6(c["gate"]).alias("gate"))


@query(_ROLL + f""", t AS (SELECT *, round(0.5 * {_QHAT} + 0.8 * {_MHAT}, 9) AS total FROM q)
SELECT video_id, slot, arg_max(frame_idx, {{'b': total, 't': -ts, 'i': -frame_idx}}) AS frame_idx, round(max(total), 6) AS best FROM t GROUP BY video_id, slot""")
def argmax_select(spark: SparkSession, sf: str) -> DataFrame:
    c = rolling.normalised(_cands(spark, sf), {"blur": "q_hat", "flow": "m_hat"})
    scored = c.withColumn("total", F.round(0.5 * F.col("q_hat") + 0.8 * F.col("m_hat"), 9))
    return S.argmax_select(scored, "total").withColumn("best", r6("best"))


_H = ", ".join(f"CASE WHEN row_number() OVER w > {k} THEN lag(dino_emb, {k}) OVER w ELSE first_value(dino_emb) OVER w END AS h{k}" for k in (1, 5, 10))


@query(f"""WITH {_O}, h AS (SELECT video_id, slot, dino_emb AS v, row_number() OVER w AS rn, {_H} FROM o WINDOW w AS (PARTITION BY video_id ORDER BY slot))
SELECT video_id, slot, round(CASE WHEN rn = 1 THEN 0.0 ELSE 0.6 * ({_dist('v', 'h1')}) + 0.3 * ({_dist('v', 'h5')}) + 0.1 * ({_dist('v', 'h10')}) END, 6) + 0.0 AS c_val FROM h""")
def continuity_given_history(spark: SparkSession, sf: str) -> DataFrame:
    return emit.continuity(clean_outputs(spark, sf)).withColumn("c_val", r6("c_val"))


@query()
def selection_fold(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: one selected frame or synthetic mark per slot of every video."""
    s = pipeline.select(clean_frames(spark, sf), Config(clip_dim=64, dino_dim=16))
    return s.select("video_id", "slot", "frame_idx", "is_synthetic", *[r6(F.try_element_at("scores", F.lit(k))).alias(k) for k in ("semantic", "entity", "consistency", "total")])


@query()
def pipeline_outputs(spark: SparkSession, sf: str) -> DataFrame:
    """Selection, gap filling, holding and smoothing end to end: telemetry of every slot."""
    out = pipeline.outputs(clean_frames(spark, sf), Config(clip_dim=64, dino_dim=16))
    return telemetry(out, "kind").drop("scores")


# ---- emission ------------------------------------------------------------------------------------------------------

def _gaps(source: str, name: str = "g") -> str:
    return f"""g1 AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY video_id) AS n, lag(real) OVER w AS was FROM {source} WINDOW w AS (PARTITION BY video_id ORDER BY slot)),
g2 AS (SELECT *, last_value(CASE WHEN real THEN rn END IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pr,
  first_value(CASE WHEN real THEN rn END IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nr FROM g1),
{name} AS (SELECT *, NOT real AND pr IS NOT NULL AND nr IS NOT NULL AND nr - pr - 1 <= 2 AS fill, NOT real AND rn > greatest(1, n - 2) AND coalesce(was, FALSE) AS hold FROM g2)"""


_G = f"WITH {_O}, {_gaps('o')}"


@query(_G + " SELECT video_id, slot, CASE WHEN real THEN 'R' WHEN hold THEN 'H' WHEN fill THEN 'L' ELSE 'Z' END AS kind FROM g")
def gap_fill_kind(spark: SparkSession, sf: str) -> DataFrame:
    return emit.gap_kinds(clean_outputs(spark, sf).select("video_id", "slot", "real")).select("video_id", "slot", "kind")


@query(_G + f""", l AS (SELECT g.video_id, g.slot, (g.rn - g.pr) / (g.nr - g.pr - 1 + 1.0) AS a, p.clip_emb AS p, q.clip_emb AS q FROM g
  JOIN g p ON p.video_id = g.video_id AND p.rn = g.pr JOIN g q ON q.video_id = g.video_id AND q.rn = g.nr WHERE g.fill AND NOT g.hold),
m AS (SELECT video_id, slot, a, list_transform(list_zip(p, q), lambda z: (1 - a) * z[1] + a * z[2]) AS v FROM l)
SELECT video_id, slot, round(a, 6) AS alpha, {_vec(f"CASE WHEN {_norm('v')} > 1e-8 THEN list_transform(v, lambda e: e / {_norm('v')}) ELSE v END")} AS vector FROM m""")
def gap_lerp(spark: SparkSession, sf: str) -> DataFrame:
    o = emit.filled(clean_outputs(spark, sf).select("video_id", "slot", "real", "clip_emb", "scores"), ("clip_emb",))
    return o.where("kind = 'L'").select("video_id", "slot", r6("alpha").alias("alpha"), vec(F.col("clip_emb")).alias("vector"))


@query(f"""WITH {_O}, l AS (SELECT *, lag(real) OVER (PARTITION BY video_id ORDER BY slot) AS w FROM o), e AS (SELECT video_id, max(slot) AS z FROM l WHERE w AND NOT real GROUP BY video_id),
c AS (SELECT o.* FROM o JOIN e ON e.video_id = o.video_id AND o.slot <= e.z), {_gaps('c')}
SELECT g.video_id, g.slot, {_vec('p.clip_emb')} AS vector FROM g JOIN g p ON p.video_id = g.video_id AND p.rn = g.rn - 1 WHERE g.hold""")
def hold_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Held slots of each video as if its stream ended with its last slot that a hold can fill."""
    o = clean_outputs(spark, sf).select("video_id", "slot", "real", "clip_emb", "scores")
    rows, w = neighbourhoods(o.select("video_id", "slot", "real"), ["slot"], 1)
    ends = rows.withColumn("was", F.lag("real").over(w)).where("core AND was AND NOT real").groupBy("video_id").agg(F.max("slot").alias("z"))
    cut = o.join(ends, "video_id").where("slot <= z").drop("z")
    return emit.filled(cut, ("clip_emb",)).where("kind = 'H'").select("video_id", "slot", vec(F.col("clip_emb")).alias("vector"))


def _five(f) -> str:
    return " + ".join(f(v) for v in ("p2", "p1", "v", "l1", "l2"))


_UNIT = _five(lambda v: f"coalesce({v}[i] / (n{v} + 1e-8), 0.0)")
_MIX = " + ".join(f"coalesce({t:.11f} * {v}[i], 0.0)" for t, v in zip(emit.TAPS, ("p2", "p1", "v", "l1", "l2")))


@query(f"""WITH RECURSIVE {_O}, r AS (SELECT video_id, slot, clip_emb AS v, lead(clip_emb) OVER w AS l1, lead(clip_emb, 2) OVER w AS l2, row_number() OVER w AS rn, count(*) OVER (PARTITION BY video_id) AS n
  FROM o WHERE clip_emb IS NOT NULL WINDOW w AS (PARTITION BY video_id ORDER BY slot)),
s AS (SELECT video_id, slot, rn, v AS y, CAST(NULL AS DOUBLE[]) AS y1, FALSE AS smoothed FROM r WHERE rn = 1 UNION ALL
  SELECT video_id, slot, rn, CASE WHEN hit THEN list_transform(mix, lambda m: m / (sqrt(list_inner_product(mix, mix)) + 1e-8)) ELSE v END, p1, hit
  FROM (SELECT *, coalesce(able AND list_inner_product(total, total) / 25 > 0.85, FALSE) AS hit FROM (SELECT *, list_transform(range(1, len(v) + 1), lambda i: {_UNIT}) AS total,
    list_transform(range(1, len(v) + 1), lambda i: {_MIX}) AS mix
    FROM (SELECT r.*, s.y AS p1, s.y1 AS p2, r.rn >= 3 AND r.rn <= r.n - 2 AS able, {", ".join(f"sqrt(list_inner_product({v}, {v})) AS n{k}" for v, k in (("s.y1", "p2"), ("s.y", "p1"), ("r.v", "v"), ("r.l1", "l1"), ("r.l2", "l2")))}
      FROM s JOIN r ON r.video_id = s.video_id AND r.rn = s.rn + 1))))
SELECT video_id, slot, smoothed, {_vec('y')} AS vector FROM s""")
def smoothing(spark: SparkSession, sf: str) -> DataFrame:
    o = clean_outputs(spark, sf).where("clip_emb IS NOT NULL").select("video_id", "slot", "clip_emb")
    return emit.smoothed(o).select("video_id", "slot", "smoothed", vec(F.col("clip_emb")).alias("vector"))


@query(f"""WITH {_O}, b AS (SELECT video_id, slot, frame_data IS NOT NULL AS h, row_number() OVER (PARTITION BY video_id ORDER BY slot) AS rn FROM o),
d AS (SELECT *, last_value(CASE WHEN h THEN rn END IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p,
  first_value(CASE WHEN h THEN rn END IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY slot ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS q FROM b)
SELECT video_id, slot, CASE WHEN h THEN 'own' WHEN p IS NOT NULL AND q IS NOT NULL THEN 'blend' WHEN p IS NOT NULL THEN 'copy_prev' WHEN q IS NOT NULL THEN 'copy_next' ELSE 'black' END AS how,
  CASE WHEN NOT h AND p IS NOT NULL AND q IS NOT NULL THEN round((rn - p) / CAST(q - p AS DOUBLE), 6) END AS alpha,
  coalesce((SELECT slot FROM b b2 WHERE b2.video_id = d.video_id AND b2.rn = d.p), slot) AS prev_slot, coalesce((SELECT slot FROM b b2 WHERE b2.video_id = d.video_id AND b2.rn = d.q), slot) AS next_slot FROM d""")
def pixel_blend_plan(spark: SparkSession, sf: str) -> DataFrame:
    return emit.blend_plan(clean_outputs(spark, sf).select("video_id", "slot", "frame_data")).withColumn("alpha", r6("alpha"))


@query(f"WITH {_O} SELECT video_id, arg_min(frame_data.height, slot) AS height, arg_min(frame_data.width, slot) AS width FROM o WHERE frame_data IS NOT NULL GROUP BY video_id")
def output_size(spark: SparkSession, sf: str) -> DataFrame:
    return recon.output_size(clean_outputs(spark, sf).select("video_id", "slot", "frame_data"))


@query(f"WITH {_O} SELECT video_id, count(*) AS n_slots, count(*) FILTER (WHERE NOT real) AS n_synthetic, CAST(floor(count(*) / 30) AS BIGINT) AS progress_marks FROM o GROUP BY video_id")
def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    return recon.run_summary(clean_outputs(spark, sf).select("video_id", "slot", "real"))


@query(f"WITH {_O} SELECT video_id, slot, round(target_timestamp, 6) AS target, round(native_timestamp, 6) AS native, NOT real AS is_synthetic, round(scores['total'], 6) AS total FROM o")
def score_telemetry(spark: SparkSession, sf: str) -> DataFrame:
    t = telemetry(clean_outputs(spark, sf))
    return t.select("video_id", "slot", r6("target").alias("target"), r6("native").alias("native"), "is_synthetic", r6(F.try_element_at("scores", F.lit("total"))).alias("total"))


@query("""WITH v AS (SELECT DISTINCT cluster_id, frame_count / CAST(24.0 AS DOUBLE) AS video, CASE WHEN cluster_id % 7 = 0 THEN NULL ELSE (cluster_id % 11) * 0.9 + 0.3 END AS audio FROM clips),
d AS (SELECT *, abs(video - audio) AS drift, CASE WHEN video > 0 THEN audio / video ELSE 1.0 END AS r FROM v),
n AS (SELECT *, CASE WHEN audio IS NULL OR drift <= 0.1 THEN 0 WHEN r < 0.5 THEN CAST(ceil(ln(r) / ln(0.5)) AS BIGINT) ELSE 1 END AS n FROM d)
SELECT cluster_id, round(drift, 6) AS drift, n AS n_filters, round(CASE WHEN n = 0 THEN NULL WHEN r < 0.5 THEN pow(r, 1.0 / n) ELSE least(100.0, r) END, 6) AS filter_ratio FROM n""")
def audio_tempo_plan(spark: SparkSession, sf: str) -> DataFrame:
    video = F.col("frame_count") / F.lit(24.0)
    audio = F.when(F.col("cluster_id") % 7 != 0, (F.col("cluster_id") % 11) * F.lit(0.9) + F.lit(0.3))
    p = recon.tempo_plan(video, audio)
    c = table(spark, sf, "clips").select("cluster_id", "frame_count").distinct()
    return c.select("cluster_id", r6(p["drift"]).alias("drift"), p["n_filters"].alias("n_filters"), r6(p["filter_ratio"]).alias("filter_ratio"))


# ---- grouping ------------------------------------------------------------------------------------------------------

_WORDS = f"CAST(coalesce(list_sum(list_transform(subtitles, lambda t: len(list_filter(regexp_split_to_array(t, '{grouping.SPACES}'), lambda w: w <> '')))), 0) AS BIGINT)"
_M = f"""{_N}, raw AS (SELECT DISTINCT cluster_id, f.node_id AS node_id FROM (SELECT cluster_id, unnest(frames) AS f FROM clusters) WHERE cluster_id IS NOT NULL AND f.node_id IS NOT NULL),
m AS (SELECT raw.cluster_id, n.* FROM raw JOIN n ON n.node_id = raw.node_id)"""


def _members(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "clusters").where("cluster_id IS NOT NULL").select("cluster_id", F.explode("frames.node_id").alias("node_id")).where("node_id IS NOT NULL").distinct()
    return c.join(grouping.build_nodes(table(spark, sf, "frame_nodes")), "node_id")


@query(f"WITH {_N} SELECT node_id, video_id, CAST(frame_index AS BIGINT) AS frame_index, round(token_cost, 6) AS token_cost, CAST(len(subtitles) AS BIGINT) AS n_subtitles, embedding IS NOT NULL AS has_vector FROM n")
def node_build(spark: SparkSession, sf: str) -> DataFrame:
    n = grouping.build_nodes(table(spark, sf, "frame_nodes"))
    return n.select("node_id", "video_id", F.col("frame_index").cast("bigint").alias("frame_index"), r6("token_cost").alias("token_cost"), F.size("subtitles").cast("bigint").alias("n_subtitles"), F.col("embedding").isNotNull().alias("has_vector"))


@query(f"WITH {_N} SELECT node_id, {_WORDS} AS n_words FROM n")
def subtitle_tokens(spark: SparkSession, sf: str) -> DataFrame:
    n = grouping.build_nodes(table(spark, sf, "frame_nodes"))
    return n.select("node_id", grouping.words(F.col("subtitles")).cast("bigint").alias("n_words"))


@query(f"""WITH {_N}, a AS (SELECT node_id, {_sc('consistency')} AS c1, {_sc('entity')} AS e1, embedding AS v1, lead(node_id) OVER w AS next_node_id, lead({_sc('consistency')}) OVER w AS c2,
  lead({_sc('entity')}) OVER w AS e2, lead(embedding) OVER w AS v2 FROM n WINDOW w AS (PARTITION BY video_id ORDER BY frame_index, node_id)),
s AS (SELECT *, {_simg('v1', 'v2')} AS s FROM a WHERE next_node_id IS NOT NULL)
SELECT node_id, next_node_id, round(CASE WHEN s < 0.2 THEN 0.0 ELSE greatest(0.0, least(1.0, 0.65 * (0.5 * (c1 + c2)) + 0.25 * (1 - 0.5 * (e1 + e2)) + 0.10 * s)) END + {_OFF}, 6) AS affinity FROM s""")
def merge_affinity(spark: SparkSession, sf: str) -> DataFrame:
    a = grouping.adjacent_affinity(grouping.build_nodes(table(spark, sf, "frame_nodes")))
    return a.select("node_id", "next_node_id", r6_off("affinity").alias("affinity"))


@query(f"""WITH {_M}, k AS (SELECT cluster_id, node_id, scores, embedding AS e, lag(embedding) OVER w AS p, lead(embedding) OVER w AS q FROM m WINDOW w AS (PARTITION BY cluster_id ORDER BY frame_index, node_id))
SELECT cluster_id, node_id, round(0.45 * {_sc('gate')} + 0.25 * {_sc('semantic')} + 0.15 * {_sc('motion')} + 0.15 * {_sc('total')}
  - 0.30 * CASE WHEN e IS NULL OR p IS NULL OR q IS NULL THEN 0.0 ELSE 0.5 * (({_simg('p', 'e')}) + ({_simg('e', 'q')})) END, 6) AS priority FROM k""")
def keep_priority(spark: SparkSession, sf: str) -> DataFrame:
    return grouping.keep_priority(_members(spark, sf), ["cluster_id"], ["frame_index", "node_id"]).withColumn("priority", r6("priority"))


_COST = f"""b AS (SELECT video_id, cluster_id, sum(token_cost) AS base, sum({_WORDS}) AS words FROM m GROUP BY ALL),
ec AS (SELECT video_id, cluster_id, c, count(*) AS k FROM (SELECT video_id, cluster_id, unnest(entities).class_id AS c FROM m) GROUP BY ALL),
ep AS (SELECT video_id, cluster_id, sum(1.0 / (k + 1)) AS p FROM ec GROUP BY ALL),
tc AS (SELECT b.video_id, b.cluster_id, b.base + coalesce(ep.p, 0.0) * 2.0 + b.words * 0.5 AS token_cost FROM b LEFT JOIN ep ON ep.video_id = b.video_id AND ep.cluster_id = b.cluster_id)"""


@query(f"WITH {_M}, {_COST} SELECT cluster_id, round(token_cost, 5) AS token_cost FROM tc")
def token_cost(spark: SparkSession, sf: str) -> DataFrame:
    return grouping.token_cost(_members(spark, sf), ["video_id", "cluster_id"]).select("cluster_id", F.round("token_cost", 5).alias("token_cost"))


_PROFILE = f"""round(avg({_sc('semantic')}), 6) AS semantic_avg, round(max({_sc('motion')}), 6) AS motion_max, round(avg({_sc('entity')}), 6) AS entity_avg,
  round(avg({_sc('consistency')}), 6) AS consistency_avg, round(avg({_sc('total')}), 6) AS total_avg"""


@query(f"WITH {_M} SELECT cluster_id, {_PROFILE} FROM m GROUP BY cluster_id")
def cluster_profile(spark: SparkSession, sf: str) -> DataFrame:
    p = grouping.profile(_members(spark, sf), ["cluster_id"])
    return p.select("cluster_id", *[r6(c).alias(c) for c in ("semantic_avg", "motion_max", "entity_avg", "consistency_avg", "total_avg")])


@query(f"""WITH {_M}, {_COST}, p AS (SELECT video_id, cluster_id, min(frame_index) AS a, max(frame_index) AS z, count(*) AS k FROM m GROUP BY ALL)
SELECT p.video_id, p.cluster_id, CAST(row_number() OVER (PARTITION BY p.video_id ORDER BY p.a, p.cluster_id) - 1 AS INT) AS clip_index, p.a AS start_frame_index, p.z AS end_frame_index,
  round(p.a / 24.0, 6) AS start_time_sec, round(p.z / 24.0, 6) AS end_time_sec, p.z - p.a + 1 AS frame_count, p.k AS cluster_frame_count, round(tc.token_cost, 5) AS token_cost,
  'clips/' || printf('clip_%04d.mp4', CAST(row_number() OVER (PARTITION BY p.video_id ORDER BY p.a, p.cluster_id) - 1 AS INT)) AS path, sp.* EXCLUDE (cluster_id)
FROM p JOIN tc ON tc.video_id = p.video_id AND tc.cluster_id = p.cluster_id JOIN (SELECT cluster_id, {_PROFILE} FROM m GROUP BY cluster_id) sp ON sp.cluster_id = p.cluster_id""")
def clip_manifest(spark: SparkSession, sf: str) -> DataFrame:
    m = grouping.manifest(_members(spark, sf))
    return m.select(
        "video_id", "cluster_id", "clip_index", "start_frame_index", "end_frame_index", r6("start_time_sec").alias("start_time_sec"),
        r6("end_time_sec").alias("end_time_sec"), "frame_count", "cluster_frame_count", F.round("token_cost", 5).alias("token_cost"), "path",
        *[r6(f"score_profile.{c}").alias(c) for c in ("semantic_avg", "motion_max", "entity_avg", "consistency_avg", "total_avg")],
    )


@query()
def group_frames(spark: SparkSession, sf: str) -> DataFrame:
    return grouping.group_frames(grouping.build_nodes(table(spark, sf, "frame_nodes")))


@query()
def group_frames_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Manifest of the clips that the greedy merge finds."""
    nodes = grouping.build_nodes(table(spark, sf, "frame_nodes"))
    return grouping.manifest(nodes.join(grouping.group_frames(nodes).drop("video_id"), "node_id"))
