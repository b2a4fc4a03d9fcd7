"""The fold's own terms, checked with choices that are known beforehand.

With one candidate a slot the fold has nothing to choose, so all it keeps (bank, averages, percentiles, history, the previous choice's
detections) follows from the candidates, and SQL can state it.  The candidate of a slot is its sharpest one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.operators import timeline as T
from reelspark.operators.select import select_frames
from reelspark.plans.reference import _C, _F, _K, _dist, _greedy, _norm, r6
from reelspark.sources.frames import clean_frames

_ZERO = "list_transform(range(0, 16), lambda i: 0.0)"
_SQL = f"""WITH RECURSIVE {_F}, {_K}, {_C},
b AS (SELECT video_id, slot, arg_max(frame_idx, {{'b': blur, 't': -ts, 'i': -frame_idx}}) AS frame_idx FROM c GROUP BY video_id, slot),
r AS (SELECT b.video_id, b.slot, b.frame_idx, f.clip_emb AS v, coalesce(f.dino_emb, {_ZERO}) AS d, coalesce(f.entities, []) AS e, row_number() OVER (PARTITION BY b.video_id ORDER BY b.slot) AS i
  FROM b JOIN f ON f.video_id = b.video_id AND f.frame_idx = b.frame_idx),
x AS (SELECT video_id, i, v AS ctx FROM r WHERE i = 1 UNION ALL
  SELECT r.video_id, r.i, list_transform(list_zip(r.v, x.ctx), lambda z: 0.3 * z[1] + 0.7 * z[2]) FROM x JOIN r ON r.video_id = x.video_id AND r.i = x.i + 1),
un AS (SELECT video_id, i, list_transform(v, lambda z: z / n) AS u FROM (SELECT video_id, i, v, {_norm('v')} + 1e-8 AS n FROM r)),
sm AS (SELECT a.video_id, a.i, list_inner_product(a.u, b.u) AS s, row_number() OVER (PARTITION BY a.video_id, a.i ORDER BY list_inner_product(a.u, b.u) DESC) AS k
  FROM un a JOIN un b ON b.video_id = a.video_id AND b.i < a.i),
lg AS (SELECT video_id, i, greatest(0.0, 1 - avg(s)) AS far FROM sm WHERE k <= 5 GROUP BY video_id, i),
nv AS (SELECT r.*, 0.5 * CASE WHEN r.i = 1 THEN 1.0 ELSE {_dist('r.v', 'x.ctx')} END + 0.5 * coalesce(lg.far, 1.0) AS nov
  FROM r LEFT JOIN x ON x.video_id = r.video_id AND x.i = r.i - 1 LEFT JOIN lg ON lg.video_id = r.video_id AND lg.i = r.i),
pc AS (SELECT *, list_sort(list(nov) OVER (PARTITION BY video_id ORDER BY i ROWS BETWEEN 120 PRECEDING AND 1 PRECEDING)) AS l FROM nv),
pq AS (SELECT *, coalesce(l[1 + CAST(floor(0.25 * (len(l) - 1)) AS INT)], 0.0) AS p25, coalesce(l[1 + CAST(floor(0.75 * (len(l) - 1)) AS INT)], 0.0) AS p75 FROM pc),
gt AS (SELECT *, least(2.0, greatest(0.0, (nov - p25) / ((p75 - p25) + 0.00001))) AS nh, greatest(p75 - p25, 0.00001) AS temp FROM pq),
pe AS (SELECT video_id * 1000000 + i AS id, coalesce(lag(e) OVER (PARTITION BY video_id ORDER BY i), []) AS p, e FROM r), {_greedy('pe', 'dl')},
ea AS (SELECT r.video_id, r.i, dl.delta AS s FROM r JOIN dl ON dl.id = r.video_id * 1000000 + r.i),
eh AS (SELECT video_id, i, s FROM ea WHERE i = 1 UNION ALL SELECT a.video_id, a.i, 0.3 * a.s + 0.7 * eh.s FROM eh JOIN ea a ON a.video_id = eh.video_id AND a.i = eh.i + 1),
al AS (SELECT k.video_id, k.slot, r.d, r.i, last_value(CASE WHEN r.i IS NOT NULL THEN k.slot END IGNORE NULLS) OVER (PARTITION BY k.video_id ORDER BY k.slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a,
  first_value(CASE WHEN r.i IS NOT NULL THEN k.slot END IGNORE NULLS) OVER (PARTITION BY k.video_id ORDER BY k.slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS z
  FROM k LEFT JOIN r ON r.video_id = k.video_id AND r.slot = k.slot),
lp AS (SELECT al.video_id, al.slot, al.i, al.z, al.i IS NOT NULL OR coalesce(al.z - al.a - 1 <= 2, FALSE) AS has, CASE WHEN al.i IS NOT NULL THEN al.d WHEN al.z - al.a - 1 <= 2 THEN
    list_transform(list_zip(p.d, q.d), lambda y: (1 - (al.slot - al.a) / CAST(al.z - al.a AS DOUBLE)) * coalesce(y[1], 0.0) + (al.slot - al.a) / CAST(al.z - al.a AS DOUBLE) * coalesce(y[2], 0.0)) ELSE {_ZERO} END AS h
  FROM al LEFT JOIN r p ON p.video_id = al.video_id AND p.slot = al.a LEFT JOIN r q ON q.video_id = al.video_id AND q.slot = al.z),
hs AS (SELECT r.video_id, r.slot, g.lag, g.wt, CASE WHEN lp.i IS NULL AND (lp.z >= r.slot OR NOT lp.has) THEN 0.0 ELSE {_dist('r.d', 'lp.h')} END AS dist
  FROM r CROSS JOIN (VALUES (1, 0.6), (5, 0.3), (10, 0.1)) g(lag, wt) JOIN lp ON lp.video_id = r.video_id AND lp.slot = greatest(r.slot - g.lag, 0) WHERE r.slot > 0),
cv AS (SELECT video_id, slot, sum(wt * dist) AS c FROM hs GROUP BY video_id, slot),
sc AS (SELECT gt.video_id, gt.slot, gt.frame_idx, gt.nh, eh.s AS ent, coalesce(cv.c, 0.0) AS c, 1 / (1 + exp(-greatest(-30.0, least(30.0, (gt.nh - gt.p75) / (gt.temp + 0.00001))))) AS g
  FROM gt JOIN eh ON eh.video_id = gt.video_id AND eh.i = gt.i LEFT JOIN cv ON cv.video_id = gt.video_id AND cv.slot = gt.slot)
SELECT k.video_id, k.slot, sc.frame_idx, sc.slot IS NULL AS is_synthetic, round(0.3125 * sc.nh + 0.125 * sc.ent, 6) AS semantic, round(sc.ent, 6) AS entity, round(sc.c, 6) + 0.0 AS consistency, round(sc.g, 6) AS gate,
  round(sc.g * (0.3125 * sc.nh + 0.125 * sc.ent) + (1 - sc.g) * 0.125 * sc.ent - 0.09375 * sc.c, 6) AS total
FROM k LEFT JOIN sc ON sc.video_id = k.video_id AND sc.slot = k.slot"""


def selection_given_choices(spark: SparkSession, sf: str) -> DataFrame:
    """The fold over one candidate a slot, without the terms that depend on no choice: what is kept of all earlier ones, slot by slot."""
    frames = clean_frames(spark, sf)
    c = T.candidates(frames.select("video_id", "frame_idx", "ts", "blur"))
    best = c.groupBy("video_id", "slot").agg(F.max_by(F.struct("frame_idx", "ts"), F.struct("blur", (-F.col("ts")).alias("t"), (-F.col("frame_idx")).alias("i"))).alias("b"))
    zero = F.lit(0.0)
    given = best.select("video_id", "slot", "b.frame_idx", "b.ts", zero.alias("q_hat"), zero.alias("m_hat"), zero.alias("d_val"))
    scored = given.join(frames.select("video_id", "frame_idx", "clip_emb", "dino_emb", "entities"), ["video_id", "frame_idx"])
    s = select_frames(scored, T.all_slots(frames.select("video_id", "ts")))
    value = lambda k: r6(F.try_element_at("scores", F.lit(k)))
    names = ("semantic", "entity", "gate", "total")
    return s.select("video_id", "slot", "frame_idx", "is_synthetic", (value("consistency") + F.lit(0.0)).alias("consistency"), *[value(k).alias(k) for k in names])


QUERIES = {"selection_given_choices": selection_given_choices}
ORACLE = {"selection_given_choices": _SQL}
