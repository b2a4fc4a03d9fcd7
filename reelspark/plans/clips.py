"""Clip grouping in cases that SQL can state, fallback columns of nodes, and clips as slices of the slots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.operators import grouping
from reelspark.operators.grouping import Grouping
from reelspark.plans.reference import _M, _N, _O, _sc, _simg, _WORDS, _members
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


@query(f"WITH {_N} SELECT video_id, node_id, row_number() OVER (PARTITION BY video_id ORDER BY frame_index, node_id) - 1 AS cluster_id FROM n")
def group_frames_blind(spark: SparkSession, sf: str) -> DataFrame:
    """Grouping of frames without vectors, as the whole pipeline does by default: nothing merges."""
    return grouping.group_frames(grouping.build_nodes(table(spark, sf, "frame_nodes")), embedding=None)


_BAR = 0.5501234
_AFF = f"""a AS (SELECT video_id, node_id, frame_index, {_sc('consistency')} AS c1, {_sc('entity')} AS e1, embedding AS v1, lead({_sc('consistency')}) OVER w AS c2,
  lead({_sc('entity')}) OVER w AS e2, lead(embedding) OVER w AS v2, lead(node_id) OVER w AS nx FROM n WINDOW w AS (PARTITION BY video_id ORDER BY frame_index, node_id)),
s AS (SELECT *, {_simg('v1', 'v2')} AS s FROM a),
f AS (SELECT *, CASE WHEN nx IS NULL OR s < 0.2 THEN 0.0 ELSE greatest(0.0, least(1.0, 0.65 * (0.5 * (c1 + c2)) + 0.25 * (1 - 0.5 * (e1 + e2)) + 0.10 * s)) END AS aff FROM s)"""


@query(f"""WITH {_N}, {_AFF}, g AS (SELECT video_id, node_id, frame_index, coalesce(sum(CASE WHEN aff < {_BAR} THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY frame_index, node_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM f)
SELECT video_id, node_id, first_value(node_id) OVER (PARTITION BY video_id, run ORDER BY frame_index, node_id) AS first_node, count(*) OVER (PARTITION BY video_id, run) AS n FROM g""")
def group_frames_unbounded(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy merge without limits of cost and length and with a fixed bar: all neighbours above it end in one clip."""
    nodes = grouping.build_nodes(table(spark, sf, "frame_nodes"))
    got = grouping.group_frames(nodes, Grouping(limit=1e15, dynamic=False, max_sec=1e9, merge_threshold=_BAR))
    place = got.join(nodes.select("node_id", "frame_index"), "node_id")
    first = place.groupBy("video_id", "cluster_id").agg(F.min_by("node_id", F.struct("frame_index", "node_id")).alias("first_node"), F.count(F.lit(1)).alias("n"))
    return place.join(first, ["video_id", "cluster_id"]).select("video_id", "node_id", "first_node", "n")


_LIMIT = 600.0
_FLAT = "flatten(list_transform(kept, lambda i: cl[i]))"
_PRICE = f"""list_sum(list_transform(kept, lambda i: tc[i])) + 2.0 * coalesce(list_sum(list_transform(list_distinct({_FLAT}), lambda c: 1.0 / (1 + len(list_filter({_FLAT}, lambda y: y = c))))), 0)
  + 0.5 * list_sum(list_transform(kept, lambda i: wd[i]))"""
_PAIR = lambda a, b: _simg(f"em[kept[{a}]]", f"em[kept[{b}]]")
_WANT = f"""pr[kept[j]] - 0.30 * CASE WHEN em[kept[j - 1]] IS NULL OR em[kept[j]] IS NULL OR em[kept[j + 1]] IS NULL THEN 0.0 ELSE 0.5 * (({_PAIR('j - 1', 'j')}) + ({_PAIR('j', 'j + 1')})) END"""
_BY = "ORDER BY frame_index, node_id"


@query(f"""WITH RECURSIVE {_M}, l AS (SELECT cluster_id, list(node_id {_BY}) AS ids, list(token_cost {_BY}) AS tc, list({_WORDS} {_BY}) AS wd, list(embedding {_BY}) AS em,
  list(coalesce(list_transform(entities, lambda e: e.class_id), []) {_BY}) AS cl, list(0.45 * {_sc('gate')} + 0.25 * {_sc('semantic')} + 0.15 * {_sc('motion')} + 0.15 * {_sc('total')} {_BY}) AS pr FROM m GROUP BY cluster_id),
z AS (SELECT cluster_id, range(1, len(ids) + 1) AS kept, CASE WHEN len(ids) > 2 THEN greatest(1, CAST(floor(len(ids) * 0.5) AS BIGINT)) ELSE 0 END AS drops FROM l
  UNION ALL SELECT cluster_id, list_filter(kept, lambda i: i <> kept[1 + list_position(want, list_min(want))]), drops - 1
  FROM (SELECT z.cluster_id, z.kept, z.drops, list_transform(range(2, len(z.kept)), lambda j: {_WANT}) AS want FROM z JOIN l ON l.cluster_id = z.cluster_id
    WHERE z.drops > 0 AND len(z.kept) > 2 AND {_PRICE} > {_LIMIT})),
e AS (SELECT cluster_id, arg_min(kept, len(kept)) AS kept FROM z GROUP BY cluster_id),
p AS (SELECT e.cluster_id, e.kept, ids, {_PRICE} <= {_LIMIT} AS fits FROM e JOIN l ON l.cluster_id = e.cluster_id)
SELECT cluster_id, unnest(CASE WHEN fits THEN list_transform(kept, lambda i: ids[i]) ELSE ids END) AS node_id, fits FROM p""")
def squeeze_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters squeezed to half the context limit: the least wanted interior frames go."""
    return grouping.adaptive_squeeze(_members(spark, sf), "cluster_id", Grouping(limit=_LIMIT))


@query("""WITH d AS (SELECT doc_id, any_value(video_id) AS video_id, any_value(text) AS t, any_value(n_chars) AS k FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id)
SELECT doc_id AS node_id, CAST(CASE doc_id % 3 WHEN 0 THEN coalesce(k, 30) WHEN 1 THEN 12.5 ELSE 30.0 END AS DOUBLE) AS token_cost, CASE WHEN t IS NULL THEN 0 ELSE 1 END AS n_subtitles,
  coalesce(len(list_filter(regexp_split_to_array(t, '""" + grouping.SPACES + """'), lambda w: w <> '')), 0) AS n_words FROM d""")
def node_fallbacks(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of another table: cost from token_cost, base_token_cost or the default, one text instead of a list of subtitles."""
    d = table(spark, sf, "documents").select(
        F.col("doc_id").alias("node_id"), "video_id", F.lit(None).cast("int").alias("frame_index"), F.when(F.col("doc_id") % 3 == 0, F.col("n_chars").cast("double")).alias("token_cost"),
        F.when(F.col("doc_id") % 3 == 1, F.lit(12.5)).alias("base_token_cost"), "text",
    )
    n = grouping.build_nodes(d)
    return n.select("node_id", "token_cost", F.size("subtitles").cast("bigint").alias("n_subtitles"), grouping.words(F.col("subtitles")).cast("bigint").alias("n_words"))


@query(f"""WITH {_O}, c AS (SELECT DISTINCT video_id, clip_index, start_frame_index AS a, end_frame_index AS z FROM clips WHERE end_frame_index >= start_frame_index)
SELECT c.video_id, c.clip_index, count(*) AS n_slots, count(*) FILTER (WHERE o.real) AS n_real, min(o.slot) AS first_slot, max(o.slot) AS last_slot FROM c JOIN o ON o.video_id = c.video_id AND o.slot BETWEEN c.a AND c.z GROUP BY c.video_id, c.clip_index""")
def clip_slices(spark: SparkSession, sf: str) -> DataFrame:
    """The slots that each clip of the manifest covers."""
    clips = table(spark, sf, "clips").where("end_frame_index >= start_frame_index").select("video_id", "clip_index", "start_frame_index", "end_frame_index").distinct()
    d = grouping.clip_slices(clean_outputs(spark, sf).select("video_id", "slot", "real"), clips)
    return d.groupBy("video_id", "clip_index").agg(
        F.count(F.lit(1)).alias("n_slots"), F.count_if(F.col("real")).alias("n_real"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot")
    )


@query(f"""WITH {_M}, k AS (SELECT cluster_id, node_id, frame_index, scores, embedding AS e, lag(embedding) OVER w AS p, lead(embedding) OVER w AS q, row_number() OVER w AS rn, count(*) OVER (PARTITION BY cluster_id) AS n
  FROM m WINDOW w AS (PARTITION BY cluster_id ORDER BY frame_index, node_id)),
v AS (SELECT cluster_id, node_id, rn, round(0.45 * {_sc('gate')} + 0.25 * {_sc('semantic')} + 0.15 * {_sc('motion')} + 0.15 * {_sc('total')}
  - 0.30 * CASE WHEN e IS NULL OR p IS NULL OR q IS NULL THEN 0.0 ELSE 0.5 * (({_simg('p', 'e')}) + ({_simg('e', 'q')})) END, 9) AS w FROM k WHERE rn > 1 AND rn < n)
SELECT cluster_id, arg_min(node_id, {{'w': w, 'r': rn}}) AS node_id FROM v GROUP BY cluster_id""")
def first_drop(spark: SparkSession, sf: str) -> DataFrame:
    """The interior frame of each cluster that would be dropped first: least priority, the earliest of equals."""
    return grouping.first_drop(_members(spark, sf), "cluster_id")
