"""Clip grouping: token cost, affinity, keep priority, cluster profile, and the greedy budgeted merge of adjacent frames."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspark.functions.vectors import score, similarity_grouping
from reelspark.operators.ordering import carried, group_bounds, neighbourhoods, spread, stream_groups, with_positions
from reelspark.session import cut_lineage


@dataclass(frozen=True)
class Grouping:
    limit: float = 1200.0
    merge_threshold: float = 0.55
    dynamic: bool = True
    visual_cost: float = 30.0
    entity_cost: float = 2.0
    subtitle_cost: float = 0.5
    max_drop: float = 0.5
    fps: float = 24.0
    min_sec: float = 2.75
    max_sec: float = 6.0


DEFAULT = Grouping()


# fixed values: what Unicode counts as white space, for Java and RE2 alike
SPACES = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def words(texts: Column) -> Column:
    """Words between white space (of any script) of all texts of a list."""
    each = F.transform(F.coalesce(texts, F.array().cast("array<string>")), lambda t: F.size(F.filter(F.split(t, SPACES), lambda w: w != "")))
    return F.aggregate(F.filter(each, lambda n: n.isNotNull()), F.lit(0), lambda s, n: s + n)


def normalize_subtitles(single: Column | None, many: Column | None) -> Column:
    """A single text is kept even if blank; of a list NULL and blank texts go; nothing gives an empty list."""
    empty = F.array().cast("array<string>")
    out = empty
    if many is not None:
        out = F.coalesce(F.filter(many, lambda x: x.isNotNull() & (F.regexp_replace(x, SPACES, "") != "")), empty)
    if single is not None:
        one = F.when(single.isNull(), empty).otherwise(F.array(single))
        out = F.when(F.size(out) > 0, out).otherwise(one)
    return out


def field(frames: DataFrame, *names: str, kind: str) -> Column:
    """The first of the columns ``names`` that the table has and that is not NULL; NULL of type ``kind`` if it has none."""
    have = [F.col(n).cast(kind) for n in names if n in frames.columns]
    return F.coalesce(*have) if have else F.lit(None).cast(kind)


def build_nodes(nodes: DataFrame, cfg: Grouping = DEFAULT) -> DataFrame:
    """Frames as grouping input: one row per node, defaults filled in.

    Cost: token_cost, else base_token_cost, else the default.  Subtitles: the first of subtitles, subtitle and text that gives any; each may
    be a text or a list.  Vector: embedding, else frame_embedding; one that holds NULL or NaN is none.  Missing columns count as
    NULL.  Repeated rows count once; missing lists are empty, a missing score map is empty.
    """
    texts = [c for c in ("subtitles", "subtitle", "text") if c in nodes.columns]
    vectors = [c for c in ("embedding", "frame_embedding") if c in nodes.columns]
    rest = [c for c in ("scores", "entities") if c in nodes.columns]
    d = nodes.where("node_id IS NOT NULL").groupBy("node_id").agg(
        F.max("video_id").alias("video_id"), F.max("frame_index").alias("frame_index"), *[F.max(c).alias(c) for c in ("token_cost", "base_token_cost") if c in nodes.columns],
        *[F.any_value(c, True).alias(c) for c in (*rest, *texts, *vectors)],
    )
    said = F.array().cast("array<string>")
    for c in reversed(texts):
        is_list = nodes.schema[c].dataType.typeName() == "array"
        mine = normalize_subtitles(None, F.col(c).cast("array<string>")) if is_list else normalize_subtitles(F.col(c).cast("string"), None)
        said = F.when(F.size(mine) > 0, mine).otherwise(said)
    d = d.withColumn("_v", field(d, *vectors, kind="array<double>"))
    bad = F.exists("_v", lambda x: x.isNull() | F.isnan(x))
    return d.select(
        "node_id", "video_id", "frame_index", F.coalesce(field(d, "token_cost", "base_token_cost", kind="double"), F.lit(cfg.visual_cost)).alias("token_cost"),
        field(d, "scores", kind="map<string,double>").alias("scores") if "scores" not in d.columns else F.col("scores"),
        F.col("entities") if "entities" in d.columns else F.lit(None).cast("array<struct<bbox:array<double>,confidence:double,class_id:int,class_name:string>>").alias("entities"),
        said.alias("subtitles"), F.when(~bad, F.col("_v")).alias("embedding"),
    )


def affinity(c1: Column, c2: Column, e1: Column, e2: Column, v1: Column, v2: Column) -> Column:
    """Merge affinity of neighbours: 0 at a scene cut (similarity below 0.2), else weighted and clipped to [0, 1]."""
    sim = similarity_grouping(v1, v2)
    raw = 0.65 * (0.5 * (c1 + c2)) + 0.25 * (1 - 0.5 * (e1 + e2)) + 0.10 * sim
    return F.when(sim < 0.2, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))


def adjacent_affinity(nodes: DataFrame) -> DataFrame:
    """(video_id, node_id, next_node_id, affinity) of each node and the next one of its video."""
    cols = {"c": score(F.col("scores"), "consistency"), "e": score(F.col("scores"), "entity"), "v": F.col("embedding")}
    d, w = neighbourhoods(nodes.select("video_id", "node_id", "frame_index", *[x.alias(k) for k, x in cols.items()]), ["frame_index", "node_id"], 1)
    for k in ("c", "e", "v", "node_id"):
        d = d.withColumn(f"{k}2", F.lead(k).over(w))
    value = affinity(*(F.col(x) for x in ("c", "c2", "e", "e2", "v", "v2")))
    return d.where("core AND node_id2 IS NOT NULL").select("video_id", "node_id", F.col("node_id2").alias("next_node_id"), value.alias("affinity"))


def keep_priority(nodes: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """(*by, node_id, priority): lower is dropped first; similarity to both neighbours lowers it for interior frames."""
    w = Window.partitionBy(*by).orderBy(*order)
    d = nodes.withColumn("_p", F.lag("embedding").over(w)).withColumn("_n", F.lead("embedding").over(w))
    e, p, n = F.col("embedding"), F.col("_p"), F.col("_n")
    bonus = F.when(e.isNotNull() & p.isNotNull() & n.isNotNull(), 0.5 * (similarity_grouping(p, e) + similarity_grouping(e, n))).otherwise(F.lit(0.0))
    s = F.col("scores")
    value = 0.45 * score(s, "gate") + 0.25 * score(s, "semantic") + 0.15 * score(s, "motion") + 0.15 * score(s, "total") - 0.30 * bonus
    return d.select(*by, "node_id", value.alias("priority"))


def first_drop(members: DataFrame, by: str) -> DataFrame:
    """(by, node_id): the interior frame of least priority of each cluster, the earliest of equals."""
    w = Window.partitionBy(by).orderBy("frame_index", "node_id")
    place = members.select(by, "node_id", F.row_number().over(w).alias("r"), F.count(F.lit(1)).over(Window.partitionBy(by)).alias("n"))
    d = keep_priority(members, [by], ["frame_index", "node_id"]).join(place, [by, "node_id"]).where("r > 1 AND r < n")
    return d.groupBy(by).agg(F.min_by("node_id", F.struct(F.round("priority", 9), "r")).alias("node_id"))


def token_cost(members: DataFrame, by: list[str], cfg: Grouping = DEFAULT) -> DataFrame:
    """(*by, token_cost): frame costs, class counts at falling prices, and subtitle words."""
    base = members.groupBy(*by).agg(F.sum("token_cost").alias("_base"), F.sum(words(F.col("subtitles"))).alias("_words"))
    classes = members.select(*by, F.explode("entities").alias("e")).groupBy(*by, F.col("e.class_id").alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    priced = classes.groupBy(*by).agg(F.sum(1 / (F.col("_n") + 1)).alias("_e"))
    total = F.col("_base") + F.coalesce("_e", F.lit(0.0)) * cfg.entity_cost + F.col("_words") * cfg.subtitle_cost
    return base.join(priced, by, "left").select(*by, total.alias("token_cost"))


def profile(members: DataFrame, by: list[str]) -> DataFrame:
    """Score profile, frame count and boundary frames of each cluster."""
    s = F.col("scores")
    return members.groupBy(*by).agg(
        F.avg(score(s, "semantic")).alias("semantic_avg"), F.max(score(s, "motion")).alias("motion_max"), F.avg(score(s, "entity")).alias("entity_avg"),
        F.avg(score(s, "consistency")).alias("consistency_avg"), F.avg(score(s, "total")).alias("total_avg"),
        F.min("frame_index").alias("start_frame_index"), F.max("frame_index").alias("end_frame_index"), F.count(F.lit(1)).alias("cluster_frame_count"),
    )


def manifest(members: DataFrame, cfg: Grouping = DEFAULT, clip_dir: str = "clips") -> DataFrame:
    """One row per cluster in order of its first frame: range, times, counts, cost, nested score profile and path of the clip."""
    by = ["video_id", "cluster_id"]
    d = profile(members, by).join(token_cost(members, by, cfg), by)
    w = Window.partitionBy("video_id").orderBy("start_frame_index", "cluster_id")
    d = d.withColumn("start_frame_index", F.greatest(F.lit(0), "start_frame_index")).where("end_frame_index >= start_frame_index")
    return d.withColumn("clip_index", (F.row_number().over(w) - 1).cast("int")).select(
        *by, "clip_index", "start_frame_index", "end_frame_index", (F.col("start_frame_index") / cfg.fps).alias("start_time_sec"),
        (F.col("end_frame_index") / cfg.fps).alias("end_time_sec"), (F.col("end_frame_index") - F.col("start_frame_index") + 1).alias("frame_count"),
        "cluster_frame_count", "token_cost", F.struct("semantic_avg", "motion_max", "entity_avg", "consistency_avg", "total_avg").alias("score_profile"),
        F.concat(F.lit(clip_dir.rstrip("/")), F.lit("/"), F.format_string("clip_%04d.mp4", "clip_index")).alias("path"),
    )


def clip_slices(outputs: DataFrame, clips: DataFrame) -> DataFrame:
    """The slots of each clip: those from its first to its last frame index, squeezed-out ones too, with clip_index."""
    span = clips.select("video_id", "clip_index", F.explode(F.sequence(F.col("start_frame_index").cast("bigint"), F.col("end_frame_index").cast("bigint"))).alias("slot"))
    return outputs.join(span, ["video_id", "slot"])


def _similar(a, b) -> float:
    import numpy as np

    if a is None or b is None:
        return 0.0
    na, nb = np.sqrt(a @ a), np.sqrt(b @ b)
    return 1.0 if na < 1e-8 or nb < 1e-8 else float(a @ b) / (na * nb)


class Cost:
    """Running token cost of a set of frames: plain costs, frames per class, subtitle words."""

    __slots__ = ("base", "count", "words")

    def __init__(self, base: float = 0.0, classes=(), words: int = 0):
        self.base, self.words, self.count = base, words, {}
        for c in classes:
            self.count[c] = self.count.get(c, 0) + 1

    def with_(self, other: Cost) -> Cost:
        out = Cost(self.base + other.base, (), self.words + other.words)
        out.count = dict(self.count)
        for c, k in other.count.items():
            out.count[c] = out.count.get(c, 0) + k
        return out

    def total(self, cfg: Grouping) -> float:
        return self.base + (sum(1.0 / (k + 1) for k in self.count.values()) * cfg.entity_cost + self.words * cfg.subtitle_cost)


def cut_bar(cfg: Grouping) -> tuple[float, float]:
    """(affinity a merge needs, what the size penalty takes off at least): neighbours below their sum never merge."""
    return cfg.merge_threshold - (0.05 if cfg.dynamic else 0.0), 0.02 if cfg.dynamic else 0.0


class Segment:
    """Greedy merge of a stretch of neighbouring frames.

    Clusters are intervals, so a merge is named by the border between two frames, and a border's affinity never changes: a squeezed
    cluster keeps its first and last frame.  ``near[i]`` is the affinity of frames i and i + 1.
    """

    def __init__(self, cost, classes, n_words, cfg: Grouping, near, keep=None, vectors=None):
        self.cost, self.classes, self.words, self.cfg, self.near, self.keep, self.v = cost, classes, n_words, cfg, near, keep, vectors

    def one(self, i: int) -> Cost:
        return Cost(self.cost[i], self.classes[i], self.words[i])

    def priority(self, at: list[int], k: int) -> float:
        bonus = 0.0
        if 0 < k < len(at) - 1 and all(self.v[at[j]] is not None for j in (k - 1, k, k + 1)):
            bonus = 0.5 * (_similar(self.v[at[k - 1]], self.v[at[k]]) + _similar(self.v[at[k]], self.v[at[k + 1]]))
        return self.keep[at[k]] - 0.30 * bonus

    def squeeze(self, at: list[int], least: int = 2) -> list[int] | None:
        """The frames left when the least wanted interior ones are dropped until the limit holds, or None."""
        classes: dict = {}
        for i in at:
            for c in self.classes[i]:
                classes[c] = classes.get(c, 0) + 1
        total = Cost(sum(self.cost[i] for i in at), (), sum(self.words[i] for i in at))
        total.count = classes
        left = list(at)
        room = min(max(1, int(len(at) * self.cfg.max_drop)) if len(at) > 2 else 0, len(at) - max(2, least))
        wanted = [self.priority(left, k) for k in range(len(left))] if room > 0 and total.total(self.cfg) > self.cfg.limit else []
        while room > 0 and total.total(self.cfg) > self.cfg.limit:
            k = min(range(1, len(left) - 1), key=wanted.__getitem__)
            gone = left.pop(k)
            del wanted[k]
            total.base -= self.cost[gone]
            total.words -= self.words[gone]
            for c in self.classes[gone]:
                total.count[c] -= 1
                if not total.count[c]:
                    del total.count[c]
            for j in (k - 1, k):  # only the neighbours of the gap look different now
                wanted[j] = self.priority(left, j)
            room -= 1
        return left if total.total(self.cfg) <= self.cfg.limit else None

    def merge(self) -> tuple[list[tuple[int, list[int]]], list[float]]:
        """([(number of the merge that made the cluster or -1, its frames)] in order, [least affinity used up to each merge])."""
        cfg, n = self.cfg, len(self.cost)
        bar, _ = cut_bar(cfg)
        most, least = int(cfg.fps * cfg.max_sec), int(cfg.fps * cfg.min_sec)
        # by first frame: last frame, name, frames, cost; by last frame: first frame
        last, name, held, cost = list(range(n)), list(range(n)), [[i] for i in range(n)], [self.one(i) for i in range(n)]
        first, turn = list(range(n)), [0] * n
        heap: list = []
        used: list[float] = []
        low = float("inf")

        def offer(i: int) -> None:
            if 0 <= i < n - 1:
                a, b = first[i], i + 1
                value = self.near[i] - (min(0.2, 0.01 * (len(held[a]) + len(held[b]))) if cfg.dynamic else 0.0)
                turn[i] += 1
                heapq.heappush(heap, (-value, name[a], name[b], i, turn[i]))

        for i in range(n - 1):
            offer(i)
        while heap and -heap[0][0] >= bar:
            value, _, _, i, t = heapq.heappop(heap)
            low = min(low, -value)
            if t != turn[i]:
                continue
            a, b = first[i], i + 1
            if len(held[a]) + len(held[b]) > most:
                continue
            both, price = held[a] + held[b], cost[a].with_(cost[b])
            if price.total(cfg) > cfg.limit:
                both = self.squeeze(both, least)
                if both is None:
                    continue
                price = Cost()
                for j in both:
                    price = price.with_(self.one(j))
            turn[i] += 1
            last[a], held[a], cost[a], name[a] = last[b], both, price, n + len(used)
            first[last[a]] = a
            used.append(low)
            offer(a - 1)
            offer(last[a])
        out, i = [], 0
        while i < n:
            out.append((name[i] - n if name[i] >= n else -1, held[i]))
            i = last[i] + 1
        return out, used


def group_frames(nodes: DataFrame, cfg: Grouping = DEFAULT, embedding: str | None = "embedding") -> DataFrame:
    """(video_id, node_id, cluster_id): membership after the greedy merge of each video; squeezed-out frames are missing.

    ``nodes`` come from :func:`build_nodes`.  ``embedding=None`` groups without vectors, which never merges.  Ids count up from the video's
    frames, in order, to its merges, in the order in which they are made.

    Neighbours whose affinity can never reach the bar cut a video into segments, which are merged apart, in parallel.  The order
    over all segments follows from the least affinity that each used up to a merge, as the best of all open ones goes first.
    """
    vector = F.col(embedding) if embedding else F.lit(None).cast("array<double>")
    s = F.col("scores")
    keep = 0.45 * score(s, "gate") + 0.25 * score(s, "semantic") + 0.15 * score(s, "motion") + 0.15 * score(s, "total")
    slim = nodes.select(
        "video_id", "node_id", "frame_index", "token_cost", F.transform(F.coalesce("entities", F.array()), lambda e: e["class_id"]).alias("classes"),
        words(F.col("subtitles")).alias("n_words"), keep.alias("keep"), score(s, "consistency").alias("c"), score(s, "entity").alias("e"), vector.alias("v"),
    )
    rows, w = neighbourhoods(slim, ["frame_index", "node_id"], 1)
    near = affinity(F.col("c"), F.lead("c").over(w), F.col("e"), F.lead("e").over(w), F.col("v"), F.lead("v").over(w))
    bar, penalty = cut_bar(cfg)
    rows = rows.withColumn("near", near).withColumn("cut", F.when(F.coalesce(F.col("near") - penalty < bar, F.lit(True)) | (F.col("pos") == F.col("last_pos")), F.col("pos")))
    ends = carried(rows, {"cut": F.col("cut")}).withColumnsRenamed({"video_id": "_k", "chunk": "_c"})
    rows = rows.withColumn("own", F.last("cut", True).over(w.rowsBetween(Window.unboundedPreceding, -1))).where("core")
    rows = rows.join(ends, F.col("video_id").eqNullSafe(F.col("_k")) & (F.col("chunk") == F.col("_c"))).withColumn("seg", F.coalesce(F.coalesce("own", "before_cut") + 1, F.lit(0)))
    cols = ["video_id", "seg", "pos", "last_pos", "node_id", "token_cost", "classes", "n_words", "keep", "near", "v"]

    def run(batches):
        import numpy as np
        import pandas as pd

        for pdf in stream_groups(batches, ["video_id", "seg"], 4096):
            bounds = group_bounds(pdf, ["video_id", "seg"])
            node, pos, number, merges = [], [], [], []
            ids, places = pdf["node_id"].to_numpy(), pdf["pos"].to_numpy()
            row = {c: pdf[c].tolist() for c in ("token_cost", "n_words", "keep", "near")}
            for a, b in zip(bounds[:-1], bounds[1:]):
                if b == a + 1:
                    made, used = [(-1, [0])], []
                else:
                    part = Segment(
                        row["token_cost"][a:b], [list(c) for c in pdf["classes"].iloc[a:b]], row["n_words"][a:b], cfg, row["near"][a:b], row["keep"][a:b],
                        [None if v is None else np.asarray(v, float) for v in pdf["v"].iloc[a:b]],
                    )
                    made, used = part.merge()
                for k, at in made:
                    for i in at:
                        node.append(a + i)
                        # a frame that was never merged is named by its place
                        number.append(k)
                        pos.append(places[a + i])
                merges += [(a, k, low) for k, low in enumerate(used)]
            one = pdf.iloc[node]
            yield pd.DataFrame({"video_id": one["video_id"].to_numpy(), "seg": one["seg"].to_numpy(), "k": number, "node_id": ids[node], "pos": pos, "n": one["last_pos"].to_numpy() + 1, "low": np.nan})
            if merges:
                at = [m[0] for m in merges]
                one = pdf.iloc[at]
                yield pd.DataFrame({"video_id": one["video_id"].to_numpy(), "seg": one["seg"].to_numpy(), "k": [m[1] for m in merges], "node_id": None, "pos": 0, "n": 0, "low": [m[2] for m in merges]})

    parts = spread(rows.select(*cols), "video_id", "seg").sortWithinPartitions("video_id", "seg", "pos")
    done = cut_lineage(parts.mapInPandas(run, "video_id bigint, seg bigint, k bigint, node_id bigint, pos bigint, n bigint, low double"))
    merges = done.where("node_id IS NULL").select("video_id", "seg", "k", (-F.col("low")).alias("high"))
    ranked = with_positions(merges, "video_id", ["high", "seg", "k"], F.floor(F.col("high") * 4096).cast("bigint"), "rank")
    ranked = ranked.select(F.col("video_id").alias("_v"), F.col("seg").alias("_s"), F.col("k").alias("_m"), "rank")
    members = done.where("node_id IS NOT NULL").join(ranked, F.col("video_id").eqNullSafe(F.col("_v")) & (F.col("seg") == F.col("_s")) & (F.col("k") == F.col("_m")), "left")
    return members.select("video_id", "node_id", F.when(F.col("k") < 0, F.col("pos")).otherwise(F.col("n") + F.col("rank")).alias("cluster_id"))


def adaptive_squeeze(members: DataFrame, by: str, cfg: Grouping = DEFAULT, least: int = 2) -> DataFrame:
    """(by, node_id, fits): each cluster's frames after dropping the least wanted interior ones until its cost is within the limit.

    First and last frame stay; at most ``max_drop`` of the frames go.  Where that is not enough, fits is false and all frames stay.
    A cluster is bounded by its limit, so it is worked on in one task.
    """
    s = F.col("scores")
    keep = 0.45 * score(s, "gate") + 0.25 * score(s, "semantic") + 0.15 * score(s, "motion") + 0.15 * score(s, "total")
    slim = members.select(
        by, "node_id", "frame_index", "token_cost", F.transform(F.coalesce("entities", F.array()), lambda e: e["class_id"]).alias("classes"),
        words(F.col("subtitles")).alias("n_words"), keep.alias("keep"), F.col("embedding").alias("v"),
    )

    def run(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values(["frame_index", "node_id"])
        part = Segment(
            pdf["token_cost"].tolist(), [list(c) for c in pdf["classes"]], pdf["n_words"].tolist(), cfg, None, pdf["keep"].tolist(),
            [None if v is None else np.asarray(v, float) for v in pdf["v"]],
        )
        left = part.squeeze(list(range(len(pdf))), least)
        at = list(range(len(pdf))) if left is None else left
        return pd.DataFrame({by: pdf[by].iloc[at], "node_id": pdf["node_id"].iloc[at], "fits": left is not None})

    return slim.groupBy(by).applyInPandas(run, f"{by} bigint, node_id bigint, fits boolean")


# the public names of the grouping steps
Calculate_Merge_Affinity = affinity
Calculate_Token_Cost = token_cost
Adaptive_Squeeze = adaptive_squeeze
