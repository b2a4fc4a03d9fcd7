"""The frame engine's sequential parts against plain models, and its small rules."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspark.functions import entities as E
from reelspark.functions import vectors as V
from reelspark.operators import emit, grouping, recon, timeline
from reelspark.operators.select import entity_delta
from reelspark.plans import reference
from reelspark.sources.frames import clean_frames, resolve_fps
from reelspark.streaming.select import select_stream


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def arr(v):
    return F.lit(None).cast("array<double>") if v is None else F.array(*[F.lit(float(x)) for x in v])


def test_three_cosines(spark):
    a, zero, tiny = [1.0, 0.0], [0.0, 0.0], [1e-9, 0.0]
    for other, dist, group, strict in ((None, 0, 0, None), (zero, 0, 1, 0), (tiny, 0, 1, 1), (a, 0, 1, 1), ([0.0, 1.0], 1, 0, 0)):
        assert abs(one(spark, V.cosine_distance(arr(a), arr(other))) - dist) < 1e-12
        assert abs(one(spark, V.similarity_grouping(arr(a), arr(other))) - group) < 1e-12
        got = one(spark, V.similarity_strict(arr(a), arr(other)))
        assert got is None if strict is None else abs(got - strict) < 1e-12


def test_fps_rule(spark):
    for c, o, want in ((25.0, None, 25.0), (0.0, None, 30.0), (25.0, 24.0, 24.0), (25.0, 0.0, 30.0), (None, None, 30.0)):
        assert one(spark, resolve_fps(F.lit(c).cast("double"), F.lit(o).cast("double"))) == want


def test_entity_delta_like_the_expression(spark):
    r = random.Random(2)
    kind = "array<struct<bbox:array<double>,confidence:double,class_id:int,class_name:string>>"

    def some():
        out = []
        for _ in range(r.randint(0, 4)):
            x, y = r.randint(0, 6), r.randint(0, 6)
            out.append({"bbox": [x, y, x + r.randint(1, 6), y + r.randint(1, 6)], "confidence": 0.5, "class_id": r.randint(0, 1), "class_name": "c"})
        return [dict(e, bbox=[float(v) for v in e["bbox"]]) for e in out]

    rows = [(i, some(), some()) for i in range(200)] + [(900, None, some()), (901, None, None)]
    got = spark.createDataFrame(rows, f"i int, a {kind}, b {kind}").select("i", E.delta_greedy(F.col("a"), F.col("b")).alias("d")).collect()
    pairs = {i: (a or [], b or []) for i, a, b in rows}
    slim = lambda es: [(e["class_id"], e["bbox"]) for e in es]
    assert all(abs(x.d - entity_delta(*map(slim, pairs[x.i]))) < 1e-9 for x in got)


def buffer_model(pattern):
    """Kinds that a release buffer of four gives: an independent model of filling and holding."""
    kinds, held, out = [], [], []
    for k, c in enumerate(pattern):
        kinds.append("R" if c == "R" else "Z")
        held.append(k)
        if c == "R":
            real = [i for i in held[:-1] if pattern[i] == "R"]
            if real:
                for i in range(real[-1] + 1, k):
                    kinds[i] = "L"
        if len(held) >= 4:
            out.append(held.pop(0))
    for a, b in zip(held, held[1:]):
        if pattern[b] != "R" and pattern[a] == "R":
            kinds[b] = "H"
    return "".join(kinds)


def test_gap_kinds_for_every_pattern(spark):
    patterns = ["".join(p) for n in range(1, 9) for p in itertools.product("RS", repeat=n)]
    rows = [(v, k, c == "R") for v, p in enumerate(patterns) for k, c in enumerate(p)]
    got = emit.gap_kinds(spark.createDataFrame(rows, "video_id bigint, slot bigint, real boolean")).select("video_id", "slot", "kind").collect()
    kinds: dict = {}
    for x in sorted(got):
        kinds[x.video_id] = kinds.get(x.video_id, "") + x.kind
    assert all(kinds[v] == buffer_model(p) for v, p in enumerate(patterns))


def smooth_sequence(x, threshold=0.85):
    """Plain model: position t uses the smoothed t-2 and t-1 and the raw rest."""
    y, changed = x.copy(), np.zeros(len(x), bool)
    for t in range(2, len(x) - 2):
        block = y[t - 2 : t + 3]
        unit = block / (np.linalg.norm(block, axis=1) + 1e-8)[:, None]
        if (unit @ unit.T).mean() > threshold:
            mix = np.array(emit.TAPS) @ block
            y[t] = mix / (np.linalg.norm(mix) + 1e-8)
            changed[t] = True
    return y, changed


def test_smoothing_like_the_sequence(spark):
    r = np.random.default_rng(3)
    x = 1 + r.normal(0, 1, (400, 8)) * np.repeat(r.choice([0.2, 0.45, 0.8], 40), 10)[:, None]
    rows = [(1, 3 * k, v.tolist()) for k, v in enumerate(x)] + [(2, k, v.tolist()) for k, v in enumerate(x[:4])]
    got = emit.smoothed(spark.createDataFrame(rows, "video_id bigint, slot bigint, clip_emb array<double>"), chunk=70, halo=30).collect()
    want, changed = smooth_sequence(x)
    mine = {g.slot // 3: g for g in got if g.video_id == 1}
    assert 50 < changed.sum() < 390 and all(np.allclose(mine[k].clip_emb, want[k], atol=1e-12) and mine[k].smoothed == changed[k] for k in range(400))
    assert len(got) == 404


def test_slots_never_close_early(spark):
    rows = [(v, v * 0.0137) for v in range(200)] + [(500, 0.04166666666 * 7 + 0.08333333333 / 2)]
    got = {x.video_id: x.n_slots for x in timeline.video_slots(spark.createDataFrame(rows, "video_id bigint, ts double")).collect()}
    for v, t in rows:
        assert got[v] == sum(1 for k in range(400) if k * 0.04166666666 + 0.08333333333 / 2 <= t)


def frames_of(n, seed=0, cost=30.0, cut=None):
    r = np.random.default_rng(seed)
    base = r.normal(size=8)
    v = [base + r.normal(0, 0.1, 8) if cut is None or i < cut else -base for i in range(n)]
    s = [{"consistency": 0.9, "entity": 0.1, "gate": r.random(), "semantic": r.random(), "motion": 0.1, "total": r.random()} for _ in range(n)]
    return [(cost, s[i], [], 0, v[i]) for i in range(n)]


def plain_groups(frames, cfg):
    """Plain model of the greedy merge over (cost, scores, classes, words, vector): everything is recomputed at every step."""
    sim = lambda a, b: 0.0 if a is None or b is None else float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)) if a.any() and b.any() else 1.0

    def price(at):
        classes = [c for i in at for c in frames[i][2]]
        return sum(frames[i][0] for i in at) + cfg.entity_cost * sum(1 / (classes.count(c) + 1) for c in set(classes)) + cfg.subtitle_cost * sum(frames[i][3] for i in at)

    def affinity(i, j):
        x, y, s = frames[i][1], frames[j][1], sim(frames[i][4], frames[j][4])
        raw = 0.65 * (0.5 * (x["consistency"] + y["consistency"])) + 0.25 * (1 - 0.5 * (x["entity"] + y["entity"])) + 0.10 * s
        return 0.0 if s < 0.2 else min(1.0, max(0.0, raw))

    def priority(at, k):
        s, near = frames[at[k]][1], [frames[at[j]][4] for j in (k - 1, k, k + 1) if 0 <= j < len(at)]
        bonus = 0.5 * (sim(near[0], near[1]) + sim(near[1], near[2])) if len(near) == 3 and all(v is not None for v in near) else 0.0
        return 0.45 * s["gate"] + 0.25 * s["semantic"] + 0.15 * s["motion"] + 0.15 * s["total"] - 0.30 * bonus

    def squeeze(at, least):
        drops = max(1, int(len(at) * cfg.max_drop)) if len(at) > 2 else 0
        at = list(at)
        while price(at) > cfg.limit and drops and len(at) > max(2, least):
            at.pop(min(range(1, len(at) - 1), key=lambda k: priority(at, k)))
            drops -= 1
        return at if price(at) <= cfg.limit else None

    parts, banned, new = [(i, [i]) for i in range(len(frames))], set(), len(frames)
    bar = cfg.merge_threshold - (0.05 if cfg.dynamic else 0.0)
    while True:
        open_ = []
        for k in range(len(parts) - 1):
            (a, x), (b, y) = parts[k], parts[k + 1]
            if (a, b) not in banned:
                open_.append((-(affinity(x[-1], y[0]) - (min(0.2, 0.01 * (len(x) + len(y))) if cfg.dynamic else 0.0)), a, b, k))
        if not open_ or -min(open_)[0] < bar:
            return parts
        _, a, b, k = min(open_)
        both = parts[k][1] + parts[k + 1][1]
        if len(both) <= int(cfg.fps * cfg.max_sec) and price(both) > cfg.limit:
            both = squeeze(both, int(cfg.fps * cfg.min_sec)) or [0] * 10**6
        if len(both) > int(cfg.fps * cfg.max_sec):
            banned.add((a, b))
            continue
        parts[k : k + 2] = [(new, both)]
        new += 1


def grouped(spark, videos, cfg, embedding="embedding"):
    kind = "array<struct<bbox:array<double>,confidence:double,class_id:int,class_name:string>>"
    rows = [
        (1000 * v + i, v, i, c, s, [{"bbox": [], "confidence": 1.0, "class_id": k, "class_name": "c"} for k in e], ["w"] * w, None if x is None else x.tolist())
        for v, frames in videos.items() for i, (c, s, e, w, x) in enumerate(frames)
    ]
    df = spark.createDataFrame(rows, f"node_id bigint, video_id bigint, frame_index int, token_cost double, scores map<string,double>, entities {kind}, subtitles array<string>, embedding array<double>")
    out: dict = {}
    for r in grouping.group_frames(df, cfg, embedding).collect():
        out.setdefault(r.video_id, {}).setdefault(r.cluster_id, []).append(r.node_id - 1000 * r.video_id)
    return {v: sorted((c, sorted(at)) for c, at in g.items()) for v, g in out.items()}


def test_grouping_like_the_plain_model(spark):
    r = np.random.default_rng(4)

    def some(n):
        base, out = r.normal(size=8), []
        for _ in range(n):
            base = base + r.normal(0, 0.5, 8) if r.random() < 0.9 else r.normal(size=8)
            s = {k: float(r.random()) for k in ("consistency", "entity", "gate", "semantic", "motion", "total")}
            out.append((float(r.choice([10.0, 30.0, 5.0])), s, r.integers(0, 3, r.integers(0, 3)).tolist(), int(r.integers(0, 6)), None if r.random() < 0.05 else np.zeros(8) if r.random() < 0.05 else base.copy()))
        return out

    videos = {v: some(n) for v, n in ((1, 90), (2, 1), (3, 45), (4, 70))}
    for cfg in (grouping.DEFAULT, grouping.Grouping(limit=90.0, min_sec=0.1, merge_threshold=0.3), grouping.Grouping(limit=200.0, dynamic=False, max_sec=0.3, merge_threshold=0.4)):
        assert grouped(spark, videos, cfg) == {v: sorted((c, sorted(at)) for c, at in plain_groups(f, cfg)) for v, f in videos.items()}


def test_grouping_limits_and_cuts(spark):
    groups = grouped(spark, {1: frames_of(145), 2: frames_of(30, cut=11)}, grouping.DEFAULT)
    assert sorted(i for _, at in groups[1] for i in at) == list(range(145)) and all(30 * len(at) <= 1200 for _, at in groups[1])
    assert all(max(at) < 11 or min(at) >= 11 for _, at in groups[2])
    assert grouped(spark, {1: frames_of(5)}, grouping.DEFAULT, None) == {1: [(i, [i]) for i in range(5)]}


def segment(frames, cfg):
    keep = [0.45 * s["gate"] + 0.25 * s["semantic"] + 0.15 * s["motion"] + 0.15 * s["total"] for _, s, *_ in frames]
    return grouping.Segment([f[0] for f in frames], [f[2] for f in frames], [f[3] for f in frames], cfg, None, keep, [f[4] for f in frames])


def test_squeeze():
    cfg = grouping.Grouping(limit=100.0, min_sec=0.1)
    seq = segment(frames_of(14, cost=10.0), cfg)
    kept = seq.squeeze(list(range(14)), 2)
    assert kept[0] == 0 and kept[-1] == 13 and len(kept) == 10
    assert segment(frames_of(67), grouping.DEFAULT).squeeze(list(range(67)), 66) is None
    assert seq.squeeze([0, 1], 2) == [0, 1]


def test_subtitles_and_words(spark):
    many = F.array(F.lit("a b"), F.lit(None), F.lit("  "), F.lit(" c\td "))
    assert one(spark, grouping.words(grouping.normalize_subtitles(None, many))) == 4
    assert one(spark, grouping.normalize_subtitles(F.lit(" "), None)) == [" "]
    assert one(spark, grouping.normalize_subtitles(F.lit(None).cast("string"), None)) == []


def test_tempo(spark):
    rows = [(10.0, 10.05), (10.0, 20.0), (10.0, 2.0), (10.0, None), (0.0, 5.0), (1.0, 500.0)]
    df = spark.createDataFrame(rows, "v double, a double")
    p = recon.tempo_plan(F.col("v"), F.col("a"))
    got = [(x.n, x.f) for x in df.select(p["n_filters"].alias("n"), p["filter_ratio"].alias("f")).collect()]
    assert got[0] == (0, None) and got[1] == (1, 2.0) and got[3] == (0, None) and got[4] == (1, 1.0) and got[5] == (1, 100.0)
    assert got[2][0] == 3 and abs(got[2][1] ** 3 - 0.2) < 1e-12


def test_red_image():
    img = np.zeros((224, 224, 3), np.uint8)
    img[..., 2] = 255
    assert recon.laplacian_variance(recon.gray(img)) == 0.0
    img[100, 100] = 0
    assert recon.laplacian_variance(recon.gray(img)) > 0


def test_selection_rules_and_stream(spark, sf, tmp_path):
    batch = {(x.video_id, x.slot): x for x in reference.selection_fold(spark, sf).collect()}
    frames = clean_frames(spark, sf)
    closed = {(x.video_id, x.slot) for x in timeline.all_slots(frames).collect()}
    assert set(batch) == closed
    src = str(tmp_path / "in")
    frames.repartition(1).write.parquet(src)
    stream = spark.readStream.schema(frames.schema).parquet(src)
    q = select_stream(stream).writeStream.format("memory").queryName("chosen").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(x.video_id, x.slot): x for x in spark.table("chosen").collect()}
    assert set(got) == set(batch)
    assert all(got[k].frame_idx == batch[k].frame_idx and got[k].is_synthetic == batch[k].is_synthetic for k in batch)


def test_best_of_equals_is_the_earliest(spark):
    from reelspark.operators.score import argmax_select

    rows = [(1, 0, 5, 0.2, 0.5), (1, 0, 4, 0.1, 0.5), (1, 0, 6, 0.3, 0.4), (1, 1, 7, 0.4, float("nan")), (1, 1, 8, 0.5, 0.1)]
    got = argmax_select(spark.createDataFrame(rows, "video_id bigint, slot bigint, frame_idx bigint, ts double, total double"), "total").collect()
    assert {(x.slot, x.frame_idx) for x in got} == {(0, 4), (1, 8)}


def test_whole_pipeline(spark, sf, tmp_path):
    import dataclasses

    from reelspark.config import Config, from_dict
    from reelspark.plans import pipeline

    assert from_dict({"clip_grouping": {"enabled": False, "effective_context_limit": 90}, "dimensions": {"clip": 64}}).grouping.limit == 90.0
    cfg = Config(clip_dim=64, dino_dim=16)
    frames = clean_frames(spark, sf)
    paths = pipeline.run(spark, frames, str(tmp_path / "a"), cfg)
    scores, clips = spark.read.json(paths["scores"]), spark.read.json(paths["clips"])
    n = timeline.all_slots(frames).count()
    assert scores.count() == n == clips.count()  # without vectors nothing merges
    assert scores.where("is_synthetic <> (native IS NULL)").count() == 0
    merged = pipeline.run(spark, frames, str(tmp_path / "b"), dataclasses.replace(cfg, grouping_embedding="clip_emb"))
    assert spark.read.json(merged["clips"]).selectExpr("sum(cluster_frame_count)").first()[0] == n
    assert "clips" not in pipeline.run(spark, frames.limit(0), str(tmp_path / "c"), cfg)


def test_checkpoint_folder_of_a_cluster(spark, monkeypatch):
    from reelspark import session

    assert session.is_local("local[4]") and session.is_local("local") and not session.is_local("local-cluster[2,1,1024]") and not session.is_local("yarn")
    unset = type("U", (), {"isDefined": staticmethod(lambda: False)})
    fake = type("S", (), {"master": "yarn", "_jsc": type("J", (), {"sc": staticmethod(lambda: type("C", (), {"getCheckpointDir": staticmethod(lambda: unset)}))})})
    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        session.ensure_checkpoint_dir(type("P", (), {"sparkContext": fake, "conf": type("F", (), {"get": staticmethod(lambda k, d: d)})}))


def test_settings_reach_the_engine(spark):
    from reelspark.config import from_dict

    c = from_dict({"pipeline": {"stride_sec": 0.1, "target_window_sec": 0.2, "target_fps": 10}, "memory": {"faiss_max_elements": 5, "enforce_bound": True}, "scoring": {"eps": 1e-3}})
    assert (c.stride_sec, c.window_sec, c.target_fps, c.bank_bound, c.enforce_bank_bound, c.eps) == (0.1, 0.2, 10.0, 5, True, 1e-3)
    frames = spark.createDataFrame([(1, i, i * 0.05) for i in range(40)], "video_id bigint, frame_idx bigint, ts double")
    slots = timeline.all_slots(frames, stride=0.1, window=0.2).count()
    assert slots == sum(1 for k in range(100) if k * 0.1 + 0.1 <= 39 * 0.05)
    held = timeline.candidates(frames, 0.1, 0.2).collect()
    assert {(h.slot, h.frame_idx) for h in held} == {(k, i) for k in range(slots) for i in range(40) if k * 0.1 - 0.1 <= i * 0.05 < k * 0.1 + 0.1}
    late = timeline.all_slots(spark.createDataFrame([(1, 0, 50.0)], "video_id bigint, frame_idx bigint, ts double"), block=4)
    assert [r.slot for r in late.orderBy("slot").collect()] == list(range(1200))


def test_pictures_from_files_to_vectors(spark, tmp_path):
    from reelspark.sources.frames import decode_with, infer_with, probe_durations, video_files

    r = np.random.default_rng(1)
    for k in range(3):
        (tmp_path / f"v{k}.raw").write_bytes(r.integers(0, 256, (5, 4, 6, 3), dtype=np.uint8).tobytes())

    def decoder(path, content):
        for i in range(0, len(content), 72):
            yield {"path": path, "frame_idx": i // 72, "height": 4, "width": 6, "n_channels": 3, "pixels": content[i : i + 72]}

    frames = decode_with(video_files(spark, str(tmp_path)), decoder, "path string, frame_idx bigint, height int, width int, n_channels int, pixels binary")
    assert frames.count() == 15
    frames = frames.withColumn("pixels", F.when(F.col("frame_idx") != 4, F.col("pixels")))
    def load():
        return lambda images: [i.reshape(-1, 3).mean(0) for i in images]

    got = infer_with(frames, load, "clip_emb", 8).collect()
    for g in got:
        if g.pixels is None:
            assert g.clip_emb is None
            continue
        want = np.resize(np.frombuffer(g.pixels, np.uint8).reshape(-1, 3).mean(0), 8)
        assert np.allclose(g.clip_emb, want / np.linalg.norm(want))

    def probe(path):
        if path.endswith("v1.raw"):
            raise OSError("broken")
        return None if path.endswith("v2.raw") else 3.5

    found = {p.path[-6:]: p.duration for p in probe_durations(video_files(spark, str(tmp_path)), probe).collect()}
    assert found == {"v0.raw": 3.5, "v1.raw": None, "v2.raw": None}


def test_resize_and_flow(spark):
    r = np.random.default_rng(2)
    img = r.integers(0, 256, (8, 12, 3), dtype=np.uint8)
    assert (recon.resized(img, 4, 6) == np.rint(img.reshape(4, 2, 6, 2, 3).mean((1, 3))).astype(np.uint8)).all()
    assert recon.resized(np.full((5, 7), 90, np.uint8), 20, 30, "lanczos4").min() == 90 == recon.resized(np.full((5, 7), 90, np.uint8), 20, 30, "lanczos4").max()
    yy, xx = np.mgrid[:60, :80]
    scene = lambda dx: np.rint(127 + 60 * np.sin((xx - dx) / 5) * np.cos(yy / 7)).astype(np.uint8)
    assert recon.dense_flow(scene(0), scene(0)) == 0.0 and abs(recon.dense_flow(scene(0), scene(2)) - 2) < 0.5
    rows = [(1, k, scene(k).tobytes(), 60, 80, 1) for k in range(5)] + [(1, 5, None, 60, 80, 1), (2, 0, scene(0).tobytes(), 60, 80, 1)]
    df = spark.createDataFrame(rows, "video_id bigint, frame_idx bigint, pixels binary, height int, width int, n_channels int")
    got = {(g.video_id, g.frame_idx): g.optical_flow_mag for g in recon.flow_with(df, size=(80, 60), chunk=3).collect()}
    assert got[(1, 0)] == got[(2, 0)] == got[(1, 5)] == 0.0 and all(abs(got[(1, k)] - 1) < 0.4 for k in range(1, 5)) and len(got) == 7


def test_blends_and_black(spark):
    data = [(1, 0, None), (1, 2, (1, 1, 3, b"\x00\x0a\xff")), (1, 3, None), (1, 5, (1, 1, 3, b"\x01\x14\x00")), (1, 9, None), (2, 0, None), (3, 0, (1, 2, 3, b"\x01" * 6)), (3, 1, None)]
    df = spark.createDataFrame(data, "video_id bigint, slot bigint, frame_data struct<height:int,width:int,n_channels:int,pixels:binary>")
    got = {(g.video_id, g.slot): (g.how, None if g.pixels is None else bytes(g.pixels)) for g in recon.fill_pixels(df, emit.blend_plan(df)).collect()}
    assert got[(1, 0)] == ("copy_next", b"\x00\x0a\xff") and got[(1, 9)] == ("copy_prev", b"\x01\x14\x00")
    assert got[(1, 3)] == ("blend", bytes([0, 15, 128])) and got[(2, 0)] == ("black", b"") and got[(3, 1)] == ("copy_prev", b"\x01" * 6)


def test_matrix_with_zero_rows(spark):
    from reelspark.operators.score import cosine_matrix, diversity

    rows = [(1, 0, 0, [1.0, 0.0]), (1, 0, 1, [0.0, 0.0]), (1, 0, 2, [3.0, 4.0]), (1, 0, 3, None), (1, 1, 2, [3.0, 4.0])]
    df = spark.createDataFrame(rows, "video_id bigint, slot bigint, frame_idx bigint, v array<double>")
    got = {(m.slot, m.frame_idx, m.other_idx): m.similarity for m in cosine_matrix(df, "v").collect()}
    assert len(got) == 17 and got[(0, 0, 0)] == 1 and abs(got[(0, 0, 2)] - 0.6) < 1e-12 and got[(0, 1, 1)] == got[(0, 1, 2)] == got[(0, 3, 0)] == 0
    near = {(m.slot, m.frame_idx): m.d_val for m in diversity(df, "v").collect()}
    assert near[(0, 0)] == near[(0, 1)] == 1.0 and near[(1, 2)] == 0.0


def test_bank_in_blocks():
    from reelspark.operators.select import Bank

    r = np.random.default_rng(0)
    bank, plain, q = Bank(6), Bank(6, 30), r.normal(size=(40, 6))
    for step in range(3):
        bank.look_ahead(q)
        for k in range(0, 40, 2):
            assert np.allclose(bank.novelty(q[k : k + 2], at=slice(k, k + 2)), bank.novelty(q[k : k + 2]))
            bank.add(q[k])
            plain.add(q[k])
    assert plain.n == 30 and bank.n == 60


def decoded(path, content):
    for k in range(30):
        x = [float(np.cos(k / 9 + j)) for j in range(64)]
        yield {"video_id": 5, "frame_id": k, "frame_idx": k, "ts": k / 25, "clip_emb": x, "dino_emb": x[:16], "blur_variance": 10.0 + k % 7, "optical_flow_mag": 1.0 + k % 3, "entities": None}


def sound(path):
    return 1.25 if path.endswith("a.raw") else None


def test_command_line(spark, tmp_path):
    from reelspark.__main__ import main

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.raw").write_bytes(b"x")
    (tmp_path / "c.yaml").write_text("dimensions: {clip: 64, dino: 16}")
    here = "tests.test_engine"
    paths = main(["--video_path", str(tmp_path / "in"), "--decoder", f"{here}:decoded", "--probe", f"{here}:sound", "--output_dir", str(tmp_path / "out"), "--config", str(tmp_path / "c.yaml")])
    clips = spark.read.json(paths["clips"])
    assert spark.read.json(paths["scores"]).count() == clips.count() > 20
    assert set(clips.select("score_profile.*").columns) == {"semantic_avg", "motion_max", "entity_avg", "consistency_avg", "total_avg"} and clips.first().path.endswith(".mp4")
    assert spark.read.json(paths["audio"]).first().duration == 1.25
    with pytest.raises(SystemExit):
        main(["--video_path", "x"])


def test_clips_to_an_encoder(spark):
    # a clip sees only its own slots, squeezed-out ones too, and every picture reaches the encoder in order
    from reelspark.sources.sinks import encode_clips

    one = lambda v: (1, 1, 3, bytes([v] * 3))
    data = [(1, k, one(10 * k) if k in (1, 3, 6) else None) for k in range(8)]
    df = spark.createDataFrame(data, "video_id bigint, slot bigint, frame_data struct<height:int,width:int,n_channels:int,pixels:binary>")
    clips = spark.createDataFrame([(1, 0, 0, 2), (1, 1, 2, 5), (1, 2, 7, 7)], "video_id bigint, clip_index int, start_frame_index int, end_frame_index int")
    slots = grouping.clip_slices(df, clips).withColumn("clip_id", F.col("clip_index").cast("bigint"))
    pictures = recon.fill_pixels(slots.select("clip_id", "slot", "frame_data"), emit.blend_plan(slots.select("clip_id", "slot", "frame_data"), "clip_id"), "clip_id")

    def encoder(clip, rows):
        return {"clip_id": int(clip), "n": len(rows), "stream": b"".join(bytes(p) for p in rows["pixels"])}

    got = {r.clip_id: (r.n, bytes(r.stream)) for r in encode_clips(pictures, encoder, "clip_id bigint, n int, stream binary").collect()}
    assert got == {0: (3, bytes([10] * 9)), 1: (4, bytes([30] * 12)), 2: (1, b"")}
