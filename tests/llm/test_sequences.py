"""Runs, pieces and tokens against plain models."""

import random

import numpy as np
import pytest

from reelspark.llm import tokens
from reelspark.llm.runs import collapse_runs
from reelspark.llm.split import cut_points, gap_similarity, split_oversized, valley_depth

DIM = 64


def unit(seed):
    v = np.random.default_rng(seed).normal(size=DIM)
    return np.round(v / np.linalg.norm(v), 3).tolist()


def model_runs(rows):
    """Runs of one entity's (slot, stamp, vector), slots unique."""
    out, before = [], None
    for slot, stamp, v in sorted(rows, key=lambda r: r[0]):
        if stamp is None or stamp != stamp:
            before = None
            continue
        same = False
        if before is not None and slot == before[0] + 1:
            same = stamp == before[1]
            if not same and v is not None and before[2] is not None and any(v) and any(before[2]):
                a, b = np.array(v), np.array(before[2])
                same = a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.985
        if same:
            out[-1][1] = slot
        else:
            out.append([slot, slot])
        before = (slot, stamp, v)
    return {tuple(r) for r in out}


SCHEMA = "video_id bigint, slot bigint, stamp double, vec array<double>, tt double, block string"


@pytest.mark.parametrize("block", [4, 16, 2048])
def test_runs_like_the_model(spark, block):
    r = random.Random(block)
    rows, by = [], {}
    for e in (1, 2, None):
        slot, stamp, v = 0, 0.1, unit(1)
        for _ in range(150):
            slot += 1 if r.random() < 0.93 else 3
            if r.random() < 0.4:
                stamp = round(stamp + 0.1, 3)
                v = unit(r.randint(0, 3)) if r.random() < 0.7 else v
            row = (e, slot, None if r.random() < 0.05 else stamp, None if r.random() < 0.05 else [0.0] * DIM if r.random() < 0.05 else v, slot * 0.04, "x")
            rows += [row] * r.choice([1, 1, 1, 2])
            by.setdefault(e, []).append(row[1:4])
    rows.append((1, None, 0.1, unit(1), 0.0, "x"))
    r.shuffle(rows)
    got = collapse_runs(spark.createDataFrame(rows, SCHEMA), "video_id", "slot", "stamp", "vec", "tt", block=block).collect()
    for e, some in by.items():
        mine = [x for x in got if x.video_id == e]
        assert {(x.first_slot, x.last_slot) for x in mine} == model_runs(some)
        assert all(x.n_slots == x.last_slot - x.first_slot + 1 and abs(x.duration - 0.04 * (x.n_slots - 1)) < 1e-9 for x in mine)


@pytest.mark.parametrize(("block", "slots", "time", "anchor"), [(8, 3, None, "previous"), (8, 3, 0.09, "previous"), (16, 1, 0.05, "previous"), (8, 3, 0.09, "first"), (8, 1, None, "first")])
def test_tolerances_and_anchor(spark, block, slots, time, anchor):
    r = random.Random(block + slots)
    rows, want = [], set()
    for e in (1, 2):
        slot, v, mine = 0, np.array(unit(1)), []
        for _ in range(200):
            slot += r.choice([1, 1, 1, 2, 3, 5])
            v = v + np.random.default_rng(slot).normal(0, 0.012, DIM) if r.random() < 0.95 else np.array(unit(slot))
            mine.append((slot, float(slot), v / np.linalg.norm(v), slot * 0.03))
        rows += [(e, s, t, x.tolist(), tt, "x") for s, t, x, tt in mine]
        runs, held = [], None
        for k, (s, t, x, tt) in enumerate(mine):
            same = k and s - mine[k - 1][0] <= slots and (time is None or tt - mine[k - 1][3] <= time + 1e-9) and x @ (mine[k - 1][2] if anchor == "previous" else held) >= 0.985
            if same:
                runs[-1] = [runs[-1][0], s, runs[-1][2] + 1]
            else:
                runs.append([s, s, 1])
                held = x
        want |= {(e, *q) for q in runs}
    r.shuffle(rows)
    got = collapse_runs(spark.createDataFrame(rows, SCHEMA), "video_id", "slot", "stamp", "vec", "tt", block=block, most_slots=slots, most_time=time, anchor=anchor)
    assert {(g.video_id, g.first_slot, g.last_slot, g.n_slots) for g in got.collect()} == want


def test_one_run_over_many_blocks_and_empty(spark):
    rows = [(1, k, 5.0, None, k * 1.0, "x") for k in range(100)]
    got = collapse_runs(spark.createDataFrame(rows, SCHEMA), "video_id", "slot", "stamp", "vec", "tt", block=8).collect()
    assert [(x.first_slot, x.last_slot, x.duration) for x in got] == [(0, 99, 99.0)]
    assert collapse_runs(spark.createDataFrame([], SCHEMA), "video_id", "slot", "stamp", "vec", "tt").count() == 0


def test_pieces_keep_the_rules():
    r = np.random.default_rng(1)
    for _ in range(300):
        n = int(r.integers(1, 60))
        cost = r.choice([5.0, 30.0, 60.0, 0.0], n)
        boundary = r.random(max(n - 1, 0)) < 0.15
        pieces = cut_points(cost, boundary, np.zeros(max(n - 1, 0)), 200.0, 2, "latest")
        if cost.sum() <= 200:
            assert pieces == [(0, n - 1, "whole")]
            continue
        assert pieces[0][0] == 0 and pieces[-1][1] == n - 1
        for (a, b, kind), (c, d, _) in zip(pieces, pieces[1:]):
            assert c == max(b - 1, a) and d > b
            assert (kind == "boundary") == bool(boundary[b] and kind != "size")
        assert all(cost[a : b + 1].sum() <= 200 for a, b, _ in pieces)


def test_single_item_above_the_limit_stands_alone():
    got = cut_points(np.array([10.0, 500.0, 10.0, 10.0]), np.zeros(3, bool), np.zeros(3), 100.0, 2, "latest")
    assert [(a, b) for a, b, _ in got] == [(0, 0), (1, 1), (2, 3)]


def test_valleys():
    x = np.vstack([np.tile([1.0, 0.1], (5, 1)), np.tile([0.1, 1.0], (5, 1))])
    sim = gap_similarity(x, np.ones(10, bool), 3)
    assert sim.argmin() == 4 and valley_depth(sim).argmax() == 4
    assert np.isnan(gap_similarity(x, np.zeros(10, bool), 1)).all()


FRAMES = "cluster_id bigint, frames array<struct<node_id:bigint,frame_index:int,token_cost:double,embedding:array<double>>>, piece string"


def test_split_rows(spark):
    f = [(k, k, None, unit(1) if k < 30 else [-x for x in unit(1)]) for k in range(60)]
    jumbled = [f[k] for k in random.Random(1).sample(range(60), 60)] + f[3:6]
    rows = [(1, jumbled, "x"), (1, jumbled, "x"), (2, f[:40], "x"), (3, None, "x"), (4, [], "x"), (None, f, "x"), (5, [(1, None, 5000.0, None), (2, 1, float("nan"), None)], "x")]
    got = sorted((x.cluster_id, x.first_index, x.last_index, x.cut) for x in split_oversized(spark.createDataFrame(rows, FRAMES), "cluster_id", "frames", 1200.0).collect())
    assert got == [(1, 0, 29, "boundary"), (1, 28, 59, "end")]


PATH = f"{tokens.TOKENIZERS}/{tokens.VOCABULARY}"


def test_tree_join_is_exact():
    enc, back, pattern = tokens.load(PATH)
    r = random.Random(3)
    for letters in ("ab", "abcdefgh", "thequickbrownfox", "你好世界光", "aAé­ \n\t", "0123456789", "=-_*#", "don't we'll "):
        for _ in range(20):
            t = "".join(r.choice(letters) for _ in range(r.randint(0, 1500)))
            for limit in (5, 33, 256):
                parts = [(k, tokens.encode_part(b, k, enc)) for b, k in tokens.cut(t, limit, pattern)]
                assert tokens.assemble(parts, enc, back) == enc.encode_ordinary(t)


def test_corpus_round_trip_and_reference(spark):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    tk.encode_special_tokens = True
    texts = [None, "", " ", "Hello  world\n", "<|endoftext|> x", "a" * 5000, "word " * 2000 + "  \n", "漢字かな" * 900, "é \U0001f600 ﬁ", "\r\n\t x" * 700]
    rows = [(i, t, "z", [1]) for i, t in enumerate(texts)] + [(5, texts[5], "z", [1]), (None, "null id", "z", [1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, doc string, ids array<int>")
    got = tokens.encode_corpus(df, "doc_id", "text", long_text=1024).collect()
    assert len(got) == len(rows) and sum(g.doc_id == 5 for g in got) == 2
    enc, back, _ = tokens.load(PATH)
    for g in got:
        t = "null id" if g.doc_id is None else texts[g.doc_id]
        assert g.ids == (tk.encode(t, add_special_tokens=False).ids if t else [])
        assert b"".join(back[i] for i in g.ids).decode() == (t or "")
    assert tokens.encode_corpus(df.limit(0), "doc_id", "text").count() == 0
