"""Faulty readings and the regular grid on small hand-made tables."""

import math
import random

from reelspark.operators.regrid import regular_grid
from reelspark.operators.spikes import SpikeRule, flag_readings
from reelspark.plans.core_problems import QUERIES

RULES = {"a": SpikeRule(high=1000.0), "b": SpikeRule(high=200.0, zero_at_first_index=True)}
SCHEMA = "v bigint, i bigint, id bigint, a double, b double, extra string"


def readings(n=120, seed=1):
    r = random.Random(seed)
    return [[1, k, k, 50 * math.exp(r.gauss(0, 0.1)), 2 * math.exp(r.gauss(0, 0.1)), "x"] for k in range(n)]


def flags(spark, rows, **kw):
    got = flag_readings(spark.createDataFrame(rows, SCHEMA), "v", "i", "id", RULES, **kw).collect()
    return {(r.row_id, r.metric): r.flag for r in got}


def test_kinds(spark):
    rows = readings()
    rows[10][3] = 400.0  # spike
    rows[30][3], rows[31][3] = 5.0, 5.1  # drop of two
    for k in range(50, 57):
        rows[k][3] = 47.0  # stuck
    rows[70][3], rows[71][3], rows[72][3], rows[73][3] = -1.0, float("nan"), float("inf"), 2000.0
    for k in range(90, 94):
        rows[k][3] = 300.0  # four in a row are no spike
    rows[0][4] = 0.0  # the first flow is no case
    got = flags(spark, rows)
    want = {(10, "a"): "spike", (30, "a"): "spike", (31, "a"): "spike"}
    want |= {(k, "a"): "stuck" for k in range(50, 57)} | {(k, "a"): "impossible" for k in range(70, 74)}
    assert got == want


def test_found_readings_run_no_model(spark, sf):
    """p3_found has no stage that its rows don't depend on; they are the readings that p3_readings judges with the model."""
    found, judged = (QUERIES[q](spark, sf) for q in ("p3_found", "p3_readings"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile_approx" in plan(judged) and "percentile_approx" not in plan(found)
    assert "probability" not in plan(found)
    rows = found.collect()
    assert rows and sorted(rows) == sorted((r.frame_id, r.metric) for r in judged.collect())


def test_chunks_answer_like_the_whole(spark):
    rows = readings(900, 3)
    for k in range(20, 900, 37):
        rows[k][3] *= 6
    for k in range(250, 262):
        rows[k][4] = 1.5
    assert flags(spark, rows, chunk=128, halo=64) == flags(spark, rows, chunk=4096, halo=64)


def test_nulls_repeats_and_empty(spark):
    rows = readings(60)
    rows[5][3] = None
    rows += [list(rows[7]), [None, 3, 900, 5000.0, 1.0, None], [1, None, 901, -3.0, None, None], [1, 4000, None, -1.0, 1.0, None]]
    assert flags(spark, rows) == {(900, "a"): "impossible", (901, "a"): "impossible"}
    assert flags(spark, []) == {}


def test_grid_against_brute_force(spark):
    r = random.Random(5)
    rows, t = [], 0.0
    for k in range(700):
        t += r.choice([0.02, 0.04, 0.04, 0.05, 0.3 if r.random() < 0.05 else 0.04])
        rows.append((1, t, 10 + math.sin(t), "e"))
    rows += [rows[3], (1, None, 1.0, "e"), (1, float("nan"), 1.0, "e"), (1, -4.0, 1.0, "e"), (None, 1.0, 5.0, "e"), (2, 100.0, None, "e")]
    df = spark.createDataFrame(rows, "v bigint, t double, x double, t_extra string")
    got = regular_grid(df, "v", "t", {"x": (0.0, 100.0)}, chunk=64, halo=48).collect()
    half, stride = 0.08333333333 / 2, 0.04166666666
    times = [t for v, t, *_ in rows if v == 1 and t is not None and t >= 0]
    held = {k for t in times for k in range(max(0, int(t / stride) - 2), int(t / stride) + 4) if k * stride - half <= t < k * stride + half}
    mine = {x.slot: x for x in got if x.v == 1}
    assert sorted(mine) == list(range(min(held), max(held) + 1))
    assert {k for k, x in mine.items() if not x.is_synthetic} == held
    assert all(abs(x.x_est - (10 + math.sin(x.target_timestamp))) < 0.3 for x in mine.values())
    gap = [x.x_sd for x in mine.values() if x.is_synthetic]
    assert sum(gap) / len(gap) > sum(x.x_sd for x in mine.values() if not x.is_synthetic) / len(held)
    lone = [x for x in got if x.v == 2]
    assert lone and all(x.x_est is None for x in lone)
    assert {x.slot for x in got if x.v is None} == {23, 24, 25} & {k for k in range(20, 30) if k * stride - half <= 1.0 < k * stride + half}


def test_grid_chunks_agree(spark):
    r = random.Random(9)
    rows, t = [], 3.0
    for _ in range(1500):
        t += r.expovariate(24)
        rows.append((7, t, 5 + 0.1 * t + r.gauss(0, 0.1)))
    df = spark.createDataFrame(rows, "v bigint, t double, x double")
    a = {x.slot: x for x in regular_grid(df, "v", "t", {"x": (0.0, 100.0)}, chunk=4096).collect()}
    b = {x.slot: x for x in regular_grid(df, "v", "t", {"x": (0.0, 100.0)}, chunk=256).collect()}
    assert a.keys() == b.keys() and all(a[k].is_synthetic == b[k].is_synthetic for k in a)
    assert max(abs(a[k].x_est - b[k].x_est) for k in a) < 0.001


def test_empty_grid(spark):
    df = spark.createDataFrame([], "v bigint, t double, x double")
    assert regular_grid(df, "v", "t", {"x": (0.0, 1.0)}).count() == 0
