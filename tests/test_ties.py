"""Values that only rounding tells apart come out as in the comparison SQL."""

import random

import duckdb
import numpy as np
import pandas as pd

from kinelake.operators import features, segmentation


def test_motion_energy_rounds_like_its_sql(spark):
    draw = random.Random(7)
    clips = {c: [draw.random() * draw.choice((0, 1, 3)) for _ in range(60)] for c in range(20)}
    table = spark.createDataFrame([(c, t, x) for c, xs in clips.items() for t, x in enumerate(xs)], "clip_id long, t int, lead_wrist_velocity double")
    got = {(r["clip_id"], r["t"]): r["smoothed"] for r in segmentation.motion_energy(table, {"lead_wrist_velocity": 1.0}).collect()}
    for c, xs in clips.items():
        ordered, place = sorted(xs), 59 * 0.95
        p95 = ordered[56] + (ordered[57] - ordered[56]) * (place - 56)
        scaled = [max(0.0, min(1.0, x / p95)) for x in xs]
        for t in range(60):
            total = 0.0
            for by in range(-2, 3):
                total += scaled[min(59, max(0, t + by))]
            assert got[c, t] == max(0.0, min(1.0, total / 5))


def test_scale_and_steps_are_those_of_duckdb(spark):
    """The percentile is fused, squares are powers: to the last bit."""
    draw = random.Random(11)
    rows = [(c, t, draw.random() * draw.choice((0, 1, 3))) for c in range(400) for t in range(60)]
    table = spark.createDataFrame(rows, "clip_id long, t int, lead_wrist_velocity double")
    got = {(r["clip_id"], r["t"]): r["normalised"] for r in segmentation.motion_energy(table, {"lead_wrist_velocity": 1.0}).collect()}
    con = duckdb.connect()
    con.register("x", pd.DataFrame(rows, columns=["c", "t", "v"]))
    scaled = con.execute("SELECT c, t, least(1.0, v / quantile_cont(v, 0.95) OVER (PARTITION BY c)) FROM x").fetchall()
    assert got == {(c, t): value for c, t, value in scaled}
    away = np.array([[draw.uniform(-0.5, 0.5) for _ in range(5000)] for _ in range(3)])
    con.register("d", pd.DataFrame(away.T, columns=list("xyz")).reset_index())
    assert features._distance(away).tolist() == [v for (v,) in con.execute("SELECT sqrt(x ** 2 + y ** 2 + z ** 2) FROM d ORDER BY index").fetchall()]
