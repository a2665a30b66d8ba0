"""Points and features over Arrow batches equal the operators on landmark arrays."""

import math

from pyspark.sql import functions as F

from kinelake.operators import features, pose
from kinelake.plans import derive


def _frames(spark):
    def mark(k, n):
        x = float("nan") if (n, k) == (2, 15) else float("inf") if (n, k) == (3, 23) else 0.3 + 0.01 * k + 0.02 * n * (k % 5)
        return (x, 0.1 + 0.02 * ((k * 7 + n) % 11), 0.01 * k, 1.0)

    rows = [(1, n, [mark(k, n) for k in range(33)]) for n in range(4)]
    rows += [(1, 4, [mark(k, 4) for k in range(20)]), (1, 5, [mark(k, 5) for k in range(10)]), (1, 6, []), (1, 7, None), (1, 8, [None if k == 11 else mark(k, 8) for k in range(33)])]
    return spark.createDataFrame(rows, "clip_id long, pos int, landmarks array<struct<x:double,y:double,z:double,visibility:double>>").repartition(3)


def test_prepared_points_are_those_of_the_landmarks(spark):
    frames = _frames(spark)
    got = {r["pos"]: r["points"] for r in features.prepared_points(frames, "pos").collect()}
    whole = pose.align(pose.normalise(frames).drop("ok"))
    want = {r["pos"]: r for r in features.used_points(whole, "pos").collect()}
    names = [f"{c}{k}" for k in features.USED for c in "xyz"]
    assert got.keys() == want.keys()
    # Landmark arrays keep the rest of a point with a part that isn't finite; as a point it is missing.
    for pos in got:
        for name, value in zip(names, got[pos], strict=True):
            other = want[pos][name]
            assert math.isnan(value) if other is None else math.isclose(value, other, abs_tol=1e-12), (pos, name)


def test_frame_features_look_back_once(spark):
    made = features.frame_features(_frames(spark).withColumnRenamed("pos", "t"))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lag(") == 1
    rows = {r["t"]: r for r in made.collect()}
    assert len(rows) == 9 and all(math.isfinite(r[n]) for r in rows.values() for n in features.FRAME_FEATURES)
    assert rows[0]["lead_elbow_velocity"] == 0.0 and rows[1]["lead_elbow_velocity"] > 0.0
    # The wrist is missing at 2: it has no angle, no step there or after it.
    assert rows[2]["lead_elbow_angle"] == rows[2]["lead_wrist_velocity"] == rows[3]["lead_wrist_velocity"] == 0.0 < rows[1]["lead_elbow_angle"]
    assert made.where(F.col("lead_elbow_angle") > 0).count() == sum(r["lead_elbow_angle"] > 0 for r in rows.values())


def test_normalise_and_align_run_over_arrow_batches(spark):
    # As lambdas over 33 landmarks they were interpreted. What can't be moved stays as it is, nulls and other parts too.
    frames = _frames(spark)
    for made, lenient in ((pose.normalise(frames), False), (pose.normalise(frames, fallback=True), True), (pose.align(frames), False)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "lambdafunction" not in plan and plan.count("ArrowEvalPython") == 1
        assert made.schema["landmarks"].dataType == frames.schema["landmarks"].dataType
        rows = {r["pos"]: r for r in made.collect()}
        before = {r["pos"]: r["landmarks"] for r in frames.collect()}
        assert rows[7]["landmarks"] is None and rows[6]["landmarks"] == [] and not rows[6]["ok"] and not rows[7]["ok"] and rows[8]["ok"] == lenient
        assert rows[5]["landmarks"] == before[5] and (lenient or rows[8]["landmarks"] == before[8] and rows[8]["landmarks"][11] is None)
        assert math.isnan(rows[2]["landmarks"][15]["x"]) and all(m["visibility"] == 1.0 for m in rows[1]["landmarks"])
    flat = [(0.0, 1.0, 2.0, 0.5)] * 25
    flat[3], flat[4] = None, (None, 3.0, 2.0, 0.5)
    still = spark.createDataFrame([(flat,)], frames.schema["landmarks"].dataType.simpleString().join(["landmarks ", ""]))
    plain, lenient = pose.normalise(still).first(), pose.normalise(still, fallback=True).first()
    # No torso: the extent in y, 2, is the unit. A missing landmark has missing parts then.
    assert not plain["ok"] and plain["landmarks"][3] is None and lenient["ok"]
    assert tuple(lenient["landmarks"][3]) == (None,) * 4 and tuple(lenient["landmarks"][4]) == (None, 1.0, 0.0, 0.5)


def test_numbering_deals_no_landmarks(spark):
    sf_dir = "/root/testdata/sf0.001"
    made = derive.cleaned(spark, sf_dir)
    plan = made._jdf.queryExecution().executedPlan().toString()
    # What an exchange or a sort takes in is named in the line below it.
    lines = plan.split("\n")
    moved = [below for line, below in zip(lines, lines[1:]) if "Exchange hash" in line]
    assert len(moved) == 2 and not any("landmarks" in below for below in moved)
    want = pose.clean(derive.frames(spark, sf_dir))
    assert made.columns == want.columns and made.count() == want.count() and made.exceptAll(want).isEmpty()


def test_statistics_add_up_over_batches(spark):
    names = ["a", "b", "c", "d"]
    rows = [(k % 5, k // 5, 1e6 + k * k % 17, None if k % 3 == 0 else k * 0.5, 0.1, None) for k in range(200)]
    table = spark.createDataFrame(rows, "clip_id long, t int, a double, b double, c double, d double").repartition(3, "clip_id")
    made = features.statistics(table, names)
    # Hundreds of aggregates a plan weren't compiled.
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and plan.count("lag(") == 1 and "stddev_pop" not in plan
    got = {r["feature"]: r for r in made.collect()}
    assert set(got) == set(names) and got["d"]["mean"] is None and got["d"]["mean_abs_delta"] == 0.0
    facts = features._deltas(table, names)
    for n in names[:3]:
        want = facts.agg(*features._facts(n, 1e-8)).first()
        for key in want.asDict():
            a, b = got[n][key], want[key]
            assert (a is None and b is None) or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12), (n, key, a, b)
    odd = features.statistics(spark.createDataFrame([(1, 0, float("nan")), (1, 1, 2.0), (1, 2, float("inf"))], "clip_id long, t int, a double"), ["a"]).first()
    assert math.isnan(odd["max"]) and odd["min"] == 2.0
