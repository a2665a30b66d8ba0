"""Derived frames: landmarks made over batches equal their formulas, and filters don't make them again; correlations of batches."""

from pyspark.sql import functions as F

from kinelake.operators import features, pose
from kinelake.plans import derive


def test_landmarks_by_batch(spark, tmp_path):
    rows = spark.range(600).selectExpr("id AS event_id", "id % 7 AS user_id", "timestamp_seconds(1700000000 + id * 37 % 600) AS ts")
    rows.write.parquet(str(tmp_path / "events.parquet"))
    frames = derive.frames(spark, str(tmp_path))
    plan = pose.clean(frames)._jdf.queryExecution().executedPlan().toString()
    # Once in the tree, once in its list of nodes at most.
    assert plan.count("ArrowEvalPython") == 1 and "transform(sequence" not in plan
    order = "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1"
    numbers = spark.read.parquet(str(tmp_path / "events.parquet")).selectExpr("user_id AS clip_id", f"{order} AS pos", "event_id AS e")
    parts = [F.expr(f"CAST({formula.format(k='k')} AS DOUBLE)") for formula in (derive.X, derive.Y, derive.Z, derive.V)]
    wanted = numbers.where("e % 19 <> 0").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(32)))).select("clip_id", "pos", "k", *[p.alias(n) for n, p in zip("xyzv", parts, strict=True)], "e")
    wanted = wanted.withColumn("x", F.when(~((F.col("e") % 23 == 0) & (F.col("k") == 15)), F.col("x"))).drop("e")
    got = frames.select("clip_id", "pos", F.posexplode("landmarks").alias("k", "m")).select("clip_id", "pos", "k", *[F.col(f"m.{c}") for c in ("x", "y", "z", "visibility")])
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, wanted.collect())))
    assert frames.count() == 600 and frames.where("size(landmarks) = 0").count() == len(range(0, 600, 19))


def test_correlations_by_products(spark):
    nan, names = float("nan"), list("abcdefg")
    # b follows a, c too but for a large mean; d is constant, e has NULLs, f one NaN, g is NULL but where d is there.
    made = [(i, float(i * i % 83), 2.0 * (i * i % 83) + i % 3, 1e7 - (i * i % 83), 0.1, None if i % 5 == 0 else float(i * i % 83), nan if i == 7 else float(i * i % 83), 0.3 if i % 2 else None) for i in range(400)]
    rows = spark.createDataFrame(made, "k int, a double, b double, c double, d double, e double, f double, g double").repartition(3)
    got = {(r["feature_a"], r["feature_b"]): r["r"] for r in features.correlations(rows, names, 0.5).collect()}
    wanted = {(x, y): rows.agg(F.corr(x, y).alias("r")).first()["r"] for x, y in [("a", "b"), ("a", "c"), ("b", "c"), ("a", "e"), ("b", "e"), ("c", "e")]}
    assert got.keys() == wanted.keys() and all(abs(got[p] - wanted[p]) < 1e-9 for p in wanted)
    assert features.correlations(rows.where("k < 0"), names, 0.5).count() == 0
    # One aggregate for all pairs, whatever their number: no corr a pair in the plan.
    assert "corr(" not in features.correlations(rows, names)._jdf.queryExecution().executedPlan().toString()
