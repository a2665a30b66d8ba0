"""Parts that no query reaches: readers of tables, column reports, lenient flags, general number format."""

import pytest
from pyspark.sql import functions as F

from kinelake.functions import labels, texts
from kinelake.operators import dataset, evaluation, features, rates
from kinelake.sources import files


def test_tensor_and_slice(spark, tmp_path):
    rows = spark.createDataFrame([(c, t, float(t), float(c)) for c in (1, 2) for t in (1, 0)], "clip_id long, t int, a double, b double")
    made = features.tensor(rows, ["a", "b"])
    assert {r["clip_id"]: r["x"] for r in made.collect()} == {1: [[0.0, 1.0], [1.0, 1.0]], 2: [[0.0, 2.0], [1.0, 2.0]]}
    files.write_tensor(made.withColumn("split", F.when(F.col("clip_id") == 1, "train").otherwise("test")), str(tmp_path / "x"))
    part = files.read_slice(spark, str(tmp_path / "x"), split="train")
    assert [r["clip_id"] for r in part.collect()] == [1]
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "train" in plan


def test_columns_and_candidates(spark):
    assert dataset.column_report(["b", "a", "x"], ["a", "b", "c"]) == {"missing": ["c"], "unexpected": ["x"], "misplaced": ["b", "a"]}
    rows = spark.createDataFrame([(" ", None, "v"), ("", None, "w")], "first string, second string, third string")
    assert dataset.first_filled(rows, ["gone", "first", "second", "third"]) == "third"
    assert dataset.first_filled(rows, ["first", "second"]) is None and dataset.first_filled(rows, ["gone"]) is None
    got = rows.select(evaluation.first_filled_text(F.col("first"), F.col("second"), F.col("third")).alias("x")).collect()
    assert [r["x"] for r in got] == ["v", "w"]


def test_flags(spark):
    rows = spark.createDataFrame([(" YES ",), ("y",), ("true",), ("1",), ("no",), (None,)], "v string")
    strict, lenient = ([bool(r["x"]) for r in rows.select(dataset.use_clip(F.col("v"), how).alias("x")).collect()] for how in (False, True))
    assert strict == [True, False, False, False, False, False] and lenient == [True] * 4 + [False] * 2


def test_players(spark):
    names = [("a_good_1", "pull"), ("a_AVG_08", "pull"), ("a_average_9", "pull"), ("a_bad_4", "pull"), ("a_bad_5", "pull"), ("a_good_3", "Idle"), ("a_fine_1", "pull")]
    rows = spark.createDataFrame(names, "stem string, label string")
    got = [r["p"] for r in rows.select(labels.player_of(F.col("stem"), F.col("label")).alias("p")).collect()]
    assert got == ["playerA", "playerD", "unknown", "playerD", "unknown", "unknown", "unknown"]


def test_general_format(spark):
    values = [0.0, 1.0, 10.0, 123456.0, 1234567.0, 1e6, 999999.6, 0.5, 0.0001, 0.00012345678, 0.00001, -2.5, 1e-7, 3.0e22, 100000.0]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r["g"] for r in rows.select(rates.general(F.col("v")).alias("g")).collect()] == [f"{v:g}" for v in values]


def test_rounding_of_binary_values(spark):
    # 98.55 and 0.35 lie below the tie; 0.25, 84.5 and 1234565 lie on it.
    values = [98.55, 0.35, 98.15, 0.25, 98.75, 84.5, 85.5, -0.04, 0.0, 1e7 + 0.25, 1234567.891, 1234565.0, 0.1000005]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 1, 4):
        assert [r["f"] for r in rows.select(texts.fixed(F.col("v"), digits).alias("f")).collect()] == [f"{v:.{digits}f}" for v in values]
    assert [r["g"] for r in rows.select(rates.general(F.col("v")).alias("g")).collect()] == [f"{v:g}" for v in values]
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),)], "v double")
    assert [r["f"] for r in odd.select(texts.fixed(F.col("v"), 1).alias("f")).collect()] == ["NaN", "Infinity"]


def test_counted_split_refuses(spark):
    rows = spark.createDataFrame([(i, "a" if i < 20 else "b") for i in range(41)], "k int, shot_label string")
    with pytest.raises(Exception, match="class b: 21 rows, 20 are needed"):
        dataset.counted_split(rows, "k").collect()
    got = dataset.counted_split(rows.where("k < 40"), "k").groupBy("shot_label", "split").count().collect()
    assert {(r["shot_label"], r["split"]): r["count"] for r in got} == {(c, s): n for c in "ab" for s, n in (("train", 14), ("validation", 3), ("test", 3))}


def test_scored_clips(spark):
    import numpy as np

    tensors = spark.createDataFrame([(i, [[float(i), 1.0], [0.5, 2.0]]) for i in range(3)], "clip_id long, x array<array<float>>")
    predict = lambda x: np.stack([x[:, 0, 0], x[:, 1, 1], x[:, 0, 1], x[:, 1, 0]], axis=1)
    got = {r["clip_id"]: [r[f"probability_{n}"] for n in labels.SHOTS] for r in evaluation.score_clips(tensors, predict).collect()}
    for i in range(3):
        z = np.exp(np.array([i, 2.0, 1.0, 0.5]))
        assert np.allclose(got[i], z / z.sum())
