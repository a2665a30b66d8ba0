"""What must be an error is one, with its counts; sketches stay within their error."""

import random

import pytest
from pyspark.sql import functions as F

from kinelake.operators import contracts, dataset, features, scoring


def test_missing_and_non_finite_features(spark):
    names = ["a", "b"]
    good = spark.createDataFrame([(1, 0.5, 1.0), (2, 0.25, -1.0)], "clip_id long, a double, b double")
    assert features.feature_vectors(good, names).orderBy("clip_id").collect()[0]["features"] == [0.5, 1.0]
    with pytest.raises(contracts.ContractError) as e:
        features.feature_vectors(good.drop("b").withColumn("c", F.lit(1.0)), names)
    assert e.value.counts == {"missing b": 1, "unexpected c": 1}
    bad = good.unionByName(spark.createDataFrame([(3, float("nan"), 1.0), (4, 1.0, None), (5, float("inf"), float("nan"))], good.schema))
    with pytest.raises(contracts.ContractError) as e:
        features.feature_vectors(bad, names)
    assert e.value.counts == {"rows with non-finite features": 3}


def test_scaler_refuses(spark):
    train = spark.createDataFrame([(1, 1.0), (2, 3.0)], "clip_id long, a double")
    scaler = features.fit_scaler(train, ["a"])
    assert [r["a"] for r in features.scale(train, scaler, ["a"]).orderBy("clip_id").collect()] == [-1.0, 1.0]
    odd = train.unionByName(spark.createDataFrame([(3, float("inf")), (4, None)], train.schema))
    with pytest.raises(Exception, match="a: 2 values aren't finite"):
        features.fit_scaler(odd, ["a"]).collect()
    with pytest.raises(Exception, match="isn't finite"):
        features.scale(odd, scaler, ["a"]).collect()


def stats_of(spark, sizes):
    random.seed(4)
    clips, rows, clip = [], [], 0
    for shot, n in sizes.items():
        for _ in range(n):
            clip += 1
            clips.append((clip, shot))
            rows.append((clip, "lead_elbow_angle", "mean", random.gauss(100, 30)))
    return spark.createDataFrame(rows, "clip_id long, feature string, statistic string, value double"), spark.createDataFrame(clips, "clip_id long, shot string")


def test_small_and_unknown_classes(spark):
    stats, clips = stats_of(spark, {"cover_drive": 5, "pull_shot": 2})
    with pytest.raises(Exception, match="class pull_shot: 2 values of lead_elbow_angle"):
        scoring.templates(stats, clips).collect()
    known = scoring.templates(stats, clips.where("shot = 'cover_drive'"))
    assert known.count() == 1
    with pytest.raises(Exception, match="no templates of class pull_shot"):
        scoring.deviations(stats, clips, known).collect()


def test_sketched_templates_within_their_rank_error(spark):
    stats, clips = stats_of(spark, {"cover_drive": 6000, "pull_shot": 4})
    exact = {r["shot"]: r for r in scoring.templates(stats, clips).collect()}
    first = scoring.template_sketches(stats.where("clip_id % 2 = 0"), clips)
    both = scoring.template_sketches(stats.where("clip_id % 2 = 1"), clips, first)
    values = sorted(r["value"] for r in stats.join(clips.where("shot = 'cover_drive'"), "clip_id").collect())
    for r in scoring.sketched_templates(both).collect():
        assert r["n"] == exact[r["shot"]]["n"] and abs(r["std"] - exact[r["shot"]]["std"]) < 1e-6
        if r["shot"] == "cover_drive":
            for got, q in ((r["low"], 0.1), (r["center"], 0.5), (r["high"], 0.9)):
                rank = sum(v <= got for v in values) / len(values)
                assert abs(rank - q) <= 2 * scoring.RANK_ERROR
    few = scoring.template_sketches(*stats_of(spark, {"cover_drive": 2}))
    with pytest.raises(Exception, match="class cover_drive: 2 values"):
        scoring.sketched_templates(few).collect()


def test_strict_split(spark):
    meta = spark.createDataFrame([("001", "a", "x", "P1"), ("002", "b", "x", " "), ("003", "c", "x", "P1"), ("004", "d", "x", "P1"), ("004", "d", "x", "P2")], "video_id string, file_name string, shot_label string, person_id string")
    split = spark.createDataFrame([("001", "a", "x"), ("002", "b", "x"), ("003", "c", "y"), ("004", "d", "x"), ("005", "e", "x"), ("006", "f", "x"), ("006", "f", "x")], "video_id string, file_name string, shot_label string")
    with pytest.raises(contracts.ContractError) as e:
        dataset.strict_split(split, meta)
    assert e.value.counts == {"missing_person": 2, "label_mismatch": 1, "duplicate_meta": 2, "duplicate_split": 2}
    assert [r["person_id"] for r in dataset.strict_split(split.limit(1), meta.limit(1)).collect()] == ["P1"]


def test_feature_schema(spark):
    table = spark.createDataFrame([("1", 2, 1.5, True, "7", 0), ("2", 3, None, False, "x", 1)], "video_id string, a int, b double, flag boolean, c string, encoded_label int")
    assert dataset.feature_schema(table.select("video_id", "a", "flag", "encoded_label"), "encoded_label") == {"features": ["a"], "ignored": ["video_id", "flag", "encoded_label"]}
    with pytest.raises(contracts.ContractError) as e:
        dataset.feature_schema(table, "encoded_label", text=("c",))
    assert e.value.counts == {"b: missing": 1, "c: not a number": 1}
    with pytest.raises(contracts.ContractError):
        dataset.feature_schema(table.select("video_id", "flag"), "encoded_label")


def test_unmatched_stems_are_found_by_their_runs(spark):
    meta = spark.createDataFrame([("9", "c.mp4"), ("8", "a_long_name_of_a_clip.mov"), ("7", ""), ("6", "zz.mp4"), ("5.0", "e.mp4")], "video_id string, file_name string")
    files = spark.createDataFrame([("777_old_c_take2_sequence.json",), ("x_a_long_name_of_a_clip2_sequence.json",), ("y_a_long_name_of_a_dog.json",), ("p_zz_1.json",), ("q_zz_2.json",), ("5_e.json",), ("005_f.json",), ("5_other.json",)], "seq_file string")
    got = {r["video_id"]: (r["status"], r["seq_file"]) for r in dataset.match_sequences(meta, files).collect()}
    # c is in every file with a c: ambiguous; the long name in one; zz in two; of id 5, one file holds e ... all of them do
    assert got["8"] == ("matched", "x_a_long_name_of_a_clip2_sequence.json") and got["7"] == ("missing", None) and got["6"] == ("ambiguous", None)
    only = files.where("seq_file LIKE '777%'")
    assert {r["video_id"]: r["seq_file"] for r in dataset.match_sequences(meta.limit(1), only).collect()} == {"9": "777_old_c_take2_sequence.json"}
