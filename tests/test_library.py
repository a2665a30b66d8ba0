import json

import duckdb
import pytest
from pyspark.sql import functions as F

from kinelake.functions import geometry, labels
from kinelake.operators import dataset, evaluation, features, pose, rates, segmentation, sessions
from kinelake.plans import registry
from kinelake.sources import files
from kinelake.streaming import live

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def compare(df, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(sql)
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    ours = sorted(repr([plain(r[c]) for c in names]) for r in df.collect())
    theirs = sorted(repr([plain(v) for v in r]) for r in want.select(*[f'"{c}"' for c in names]).fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", ["p1_metadata", "w11_stratified_split", "a21_confusion", "a23_reliability", "a33_shot_distribution", "j7_verdicts", "g1_decisions", "p14_review_queue", "p15_export_set", "j8_bind_feedback", "g2_withdrawals", "g2_feedback_removals", "a33_totals", "t12_first_issues", "p12_probe_check", "st7_sliding_stream", "st4_live_results", "w14_fixed_window", "p5_clean_counts", "p8_resample", "p19_verify", "f23_score_rows", "st1_state_trace", "w15_sliding_window", "g4_player_split", "a28_templates", "a18_split_audit", "j1_match_sequences"])
def test_against_sql(spark, name):
    compare(registry.queries()[name](spark, SF), registry.oracle_sql()[name])


def test_geometry(spark):
    row = spark.range(1).select(
        geometry.wrapped(F.lit(-358.0)).alias("w"), geometry.heading(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), True).alias("h"),
        geometry.safe_float(F.lit(float("inf"))).alias("s"),
    ).first()
    assert row["w"] == 2.0 and row["h"] is None and row["s"] == 0.0
    mean = spark.createDataFrame([(179.0,), (-179.0,)], "d double").agg(geometry.circular_mean(F.col("d")).alias("m")).first()["m"]
    assert abs(abs(mean) - 180) < 1e-9
    assert spark.createDataFrame([(None,)], "d double").agg(geometry.circular_mean(F.col("d")).alias("m")).first()["m"] == 0


def test_labels(spark):
    rows = spark.createDataFrame([("x_good_3",), ("x_bad_2",), ("x_avg_9",), ("x",)], "s string").select(labels.player_of(F.col("s")).alias("p")).collect()
    assert [r["p"] for r in rows] == ["playerB", "playerB", "unknown", "unknown"]
    assert spark.createDataFrame([("7.0",), ("a ",)], "s string").select(labels.video_id(F.col("s")).alias("v")).collect()[0]["v"] == "007"


def energies(spark, *clips):
    return spark.createDataFrame([(c, t, float(e)) for c, es in enumerate(clips) for t, e in enumerate(es)], "clip_id bigint, t int, smoothed double")


def test_segments(spark):
    swing = [0, 0, 0.4, 0.5, 0.6, 0.7, 0.6, 0.5, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05]
    forced = [0, 0.4, 0.5, 0.6, 0.6]
    found = {r["clip_id"]: r for r in segmentation.segments(energies(spark, swing, forced, [0.0] * 5)).collect()}
    assert found[0]["trigger_count"] == 1 and found[0]["completion_reason"] == "stabilized_follow_through" and found[0]["peak_frame"] == 5
    assert found[1]["completion_reason"] == "sequence_end_completion" and found[1]["trigger_frame"] == 4
    assert found[2]["start_frame"] is None and found[2]["trigger_count"] == 0
    assert segmentation.trace(energies(spark, forced)).count() == 6


def test_motion_energy_repeats_edges(spark):
    table = spark.createDataFrame([(1, t, float(v)) for t, v in enumerate([1, 0, 0, 0, 0, 1])], "clip_id bigint, t int, lead_wrist_velocity double")
    got = [r["smoothed"] for r in segmentation.motion_energy(table, {"lead_wrist_velocity": 1.0}).orderBy("t").collect()]
    assert got == pytest.approx([0.6, 0.4, 0.2, 0.2, 0.4, 0.6])


def test_empty_and_short_clips(spark):
    schema = "clip_id bigint, frames array<struct<frame_index: int, timestamp: double, landmarks: array<struct<x: double, y: double, z: double, visibility: double>>>>"
    mark = (0.1, 0.2, 0.0, 0.9)
    docs = spark.createDataFrame([(1, []), (2, [(0, 0.0, [])]), (3, [(0, 0.0, [mark] * 10)])], schema)
    frames = pose.flatten(docs)
    assert {r["clip_id"]: r["total_frames"] for r in pose.inspect(frames).collect()} == {1: 0, 2: 1, 3: 1}
    assert not pose.normalise(frames.where("clip_id = 3")).first()["ok"]
    assert pose.resample(pose.clean(frames.where("pos is not null")), 5).count() == 5
    assert features.clip_features(frames.where("pos is not null")).where("motion_energy_total = 0").count() == 2


def test_player_split_keeps_groups(spark):
    rows = spark.createDataFrame([(i, f"P{i % 7}") for i in range(100)], "k int, person_id string")
    split = dataset.player_disjoint_split(rows, "person_id")
    assert split.count() == 100 and dataset.split_summary(split, "person_id").agg(F.sum("shared_groups")).first()[0] == 0
    with pytest.raises(ValueError):
        dataset.player_disjoint_split(rows.withColumn("person_id", F.lit(" ")), "person_id")


def test_sequence_match(spark):
    meta = spark.createDataFrame([("001", "a_good_1.mp4"), ("2", "b_good_1.mp4"), ("3", "c.mp4"), ("9", "d.mp4")], "video_id string, file_name string")
    seqs = spark.createDataFrame([("001_a_good_1_sequence.json",), ("002_b_good_1_sequence.json",), ("002_zz_sequence.json",), ("777_c_sequence.json",)], "seq_file string")
    got = {r["video_id"]: (r["status"], r["seq_file"]) for r in dataset.match_sequences(meta, seqs).collect()}
    assert got["001"][0] == got["2"][0] == got["3"][0] == "matched" and got["2"][1].startswith("002_b") and got["9"] == ("missing", None)


def test_scores(spark):
    rows = spark.createDataFrame([(1, "cover_drive", {"cover_drive": 2.0, "pull_shot": 2.0}), (2, "pull_shot", {"pull_shot": -1.0}), (3, "pull_shot", {})], "row_index int, true_label string, probabilities map<string,double>")
    got = {r["row_index"]: r for r in evaluation.score_rows(rows).collect()}
    assert got[1]["predicted_label"] == "cover_drive" and got[1]["brier"] == pytest.approx(0.5) and got[2]["error"] == "negative" and got[3]["error"] == "empty"


def test_sliding_window(spark):
    rows = spark.createDataFrame([(i, 1, t) for i, t in enumerate(["2024-01-01 00:00:00", "2024-01-01 00:00:01", "2024-01-01 00:00:02", "2024-01-01 00:00:12"])], "request_id bigint, key bigint, t string").withColumn("ts", F.to_timestamp("t"))
    got = [r["allowed"] for r in rates.sliding_window(rows, 2, 10).orderBy("request_id").collect()]
    assert got == [True, True, False, True]


def test_sources(spark, tmp_path):
    good = {"frames": [{"frame_index": 0, "timestamp": 0.0, "landmarks": [{"x": "0.5", "y": 1, "visibility": "bad"}]}]}
    (tmp_path / "pose").mkdir()
    (tmp_path / "pose/a.json").write_text(json.dumps(good))
    (tmp_path / "pose/b.json").write_text("{broken")
    docs, rejects = files.read_pose(spark, str(tmp_path / "pose"))
    mark = docs.first()["frames"][0]["landmarks"][0]
    assert (mark["x"], mark["y"], mark["z"], mark["visibility"]) == (0.5, 1.0, 0.0, 0.0) and [r["source_file"] for r in rejects.collect()] == ["b.json"]
    (tmp_path / "m.json").write_text(json.dumps({"samples": [{"a": 1}, {"a": 2}]}))
    assert files.read_rows(spark, str(tmp_path / "m.json"), "json").count() == 2
    files.export_csv(spark.createDataFrame([(1, ["x"])], "id int, tags array<string>"), str(tmp_path / "out"), ["id", "tags", "gone"])
    row = spark.read.option("header", True).csv(str(tmp_path / "out")).first()
    assert row["tags"] == '["x"]' and row["gone"] is None
    with pytest.raises(ValueError):
        files.read_metadata(spark, str(tmp_path / "out"))


def run_stream(df, name, mode):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return df.sparkSession.table(name)


def test_tumbling_streams(spark, tmp_path):
    rows = [("u", f"2024-01-01 10:0{i}:00") for i in range(3)]
    spark.createDataFrame(rows, "user_id string, t string").withColumn("ts", F.to_timestamp("t")).write.parquet(str(tmp_path / "r"))
    days = spark.readStream.schema("user_id string, t string, ts timestamp").parquet(str(tmp_path / "r"))
    assert run_stream(live.shots_per_day(days), "days", "complete").first()["n"] == 3
    requests = spark.createDataFrame([(i, 1, f"2024-01-01 00:00:0{i}") for i in range(4)], "request_id bigint, key bigint, t string").withColumn("ts", F.to_timestamp("t"))
    requests.coalesce(1).write.parquet(str(tmp_path / "q"))
    log = spark.readStream.schema("request_id bigint, key bigint, t string, ts timestamp").parquet(str(tmp_path / "q"))
    assert run_stream(live.request_windows(log, 3, 60), "windows", "complete").first()["rejected"] == 1


def test_turns_against_brute_force():
    import random

    random.seed(1)
    for case in range(3000):
        n, m, lacks = random.randint(1, 7), random.randint(1, 60), [random.randint(-20, 60) for _ in range(3)]
        lacks = [x // 3 * 3 for x in lacks] if case % 3 == 0 else lacks
        got = [order[k % len(order)] for _, turns, order in dataset._turns(lacks, n, m) for k in range(turns)]
        have, want = list(lacks), []
        for _ in range(m):
            want.append(have.index(max(have)))
            have[want[-1]] -= n
        assert got == want


def test_encoding_refuses(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "shot_label string")
    assert {r["encoded_label"] for r in dataset.encode_labels(rows).collect()} == {0, 1}
    for bad, classes in ((rows.unionByName(spark.createDataFrame([(" ",)], "shot_label string")), None), (rows.where("shot_label = 'a'"), None), (rows, ["a"])):
        with pytest.raises(ValueError):
            dataset.encode_labels(bad, classes=classes)


def test_documents_and_manifests(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"n{i}") for i in range(5)], "k int, name string").repartition(2)
    files.write_rows(rows, str(tmp_path / "json"), "json")
    assert files.read_rows(spark, str(tmp_path / "json"), "json").count() == 5
    files.write_rows(rows, str(tmp_path / "jsonl"), "jsonl")
    assert files.read_rows(spark, str(tmp_path / "jsonl"), "jsonl").columns == ["k", "name"]
    named = rows.select(files.stage_name(F.lit("a/b_normalized_aligned.json"), "_sequence").alias("out_name"), "k")
    files.write_documents(named, str(tmp_path / "docs"))
    assert spark.read.json(str(tmp_path / "docs")).where("out_name = 'b_sequence.json'").count() == 5
    ragged = files.union_ragged([rows.select("k"), rows.select("name", "k")])
    assert ragged.columns == ["k", "name"] and ragged.count() == 10
    (tmp_path / "v").mkdir()
    for name in ("b.MOV", "a.mp4", "c.txt"):
        (tmp_path / "v" / name).write_bytes(b"x")
    assert files.list_videos(spark, str(tmp_path / "v")).count() == 2
    sums = rates.metric_sums(spark.createDataFrame([("m", "counter", {"a": "1"}, 2.0), ("k", "timer", {}, 1.5)], "name string, kind string, labels map<string,string>, value double"))
    rates.write_exposition(rates.exposition(sums), str(tmp_path / "text"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "text")).collect()) == ["k_seconds_count 1", "k_seconds_sum 1.500000", 'm_total{a="1"} 2.000000']


def test_fixed_length_and_vectors(spark):
    mark = (0.1, 0.2, 0.3, 0.9)
    schema = "clip_id bigint, frames array<struct<frame_index: int, timestamp: double, landmarks: array<struct<x: double, y: double, z: double, visibility: double>>>>"
    docs = spark.createDataFrame([(1, [(i, i / 30, [mark]) for i in range(7)]), (2, [(0, 0.0, [mark])]), (3, [])], schema)
    got = {r["clip_id"]: [f["frame_index"] for f in r["frames"]] for r in pose.fixed_length(docs, 4).collect()}
    assert got == {1: [0, 2, 4, 6], 2: [0, 0, 0, 0], 3: []}
    assert docs.where("clip_id = 1").select(pose.flat_vector(F.col("frames")[0]["landmarks"]).alias("v")).first()["v"] == list(mark)


def test_results_without_objects(spark):
    rows = spark.createDataFrame([(1, None), (2, "no json"), (3, '{"landmarks": [{"x": 1, "y": "2"}, {"x": "a", "y": 1}], "voice_output": {"e": 1}}'), (4, '{"voice_output": "v"}')], "id int, full_result string")
    got = {r["id"]: r for r in sessions.result_details(rows).collect()}
    assert got[3]["voice_output"] == '{"e":1}' and [tuple(m) for m in got[3]["landmarks"]] == [(1.0, 2.0, 0.0)]
    assert all(got[i]["voice_output"] is None and got[i]["landmarks"] == [] for i in (1, 2, 4))


def test_quality_of_features(spark):
    rows = spark.createDataFrame([("p", 1.0, 5.0), ("p", float("nan"), 5.0), ("q", float("inf"), 5.0), ("q", None, 5.0)], "shot string, a double, b double")
    got = {r["feature"]: r for r in features.tabular_quality(rows, ("a", "b")).collect()}
    assert (got["a"]["nan"], got["a"]["infinite"], got["a"]["mean"], got["a"]["std"], got["b"]["zero_variance"]) == (2, 1, 1.0, 0.0, True)
