"""Documents keep their unknown keys through all steps, and become one file each."""

import json
import os

import pytest
from pyspark.sql import functions as F

from kinelake.operators import pose
from kinelake.sources import documents, files


def written(tmp_path):
    mark = lambda k, f: {"x": 0.1 * k + f, "y": str(0.2 * k), "visibility": 0.9, "tag": {"k": k}} | ({"z": 0.01 * k} if k % 2 else {})
    frames = [{"frame_index": i, "timestamp": i / 30, "landmarks": [mark(k, i) for k in range(33)], "note": f"n{i}"} for i in range(4)]
    frames[2]["landmarks"] = []
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"video_metadata": {"fps": 30.0, "width": 640}, "frames": frames, "camera": {"name": "left", "ids": [1, 2]}}))
    (tmp_path / "in" / "b.json").write_text(json.dumps({"frames": [5, {"frame_index": 1}]}))
    (tmp_path / "in" / "bad.json").write_text("{")
    (tmp_path / "in" / "none.json").write_text('{"frames": 3}')
    return str(tmp_path / "in")


def test_unknown_keys_survive(spark, tmp_path):
    docs, rejects = documents.read_documents(spark, written(tmp_path))
    assert {(r["source_file"], r["reason"]) for r in rejects.collect()} == {("bad.json", "unreadable"), ("none.json", "no_frames")}
    flat = pose.flatten(docs.withColumn("clip_id", F.col("source_file")))
    assert flat.where("clip_id = 'b.json'").count() == 2
    made = pose.align(pose.normalise(pose.clean(flat)))
    again = documents.from_frames(made).select(F.lit("a_aligned.json").alias("name"), "clip_id", "other", "video_metadata", "frames")
    text = again.where("clip_id = 'a.json'").select(documents.document_text(again).alias("text")).first()["text"]
    got = json.loads(text)
    assert got["camera"] == {"name": "left", "ids": [1, 2]} and got["video_metadata"]["fps"] == 30.0
    assert [f["note"] for f in got["frames"]] == ["n0", "n1", "n3"] and [f["frame_index"] for f in got["frames"]] == [0, 1, 3]
    assert [m["tag"]["k"] for m in got["frames"][0]["landmarks"]] == list(range(33)) and got["frames"][0]["landmarks"][2]["visibility"] == 0.9
    sampled = pose.resample(made, 5).where("clip_id = 'a.json'").orderBy("t").select(F.try_variant_get(F.col("frame_other")["note"], "$", "string").alias("n"), F.try_variant_get(F.col("landmarks")[3]["other"]["tag"], "$.k", "int").alias("k")).collect()
    assert [r["n"] for r in sampled] == ["n0", "n0", "n1", "n1", "n3"] and {r["k"] for r in sampled} == {3}
    # typed parts are those of the reader without other keys
    plain = {r["source_file"]: r["frames"] for r in files.read_pose(spark, written_again(tmp_path))[0].collect()}
    ours = docs.where("source_file = 'a.json'").first()["frames"]
    assert [(m["x"], m["y"], m["z"]) for m in ours[1]["landmarks"]] == [(m["x"], m["y"], m["z"]) for m in plain["a.json"][1]["landmarks"]]


def written_again(tmp_path):
    return str(tmp_path / "in")


def test_one_file_a_document_on_commit(spark, tmp_path):
    out = tmp_path / "out"
    rows = spark.createDataFrame([(f"d{i}_normalized.json", json.dumps({"i": i})) for i in range(9)], "name string, text string").repartition(3)
    named = rows.withColumn("name", files.stage_name(F.col("name"), "_aligned"))
    documents.write_files(named, str(out))
    assert sorted(os.listdir(out)) == [f"d{i}_aligned.json" for i in range(9)]
    assert json.loads((out / "d4_aligned.json").read_text()) == {"i": 4}
    with pytest.raises(Exception, match="already"):
        documents.write_files(named.limit(1), str(out))
    # a task that fails leaves no file
    broken = rows.withColumn("name", F.when(F.col("name").startswith("d8"), "x/y").otherwise(F.concat(F.lit("n_"), "name")))
    with pytest.raises(Exception, match="no file name"):
        documents.write_files(broken, str(out))
    assert sorted(os.listdir(out)) == [f"d{i}_aligned.json" for i in range(9)]
