"""Streams whose rows come in any order give what the batch operators give; state leaves; sweeps happen once."""

import random

import pytest
from pyspark.sql import functions as F

from kinelake.operators import rates, segmentation
from kinelake.streaming import live, sweeps


def files(spark, tmp_path, name, schema, *batches):
    """A stream of one file a batch, in this order, with ts from the text t0."""
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, schema).withColumn("ts", F.to_timestamp("t0"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / name / f"b={i}"))
    made = spark.createDataFrame([], schema).withColumn("ts", F.to_timestamp("t0")).schema
    return spark.readStream.schema(made).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / name / "*"))


def run(df, name, mode, seen=None):
    writer = df.writeStream.outputMode(mode).trigger(availableNow=True).queryName(name)
    query = (writer.foreachBatch(lambda b, i: seen.append([tuple(r) for r in b.collect()])) if seen is not None else writer.format("memory")).start()
    query.awaitTermination(180)
    return query


def test_live_means_and_counts(spark, tmp_path):
    schema = "session_id string, shot string, score double, t0 string"
    stream = files(
        spark, tmp_path, "r", schema,
        [("s", "cover_drive", 80.0, "2024-01-01 10:00:00"), ("s", "cover_drive", None, "2024-01-01 10:01:00"), ("s", "pull_shot", None, "2024-01-01 10:01:00"), ("s", "odd", 1.0, "2024-01-01 10:02:00")],
        [("s", "cover_drive", 71.0, "2024-01-01 09:59:00"), ("z", "sweep_shot", float("nan"), "2024-01-01 10:03:00")],
        [("y", "pull_shot", 5.0, "2024-01-01 13:00:00")],
        [("s", "cover_drive", 10.0, "2024-01-01 13:05:00"), ("late", "pull_shot", 5.0, "2024-01-01 09:00:00")],
    )
    seen = []
    query = run(live.live_results(stream), "live", "update", seen)
    of = lambda key: [sorted((r[1], r[2], r[3]) for r in b if r[0] == key) for b in seen if any(r[0] == key for r in b)]
    # two batches, two running means, all four shots; a session after the gap starts anew
    assert of("s") == [
        [("cover_drive", 2, 80.0), ("defensive_shot", 0, None), ("pull_shot", 1, None), ("sweep_shot", 0, None)],
        [("cover_drive", 3, 75.5), ("defensive_shot", 0, None), ("pull_shot", 1, None), ("sweep_shot", 0, None)],
        [("cover_drive", 1, 10.0), ("defensive_shot", 0, None), ("pull_shot", 0, None), ("sweep_shot", 0, None)],
    ]
    assert of("z")[0][3] == ("sweep_shot", 1, None) and not of("late") and live.late_rows(query) == 1
    # state of the sessions before the gap is gone
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 2
    scores, counts = [], []
    run(live.running_scores(stream), "scores", "update", scores)
    run(live.running_counts(stream), "counts", "update", counts)
    assert [r for b in scores for r in b if r[0] == "s"] == [("s", "cover_drive", 80.0), ("s", "cover_drive", 75.5), ("s", "cover_drive", 10.0)]
    assert sorted(r for r in counts[0] if r[0] == "s") == [("s", "cover_drive", 2), ("s", "defensive_shot", 0), ("s", "pull_shot", 1), ("s", "sweep_shot", 0)]


@pytest.mark.parametrize("limit", [3, 0])
def test_shuffled_requests_are_decided_as_in_batch(spark, tmp_path, limit):
    random.seed(limit)
    schema = "request_id bigint, key bigint, t0 string"
    rows = [(i, random.randint(1, 3), f"2024-01-01 00:{m:02d}:{s:02d}") for i, (m, s) in enumerate(sorted((random.randint(0, 9), random.randint(0, 59)) for _ in range(120)))]
    # arrival is up to two minutes late, the watermark allows five
    arrival = sorted(rows, key=lambda r: int(r[2][14:16]) * 60 + int(r[2][17:]) + random.randint(0, 120))
    last = [(999, 9, "2024-01-01 03:00:00")]
    stream = files(spark, tmp_path, "q", schema, arrival[:40], arrival[40:41], arrival[41:90], arrival[90:], last, [(1000, 1, "2024-01-01 00:00:01")])
    query = run(live.sliding_requests(stream, limit, 30, "5 minutes"), f"slides{limit}", "append")
    got = {(r["request_id"], r["key"], r["allowed"]) for r in spark.table(f"slides{limit}").collect()}
    batch = spark.createDataFrame(rows, schema).withColumn("ts", F.to_timestamp("t0"))
    assert got == {(r["request_id"], r["key"], r["allowed"]) for r in rates.sliding_window(batch, limit, 30).collect()}
    assert live.late_rows(query) == 1 and query.lastProgress["stateOperators"][0]["numRowsTotal"] == 1


def energies(seed):
    random.seed(seed)
    rows = []
    for clip in range(6):
        shape = [0, 0, 0.4, 0.5, 0.6, 0.7, 0.6, 0.5, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05] * random.randint(0, 2) + [random.random() / (1 + clip) for _ in range(random.randint(3, 20))]
        rows += [(str(clip), t, float(e), f"2024-01-01 10:00:{t // 30:02d}.{t % 30 * 33:03d}") for t, e in enumerate(shape)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_shuffled_frames_give_the_batch_segments(spark, tmp_path, seed):
    schema = "session_id string, t int, smoothed double, t0 string"
    rows = energies(seed)
    arrival = random.sample(rows, len(rows))
    cut = len(rows) // 3
    stream = files(spark, tmp_path, "e", schema, arrival[:cut], arrival[cut : 2 * cut], arrival[2 * cut :] + arrival[:5], [("end", 0, 0.0, "2024-01-01 12:00:00")])
    query = run(live.segment_stream(stream, live=False), f"segments{seed}", "append")
    plain = lambda rows: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)
    batch = segmentation.segments(spark.createDataFrame(rows, schema).select(F.col("session_id").cast("bigint").alias("clip_id"), "t", "smoothed")).collect()
    want = plain((str(r[0]), *list(r)[1:]) for r in batch)
    key = lambda r: repr(r)
    assert sorted(plain(spark.table(f"segments{seed}").collect()), key=key) == sorted(want, key=key)
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 1


def test_live_shots_come_when_they_are_completed(spark, tmp_path):
    swing = [0, 0, 0.4, 0.5, 0.6, 0.7, 0.6, 0.5, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05]
    rows = [("s", t, float(e), f"2024-01-01 10:00:00.{t:03d}") for t, e in enumerate(swing)]
    seen = []
    run(live.segment_stream(files(spark, tmp_path, "f", "session_id string, t int, smoothed double, t0 string", rows[3:], rows[:3])), "shots", "append", seen)
    # frames from 3 on wait for the first three; no watermark is needed then
    assert not seen[0] and len(seen[1]) == 1 and seen[1][0][3] == 5


def test_sweep_once_a_batch(spark, tmp_path):
    folder = str(tmp_path / "tables")
    rows = [(i, i % 3, "stored", "2024-01-01 00:00:00", True) for i in range(12)]
    sessions = spark.createDataFrame(rows, "id long, user_id long, storage_status string, retention_expires_at string, consent boolean")
    feedback = spark.createDataFrame([(100 + i, i % 12, i % 12 % 3 if i < 20 else 7, "candidate", "pending_review", True) for i in range(24)], "id long, session_id long, user_id long, review_status string, eligibility string, accepted_for_review boolean")
    sweeps.write_tables(sessions, feedback, folder)
    due = sweeps.due(sessions, F.lit("2024-06-01").cast("timestamp")).select("id", "user_id")
    assert due.count() == 12
    outcomes = due.where("id < 6").withColumn("outcome", F.expr("CASE id WHEN 0 THEN 'deleted' WHEN 1 THEN 'not_found' WHEN 2 THEN 'failed' WHEN 3 THEN 'already_deleted' ELSE 'failed' END")).withColumn("at", F.lit("2024-06-01T00:00:00Z"))
    again = outcomes.where("id = 4").withColumns({"outcome": F.lit("deleted"), "at": F.lit("2024-06-02T00:00:00Z")})
    outcomes.coalesce(1).write.parquet(f"{tmp_path}/o/b=0")
    again.coalesce(1).write.parquet(f"{tmp_path}/o/b=1")
    stream = spark.readStream.schema(outcomes.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/o/*")
    stream.writeStream.foreachBatch(sweeps.sweeper(folder)).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start().awaitTermination(120)

    def state():
        own = {r["id"]: (r["storage_status"], r["deleted_at"], r["deletion_error_code"], r["consent"]) for r in spark.read.parquet(f"{folder}/sessions").collect()}
        told = {r["id"]: (r["session_id"], r["user_id"], r["review_status"], r["eligibility"], r["accepted_for_review"]) for r in spark.read.parquet(f"{folder}/feedback").collect()}
        return own, told

    own, told = state()
    first = "2024-06-01T00:00:00Z"
    assert len(own) == 12 and len(told) == 24
    assert own[0] == own[1] == own[3] == ("deleted", first, None, False) and own[2] == own[5] == ("deletion_pending", None, "failed", False)
    assert own[4] == ("deleted", "2024-06-02T00:00:00Z", None, False) and own[7] == ("stored", None, None, True)
    for session, user, status, eligibility, accepted in told.values():
        if user == session % 3 and session < 6:
            assert (status, eligibility, accepted) == ((own[session][0], "deleted" if own[session][0] == "deleted" else "withdrawn", False))
        else:
            assert (status, eligibility, accepted) == ("candidate", "pending_review", True)
    # the same batch again changes nothing, whatever it says; a new one does
    sweeps.sweep_batch(outcomes.withColumn("outcome", F.lit("failed")), 0, folder)
    assert state() == (own, told)
    sweeps.sweep_batch(outcomes.where("id = 2").withColumn("outcome", F.lit("not_found")), 7, folder, sweep=False)
    assert state()[0][2] == ("withdrawn", None, None, False)
    assert [r["batch_id"] for r in spark.read.parquet(f"{folder}/ledger").orderBy("batch_id").collect()] == [0, 1, 7]
