"""Session analytics: distributions, accuracy from verdicts, streaks, recent slices, quality gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinelake.functions import labels as rules
from kinelake.functions.labels import SHOTS
from kinelake.operators.evaluation import latest

LEAST_CONFIDENCE, LEAST_CLEAN_FRAMES = 0.55, 20
LONGEST_S, MOST_PIXELS = 20.0, 1920 * 1080


def recent(rows: DataFrame, n: int, most: int = 500) -> DataFrame:
    """The newest rows of each user."""
    kept = max(1, min(most, n))
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("id"))))
    return ranked.where(F.col("_rank") <= kept).drop("_rank")


def verdicts(feedback: DataFrame) -> DataFrame:
    """Of a session's correct and incorrect verdicts, the oldest."""
    told = feedback.where(F.col("verdict").isin("correct", "incorrect"))
    return latest(told, ["session_id"], F.col("created_at"), F.col("id")).select("session_id", "verdict")


def feedback_accuracy(sessions: DataFrame, feedback: DataFrame) -> DataFrame:
    """Percent correct by user and shot, and by user (shot NULL); verdicts without a known session count for the user."""
    told = feedback.where(F.col("verdict").isin("correct", "incorrect"))
    own = told.join(sessions.select(F.col("id").alias("session_id"), "predicted_shot"), "session_id", "left")
    shot = F.when(F.col("predicted_shot").isin(*SHOTS), F.col("predicted_shot")).otherwise("other").alias("shot")
    rows = own.select("user_id", shot, (F.col("verdict") == "correct").cast("int").alias("hit"))
    return rows.rollup("user_id", "shot").agg(F.count(F.lit(1)).alias("verdicts"), F.round(F.avg("hit") * 100, 1).alias("accuracy")).where("user_id is not null and (shot is null or shot <> 'other')")


def shot_distribution(sessions: DataFrame) -> DataFrame:
    """Count, percent and mean technique score of the four shots of each user, zeros kept.

    Sums are pre-aggregated by user and shot, so a user with very many sessions is no heavier.
    """
    users = sessions.select("user_id").distinct()
    shots = sessions.sparkSession.createDataFrame([(s,) for s in SHOTS], "predicted_shot string")
    counted = sessions.where(F.col("predicted_shot").isin(*SHOTS)).groupBy("user_id", "predicted_shot").agg(F.count(F.lit(1)).alias("shots"), F.round(F.avg("technique_match_score"), 1).alias("mean_score"))
    full = users.crossJoin(F.broadcast(shots)).join(counted, ["user_id", "predicted_shot"], "left").fillna(0, ["shots"])
    total = F.sum("shots").over(Window.partitionBy("user_id"))
    return full.withColumn("percent", F.when(total > 0, F.round(F.col("shots") * 100.0 / total, 1)).otherwise(0.0))


def daily(sessions: DataFrame) -> DataFrame:
    """Sessions of each user and day (in the timestamp's own offset), whatever their shot; supported shots beside."""
    day = rules.day_key(F.col("created_at"))
    return sessions.groupBy("user_id", day.alias("day")).agg(F.count(F.lit(1)).alias("sessions"), F.count_if(F.coalesce(F.col("predicted_shot").isin(*SHOTS), F.lit(False))).alias("shots"))


def totals(sessions: DataFrame) -> DataFrame:
    """Supported shots, active days (of all sessions) and shots a day of each user; NULL a day without any day."""
    days = F.count("day")
    return daily(sessions).groupBy("user_id").agg(F.sum("shots").alias("total_shots"), days.alias("session_days"), F.round(F.try_divide(F.sum("shots"), days), 2).alias("shots_per_session"))


def chart(sessions: DataFrame) -> DataFrame:
    """A33d: count, seconds and mean confidence of each predicted shot, NULL as unknown."""
    return sessions.groupBy(F.coalesce("predicted_shot", F.lit("unknown")).alias("shot")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("duration_seconds", F.lit(0.0))).alias("seconds"), F.avg(F.coalesce("shot_confidence", F.lit(0.0))).alias("mean_confidence"))


def strongest(distribution: DataFrame) -> DataFrame:
    """Best and most practised shot of each user; the first in name order on ties."""
    return distribution.groupBy("user_id").agg(F.min_by("predicted_shot", F.when(F.col("mean_score").isNotNull(), F.struct((-F.col("mean_score")).alias("s"), "predicted_shot"))).alias("strongest"), F.min_by("predicted_shot", F.struct((-F.col("shots")).alias("n"), "predicted_shot")).alias("most_practised"))


def streak(sessions: DataFrame, today: Column) -> DataFrame:
    """Consecutive days up to today; users without a session today have no row."""
    days = sessions.select("user_id", F.to_date(F.substring("created_at", 1, 10)).alias("day")).distinct()
    island = days.withColumn("island", F.date_sub("day", F.row_number().over(Window.partitionBy("user_id").orderBy("day"))))
    return island.groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("streak"), F.max("day").alias("last")).where(F.col("last") == today).select("user_id", "streak")


#: Fixed value: what an issue without any text says.
NO_ISSUE_TEXT = "Review the coaching feedback for this analysis."


def feedback_text() -> Column:
    """tips that aren't empty, else spoken, else detailed feedback. A list of tips decides even if all of them are empty."""
    tips = F.array_join(F.filter("coaching_tips", lambda t: F.coalesce(t, F.lit("")) != ""), " ")
    spoken, detailed = F.nullif(F.trim("spoken_feedback"), F.lit("")), F.nullif(F.trim(F.get_json_object("full_result", "$.detailed_feedback")), F.lit(""))
    return F.when(F.coalesce(F.size("coaching_tips"), F.lit(0)) > 0, tips).otherwise(F.coalesce(spoken, detailed))


def latest_output(sessions: DataFrame) -> DataFrame:
    """The newest session of each user in full: shot, scores, time, text, voice output and landmarks."""
    own = F.struct("id", "predicted_shot", "shot_confidence", "technique_match_score", "created_at", feedback_text().alias("text"), *_details())
    return sessions.groupBy("user_id").agg(F.max_by(own, F.struct("created_at", "id")).alias("s")).select("user_id", "s.*")


def first_issues(sessions: DataFrame, most: int = 3) -> DataFrame:
    """The first issue of each of a user's sessions that has any, newest first: its description, name, the first tip or a standing text."""
    held = lambda key: F.nullif(F.get_json_object("full_result", f"$.detected_issues[0].{key}"), F.lit(""))
    note = F.coalesce(held("description"), held("issue"), F.nullif(F.get("coaching_tips", F.lit(0)), F.lit("")), F.lit(NO_ISSUE_TEXT))
    found = sessions.where(F.get_json_object("full_result", "$.detected_issues[0]").isNotNull())
    shot = F.initcap(F.replace(F.coalesce(F.nullif("predicted_shot", F.lit("")), F.lit("Unknown")), F.lit("_"), F.lit(" ")))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("id"))))
    return ranked.where(F.col("rank") <= most).select("user_id", "rank", shot.alias("shot"), note.alias("note"))


def quality_gate(rows: DataFrame) -> DataFrame:
    """Uncertain under the least confidence; too few clean frames overrule that; reasons of both."""
    low = F.coalesce(F.col("shot_confidence") < LEAST_CONFIDENCE, F.lit(False))
    few = F.coalesce(F.col("clean_frames") < LEAST_CLEAN_FRAMES, F.lit(False))
    reasons = F.array_compact(F.array(F.when(low, "low_confidence"), F.when(few, "too_few_clean_frames")))
    return rows.withColumn("quality_status", F.when(few, "insufficient_quality").when(low, "uncertain").otherwise("ok")).withColumn("reasons", F.array_join(reasons, ","))


def segment_timing(rows: DataFrame, fps: float = 30.0) -> DataFrame:
    """Status and seconds of a segment by its timing array, else by frames / fps."""
    begin, end = F.get("timing", F.col("start_frame")), F.get("timing", F.col("end_frame"))
    status = (
        F.when(F.col("timing").isNull(), "unavailable")
        .when(F.col("start_frame").isNull() | F.col("end_frame").isNull() | (F.col("start_frame") < 0) | (F.col("end_frame") < F.col("start_frame")) | (F.col("end_frame") >= F.size("timing")), "invalid_segment")
        .when(begin.isNull() | end.isNull(), "missing_timestamps").otherwise("ok")
    )
    counted = F.when(F.col("end_frame") >= F.col("start_frame"), F.round((F.col("end_frame") - F.col("start_frame") + 1) / fps, 2)).otherwise(0.0)
    return rows.withColumn("status", status).withColumn("seconds", F.when(status == "ok", F.round(F.greatest(F.lit(0.0), end - begin), 3)).otherwise(F.coalesce(counted, F.lit(0.0))))


def probe_check(rows: DataFrame) -> DataFrame:
    """error_code of clip probes (frames, fps, width, height, seconds), NULL when accepted.

    A duration that isn't given follows from frames and fps, a number of frames from duration and fps.
    """
    fps, frames, given = (F.coalesce(F.col(c), F.lit(0)) for c in ("fps", "frames", "seconds"))
    seconds = F.when((given <= 0) & (fps > 0) & (frames > 0), frames / fps).otherwise(given)
    width, height = (F.coalesce(F.col(c), F.lit(0)) for c in ("width", "height"))
    code = (
        F.when((width <= 0) | (height <= 0) | ((frames <= 0) & (seconds <= 0)), "no_readable_frames")
        .when(seconds > LONGEST_S, "too_long").when(width.cast("long") * height > MOST_PIXELS, "too_large")
    )
    filled = F.when((frames <= 0) & (seconds > 0) & (fps > 0), F.greatest(F.lit(1), F.bround(seconds * fps).cast("long"))).otherwise(frames)
    return rows.withColumns({"seconds": seconds, "frames": filled.cast("long"), "error_code": code})


def by_accuracy(rows: DataFrame, which: str = "all", threshold: float = 75.0) -> DataFrame:
    """sessions with an accuracy of the threshold at least (high), under it (low), or all."""
    return rows if which == "all" else rows.where(F.col("accuracy") >= threshold if which == "high" else F.col("accuracy") < threshold)


def mean_accuracy(rows: DataFrame) -> DataFrame:
    """mean of the accuracies that are known, to one decimal; NULL without any."""
    return rows.agg(F.count("accuracy").alias("known"), F.round(F.avg("accuracy"), 1).alias("mean_accuracy"))


def _details() -> tuple[Column, Column]:
    parsed = F.from_json("full_result", "landmarks array<struct<x: string, y: string, visibility: string>>")
    number = lambda m, c: m[c].try_cast("double")
    marks = F.transform(F.coalesce(parsed["landmarks"], F.array()), lambda m: F.struct(number(m, "x").alias("x"), number(m, "y").alias("y"), F.coalesce(number(m, "visibility"), F.lit(0.0)).alias("visibility")))
    voice = F.get_json_object("full_result", "$.voice_output")
    return F.when(voice.startswith("{"), voice).alias("voice_output"), F.filter(marks, lambda m: m["x"].isNotNull() & m["y"].isNotNull()).alias("landmarks")


def result_details(sessions: DataFrame) -> DataFrame:
    """Each session's voice_output object (as JSON) and landmarks from its JSON result.

    Landmarks without numbers for x and y are dropped; a missing visibility is 0.
    Results that aren't objects, or hold no such parts, give NULL and an empty list.
    """
    return sessions.select("id", *_details())
