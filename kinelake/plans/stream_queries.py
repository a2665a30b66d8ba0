"""Streams over the given tables, run to their end; what they leave is compared like a batch query's result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.functions.labels import SHOTS
from kinelake.plans import audit_queries, derive, pose_queries
from kinelake.plans.pose_queries import tidy, tidy_sql
from kinelake.session import settle, shared_path
from kinelake.streaming import live

#: A row so far ahead that the watermark passes all others; its own key is left out of results.
END, AHEAD = -1, "10 days"
#: Time of frame 0, in milliseconds. Watermarks start at 1970, and a row at that very time would be late.
BEGIN_MS = 1_704_067_200_000


def _streamed(rows: DataFrame) -> DataFrame:
    """rows as a stream of files."""
    return rows.sparkSession.readStream.schema(rows.schema).parquet(settle(rows).settled_path)


def _ended(stream: DataFrame, mode: str) -> DataFrame:
    """All that a stream emits until its input ends, with the number of the micro-batch (batch)."""
    spark = stream.sparkSession
    folder = shared_path(spark, "emitted")

    def emit(rows: DataFrame, number: int) -> None:
        rows.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/{number}")

    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", shared_path(spark, "stream"))
    writer.foreachBatch(emit).start().awaitTermination()
    return spark.read.schema(stream.withColumn("batch", F.lit(0)).schema).parquet(f"{folder}/*")


def _ahead(rows: DataFrame, key: str) -> DataFrame:
    """rows and one at the end of time, with the key END."""
    last = rows.agg(F.max("ts").alias("ts")).select(*[(F.col("ts") + F.expr(f"INTERVAL {AHEAD}")).alias(c) if c == "ts" else F.lit(END if c == key else 0).cast(t).alias(c) for c, t in rows.dtypes])
    return rows.unionByName(last)


def _requests(s: SparkSession, d: str) -> DataFrame:
    made = derive.requests(s, d).select("request_id", "key", F.col("ts").cast("timestamp").alias("ts"))
    # Written in another order than that of time.
    return _ahead(made, "key").repartition(5, F.hash("request_id"))


def _sliding(s: SparkSession, d: str) -> DataFrame:
    decided = _ended(live.sliding_requests(_streamed(_requests(s, d)), 3, 3600.0 * 24), "append")
    return decided.where(F.col("key") != END).select("request_id", "key", "allowed")


def _segments(s: SparkSession, d: str) -> DataFrame:
    """Frames of 30 a second, out of order; sequences end three seconds after their last frame."""
    frames = pose_queries._energy(s, d).select(F.col("clip_id").cast("string").alias("session_id"), F.col("t").cast("int").alias("t"), "smoothed", F.timestamp_millis(F.col("t") * 33 + BEGIN_MS).alias("ts"))
    shuffled = _ahead(frames, "session_id").repartition(5, F.hash("t"))
    found = _ended(live.segment_stream(_streamed(shuffled), gap="3 seconds", live=False), "append").where(F.col("session_id") != str(END))
    return tidy(found.select(F.col("session_id").cast("bigint").alias("clip_id"), *[c for c in found.columns if c not in ("session_id", "batch")]))


def _results(s: SparkSession, d: str) -> DataFrame:
    shot = F.get(F.array(*[F.lit(x) for x in SHOTS]), (F.col("event_id") % 5).cast("int"))
    # The offset keeps means away from ties of rounding.
    score = F.when(F.col("event_id") % 7 != 0, F.col("value") + 0.00123457)
    return derive.table(s, d, "events").select(F.col("user_id").cast("string").alias("session_id"), F.coalesce(shot, F.lit("other_shot")).alias("shot"), score.alias("score"), F.col("ts").cast("timestamp").alias("ts"))


def _live(s: SparkSession, d: str) -> DataFrame:
    """The last that each session was told."""
    told = _ended(live.live_results(_streamed(_results(s, d))), "update")
    last = told.groupBy("session_id", "shot").agg(F.max_by(F.struct("n", "mean_score"), "batch").alias("x"))
    return tidy(last.select("session_id", "shot", "x.n", "x.mean_score"), 1)


QUERIES = {"st3_segments_stream": _segments, "st4_live_results": _live, "st7_sliding_stream": _sliding}

ORACLE = {
    "st3_segments_stream": audit_queries.ORACLE["st3_segments"],
    "st4_live_results": tidy_sql(
        f"""ev AS (SELECT user_id::VARCHAR AS session_id, CASE event_id % 5 WHEN 0 THEN 'cover_drive' WHEN 1 THEN 'defensive_shot' WHEN 2 THEN 'pull_shot' WHEN 3 THEN 'sweep_shot' END AS shot,
  CASE WHEN event_id % 7 <> 0 THEN value + 0.00123457 END AS score FROM events), lb(shot) AS (VALUES {", ".join(f"('{x}')" for x in SHOTS)})""",
        "SELECT session_id, lb.shot, count(ev.shot) AS n, avg(score) AS mean_score FROM (SELECT DISTINCT session_id FROM ev) CROSS JOIN lb LEFT JOIN ev USING (session_id, shot) GROUP BY ALL",
        ["session_id", "shot", "n"], ["mean_score"], 1,
    ),
    "st7_sliding_stream": audit_queries.ORACLE["w15_sliding_window"],
}
