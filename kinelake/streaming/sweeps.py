"""ST8: the retention sweep of sessions and their feedback, batch by batch.

Both tables are Parquet, partitioned by a bucket of the user. A batch of deletion outcomes
rewrites the buckets of its users only, and each batch is entered in a ledger when both
tables have it, so that a batch that comes again, after a failure or a restart, does
nothing, and one that failed half-way is done again to the same result: what it writes
depends on the batch alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from kinelake.operators import governance
from kinelake.session import discard, settle

#: Buckets of a table: the most partitions that a batch may rewrite.
BUCKETS = 64
LEDGER = "batch_id long, outcomes long"
#: Columns that a removal may set and that a table might not have yet.
SESSION_EXTRA = {"withdrawn_at": "string", "deleted_at": "string", "deletion_error_code": "string"}
FEEDBACK_EXTRA = {"withdrawn_at": "string", "deleted_at": "string"}


def _bucket():
    return F.pmod(F.xxhash64("user_id"), F.lit(BUCKETS)).cast("int")


def write_tables(sessions: DataFrame, feedback: DataFrame, folder: str) -> None:
    """Lay both tables down for sweeps."""
    for rows, name, extra in ((sessions, "sessions", SESSION_EXTRA), (feedback, "feedback", FEEDBACK_EXTRA)):
        lacking = {c: F.lit(None).cast(kind) for c, kind in extra.items() if c not in rows.columns}
        laid = rows.withColumns(lacking) if lacking else rows
        laid.withColumn("bucket", _bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/{name}")


def _done(spark: SparkSession, folder: str, batch_id: int) -> bool:
    try:
        return not spark.read.schema(LEDGER).parquet(f"{folder}/ledger").where(F.col("batch_id") == batch_id).isEmpty()
    except AnalysisException:  # no ledger yet
        return False


def sweep_batch(outcomes: DataFrame, batch_id: int, folder: str, sweep: bool = True) -> None:
    """Apply deletion outcomes (id, user_id, outcome, at) to the tables in folder, once a batch_id.

    Of several outcomes of a session the latest counts. Sessions and feedback rows of other
    users and sessions are rewritten as they are, or not at all.
    """
    spark = outcomes.sparkSession
    if _done(spark, folder, batch_id):
        return
    newest = settle(outcomes.groupBy("id", "user_id").agg(F.max_by("outcome", F.struct("at", "outcome")).alias("outcome"), F.max("at").alias("at")))
    touched = [r["bucket"] for r in newest.select(_bucket().alias("bucket")).distinct().collect()]  # BUCKETS at most
    count = newest.count()
    if count:
        # Within a batch the stamp is the outcome's own, so that a repeated batch writes the same.
        for name, change in (("sessions", governance.apply_removals), ("feedback", governance.remove_feedback)):
            rows = spark.read.parquet(f"{folder}/{name}").where(F.col("bucket").isin(touched))
            key = "id" if name == "sessions" else "session_id"
            stamped = rows.join(newest.select(F.col("id").alias(key), "user_id", F.col("at").alias("_at")), [key, "user_id"], "left")
            changed = settle(change(stamped, newest, F.col("_at"), sweep).select(*rows.columns))
            changed.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{folder}/{name}")
            discard(changed)
    discard(newest)
    spark.createDataFrame([(batch_id, count)], LEDGER).write.mode("append").parquet(f"{folder}/ledger")


def sweeper(folder: str, sweep: bool = True) -> Callable[[DataFrame, int], None]:
    """What ``writeStream.foreachBatch`` of a stream of deletion outcomes calls."""
    return lambda outcomes, batch_id: sweep_batch(outcomes, batch_id, folder, sweep)


def due(sessions: DataFrame, now, limit: int = 1000) -> DataFrame:
    """Sessions whose evidence is to be deleted, for the job that makes the outcomes; those without id or user are left out."""
    return governance.cleanup_candidates(sessions, now, limit).where("id is not null and user_id is not null")
