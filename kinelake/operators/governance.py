"""Consent, review queue, decisions and retention, as set-based row transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinelake.functions.labels import SHOTS
from kinelake.operators.evaluation import latest

#: Splits a decision may name, outcomes that count as done or as deleted, tip flags, storage states without evidence.
SPLITS = ("train", "validation", "test", "holdout")
DONE = ("deleted", "already_deleted", "not_found")
REMOVED = ("deleted", "already_deleted")
TIP_FLAGS = ("useful", "incorrect", "unsafe", "unclear")
UNRETAINED = ("not_retained", "deleted", "withdrawn", "deletion_pending")


def retained(deadline: Column, now: Column, null_passes: bool = True) -> Column:
    """Whether a deadline text lies after now; unparsable ones don't."""
    later = F.coalesce(F.try_to_timestamp(deadline) > now, F.lit(False))
    return F.when(deadline.isNull(), null_passes).otherwise(later)


def _given(column: str | Column) -> Column:
    """Whether a text is there and not empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")) != ""


def reviewable(now: Column) -> Column:
    """Neither withdrawn nor deleted, stored, with a path, retained, and metadata of user, session and checksum."""
    named = [_given(F.get_json_object("evidence_metadata", f"$.{key}")) for key in ("user_id", "analysis_session_id", "checksum_sha256")]
    return (
        ~_given("withdrawn_at") & ~_given("deleted_at") & (F.coalesce("storage_status", F.lit("")) == "stored") & _given("evidence_object_path")
        & retained(F.col("retention_expires_at"), now) & named[0] & named[1] & named[2]
    )


def _consented_and_stored() -> Column:
    return F.col("accepted_for_review") & F.col("consent") & (F.col("storage_status") == "stored") & F.col("withdrawn_at").isNull() & F.col("deleted_at").isNull()


def review_queue(rows: DataFrame, now: Column, limit: int = 100) -> DataFrame:
    """Consented candidates that wait for review, oldest first; a deadline must be given and lie ahead."""
    waits = (F.col("review_status") == "candidate") & (F.col("eligibility") == "pending_review")
    fits = rows.where(_consented_and_stored() & waits & retained(F.col("retention_expires_at"), now, null_passes=False))
    return fits.orderBy("created_at", "id").limit(max(1, min(1000, limit)))


def export_set(rows: DataFrame, now: Column, limit: int | None = None) -> DataFrame:
    """Approved and eligible rows, accepted, consented, stored, neither withdrawn nor deleted, with evidence, reviewer and label, still retained.

    limit takes the oldest rows before the checks of evidence, reviewer and deadline, as a paged listing does.
    """
    listed = rows.where(_consented_and_stored() & (F.col("review_status") == "approved") & (F.col("eligibility") == "eligible"))
    if limit is not None:
        listed = listed.orderBy("created_at", "id").limit(limit)
    return listed.where(_given("evidence_object_path") & _given("reviewer_id") & _given("reviewer_label") & retained(F.col("retention_expires_at"), now))


def cleanup_candidates(rows: DataFrame, now: Column, limit: int = 100) -> DataFrame:
    """Stored or deletion-pending evidence past its deadline, earliest first."""
    due = F.try_to_timestamp(F.col("retention_expires_at")) <= now
    return rows.where(F.col("storage_status").isin("stored", "deletion_pending") & due).orderBy("retention_expires_at", "id").limit(max(1, min(1000, limit)))


def _broken() -> Column:
    checks = {
        "corrected_shot": (F.col("verdict") == "incorrect") & F.col("corrected_shot").isNull(),
        "rating": ~F.col("rating").between(1, 5),
        "shot": ~F.col("corrected_shot").isin(*SHOTS),
        "tip_flags": F.size(F.array_except("tip_flags", F.array(*[F.lit(f) for f in TIP_FLAGS]))) > 0,
        "verdict": ~F.col("verdict").isin("correct", "incorrect", "unsure"),
    }
    return F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), name) for name, test in checks.items()])), ",")


def violations(rows: DataFrame) -> DataFrame:
    """Rows with the rules that they break, in alphabetical order; keeps only those."""
    return rows.withColumn("violations", _broken()).where("violations <> ''")


def bind(feedback: DataFrame, sessions: DataFrame, now: Column, participation: bool = True) -> DataFrame:
    """Feedback with the trusted fields of the session that its user owns, or a violation.

    violation is session_not_found, unsupported_prediction or what ``violations`` finds; such rows
    get no status. Evidence counts if the session's is reviewable (P13) and participation is on:
    a consented row is a candidate then, else it waits for evidence or has none retained.
    """
    own = sessions.select(
        F.col("id").alias("session_id"), "user_id", "predicted_shot", "clip_hash", "evidence_object_path", "evidence_metadata", "retention_expires_at",
        F.coalesce("storage_status", F.lit("not_retained")).alias("storage_status"), reviewable(now).alias("_reviewable"), F.lit(True).alias("_found"),
    )
    joined = feedback.withColumn("_broken", _broken()).join(own, ["session_id", "user_id"], "left")
    violation = (
        F.when(F.col("_found").isNull(), "session_not_found").when(~F.coalesce(F.col("predicted_shot").isin(*SHOTS), F.lit(False)), "unsupported_prediction")
        .when(F.col("_broken") != "", F.col("_broken"))
    )
    consent = F.coalesce("consent", F.lit(False))
    evidence = consent & F.col("_reviewable") & F.lit(participation)
    status = F.when(~consent, "not_consented").when(evidence, "candidate").when(F.col("storage_status").isin(*UNRETAINED), "evidence_not_retained").otherwise("awaiting_evidence")
    fine = violation.isNull()
    return joined.select(
        *feedback.columns, violation.alias("violation"), "predicted_shot", F.lower("clip_hash").alias("clip_hash"), "storage_status", "evidence_object_path", "evidence_metadata",
        F.when(fine, status).alias("review_status"), F.when(fine & evidence, "pending_review").when(fine, "not_eligible").alias("eligibility"),
        F.when(fine, evidence).alias("accepted_for_review"), F.when(fine & consent, F.col("retention_expires_at")).alias("retention_expires_at"),
    )


def dedupe_candidates(rows: DataFrame) -> DataFrame:
    """One consented row a user, clip and version; rows without consent (false or NULL) pass."""
    keys = ["user_id", "clip_hash", "_model", "_pipeline"]
    agreed = F.coalesce("consent", F.lit(False))
    named = rows.withColumn("_model", F.coalesce("model_version", F.lit(""))).withColumn("_pipeline", F.coalesce("pipeline_version", F.lit("")))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("created_at", "id"))
    return named.where(agreed).withColumn("_rank", rank).where("_rank = 1").drop("_rank").unionByName(named.where(~agreed)).drop("_model", "_pipeline")


def apply_decisions(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """G1: the latest decision of each row, checked; bad ones set violation and change nothing.

    A split is optional, for either decision, but must be a known one. Reviewer, label and
    quality are kept of both decisions, split and version of approvals only.
    """
    last = latest(decisions, ["feedback_id"], F.desc("decided_at"), F.desc("reviewer_id"))
    approve = F.col("decision") == "approve"
    bad = (
        F.when(~F.coalesce(F.col("decision").isin("approve", "reject"), F.lit(False)), "unknown_decision")
        .when(approve & ~F.coalesce(F.col("label").isin(*SHOTS), F.lit(False)), "unsupported_label")
        .when(~F.col("quality").between(0, 1), "quality_out_of_range")
        .when(~F.col("split_name").isin(*SPLITS), "unknown_split")
        .when(approve & F.col("unsafe"), "unsafe")
        .when(~approve & ~_given("reason"), "reason_missing")
    )
    named = last.withColumnRenamed("feedback_id", "id").withColumn("_decided", F.lit(True))
    joined = rows.join(named, "id", "left").withColumn("violation", F.when(F.col("_decided"), bad))
    valid = F.coalesce("_decided", F.lit(False)) & F.col("violation").isNull()
    approved = valid & approve
    status = F.when(approved, "approved").when(valid, "rejected").otherwise(F.col("review_status"))
    return joined.select(
        "id", "violation", status.alias("review_status"),
        F.when(approved, "eligible").when(valid, "rejected").otherwise(F.col("eligibility")).alias("eligibility"),
        F.when(valid, approved).otherwise(F.col("accepted_for_review")).alias("accepted_for_review"),
        F.when(approved, F.col("split_name")).alias("split_assignment"), F.when(approved, F.col("inclusion_version")).alias("training_inclusion_version"),
        *[F.when(valid, F.col(given)).alias(name) for given, name in (("reviewer_id", "reviewer_id"), ("label", "reviewer_label"), ("quality", "label_quality_score"), ("reason", "rejection_reason"))],
    )


def _terminal(sweep: bool) -> tuple[Column, Column]:
    """(terminal status, whether it counts as deleted) of an outcome: a sweep counts not_found as deleted, a withdrawal as withdrawn."""
    removed = F.coalesce(F.col("outcome").isin(*(DONE if sweep else REMOVED)), F.lit(False))
    return F.when(removed, "deleted").when(F.col("outcome").isin(*DONE), "withdrawn").otherwise("deletion_pending"), removed


def apply_removals(sessions: DataFrame, outcomes: DataFrame, at: Column, sweep: bool = True) -> DataFrame:
    """G2, ST8: sessions after deletion outcomes (id, user_id, outcome) at a time (text); other rows as they are.

    withdrawn_at is set by every outcome, deleted_at by deletions only; a failed
    deletion leaves its code.
    """
    status, removed = _terminal(sweep)
    hit = F.col("_hit").isNotNull()
    joined = sessions.join(outcomes.select("id", "user_id", "outcome", F.lit(True).alias("_hit")), ["id", "user_id"], "left")
    changed = {
        "storage_status": status, "withdrawn_at": at, "deleted_at": F.when(removed, at), "consent": F.lit(False),
        "deletion_error_code": F.when(status == "deletion_pending", F.coalesce("outcome", F.lit("no_outcome"))),
    }
    old = {c: F.col(c) if c in sessions.columns else F.lit(None).cast("string") for c in changed}
    return joined.select(*[c for c in sessions.columns if c not in changed], *[F.when(hit, value).otherwise(old[c]).alias(c) for c, value in changed.items()])


def remove_feedback(feedback: DataFrame, outcomes: DataFrame, at: Column, sweep: bool = True) -> DataFrame:
    """G2, ST8: feedback of the sessions with deletion outcomes (id, user_id, outcome): status, eligibility and acceptance; other rows as they are.

    Whatever the outcome, a row is no longer eligible: deleted after a deletion, else withdrawn.
    """
    status, removed = _terminal(sweep)
    hit = F.col("_hit").isNotNull()
    joined = feedback.join(outcomes.select(F.col("id").alias("session_id"), "user_id", "outcome", F.lit(True).alias("_hit")), ["session_id", "user_id"], "left")
    changed = {
        "review_status": status, "eligibility": F.when(removed, "deleted").otherwise("withdrawn"), "accepted_for_review": F.lit(False),
        "withdrawn_at": at, "deleted_at": F.when(removed, at),
    }
    old = {c: F.col(c) if c in feedback.columns else F.lit(None).cast("string") for c in changed}
    return joined.select(*[c for c in feedback.columns if c not in changed], *[F.when(hit, value).otherwise(old[c]).alias(c) for c, value in changed.items()])


def retention_sweep(rows: DataFrame, outcomes: DataFrame, now: Column, limit: int = 100, dry_run: bool = False) -> DataFrame:
    """ST8: the candidates of one incremental batch (P16) and what becomes of them: status, storage_status, error_code.

    A dry run names the candidates only. Candidates without an id or user are
    skipped; deleted, already deleted and not found count as deleted, else deletion
    stays pending with the outcome as error.
    """
    batch = cleanup_candidates(rows, now, limit).select("id", "user_id", "storage_status")
    known = F.col("id").isNotNull() & F.col("user_id").isNotNull()
    if dry_run:
        return batch.select("id", F.when(known, "dry_run").otherwise("skipped").alias("status"), "storage_status", F.when(~known, "missing_identity").alias("error_code"))
    outcome = F.coalesce("outcome", F.lit("no_outcome"))
    done = outcome.isin(*DONE)
    return batch.join(outcomes, "id", "left").select(
        "id", F.when(known, outcome).otherwise("skipped").alias("status"),
        F.when(~known, F.col("storage_status")).when(done, "deleted").otherwise("deletion_pending").alias("storage_status"),
        F.when(~known, "missing_identity").when(~done, outcome).alias("error_code"),
    )


def candidate_view(rows: DataFrame, now: Column) -> DataFrame:
    """G3."""
    return rows.select("id", "user_id", "predicted_shot", "created_at", reviewable(now).alias("reviewable"), F.get_json_object("evidence_metadata", "$.provider_id").alias("provider_id"))


def deadline(created: Column, days: int = 30) -> Column:
    """F26."""
    return created + F.make_dt_interval(F.lit(max(1, days)))
