"""Queries over clip metadata, predictions, sessions, feedback and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinelake.functions import labels as rules
from kinelake.functions.labels import SHOTS
from kinelake.operators import dataset, evaluation, features, governance, rates, sessions
from kinelake.plans import derive, pose_queries
from kinelake.plans.pose_queries import tidy, tidy_sql

NOW = "TIMESTAMP '1998-06-01 00:00:00'"
_now = lambda: F.expr(NOW)
_THRESHOLDS = (0.0, 0.3, 0.4, 0.5, 0.6, 0.8)


def _scored(s, d):
    return evaluation.score_rows(derive.predictions(s, d))


def _past_ties(df):
    """Four digits on either side by the same arithmetic: quotients that end in a 5 at the fifth digit are moved past the tie first."""
    return df.select(*[(F.round(F.col(c) + 1e-11, 4) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _runs(s, d):
    """Runs with their macro F1 over the four classes; the gap is that of mean confidence and accuracy."""
    ok = _scored(s, d).where("error is null")
    own = ok.groupBy("model", "seed").agg(F.avg(F.col("correct").cast("int")).alias("accuracy"), F.avg("nll").alias("loss"), F.avg("confidence").alias("_mean"), F.count(F.lit(1)).alias("parameters"))
    hit = F.when(F.col("true_label") == F.col("predicted_label"), 1).otherwise(0)
    tall = ok.select("model", "seed", F.inline(F.array(*[F.struct(F.lit(x).alias("label"), (F.col("true_label") == x).cast("int").alias("t"), (F.col("predicted_label") == x).cast("int").alias("p"), (hit * (F.col("true_label") == x).cast("int")).alias("h")) for x in SHOTS])))
    f1 = tall.groupBy("model", "seed", "label").agg(F.coalesce(F.try_divide(F.sum("h") * 2.0, F.sum("t") + F.sum("p")), F.lit(0.0)).alias("f1")).groupBy("model", "seed").agg(F.avg("f1").alias("macro_f1"))
    return own.join(f1, ["model", "seed"]).withColumn("gap", F.col("_mean") - F.col("accuracy")).drop("_mean")


def _split(s, d):
    return dataset.stratified_split(derive.clips(s, d), "clip_key")


def _metrics(s, d):
    """Counters and timers whose label values have quotes, in values that sum up without rounding."""
    return derive.requests(s, d).selectExpr(
        "concat('http_', event_type) AS name", "CASE WHEN event_type = 'error' THEN 'counter' ELSE 'timer' END AS kind",
        "map('code', concat('x\"', CAST(key % 3 AS STRING))) AS labels", "CAST(floor(value) AS DOUBLE) * 64.25D AS value",
    )


def _outcomes(s, d):
    """Deletion outcomes of three quarters of the sessions."""
    return derive.sessions(s, d).where("id % 4 <> 1").selectExpr("id", "user_id", f"{OUTCOME} AS outcome")


#: Outcome of a deletion, in words that Spark and DuckDB share.
OUTCOME = "CASE id % 7 WHEN 0 THEN 'deleted' WHEN 1 THEN 'already_deleted' WHEN 2 THEN 'not_found' ELSE 'failed' END"
SWEPT_AT = "1998-06-01T00:00:00Z"


def _removed_sessions(s, d, sweep):
    changed = governance.apply_removals(derive.sessions(s, d), _outcomes(s, d), F.lit(SWEPT_AT), sweep)
    return changed.select("id", "storage_status", "withdrawn_at", "deleted_at", "consent", "deletion_error_code")


def _review_rows(s, d):
    return governance.bind(derive.feedback(s, d), derive.sessions(s, d), _now())


def _removed_feedback(s, d, sweep):
    changed = governance.remove_feedback(_review_rows(s, d), _outcomes(s, d), F.lit(SWEPT_AT), sweep)
    return changed.select("id", "review_status", "eligibility", "accepted_for_review", "withdrawn_at", "deleted_at")


def _probes(s, d):
    """Clip probes: some without size, frames or rate, some with a duration of their own."""
    return derive.sessions(s, d).selectExpr(
        "id", "CASE WHEN id % 5 = 0 THEN NULL ELSE clean_frames * 15 END AS frames", "CAST(id % 3 AS DOUBLE) * 15 AS fps", "CAST(CASE WHEN id % 11 = 0 THEN 0 ELSE 1280 + id % 2 * 2560 END AS INT) AS width",
        "CASE WHEN id % 13 = 0 THEN NULL ELSE 720 END AS height", "CASE id % 4 WHEN 0 THEN duration_seconds * 2 WHEN 1 THEN 0D END AS seconds",
    )


def _decisions(s, d):
    return derive.feedback(s, d).selectExpr(
        "session_id AS feedback_id", "CAST(id AS STRING) AS reviewer_id", "created_at AS decided_at", "CASE rating WHEN 0 THEN CASE WHEN id % 2 = 0 THEN 'hold' ELSE 'reject' END WHEN 1 THEN 'reject' WHEN 2 THEN 'reject' ELSE 'approve' END AS decision", "corrected_shot AS label", "rating / 6.0D AS quality", "size(tip_flags) > 1 AND rating = 5 AS unsafe", "CASE WHEN rating = 3 THEN 'dev' WHEN rating = 4 THEN NULL ELSE 'train' END AS split_name", "CASE rating WHEN 1 THEN 'blurred' WHEN 0 THEN '' END AS reason", "CASE WHEN rating % 2 = 0 THEN 'v2' END AS inclusion_version",
    )


def _joined_split(s, d):
    """A split whose rows partly repeat, lack metadata or a person, or disagree in their class."""
    made = _split(s, d).selectExpr("clip_key", "CAST(clip_key AS STRING) AS video_id", "CASE WHEN clip_key % 17 = 3 THEN 'gone.mp4' ELSE file_name END AS file_name", "CASE WHEN clip_key % 19 = 5 THEN 'idle' ELSE shot_label END AS shot_label", "split")
    split = made.unionByName(made.where("clip_key % 41 = 1"))
    meta = derive.clips(s, d).selectExpr("CAST(clip_key AS STRING) AS video_id", "file_name", "shot_label", "CASE WHEN clip_key % 23 = 7 THEN ' ' ELSE person_id END AS person_id")
    return dataset.joined_split(split, meta.unionByName(meta.where("file_name LIKE '%77.mp4'")))


QUERIES = {
    "p1_metadata": lambda s, d: dataset.metadata(derive.clip_files(s, d).select("path")),
    "p2_use_clip": lambda s, d: dataset.metadata(derive.clip_files(s, d).select("path")).where(dataset.use_clip(F.col("use_for_v1"))).groupBy("shot_label").agg(F.count(F.lit(1)).alias("n")),
    "p18_name_rules": lambda s, d: derive.clips(s, d).select("clip_key", rules.shot_of(F.col("file_name")).alias("shot"), rules.quality_of(F.col("file_name")).alias("quality"), rules.video_id(F.col("clip_key").cast("string")).alias("video_id")),
    "j2_join_violations": lambda s, d: dataset.join_violations(derive.clips(s, d).selectExpr("person_id", "clip_key % 50 AS slot"), derive.clips(s, d).selectExpr("person_id", "clip_key % 7 AS slot"), ["person_id", "slot"]),
    "j2_joined_split": _joined_split,
    "j3_with_person": lambda s, d: dataset.with_person(derive.clips(s, d).selectExpr("clip_key AS row_index", "file_name"), derive.clips(s, d).where("clip_key % 3 = 0").select("file_name", "person_id", "quality")).select("row_index", "person_id", "quality"),
    "j9_set_report": lambda s, d: dataset.set_report(derive.clips(s, d).where("clip_key % 10 <> 3").select("clip_key"), _split(s, d).where("clip_key % 10 <> 4").select("clip_key", "split"), "clip_key"),
    "a16_encode_labels": lambda s, d: dataset.encode_labels(derive.clips(s, d)).select("clip_key", "shot_label", "encoded_label"),
    "w11_stratified_split": lambda s, d: _split(s, d).select("clip_key", "shot_label", "split"),
    "a17_distribution": lambda s, d: dataset.distribution(_split(s, d)),
    "a19_split_summary": lambda s, d: dataset.split_summary(_split(s, d), "person_id"),
    "g4_player_split": lambda s, d: dataset.split_summary(dataset.player_disjoint_split(derive.clips(s, d), "person_id"), "person_id"),
    "a35_manifest": lambda s, d: dataset.manifest(_split(s, d), 32, health=features.health_summary(features.health(features.statistics(pose_queries.frame_table(s, d)))).select("health_status", "features")),
    "w11_counted_split": lambda s, d: dataset.counted_split(derive.clips(s, d), "clip_key", train=140, validation=30, each=None).select("clip_key", "shot_label", "split"),
    "t6_best_run": lambda s, d: tidy((lambda runs: evaluation.best_run(runs, evaluation.aggregate_seeds(runs)))(_runs(s, d)).select("model", "seed", "macro_f1", "loss")),
    "j3_with_duplicates": lambda s, d: dataset.with_person(derive.clips(s, d).selectExpr("clip_key AS row_index", "file_name"), derive.clips(s, d).select("file_name", "person_id", "quality").unionByName(derive.clips(s, d).where("clip_key % 1000 = 1").selectExpr("file_name", "'other' AS person_id", "'bad' AS quality"))).select("row_index", "person_id", "quality"),
    "f23_score_rows": lambda s, d: _past_ties(_scored(s, d).where("error is null").select("row_index", "predicted_label", "confidence", "correct", "nll", "brier")),
    "a21_confusion": lambda s, d: evaluation.confusion(_scored(s, d).where("error is null")),
    "a20_class_metrics": lambda s, d: tidy(evaluation.class_metrics(evaluation.confusion(_scored(s, d).where("error is null")))),
    "a20_overall_metrics": lambda s, d: tidy(evaluation.overall_metrics(evaluation.confusion(_scored(s, d).where("error is null")))),
    "a22_calibration": lambda s, d: tidy(evaluation.calibration_totals(_scored(s, d))),
    "a23_reliability": lambda s, d: tidy(evaluation.reliability(_scored(s, d))),
    "a23_calibration_error": lambda s, d: tidy(evaluation.calibration_error(evaluation.reliability(_scored(s, d)))),
    "a24_rejection": lambda s, d: tidy(evaluation.rejection(_scored(s, d), _THRESHOLDS)),
    "a25_seeds": lambda s, d: tidy(evaluation.aggregate_seeds(_runs(s, d))),
    "t6_best_model": lambda s, d: evaluation.best_model(evaluation.aggregate_seeds(_runs(s, d))).select("model", "seeds"),
    "a26_failures": lambda s, d: evaluation.confused_pairs(_scored(s, d)),
    "t7_confident_errors": lambda s, d: tidy(evaluation.confident_errors(_scored(s, d)).select("row_index", "confidence")),
    "j6_alignment": lambda s, d: evaluation.alignment_errors(derive.predictions(s, d), derive.clips(s, d).where("clip_key % 5 <> 0").selectExpr("clip_key AS row_index", "shot_label")),
    "t9_recent_sessions": lambda s, d: sessions.recent(derive.sessions(s, d), 3).select("user_id", "id"),
    "j7_verdicts": lambda s, d: sessions.verdicts(derive.feedback(s, d)),
    "a33_shot_distribution": lambda s, d: tidy(sessions.shot_distribution(derive.sessions(s, d))),
    "a33_totals": lambda s, d: tidy(sessions.totals(derive.sessions(s, d))),
    "a33b_feedback_accuracy": lambda s, d: tidy(sessions.feedback_accuracy(derive.sessions(s, d), derive.feedback(s, d))),
    "a33d_chart": lambda s, d: tidy(sessions.chart(derive.sessions(s, d))),
    "t10_latest_output": lambda s, d: tidy(sessions.latest_output(derive.sessions(s, d)).drop("landmarks")),
    "t11_strongest": lambda s, d: sessions.strongest(sessions.shot_distribution(derive.sessions(s, d))),
    "t12_first_issues": lambda s, d: sessions.first_issues(derive.sessions(s, d)),
    "w12_streak": lambda s, d: sessions.streak(derive.sessions(s, d), F.expr("DATE '1998-06-01'")),
    "p10_segment_timing": lambda s, d: tidy(sessions.segment_timing(derive.sessions(s, d).selectExpr("id", "start_frame", "end_frame", "CASE WHEN id % 4 = 0 THEN NULL ELSE transform(sequence(0, 49), i -> CASE WHEN id % 3 = 0 AND i = 45 THEN NULL ELSE i / 25.0D END) END AS timing")).select("id", "status", "seconds")),
    "p11_quality_gate": lambda s, d: sessions.quality_gate(derive.sessions(s, d)).select("id", "quality_status", "reasons"),
    "p12_probe_check": lambda s, d: tidy(sessions.probe_check(_probes(s, d)).select("id", "frames", "seconds", "error_code")),
    "f16_labels": lambda s, d: derive.sessions(s, d).select("id", rules.duration_label(F.col("duration_seconds") * 10).alias("length"), rules.pseudonym(F.col("user_id")).alias("pseudonym"), rules.band(F.col("technique_match_score")).alias("band")),
    "p13_reviewable": lambda s, d: governance.candidate_view(derive.sessions(s, d), _now()).select("id", "reviewable"),
    "p14_review_queue": lambda s, d: governance.review_queue(derive.sessions(s, d), _now(), 50).select("id"),
    "p15_export_set": lambda s, d: governance.export_set(derive.sessions(s, d), _now()).select("id"),
    "p16_cleanup": lambda s, d: governance.cleanup_candidates(derive.sessions(s, d), _now(), 40).select("id"),
    "p19b_violations": lambda s, d: governance.violations(derive.feedback(s, d)).select("id", "violations"),
    "j8_bind_feedback": lambda s, d: _review_rows(s, d).select("id", "session_id", "user_id", "violation", "clip_hash", "storage_status", "review_status", "eligibility", "accepted_for_review", "retention_expires_at"),
    "w13_dedupe": lambda s, d: governance.dedupe_candidates(derive.sessions(s, d)).select("id"),
    "g1_decisions": lambda s, d: governance.apply_decisions(derive.sessions(s, d).select("id", "review_status", "eligibility", "accepted_for_review"), _decisions(s, d)).withColumn("label_quality_score", F.round("label_quality_score", 6)),
    "g2_removals": lambda s, d: _removed_sessions(s, d, True),
    "g2_withdrawals": lambda s, d: _removed_sessions(s, d, False),
    "g2_feedback_removals": lambda s, d: _removed_feedback(s, d, True),
    "g2_feedback_withdrawals": lambda s, d: _removed_feedback(s, d, False),
    "w14_fixed_window": lambda s, d: rates.fixed_window(derive.requests(s, d), 3, 3600 * 24).select("request_id", "key", "allowed"),
    "w15_sliding_window": lambda s, d: rates.sliding_window(derive.requests(s, d), 3, 3600.0 * 24),
    "a34_metric_sums": lambda s, d: tidy(rates.metric_sums(derive.requests(s, d).selectExpr("concat('http_', event_type) AS name", "CASE WHEN event_type = 'error' THEN 'counter' ELSE 'timer' END AS kind", "map('user', CAST(key % 5 AS STRING), 'code', 'x') AS labels", "value")), 2),
    "s12_exposition": lambda s, d: rates.exposition(rates.metric_sums(_metrics(s, d))),
}

_SE, _FB, _CL, _PR = derive.SESSIONS_SQL, derive.FEEDBACK_SQL, derive.CLIPS_SQL, derive.PREDICTIONS_SQL
_IN = "(" + ", ".join(f"'{x}'" for x in SHOTS) + ")"
_META = f"""{derive.CLIP_FILES_SQL}, me AS (
  SELECT printf('%03d', row_number() OVER (ORDER BY lower(path), path)) AS video_id, split_part(path, '/', 3) AS file_name, path AS relative_path, split_part(path, '/', 2) AS shot_label, regexp_replace(split_part(path, '/', 3), '\\.[^.]*$', '') AS stem FROM files)"""
_QUAL = "CASE WHEN contains({n}, 'good') THEN 'good' WHEN contains({n}, 'average') THEN 'average' WHEN contains({n}, 'bad') THEN 'bad' ELSE 'unknown' END"
_HASH = "md5('42|' || clip_key::VARCHAR)"
_SPLIT = f"""{_CL}, sr AS (SELECT *, row_number() OVER (PARTITION BY shot_label ORDER BY {_HASH}, clip_key) - 1 AS r, count(*) OVER (PARTITION BY shot_label) AS n FROM clips),
sl AS (SELECT *, CASE WHEN r < round(n * 0.7) THEN 'train' WHEN r < round(n * 0.7) + round(n * 0.15) THEN 'validation' ELSE 'test' END AS split FROM sr)"""
_CM = _PR + ", lb(l) AS (VALUES ('cover_drive'), ('defensive_shot'), ('pull_shot'), ('sweep_shot')), cm AS (SELECT a.l AS true_label, b.l AS predicted_label, (SELECT count(*) FROM sc WHERE sc.true_label = a.l AND sc.predicted_label = b.l) AS n FROM lb a, lb b)" + """,
mt AS (SELECT l AS label, sup AS support, coalesce(hit / nullif(pr, 0), 0) AS precision, coalesce(hit / nullif(sup, 0), 0) AS recall FROM (SELECT l, sum(n) FILTER (true_label = l)::DOUBLE AS sup, sum(n) FILTER (predicted_label = l)::DOUBLE AS pr, sum(n) FILTER (true_label = l AND predicted_label = l)::DOUBLE AS hit FROM lb, cm GROUP BY l)),
m2 AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM mt)"""
_RB = _PR + ", rb AS (SELECT bin, count(confidence) AS n, coalesce(avg(correct::INT), 0) AS accuracy, coalesce(avg(confidence), 0) AS confidence FROM (SELECT i::INT AS bin, i / 10.0::DOUBLE AS lo, (i + 1) / 10.0::DOUBLE AS hi FROM range(0, 10) r(i)) b LEFT JOIN sc ON sc.confidence >= lo AND (sc.confidence < hi OR (bin = 9 AND sc.confidence <= hi)) GROUP BY bin), rg AS (SELECT *, abs(accuracy - confidence) AS gap FROM rb)"
_RUN = _PR + """, lb(l) AS (VALUES ('cover_drive'), ('defensive_shot'), ('pull_shot'), ('sweep_shot')),
f1 AS (
  SELECT model, seed, l, coalesce(2e0 * sum((true_label = l AND correct)::INT) / nullif(sum((true_label = l)::INT) + sum((predicted_label = l)::INT), 0), 0) AS f1
  FROM sc, lb GROUP BY ALL
), mf AS (SELECT model, seed, avg(f1) AS macro_f1 FROM f1 GROUP BY ALL),
ru AS (
  SELECT model, seed, avg(correct::INT) AS accuracy, avg(-ln(greatest(pt, 1e-12))) AS loss, avg(confidence) AS conf, count(*) AS parameters
  FROM sc GROUP BY ALL
), ag AS (
  SELECT model, count(*) AS seeds, avg(macro_f1) AS mean_f1, stddev_pop(macro_f1) AS std_f1, avg(accuracy) AS mean_accuracy,
    avg(conf - accuracy) AS mean_gap, avg(loss) AS mean_loss, arg_min(parameters, seed) AS parameters
  FROM ru JOIN mf USING (model, seed) GROUP BY model
)"""
_DIST = _SE + f", us AS (SELECT DISTINCT user_id FROM se), lb(predicted_shot) AS (VALUES ('cover_drive'), ('defensive_shot'), ('pull_shot'), ('sweep_shot')), di AS (SELECT us.user_id, lb.predicted_shot, count(se.id) AS shots, round(avg(technique_match_score), 1) AS mean_score FROM us CROSS JOIN lb LEFT JOIN se ON se.user_id = us.user_id AND se.predicted_shot = lb.predicted_shot GROUP BY ALL), dp AS (SELECT *, CASE WHEN sum(shots) OVER (PARTITION BY user_id) > 0 THEN round(shots * 100.0::DOUBLE / sum(shots) OVER (PARTITION BY user_id), 1) ELSE 0.0 END AS percent FROM di)"
_LATER = f"try_cast(retention_expires_at AS TIMESTAMP) > {NOW}"
_DEC = f"""{_SE}, {_FB}, de AS (
  SELECT session_id AS feedback_id, id::VARCHAR AS reviewer_id, created_at AS decided_at,
    CASE rating WHEN 0 THEN CASE WHEN id % 2 = 0 THEN 'hold' ELSE 'reject' END WHEN 1 THEN 'reject' WHEN 2 THEN 'reject' ELSE 'approve' END AS decision,
    corrected_shot AS label, rating / 6.0::DOUBLE AS quality, flag_count > 1 AND rating = 5 AS unsafe,
    CASE WHEN rating = 3 THEN 'dev' WHEN rating = 4 THEN NULL ELSE 'train' END AS split_name, CASE rating WHEN 1 THEN 'blurred' WHEN 0 THEN '' END AS reason,
    CASE WHEN rating % 2 = 0 THEN 'v2' END AS inclusion_version
  FROM fb
), la AS (SELECT * FROM de QUALIFY row_number() OVER (PARTITION BY feedback_id ORDER BY decided_at DESC, reviewer_id DESC) = 1),
jd AS (SELECT se.id, se.review_status, se.eligibility, se.accepted_for_review, la.* EXCLUDE feedback_id,
  CASE WHEN decision IS NULL THEN NULL WHEN decision NOT IN ('approve', 'reject') THEN 'unknown_decision'
    WHEN decision = 'approve' AND (label IS NULL OR label NOT IN {_IN}) THEN 'unsupported_label'
    WHEN quality < 0 OR quality > 1 THEN 'quality_out_of_range'
    WHEN split_name IS NOT NULL AND split_name NOT IN ('train', 'validation', 'test', 'holdout') THEN 'unknown_split'
    WHEN decision = 'approve' AND unsafe THEN 'unsafe' WHEN decision = 'reject' AND coalesce(reason, '') = '' THEN 'reason_missing' END AS violation
  FROM se LEFT JOIN la ON la.feedback_id = se.id)"""
_REVIEWABLE = f"""(withdrawn_at IS NULL AND deleted_at IS NULL AND coalesce(storage_status = 'stored', false) AND coalesce(evidence_object_path, '') <> ''
  AND (retention_expires_at IS NULL OR coalesce({_LATER}, false)) AND has_metadata)"""
_STORED = "accepted_for_review AND consent AND storage_status = 'stored' AND withdrawn_at IS NULL AND deleted_at IS NULL"
_BROKEN = f"""concat_ws(',', CASE WHEN verdict = 'incorrect' AND corrected_shot IS NULL THEN 'corrected_shot' END,
  CASE WHEN rating < 1 OR rating > 5 THEN 'rating' END, CASE WHEN corrected_shot NOT IN {_IN} THEN 'shot' END, CASE WHEN odd_flag THEN 'tip_flags' END)"""
_BOUND = f"""{_SE}, {_FB}, bo AS (
  SELECT fb.id, fb.session_id, fb.user_id, se.predicted_shot, lower(se.clip_hash) AS clip_hash, CASE WHEN se.id IS NOT NULL THEN coalesce(storage_status, 'not_retained') END AS storage_status, retention_expires_at, fb.consent,
    fb.consent AND {_REVIEWABLE} AS evidence,
    CASE WHEN se.id IS NULL THEN 'session_not_found' WHEN predicted_shot IS NULL OR predicted_shot NOT IN {_IN} THEN 'unsupported_prediction' WHEN {_BROKEN} <> '' THEN {_BROKEN} END AS violation
  FROM fb LEFT JOIN se ON se.id = fb.session_id AND se.user_id = fb.user_id
), bn AS (
  SELECT id, session_id, user_id, violation, clip_hash, storage_status,
    CASE WHEN violation IS NOT NULL THEN NULL WHEN NOT consent THEN 'not_consented' WHEN evidence THEN 'candidate'
      WHEN storage_status IN ('not_retained', 'deleted', 'withdrawn', 'deletion_pending') THEN 'evidence_not_retained' ELSE 'awaiting_evidence' END AS review_status,
    CASE WHEN violation IS NOT NULL THEN NULL WHEN evidence THEN 'pending_review' ELSE 'not_eligible' END AS eligibility,
    CASE WHEN violation IS NULL THEN evidence END AS accepted_for_review, CASE WHEN violation IS NULL AND consent THEN retention_expires_at END AS retention_expires_at
  FROM bo)"""


def _removed_sql(sweep: bool, feedback: bool) -> str:
    """Rows after a sweep (not_found is deleted) or a withdrawal (not_found is withdrawn only)."""
    deleted = "('deleted', 'already_deleted', 'not_found')" if sweep else "('deleted', 'already_deleted')"
    terminal = f"CASE WHEN outcome IN {deleted} THEN 'deleted' WHEN outcome = 'not_found' THEN 'withdrawn' ELSE 'deletion_pending' END"
    gone = f"CASE WHEN hit AND outcome IN {deleted} THEN '{SWEPT_AT}'"
    made = f"ou AS (SELECT id AS oid, user_id AS ouser, {OUTCOME} AS outcome, true AS hit FROM se WHERE id % 4 <> 1)"
    if feedback:
        return f"""WITH {_BOUND}, {made}
SELECT id, CASE WHEN hit THEN {terminal} ELSE review_status END AS review_status, CASE WHEN hit THEN CASE WHEN outcome IN {deleted} THEN 'deleted' ELSE 'withdrawn' END ELSE eligibility END AS eligibility,
  CASE WHEN hit THEN false ELSE accepted_for_review END AS accepted_for_review, CASE WHEN hit THEN '{SWEPT_AT}' END AS withdrawn_at, {gone} END AS deleted_at
FROM bn LEFT JOIN ou ON oid = session_id AND ouser = user_id"""
    return f"""WITH {_SE}, {made}
SELECT id, CASE WHEN hit THEN {terminal} ELSE storage_status END AS storage_status, CASE WHEN hit THEN '{SWEPT_AT}' ELSE withdrawn_at END AS withdrawn_at,
  {gone} WHEN hit THEN NULL ELSE deleted_at END AS deleted_at, CASE WHEN hit THEN false ELSE consent END AS consent, CASE WHEN outcome = 'failed' THEN 'failed' END AS deletion_error_code
FROM se LEFT JOIN ou ON oid = id AND ouser = user_id"""


ORACLE = {
    "p1_metadata": f"WITH {_META} SELECT video_id, file_name, relative_path, shot_label, CASE WHEN shot_label = 'idle' THEN 'none' ELSE {_QUAL.format(n='stem')} END AS quality, CASE WHEN shot_label = 'idle' THEN 'unknown' WHEN contains(stem, 'bad') AND k BETWEEN 1 AND 4 THEN 'player' || substr('ABCD', k, 1) WHEN NOT contains(stem, 'bad') AND k BETWEEN 1 AND 8 THEN 'player' || substr('ABCD', ceil(k / 2.0)::INT, 1) ELSE 'unknown' END AS person_id, CASE WHEN shot_label = 'idle' THEN 'no' ELSE 'yes' END AS use_for_v1 FROM (SELECT *, right(stem, 1)::INT AS k FROM me)",
    "p2_use_clip": f"WITH {_META} SELECT shot_label, count(*) AS n FROM me WHERE shot_label <> 'idle' GROUP BY ALL",
    "p18_name_rules": f"WITH {_CL} SELECT clip_key, shot_label AS shot, quality, printf('%03d', clip_key) AS video_id FROM clips",
    "j2_joined_split": f"""
WITH {_SPLIT}, sm AS (SELECT clip_key, clip_key::VARCHAR AS video_id, CASE WHEN clip_key % 17 = 3 THEN 'gone.mp4' ELSE file_name END AS file_name, CASE WHEN clip_key % 19 = 5 THEN 'idle' ELSE shot_label END AS shot_label, split FROM sl),
ss AS (SELECT * FROM sm UNION ALL SELECT * FROM sm WHERE clip_key % 41 = 1),
mm AS (SELECT clip_key::VARCHAR AS video_id, file_name, shot_label AS known, CASE WHEN clip_key % 23 = 7 THEN ' ' ELSE person_id END AS person_id FROM clips),
ma AS (SELECT * FROM mm UNION ALL SELECT * FROM mm WHERE file_name LIKE '%77.mp4')
SELECT ss.*, ma.person_id, CASE WHEN (SELECT count(*) FROM ss o WHERE o.video_id = ss.video_id AND o.file_name = ss.file_name) > 1 THEN 'duplicate_split'
  WHEN (SELECT count(*) FROM ma o WHERE o.video_id = ss.video_id AND o.file_name = ss.file_name) > 1 THEN 'duplicate_meta'
  WHEN trim(coalesce(ma.person_id, '')) = '' THEN 'missing_person' WHEN ss.shot_label <> ma.known THEN 'label_mismatch' END AS violation
FROM ss LEFT JOIN ma USING (video_id, file_name)""",
    "j2_join_violations": f"WITH {_CL} SELECT person_id, clip_key % 50 AS slot, 'left' AS side, count(*) AS n FROM clips GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT person_id, clip_key % 7, 'right', count(*) FROM clips GROUP BY ALL HAVING count(*) > 1",
    "j3_with_person": f"WITH {_CL} SELECT clip_key AS row_index, CASE WHEN clip_key % 3 = 0 THEN person_id ELSE 'unknown' END AS person_id, quality FROM clips",
    "j9_set_report": f"WITH {_CL} SELECT clip_key, CASE WHEN clip_key % 10 = 4 THEN 'missing' ELSE 'extra' END AS problem FROM clips WHERE clip_key % 10 IN (3, 4)",
    "a16_encode_labels": f"WITH {_CL} SELECT clip_key, shot_label, (dense_rank() OVER (ORDER BY shot_label) - 1)::INT AS encoded_label FROM clips",
    "w11_stratified_split": f"WITH {_SPLIT} SELECT clip_key, shot_label, split FROM sl",
    "a17_distribution": f"WITH {_SPLIT} SELECT split, shot_label, count(*) AS n FROM sl GROUP BY ROLLUP (split, shot_label)",
    "a19_split_summary": f"WITH {_SPLIT}, sp AS (SELECT person_id, count(DISTINCT split) AS k FROM sl GROUP BY 1) SELECT split, count(*) AS samples, count(DISTINCT sl.person_id) AS groups, count(DISTINCT sl.person_id) FILTER (k > 1) AS shared_groups FROM sl JOIN sp ON sl.person_id = sp.person_id GROUP BY split",
    "a35_manifest": f"""
WITH {_SPLIT}, {pose_queries._FS}, c AS (
  SELECT count(*) AS samples, 32 AS features, count(DISTINCT shot_label) AS classes, string_agg(DISTINCT shot_label, ',' ORDER BY shot_label) AS class_names,
    count(*) FILTER (split = 'train') AS train_samples, count(*) FILTER (split = 'validation') AS validation_samples, count(*) FILTER (split = 'test') AS test_samples FROM sl)
SELECT *, samples || 'x60x32' AS shape, train_samples || 'x60x32' AS train_shape, validation_samples || 'x60x32' AS validation_shape, test_samples || 'x60x32' AS test_shape,
  (SELECT string_agg(health_status || '=' || n, ',' ORDER BY health_status) FROM (SELECT health_status, count(*) AS n FROM he GROUP BY 1)) AS health FROM c""",
    "w11_counted_split": f"""
WITH {_CL}, ra AS (SELECT *, row_number() OVER (PARTITION BY shot_label ORDER BY {_HASH}, clip_key) AS r FROM clips)
SELECT clip_key, shot_label, CASE WHEN r <= 140 THEN 'train' WHEN r <= 170 THEN 'validation' ELSE 'test' END AS split FROM ra""",
    "t6_best_run": tidy_sql(
        _RUN + ", be AS (SELECT model FROM ag ORDER BY mean_f1 DESC, std_f1, abs(mean_gap), mean_loss, parameters, model LIMIT 1)",
        "SELECT model, seed, macro_f1, loss FROM ru JOIN mf USING (model, seed) JOIN be USING (model) ORDER BY macro_f1 DESC, loss, seed LIMIT 1", ["model", "seed"], ["macro_f1", "loss"],
    ),
    "j3_with_duplicates": f"""
WITH {_CL}, me AS (SELECT file_name, person_id, quality FROM clips UNION ALL SELECT file_name, 'other', 'bad' FROM clips WHERE clip_key % 1000 = 1),
du AS (SELECT count(*) AS n FROM (SELECT file_name FROM me GROUP BY 1 HAVING count(*) > 1))
SELECT clip_key AS row_index, CASE WHEN n > 0 THEN 'unknown' ELSE person_id END AS person_id, quality FROM clips, du""",
    "f23_score_rows": f"""
WITH {_PR}, m AS (SELECT *, -ln(greatest(pt, 1e-12)) AS nll, p0 * p0 + p1 * p1 + p2 * p2 + p3 * p3 - 2 * pt + 1 AS brier FROM sc)
SELECT row_index, predicted_label, correct, round(confidence + 1e-11, 4) + 0.0 AS confidence, round(nll + 1e-11, 4) + 0.0 AS nll, round(brier + 1e-11, 4) + 0.0 AS brier
FROM m""",
    "a21_confusion": f"WITH {_CM} SELECT * FROM cm",
    "a20_class_metrics": tidy_sql(_CM, "SELECT * FROM m2", ["label", "support::BIGINT AS support"], ["precision", "recall", "f1"]),
    "a20_overall_metrics": tidy_sql(_CM, "SELECT avg(f1) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1, avg(precision) AS macro_precision, avg(recall) AS macro_recall, sum(precision * support) / sum(support) AS weighted_precision, sum(recall * support) / sum(support) AS weighted_recall, (SELECT sum(n) FILTER (true_label = predicted_label)::DOUBLE / sum(n) FROM cm) AS accuracy FROM m2", [], ["macro_f1", "weighted_f1", "macro_precision", "macro_recall", "weighted_precision", "weighted_recall", "accuracy"]),
    "a22_calibration": tidy_sql(_CM, "SELECT (SELECT avg(f1) FROM m2) AS macro_f1, count(*) AS n, avg(correct::INT) AS accuracy, avg(-ln(greatest(pt, 1e-12))) AS nll, avg(p0 * p0 + p1 * p1 + p2 * p2 + p3 * p3 - 2 * pt + 1) AS brier, avg(confidence) AS mean_confidence FROM sc", ["n"], ["accuracy", "nll", "brier", "mean_confidence", "macro_f1"]),
    "a23_reliability": tidy_sql(_RB, "SELECT * FROM rg", ["bin", "n"], ["accuracy", "confidence", "gap"]),
    "a23_calibration_error": tidy_sql(_RB, "SELECT sum(gap * n) / sum(n) AS ece, max(gap) AS mce FROM rg", [], ["ece", "mce"]),
    "a24_rejection": tidy_sql(_PR, "SELECT th AS threshold, count(*) FILTER (confidence >= th) AS accepted, count(*) FILTER (confidence < th) AS rejected, coalesce(avg(correct::INT) FILTER (confidence >= th), 0) AS accuracy, (count(*) FILTER (confidence >= th))::DOUBLE / count(*) AS coverage FROM sc, (VALUES " + ", ".join(f"({t}::DOUBLE)" for t in _THRESHOLDS) + ") v(th) GROUP BY th", ["accepted", "rejected"], ["threshold", "accuracy", "coverage"]),
    "a25_seeds": tidy_sql(_RUN, "SELECT * FROM ag", ["model", "seeds", "parameters"], ["mean_f1", "std_f1", "mean_accuracy", "mean_gap", "mean_loss"]),
    "t6_best_model": f"WITH {_RUN} SELECT model, seeds FROM ag ORDER BY mean_f1 DESC, std_f1, abs(mean_gap), mean_loss, parameters, model LIMIT 1",
    "a26_failures": f"WITH {_PR} SELECT true_label, predicted_label, person_id, quality, count(*) AS n FROM sc WHERE NOT correct GROUP BY GROUPING SETS ((true_label, predicted_label), (person_id), (quality))",
    "t7_confident_errors": tidy_sql(_PR, "SELECT row_index, confidence FROM sc WHERE NOT correct ORDER BY confidence DESC, row_index LIMIT 5", ["row_index"], ["confidence"]),
    "j6_alignment": f"WITH {_PR}, {_CL} SELECT row_index, true_label AS left_label, CASE WHEN clip_key % 5 <> 0 THEN shot_label END AS right_label FROM raw JOIN clips ON row_index = clip_key WHERE true_label IS DISTINCT FROM CASE WHEN clip_key % 5 <> 0 THEN shot_label END",
    "t9_recent_sessions": f"WITH {_SE} SELECT user_id, id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS r FROM se) WHERE r <= 3",
    "j7_verdicts": f"WITH {_FB} SELECT session_id, verdict FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at, id) AS r FROM fb WHERE verdict IN ('correct', 'incorrect')) WHERE r = 1",
    "a33_shot_distribution": tidy_sql(_DIST, "SELECT * FROM dp", ["user_id", "predicted_shot", "shots"], ["mean_score", "percent"]),
    "a33_totals": tidy_sql(
        _SE, f"""SELECT user_id, sum(CASE WHEN predicted_shot IN {_IN} THEN 1 ELSE 0 END)::BIGINT AS total_shots, count(DISTINCT day) AS session_days,
  round(sum(CASE WHEN predicted_shot IN {_IN} THEN 1 ELSE 0 END)::DOUBLE / count(DISTINCT day), 2) AS shots_per_session FROM se GROUP BY user_id""",
        ["user_id", "total_shots", "session_days"], ["shots_per_session"],
    ),
    "a33b_feedback_accuracy": tidy_sql(
        f"""{_SE}, {_FB}, fa AS (
  SELECT fb.user_id, CASE WHEN predicted_shot IN {_IN} THEN predicted_shot ELSE 'other' END AS shot, (verdict = 'correct')::INT AS hit
  FROM fb LEFT JOIN se ON se.id = fb.session_id WHERE verdict IN ('correct', 'incorrect'))""",
        "SELECT user_id, shot, count(*) AS verdicts, round(avg(hit) * 100, 1) AS accuracy FROM fa GROUP BY GROUPING SETS ((user_id, shot), (user_id)) HAVING shot IS NULL OR shot <> 'other'",
        ["user_id", "shot", "verdicts"], ["accuracy"],
    ),
    "a33d_chart": tidy_sql(_SE, "SELECT coalesce(predicted_shot, 'unknown') AS shot, count(*) AS n, sum(duration_seconds) AS seconds, avg(shot_confidence) AS mean_confidence FROM se GROUP BY 1", ["shot", "n"], ["seconds", "mean_confidence"]),
    "t10_latest_output": tidy_sql(
        _SE, """SELECT user_id, id, predicted_shot, shot_confidence, technique_match_score, created_at, tips AS text, NULL::VARCHAR AS voice_output
FROM se QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) = 1""",
        ["user_id", "id", "predicted_shot", "created_at", "text", "voice_output"], ["shot_confidence", "technique_match_score"],
    ),
    "t11_strongest": f"WITH {_DIST} SELECT user_id, max(predicted_shot) FILTER (a = 1 AND mean_score IS NOT NULL) AS strongest, max(predicted_shot) FILTER (b = 1) AS most_practised FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY mean_score DESC NULLS LAST, predicted_shot) AS a, row_number() OVER (PARTITION BY user_id ORDER BY shots DESC, predicted_shot) AS b FROM di) GROUP BY user_id",
    "t12_first_issues": f"""
WITH {_SE}, hi AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS r FROM se WHERE issues LIKE '[{{%')
SELECT user_id, r::INT AS rank,
  CASE predicted_shot WHEN 'cover_drive' THEN 'Cover Drive' WHEN 'defensive_shot' THEN 'Defensive Shot' WHEN 'pull_shot' THEN 'Pull Shot' WHEN 'sweep_shot' THEN 'Sweep Shot' WHEN 'other_shot' THEN 'Other Shot' ELSE 'Unknown' END AS shot,
  CASE WHEN issues LIKE '%late foot%' THEN 'late foot' WHEN issues LIKE '%low elbow%' THEN 'low elbow' WHEN issues LIKE '%open hip%' THEN 'open hip'
    WHEN first_tip <> '' THEN first_tip ELSE 'Review the coaching feedback for this analysis.' END AS note
FROM hi WHERE r <= 3""",
    "w12_streak": f"WITH {_SE}, dd AS (SELECT DISTINCT user_id, day::DATE AS day FROM se), il AS (SELECT user_id, day, day - row_number() OVER (PARTITION BY user_id ORDER BY day)::INT AS g FROM dd) SELECT user_id, count(*) AS streak FROM il GROUP BY user_id, g HAVING max(day) = DATE '1998-06-01'",
    "p11_quality_gate": f"WITH {_SE} SELECT id, CASE WHEN clean_frames < 20 THEN 'insufficient_quality' WHEN shot_confidence < 0.55 THEN 'uncertain' ELSE 'ok' END AS quality_status, concat_ws(',', CASE WHEN shot_confidence < 0.55 THEN 'low_confidence' END, CASE WHEN clean_frames < 20 THEN 'too_few_clean_frames' END) AS reasons FROM se",
    "p10_segment_timing": tidy_sql(_SE, "SELECT id, st AS status, CASE WHEN st = 'ok' THEN round(greatest(0, (end_frame - start_frame) / 25.0::DOUBLE), 3) WHEN end_frame >= start_frame THEN round((end_frame - start_frame + 1) / 30.0::DOUBLE, 2) ELSE 0 END AS seconds FROM (SELECT *, CASE WHEN id % 4 = 0 THEN 'unavailable' WHEN end_frame < start_frame OR end_frame >= 50 THEN 'invalid_segment' WHEN id % 3 = 0 AND (start_frame = 45 OR end_frame = 45) THEN 'missing_timestamps' ELSE 'ok' END AS st FROM se)", ["id", "status"], ["seconds"]),
    "p12_probe_check": tidy_sql(
        f"""{_SE}, pr AS (
  SELECT id, CASE WHEN id % 5 = 0 THEN 0 ELSE clean_frames * 15 END AS frames, (id % 3) * 15.0::DOUBLE AS fps, CASE WHEN id % 11 = 0 THEN 0 ELSE 1280 + id % 2 * 2560 END AS width,
    CASE WHEN id % 13 = 0 THEN 0 ELSE 720 END AS height, CASE id % 4 WHEN 0 THEN duration_seconds * 2 ELSE 0 END AS given FROM se
), ps AS (SELECT *, CASE WHEN given <= 0 AND fps > 0 AND frames > 0 THEN frames / fps ELSE given END AS seconds FROM pr)""",
        """SELECT id, CASE WHEN frames <= 0 AND seconds > 0 AND fps > 0 THEN greatest(1, round_even(seconds * fps, 0))::BIGINT ELSE frames END AS frames, seconds,
  CASE WHEN width = 0 OR height = 0 OR (frames <= 0 AND seconds <= 0) THEN 'no_readable_frames' WHEN seconds > 20 THEN 'too_long' WHEN width * height > 1920 * 1080 THEN 'too_large' END AS error_code FROM ps""",
        ["id", "frames", "error_code"], ["seconds"],
    ),
    "f16_labels": f"WITH {_SE}, q AS (SELECT *, duration_seconds * 10 AS s, round(duration_seconds * 10)::BIGINT AS w FROM se) SELECT id, CASE WHEN s <= 0 THEN '-' WHEN w >= 60 THEN printf('%dm %ds', w // 60, w % 60) ELSE printf('%ds', w) END AS length, substr(sha256(user_id::VARCHAR), 1, 16) AS pseudonym, CASE WHEN technique_match_score >= 90 THEN 'strong' WHEN technique_match_score >= 75 THEN 'solid' WHEN technique_match_score >= 60 THEN 'needs attention' ELSE 'priority issue' END AS band FROM q",
    "p13_reviewable": f"WITH {_SE} SELECT id, {_REVIEWABLE} AS reviewable FROM se",
    "p14_review_queue": f"WITH {_SE} SELECT id FROM se WHERE {_STORED} AND review_status = 'candidate' AND eligibility = 'pending_review' AND {_LATER} ORDER BY created_at, id LIMIT 50",
    "p15_export_set": f"""
WITH {_SE} SELECT id FROM se WHERE {_STORED} AND review_status = 'approved' AND eligibility = 'eligible' AND coalesce(evidence_object_path, '') <> ''
  AND reviewer_id IS NOT NULL AND reviewer_label IS NOT NULL AND (retention_expires_at IS NULL OR coalesce({_LATER}, false))""",
    "p16_cleanup": f"WITH {_SE} SELECT id FROM se WHERE storage_status IN ('stored', 'deletion_pending') AND try_cast(retention_expires_at AS TIMESTAMP) <= {NOW} ORDER BY retention_expires_at, id LIMIT 40",
    "p19b_violations": f"WITH {_FB}, v AS (SELECT id, {_BROKEN} AS violations FROM fb) SELECT * FROM v WHERE violations <> ''",
    "j8_bind_feedback": f"WITH {_BOUND} SELECT * FROM bn",
    "w13_dedupe": f"WITH {_SE} SELECT id FROM se QUALIFY consent IS NOT TRUE OR row_number() OVER (PARTITION BY consent, user_id, clip_hash, coalesce(model_version, '') ORDER BY created_at, id) = 1",
    "g1_decisions": f"""
WITH {_DEC}, ok AS (SELECT *, decision IS NOT NULL AND violation IS NULL AS fine, coalesce(violation IS NULL AND decision = 'approve', false) AS yes FROM jd)
SELECT id, violation, CASE WHEN yes THEN 'approved' WHEN fine THEN 'rejected' ELSE review_status END AS review_status, CASE WHEN yes THEN 'eligible' WHEN fine THEN 'rejected' ELSE eligibility END AS eligibility,
  CASE WHEN fine THEN yes ELSE accepted_for_review END AS accepted_for_review, CASE WHEN yes THEN split_name END AS split_assignment, CASE WHEN yes THEN inclusion_version END AS training_inclusion_version,
  CASE WHEN fine THEN reviewer_id END AS reviewer_id, CASE WHEN fine THEN label END AS reviewer_label, CASE WHEN fine THEN round(quality, 6) END AS label_quality_score, CASE WHEN fine THEN reason END AS rejection_reason
FROM ok""",
    "g2_removals": _removed_sql(True, False),
    "g2_withdrawals": _removed_sql(False, False),
    "g2_feedback_removals": _removed_sql(True, True),
    "g2_feedback_withdrawals": _removed_sql(False, True),
    "w14_fixed_window": "SELECT event_id AS request_id, user_id AS key, row_number() OVER (PARTITION BY user_id, floor(epoch(ts) / 86400) ORDER BY ts, event_id) <= 3 AS allowed FROM events",
    "a34_metric_sums": tidy_sql("x AS (SELECT 1)", "SELECT 'http_' || event_type AS name, CASE WHEN event_type = 'error' THEN 'counter' ELSE 'timer' END AS kind, 'code=\"x\",user=\"' || (user_id % 5)::VARCHAR || '\"' AS labels, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL", ["name", "kind", "labels", "n"], ["total"], 2),
}
