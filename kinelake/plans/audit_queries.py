"""Queries of audits, summaries and text rules, and their comparison SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinelake.functions import labels as rules
from kinelake.functions import texts
from kinelake.functions.labels import SHOTS
from kinelake.operators import dataset, evaluation, features, governance, pose, rates, scoring, segmentation, sessions
from kinelake.plans import derive, pose_queries, table_queries
from kinelake.plans.pose_queries import tidy, tidy_sql

_split = table_queries._split
_scored = table_queries._scored
NOW = table_queries.NOW
TABULAR = ("lead_elbow_angle_mean", "stance_width_mean", "motion_energy_total", "body_center_shift_x")


#: A sample's value that isn't a number, and one that is infinite, in words that Spark and DuckDB share.
_ODD = {"NaN": "clip_id % 17 = 3", "Infinity": "clip_id % 19 = 4"}


def _odd_table(s, d):
    """The clip table with values that aren't finite in its first column."""
    first = TABULAR[0]
    value = F.when(F.expr(_ODD["NaN"]), float("nan")).when(F.expr(_ODD["Infinity"]), float("inf")).otherwise(F.col(first))
    return _clip_table(s, d).withColumn(first, value)


def _leaky_split(s, d):
    """A split that has some samples in two of its parts."""
    own = _split(s, d)
    return own.unionByName(own.where("clip_key % 37 = 1").withColumn("split", F.lit("holdout")))


def _clip_table(s, d):
    return features.clip_features(derive.cleaned(s, d)).withColumn("shot", F.expr(derive.SHOT.format(k="clip_id")))


def _probability_rows(s, d):
    """Predictions that keep their probabilities in one of four places, or nowhere."""
    first, second = ("cover_drive", "pull_shot")
    text = F.format_string('{"%s": %.1f, "%s": %.1f}', F.lit(first), F.col("probabilities")[first], F.lit(second), F.col("probabilities")[second])
    held = derive.predictions(s, d).withColumn("place", F.col("row_index") % 5)
    return held.select(
        "row_index",
        F.when(F.col("place") == 0, text).alias("probabilities"),
        F.when(F.col("place") <= 1, text).alias("class_probabilities"),
        F.when(F.col("place") == 2, F.struct(text.alias("probabilities"))).alias("prediction"),
        F.when(F.col("place") == 3, F.col("probabilities")[first].cast("string")).otherwise(" ").alias("prob_cover_drive"),
        F.when(F.col("place") == 3, F.col("probabilities")[second].cast("string")).otherwise("").alias("prob_pull_shot"),
    )


def _extracted(s, d):
    found = evaluation.extract_probabilities(_probability_rows(s, d))
    return tidy(found.select("row_index", F.col("probabilities")["cover_drive"].alias("first"), F.col("probabilities")["pull_shot"].alias("second"), "extraction_error"), 6)


def _results(s, d):
    """Sessions with JSON results: voice output, landmarks, or other things in their places."""
    marks = F.concat(F.lit('[{"x": '), F.col("o_orderkey") % 7, F.lit(', "y": "0.5"}, {"x": "bad", "y": 1}, {"x": 1, "y": 2, "visibility": 0.25}]'))
    voice = F.when(F.col("o_orderkey") % 3 == 0, F.lit('{"engine":"e"}')).otherwise('"text"')
    made = F.concat(F.lit('{"voice_output": '), voice, F.lit(', "landmarks": '), F.when(F.col("o_orderkey") % 4 == 0, "7").otherwise(marks), F.lit("}"))
    return derive.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), made.alias("full_result"))


def _details(s, d):
    found = sessions.result_details(_results(s, d))
    total = F.aggregate("landmarks", F.lit(0.0), lambda a, m: a + m["x"] + m["y"] * 10 + m["visibility"] * 100)
    return found.select("id", F.col("voice_output").isNotNull().alias("has_voice"), F.size("landmarks").alias("landmarks"), total.alias("total"))


def _accuracies(s, d):
    return derive.sessions(s, d).selectExpr("id", "technique_match_score AS accuracy")


def _feedback_made(s, d):
    return pose_queries.QUERIES["f14_feedback"](s, d)


def _texts(s, d):
    """Comments of all orders through the text, boolean and deadline rules."""
    rows = derive.table(s, d, "orders").selectExpr("o_orderkey AS id", "concat('  a \t', o_orderpriority, '  ') AS text", "CASE o_orderkey % 5 WHEN 0 THEN ' Yes' WHEN 1 THEN '0' WHEN 2 THEN 'maybe' ELSE 'TRUE' END AS flag", "CAST(o_orderdate AS TIMESTAMP) AS day")
    return rows.select("id", rules.clean_text(F.col("text"), 12).alias("cleaned"), rules.boolean(F.col("flag")).alias("flag"), governance.deadline(F.col("day"), 30).cast("date").cast("string").alias("deadline"), rules.clip_hash(F.col("text")).alias("hash"))


def _softmax(s, d):
    logits = F.array(*[F.col("probabilities")[name] for name in SHOTS])
    made = derive.predictions(s, d).select("row_index", evaluation.softmax(logits).alias("p"))
    return tidy(made.select("row_index", *[F.col("p")[i].alias(f"p{i}") for i in range(4)]), 6)


#: Sequence files of clips, in words that Spark and DuckDB share: under the id, under an id of another range, a second
#: take under the same id, an older take under an id of its own, another file of the same id.
_SEQUENCES = {
    "clip_key % 5 <> 2": "CASE WHEN clip_key % 7 = 1 THEN clip_key + 10000000 ELSE clip_key END || '_' || stem || '_sequence.json'",
    "clip_key % 11 = 3": "clip_key || '_other_sequence.json'",
    "clip_key % 13 = 5": "clip_key || '_' || stem || '_take2_sequence.json'",
    "clip_key % 10 = 2": "'x' || clip_key || '_old_' || stem || '_take2_sequence.json'",
}


def _sequence_files(s, d):
    clips = derive.clips(s, d).withColumn("stem", F.regexp_replace("file_name", ".mp4$", ""))
    parts = [clips.where(test).selectExpr(f"{name} AS seq_file") for test, name in _SEQUENCES.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def _matches(s, d):
    named = "CASE WHEN clip_key % 31 = 7 THEN '' ELSE file_name END AS file_name"
    return dataset.match_sequences(derive.clips(s, d).selectExpr("CAST(clip_key AS STRING) AS video_id", named), _sequence_files(s, d))


QUERIES = {
    "a10_tabular_quality": lambda s, d: tidy(features.tabular_quality(_odd_table(s, d), features.CLIP_FEATURES), 3),
    "a10_class_means": lambda s, d: tidy(features.class_means(_odd_table(s, d), features.CLIP_FEATURES), 3),
    "a14_health_advice": lambda s, d: features.health_advice(features.health(features.statistics(pose_queries.frame_table(s, d)))).select("health_status", "features"),
    "a17_distribution_check": lambda s, d: dataset.distribution_check(derive.clips(s, d), 3700),
    "a18_split_audit": lambda s, d: dataset.split_audit(_leaky_split(s, d), "clip_key", "person_id"),
    "a18_split_valid": lambda s, d: dataset.split_audit(_split(s, d), "clip_key", "person_id"),
    "a18_split_overlap": lambda s, d: dataset.split_overlap(_split(s, d), "person_id"),
    "a18_person_counts": lambda s, d: dataset.person_counts(_split(s, d)),
    "a18b_players": lambda s, d: dataset.players(dataset.metadata(derive.clip_files(s, d).select("path"))),
    "a19_split_labels": lambda s, d: dataset.split_labels(_split(s, d)),
    "a22_prediction_counts": lambda s, d: evaluation.prediction_counts(_scored(s, d)),
    "a30_component_means": lambda s, d: tidy(scoring.component_means(scoring.components(pose_queries.scored_deviations(s, d))), 2),
    "a32_feedback_summary": lambda s, d: scoring.feedback_summary(_feedback_made(s, d)),
    "t13_worst_confusions": lambda s, d: evaluation.worst_confusions(evaluation.confusion(_scored(s, d).where("error is null"))),
    "t13_strongest_pairs": lambda s, d: features.strongest_pairs(features.correlations(pose_queries.frame_table(s, d), features.FRAME_FEATURES, 0.95)).select("feature_a", "feature_b"),
    "x3_label_report": lambda s, d: dataset.label_report(derive.clips(s, d).where("shot_label <> 'sweep_shot'"), derive.sessions(s, d).where("predicted_shot is not null").selectExpr("predicted_shot AS shot_label"), SHOTS),
    "j1_match_sequences": _matches,
    "f13_issue_tips": lambda s, d: scoring.issue_tips(scoring.issues(pose_queries.scored_deviations(s, d))).select("clip_id", "rank", "issue", "why", "tip"),
    "f19b_result_details": _details,
    "f20_extract_probabilities": _extracted,
    "f24_softmax": _softmax,
    "f26_text_rules": _texts,
    "f29_mean_accuracy": lambda s, d: tidy(sessions.mean_accuracy(sessions.by_accuracy(_accuracies(s, d), "high"))),
    "st8_retention_sweep": lambda s, d: governance.retention_sweep(derive.sessions(s, d), table_queries._outcomes(s, d).drop("user_id"), F.expr(NOW), 500),
    "st8_dry_run": lambda s, d: governance.retention_sweep(derive.sessions(s, d), table_queries._outcomes(s, d).drop("user_id"), F.expr(NOW), 500, dry_run=True),
}

_CL, _SE, _PR, _SPLIT = derive.CLIPS_SQL, derive.SESSIONS_SQL, derive.PREDICTIONS_SQL, table_queries._SPLIT
_TAB = pose_queries._clip_sql() + f", tb AS (SELECT *, {derive.SHOT.format(k='clip_id')} AS shot FROM cf)"


def _finite_sql(n: str) -> str:
    return f"CASE WHEN {_ODD['NaN']} OR {_ODD['Infinity']} THEN NULL ELSE {n} END" if n == TABULAR[0] else n


def _quality_sql() -> str:
    """The first column has values that aren't finite; none of the others has."""
    made = []
    for n in features.CLIP_FEATURES:
        good = _finite_sql(n)
        nan, infinite = (f"count(*) FILTER ({_ODD['NaN']} OR {n} IS NULL)", f"count(*) FILTER ({_ODD['Infinity']} AND NOT {_ODD['NaN']})") if n == TABULAR[0] else (f"count(*) FILTER ({n} IS NULL)", "0::BIGINT")
        made.append(
            f"SELECT '{n}' AS feature, {nan} AS nan, {infinite} AS infinite, avg({good}) AS mean, CASE WHEN count({good}) > 1 THEN stddev_pop({good}) ELSE 0 END AS std, "
            f"min({good}) AS min, max({good}) AS max, CASE WHEN count({good}) > 1 THEN stddev_pop({good}) ELSE 0 END <= 1e-8 AS zero_variance FROM tb"
        )
    return " UNION ALL ".join(made)


_MEANS = " UNION ALL ".join(f"SELECT shot, count(*) AS n, '{n}' AS feature, avg({_finite_sql(n)}) AS mean FROM tb GROUP BY shot" for n in features.CLIP_FEATURES)
_SHARED = """
hs AS (SELECT person_id, bool_or(split = 'train') AS a, bool_or(split = 'validation') AS b, bool_or(split = 'test') AS c FROM sl GROUP BY 1)"""

# The automaton of shots, a row a frame: old values from the row before, new ones by its state.
_STEP = """
SELECT o.*, en.t AS nt, en.smoothed AS ne,
  CASE o.st
    WHEN 'idle' THEN CASE WHEN en.smoothed >= 0.28 THEN 'preparation' ELSE 'idle' END
    WHEN 'preparation' THEN CASE WHEN en.smoothed < 0.18 THEN 'idle' WHEN o.cnt + 1 >= 2 THEN 'backswing' ELSE o.st END
    WHEN 'backswing' THEN CASE WHEN en.smoothed >= 0.28 OR o.swing + 1 >= 4 THEN 'swing' ELSE o.st END
    WHEN 'swing' THEN CASE WHEN o.swing + 1 >= 4 AND en.smoothed < 0.18 THEN 'follow_through' ELSE o.st END
    WHEN 'follow_through' THEN CASE WHEN en.smoothed <= 0.12 AND o.cnt + 1 >= 4 THEN 'completed' ELSE o.st END
    WHEN 'completed' THEN 'cooldown'
    ELSE CASE WHEN o.cnt - 1 <= 0 AND en.smoothed <= 0.18 THEN 'idle' ELSE o.st END
  END AS nst
FROM sm o JOIN en ON en.clip_id = o.clip_id AND en.t = o.t + 1"""
_MACHINE = pose_queries._EN + f""",
sm AS (
  SELECT clip_id, (-1)::BIGINT AS t, 0e0 AS e, 'idle' AS st, 0 AS cnt, (-1)::BIGINT AS begun, (-1)::BIGINT AS ended, (-1)::BIGINT AS trig,
    0 AS swing, (-1)::BIGINT AS peak, 0e0 AS pe, '' AS tr, false AS fired
  FROM (SELECT DISTINCT clip_id FROM en)
  UNION ALL
  SELECT clip_id, nt, ne, nst,
    CASE st
      WHEN 'idle' THEN CASE WHEN nst <> st THEN 1 ELSE cnt END
      WHEN 'preparation' THEN CASE WHEN nst = 'idle' THEN 0 ELSE cnt + 1 END
      WHEN 'swing' THEN CASE WHEN nst <> st THEN (ne <= 0.12)::INT ELSE cnt END
      WHEN 'follow_through' THEN CASE WHEN ne <= 0.12 THEN cnt + 1 ELSE 0 END
      WHEN 'completed' THEN 8 WHEN 'cooldown' THEN cnt - 1 ELSE cnt
    END,
    CASE WHEN st = 'idle' AND nst <> st THEN nt WHEN st = 'preparation' AND nst = 'idle' THEN -1 ELSE begun END,
    CASE WHEN nst = 'completed' AND st <> nst THEN nt ELSE ended END,
    CASE WHEN nst = 'completed' AND st <> nst AND trig < 0 THEN nt ELSE trig END,
    CASE WHEN st IN ('backswing', 'swing') THEN swing + 1 ELSE swing END,
    CASE WHEN ne > pe THEN nt ELSE peak END, greatest(ne, pe),
    CASE WHEN nst = st THEN '' ELSE st || '_to_' || nst || CASE WHEN st = 'backswing' AND ne < 0.28 THEN '_by_duration' ELSE '' END END,
    nst = 'completed' AND st <> nst AND trig < 0
  FROM ({_STEP})
),
la AS (
  SELECT *, trig < 0 AND begun >= 0 AND st IN ('preparation', 'backswing', 'swing', 'follow_through') AS forced
  FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY t DESC) AS r FROM sm) WHERE r = 1
)"""
_TRACE = """
SELECT clip_id, t AS step, t, e AS energy, st AS state, tr AS transition, fired AS triggered FROM sm WHERE t >= 0
UNION ALL SELECT clip_id, t + 1, t, e, 'completed', 'sequence_end_to_completed', true FROM la WHERE forced"""
_FOUND = """
SELECT la.clip_id, CASE WHEN whole THEN begun END AS start_frame, CASE WHEN whole THEN CASE WHEN forced THEN t ELSE nullif(ended, -1) END END AS end_frame,
  CASE WHEN whole THEN nullif(peak, -1) END AS peak_frame, CASE WHEN whole THEN CASE WHEN forced THEN t ELSE trig END END AS trigger_frame,
  fires + forced::INT AS trigger_count,
  CASE WHEN forced THEN 'sequence_end_completion' WHEN fires > 0 THEN 'stabilized_follow_through' ELSE 'no_shot_detected' END AS completion_reason,
  max_energy, mean_energy
FROM (SELECT *, begun >= 0 AND (trig >= 0 OR forced) AS whole FROM la) la
JOIN (SELECT clip_id, count(*) FILTER (fired) AS fires, max(e) AS max_energy, avg(e) AS mean_energy FROM sm WHERE t >= 0 GROUP BY clip_id) USING (clip_id)"""

# A key's requests one by one; the list holds the times of those allowed within the window.
_SLIDING = """
WITH RECURSIVE rq AS (SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
wl AS (
  SELECT event_id, user_id, r, [us] AS held, true AS allowed FROM rq WHERE r = 1
  UNION ALL
  SELECT event_id, user_id, r, CASE WHEN len(kept) < 3 THEN list_append(kept, us) ELSE kept END, len(kept) < 3
  FROM (SELECT rq.*, list_filter(wl.held, lambda x: rq.us - x <= 86400000000) AS kept FROM wl JOIN rq ON rq.user_id = wl.user_id AND rq.r = wl.r + 1)
)
SELECT event_id AS request_id, user_id AS key, allowed FROM wl"""

# Groups one by one, largest first, each to the split that lacks most.
_PLAYERS = f"""
WITH RECURSIVE {_CL}, gs AS (SELECT person_id, count(*) AS n, md5('42|' || person_id) AS o FROM clips GROUP BY 1),
gn AS (SELECT *, row_number() OVER (ORDER BY n DESC, o) AS k FROM gs),
gr AS (
  SELECT 0::BIGINT AS k, 0::BIGINT AS a, 0::BIGINT AS b, 0::BIGINT AS c, '' AS person_id, '' AS split
  UNION ALL
  SELECT k, a + CASE WHEN s = 'train' THEN n ELSE 0 END, b + CASE WHEN s = 'validation' THEN n ELSE 0 END, c + CASE WHEN s = 'test' THEN n ELSE 0 END, person_id, s
  FROM (
    SELECT gn.k, a, b, c, gn.n, gn.person_id,
      CASE WHEN x >= y AND x >= z THEN 'train' WHEN y >= z THEN 'validation' ELSE 'test' END AS s
    FROM (SELECT *, 700000 * t - 1000000 * a AS x, 150000 * t - 1000000 * b AS y, 150000 * t - 1000000 * c AS z FROM gr, (SELECT count(*) AS t FROM clips)) q
    JOIN gn ON gn.k = q.k + 1
  )
)
SELECT split, sum(n)::BIGINT AS samples, count(*) AS groups, 0::BIGINT AS shared_groups FROM gr JOIN gn USING (k) GROUP BY split"""

_EXPO = """
WITH ms AS (SELECT 'http_' || event_type AS name, event_type = 'error' AS counter, 'code="x' || (user_id % 3)::VARCHAR || '"' AS labels, count(*) AS n, sum(floor(value) * 64.25::DOUBLE) AS total FROM events GROUP BY ALL)
SELECT name, labels, 0 AS place, CASE WHEN counter THEN name || '_total{' || labels || '} ' || printf('%g', total) ELSE name || '_seconds_count{' || labels || '} ' || n::VARCHAR END AS line FROM ms
UNION ALL SELECT name, labels, 1, name || '_seconds_sum{' || labels || '} ' || printf('%.6f', total) FROM ms WHERE NOT counter"""

_WORDS = "replace(replace({c}, '_score', ''), '_', ' ')"
def _told(part: int) -> str:
    """a feature's text, else what its component says."""
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    own = " ".join(f"WHEN '{f}' THEN {quoted(t[part])}" for f, t in texts.FEATURES.items())
    label = _WORDS.format(c="component")
    side = "CASE WHEN value < low THEN 'below' WHEN value > high THEN 'above' ELSE 'inside' END"
    general = {
        0: f"'The ' || {label} || ' lies ' || {side} || ' the usual range.'", 1: f"upper({label}[1]) || {label}[2:] || ' makes a shot repeatable.'",
        2: "CASE component " + " ".join(f"WHEN '{c}' THEN {quoted(t)}" for c, t in texts.COMPONENTS.items()) + " END",
    }[part]
    return f"CASE feature {own} ELSE {general} END"


_ISSUES = pose_queries._DEV + """,
o3 AS (SELECT *, row_number() OVER (PARTITION BY clip_id, feature ORDER BY score, deviation DESC, spec_pos) AS a FROM dv WHERE score < 75),
k3 AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY score, deviation DESC, spec_pos) AS rank FROM o3 WHERE a = 1)"""
_FEEDBACK = _ISSUES + f""",
tp AS (SELECT clip_id, count(*) AS n, arg_min({_told(2)}, rank) AS tip FROM k3 WHERE rank <= 3 GROUP BY clip_id),
fb1 AS (
  SELECT sc.clip_id, coalesce(n, 0)::INT AS issue_count, replace(shot, '_', ' ') AS name, technique_score AS x,
    CASE WHEN technique_score >= 90 THEN 'strong' WHEN technique_score >= 75 THEN 'solid' WHEN technique_score >= 60 THEN 'needs attention' ELSE 'priority issue' END AS band,
    coalesce(tip, 'Keep up your ' || {_WORDS.format(c="weakest")} || '.') AS first
  FROM sc LEFT JOIN tp ON sc.clip_id = tp.clip_id
), fe AS (
  SELECT clip_id, issue_count, band, name || ': technique ' || printf('%.1f', x) || ' of 100 (' || band || '), ' || issue_count::VARCHAR || ' issue(s). ' || first AS detailed,
    CASE WHEN issue_count = 0 AND x >= 85 THEN 'Great ' || name || '.' ELSE 'Your ' || name || ' scored ' || printf('%.0f', x) || '. ' || first END AS spoken
  FROM fb1
)"""
_EXTRACT = f"""
WITH {_PR}, x AS (SELECT row_index, row_index % 5 AS place, round(q0, 1) AS a, round(q2, 1) AS b, q0, q2 FROM raw)
SELECT row_index, CASE WHEN place < 3 THEN a WHEN place = 3 THEN q0 END AS first, CASE WHEN place < 3 THEN b WHEN place = 3 THEN q2 END AS second,
  CASE WHEN place = 4 THEN 'missing_probabilities' END AS extraction_error
FROM x"""
_SOFT = _PR + ", ex AS (SELECT row_index, " + ", ".join(f"exp(q{i} - greatest(q0, q1, q2, q3)) AS e{i}" for i in range(4)) + " FROM raw)"
_DUE = f"storage_status IN ('stored', 'deletion_pending') AND try_cast(retention_expires_at AS TIMESTAMP) <= {NOW}"
_BATCH = f"{_SE}, ba AS (SELECT * FROM se WHERE {_DUE} ORDER BY retention_expires_at, id LIMIT 500)"
_SWEPT = f"CASE WHEN id % 4 = 1 THEN 'no_outcome' ELSE {table_queries.OUTCOME} END"
_MATCH = f"""
WITH {_CL}, cs AS (SELECT *, replace(file_name, '.mp4', '') AS stem FROM clips),
sq AS ({" UNION ALL ".join(f"SELECT {name} AS seq_file FROM cs WHERE {test}" for test, name in _SEQUENCES.items())}),
sf AS (SELECT seq_file, CASE WHEN regexp_full_match(split_part(seq_file, '_', 1), '\\d+') THEN printf('%03d', split_part(seq_file, '_', 1)::BIGINT) ELSE split_part(seq_file, '_', 1) END AS fid, regexp_replace(seq_file, '\\.[^.]*$', '') AS own FROM sq),
me AS (SELECT clip_key::VARCHAR AS video_id, printf('%03d', clip_key) AS vid, CASE WHEN clip_key % 31 = 7 THEN '' ELSE file_name END AS file_name, CASE WHEN clip_key % 31 = 7 THEN '' ELSE stem END AS stem FROM cs),
bi AS (
  SELECT video_id, file_name, stem, count(seq_file) AS n, count(*) FILTER (stem <> '' AND contains(seq_file, stem)) AS held, min(seq_file) AS any_file,
    min(seq_file) FILTER (stem <> '' AND contains(seq_file, stem)) AS one, max(seq_file) FILTER (seq_file = vid || '_' || stem || '_sequence.json') AS named
  FROM me LEFT JOIN sf ON fid = vid GROUP BY ALL
), bs AS (SELECT stem, count(*) AS hits, min(seq_file) AS fallback FROM (SELECT DISTINCT stem FROM bi WHERE n = 0 AND stem <> '') JOIN sf ON contains(own, stem) GROUP BY stem),
mt AS (SELECT bi.*, hits, CASE WHEN n = 1 THEN any_file WHEN held = 1 THEN one WHEN n > 1 THEN named WHEN n = 0 AND hits = 1 THEN fallback END AS seq_file FROM bi LEFT JOIN bs ON bs.stem = bi.stem AND n = 0)
SELECT video_id, file_name, CASE WHEN seq_file IS NOT NULL THEN 'matched' WHEN n > 1 OR hits > 1 THEN 'ambiguous' ELSE 'missing' END AS status, seq_file FROM mt"""

ORACLE = {
    "a10_tabular_quality": tidy_sql(_TAB, _quality_sql(), ["feature", "nan", "infinite", "zero_variance"], ["mean", "std", "min", "max"], 3),
    "a10_class_means": tidy_sql(_TAB, _MEANS, ["shot", "n", "feature"], ["mean"], 3),
    "a14_health_advice": f"WITH {pose_queries._FS} SELECT health_status, count(*) AS features FROM he GROUP BY ALL",
    "a17_distribution_check": f"WITH {_CL} SELECT shot_label, count(*) AS n, 3700 AS expected FROM clips GROUP BY 1 HAVING count(*) <> 3700",
    "a18_split_audit": f"""
WITH {_SPLIT}, lk AS (SELECT clip_key, person_id, split FROM sl UNION ALL SELECT clip_key, person_id, 'holdout' FROM sl WHERE clip_key % 37 = 1),
n AS (SELECT (SELECT count(*) FROM (SELECT clip_key FROM lk GROUP BY 1 HAVING count(DISTINCT split) > 1)) AS leaked_samples, (SELECT count(*) FROM (SELECT person_id FROM lk GROUP BY 1 HAVING count(DISTINCT split) > 1)) AS shared_groups)
SELECT *, CASE WHEN leaked_samples > 0 THEN 'leakage' WHEN shared_groups > 0 THEN 'valid_not_disjoint' ELSE 'valid_disjoint' END AS verdict FROM n""",
    "a18_split_valid": f"""
WITH {_SPLIT},{_SHARED}, n AS (SELECT (SELECT count(*) FROM (SELECT clip_key FROM sl GROUP BY 1 HAVING count(DISTINCT split) > 1)) AS leaked_samples, count(*) FILTER (a::INT + b::INT + c::INT > 1) AS shared_groups FROM hs)
SELECT *, CASE WHEN leaked_samples > 0 THEN 'leakage' WHEN shared_groups > 0 THEN 'valid_not_disjoint' ELSE 'valid_disjoint' END AS verdict FROM n""",
    "a18_split_overlap": f"""
WITH {_SPLIT},{_SHARED}, p AS (
  SELECT 'train_vs_validation' AS pair, count(*) FILTER (a AND b) AS shared FROM hs
  UNION ALL SELECT 'train_vs_test', count(*) FILTER (a AND c) FROM hs
  UNION ALL SELECT 'validation_vs_test', count(*) FILTER (b AND c) FROM hs)
SELECT *, shared = 0 AS disjoint FROM p""",
    "a18_person_counts": f"WITH {_SPLIT} SELECT split, person_id, shot_label, count(*) AS n FROM sl GROUP BY GROUPING SETS ((split, person_id), (split, person_id, shot_label))",
    "a18b_players": f"WITH {{p1}} SELECT person_id, count(*) AS samples FROM p1 WHERE use_for_v1 = 'yes' GROUP BY 1".format(p1=f"p1 AS ({table_queries.ORACLE['p1_metadata']})"),
    "a19_split_labels": f"WITH {_SPLIT} SELECT split, shot_label AS label, count(*) AS n FROM sl GROUP BY ALL",
    "a22_prediction_counts": f"WITH {_PR} SELECT predicted_label, count(*) AS n FROM sc GROUP BY 1",
    "a30_component_means": tidy_sql(pose_queries._DEV, "SELECT component, avg(score) AS mean_score, min(score) AS min_score, max(score) AS max_score, count(*) FILTER (score NOT BETWEEN 0 AND 100) AS outside FROM co GROUP BY component", ["component", "outside"], ["mean_score", "min_score", "max_score"], 2),
    "a32_feedback_summary": f"WITH {_FEEDBACK} SELECT count(*) AS samples, sum(issue_count)::BIGINT AS issues, count(*) FILTER (trim(spoken) <> '') AS with_spoken, bool_and(trim(spoken) <> '') AS spoken_present, bool_and(trim(detailed) <> '') AS detailed_present FROM fe",
    "f14_feedback": f"WITH {_FEEDBACK} SELECT clip_id, issue_count, band, detailed, spoken FROM fe",
    "f13_issue_tips": f"WITH {_ISSUES} SELECT clip_id, rank::INT AS rank, {_told(0)} AS issue, {_told(1)} AS why, {_told(2)} AS tip FROM k3 WHERE rank <= 3",
    "t13_worst_confusions": f"WITH {table_queries._CM} SELECT true_label, predicted_label, n, row_number() OVER (ORDER BY n DESC, true_label DESC, predicted_label DESC)::INT AS rank FROM cm WHERE true_label <> predicted_label AND n > 0 QUALIFY rank <= 10",
    "t13_strongest_pairs": pose_queries.ORACLE["a13_correlations"].replace("SELECT feature_a, feature_b, round(r, 3) + 0.0 AS r FROM", "SELECT feature_a, feature_b FROM"),
    "x3_label_report": f"""
WITH {_CL}, {_SE}, kn(label) AS (VALUES {", ".join(f"('{x}')" for x in SHOTS)})
SELECT DISTINCT predicted_shot AS label, 'unknown' AS problem FROM se WHERE predicted_shot IS NOT NULL AND predicted_shot NOT IN (SELECT label FROM kn)
UNION ALL SELECT label, 'unseen' FROM kn WHERE label NOT IN (SELECT shot_label FROM clips WHERE shot_label <> 'sweep_shot')""",
    "j1_match_sequences": _MATCH,
    "f19b_result_details": "SELECT o_orderkey AS id, o_orderkey % 3 = 0 AS has_voice, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE 2 END AS landmarks, CASE WHEN o_orderkey % 4 = 0 THEN 0e0 ELSE (o_orderkey % 7 + 5 + 1 + 20 + 25)::DOUBLE END AS total FROM orders",
    "f20_extract_probabilities": tidy_sql("x0 AS (SELECT 1)", _EXTRACT.strip(), ["row_index", "extraction_error"], ["first", "second"], 6),
    "f24_softmax": tidy_sql(_SOFT, "SELECT row_index, " + ", ".join(f"e{i} / (e0 + e1 + e2 + e3) AS p{i}" for i in range(4)) + " FROM ex", ["row_index"], [f"p{i}" for i in range(4)], 6),
    "f26_text_rules": """
SELECT o_orderkey AS id, CASE WHEN length('a ' || o_orderpriority) <= 12 THEN 'a ' || o_orderpriority END AS cleaned,
  CASE o_orderkey % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN NULL ELSE true END AS flag,
  strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') AS deadline, sha256('  a ' || chr(9) || o_orderpriority || '  ') AS hash
FROM orders""",
    "f29_mean_accuracy": tidy_sql(_SE, "SELECT count(technique_match_score) AS known, round(avg(technique_match_score), 1) AS mean_accuracy FROM se WHERE technique_match_score >= 75", ["known"], ["mean_accuracy"]),
    "st8_retention_sweep": f"""
WITH {_BATCH}, o AS (SELECT id, {_SWEPT} AS status FROM ba)
SELECT id, status, CASE WHEN status IN ('deleted', 'already_deleted', 'not_found') THEN 'deleted' ELSE 'deletion_pending' END AS storage_status,
  CASE WHEN status NOT IN ('deleted', 'already_deleted', 'not_found') THEN status END AS error_code
FROM o""",
    "st8_dry_run": f"WITH {_BATCH} SELECT id, 'dry_run' AS status, storage_status, NULL::VARCHAR AS error_code FROM ba",
    "st1_state_trace": tidy_sql(_MACHINE, _TRACE, ["clip_id", "step", "t", "state", "transition", "triggered"], ["energy"]).replace("WITH ", "WITH RECURSIVE ", 1),
    "st3_segments": tidy_sql(_MACHINE, _FOUND, ["clip_id", "start_frame", "end_frame", "peak_frame", "trigger_frame", "trigger_count", "completion_reason"], ["max_energy", "mean_energy"]).replace("WITH ", "WITH RECURSIVE ", 1),
    "a31_segmentation_summary": f"WITH RECURSIVE {_MACHINE}, fo AS ({_FOUND}) SELECT count(*) AS sequences, count(trigger_frame) AS detected, count(*) FILTER (trigger_count = 1) AS single_trigger, count(*) FILTER (completion_reason = 'sequence_end_completion') AS forced, count(trigger_frame) = count(*) AND count(*) FILTER (trigger_count = 1) = count(*) AS passed FROM fo",
    "w15_sliding_window": _SLIDING,
    "g4_player_split": _PLAYERS,
    "s12_exposition": _EXPO,
}
