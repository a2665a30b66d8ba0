"""Queries over pose frames: preparation, features, segmentation, technique scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.functions.labels import SHOTS
from kinelake.operators import features as feat
from kinelake.operators import dataset, pose, scoring, segmentation
from kinelake.plans import derive
from kinelake.session import settle

USED = (0, 11, 12, 13, 14, 15, 16, 23, 24, 25, 26, 27, 28)


def tidy(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round doubles, so that results compare across engines; no negative zero."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def tidy_sql(ctes: str, body: str, keys: list[str], doubles: list[str], digits: int = 4) -> str:
    shown = ", ".join([*keys, *[f"round({c}, {digits}) + 0.0 AS {c}" for c in doubles]])
    return f"WITH {ctes} SELECT {shown} FROM ({body})"


def prepared(spark: SparkSession, sf_dir: str, length: int = 60) -> DataFrame:
    """The points that features use of cleaned, normalised, aligned and resampled frames, in this order."""
    # Renumbered as points: the window sorts them, not the landmark arrays.
    points = pose.renumber(feat.prepared_points(pose.visible(derive.frames(spark, sf_dir)), "clip_id", "pos"))
    return pose.resample(points, length)


def frame_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feat.frame_features(prepared(spark, sf_dir))


def clip_shots(table: DataFrame) -> DataFrame:
    """Class and quality of clips, by their number."""
    return table.select("clip_id").distinct().selectExpr("clip_id", f"{derive.SHOT.format(k='clip_id')} AS shot", f"{derive.QUALITY.format(k='(clip_id * 7)')} AS quality")


def scored_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = settle(scoring.clip_statistics(frame_table(spark, sf_dir)))
    clips = clip_shots(stats)
    template = scoring.templates(stats, scoring.training_clips(clips))
    return scoring.deviations(stats, clips, template)


def analyse_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: frames to features, technique score, weakest and strongest components of each clip."""
    return scoring.scores(scoring.components(scored_deviations(spark, sf_dir)))


def _feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    devs = scored_deviations(spark, sf_dir)
    return scoring.feedback(scoring.scores(scoring.components(devs)), scoring.issues(devs))


def _energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentation.motion_energy(frame_table(spark, sf_dir))


def _scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = frame_table(spark, sf_dir)
    names = ["lead_elbow_angle", "stance_width", "frame_motion_energy"]
    train = table.where(F.col("clip_id") % 5 < 3)
    return tidy(feat.scale(table.select("clip_id", "t", *names), feat.fit_scaler(train, names), names).select("clip_id", "t", *[F.col(n).cast("double").alias(n) for n in names]), 3)


#: Flaws of frames, in words that Spark and DuckDB share: too few landmarks to normalise, or to align, a hip or a
#: shoulder that isn't there, shoulders that lie on the hips.
FLAWS = {"few": "pos % 11 = 3", "fewer": "pos % 11 = 5", "hipless": "pos % 11 = 7", "flat": "pos % 11 = 9", "lame": "pos % 13 = 4"}


def flawed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned frames, some of them with flaws."""
    whole = derive.cleaned(spark, sf_dir)
    kind = whole.schema["landmarks"].dataType

    def spoilt(landmarks: pa.Array, flaws: pa.Array) -> pa.Array:
        held = pose.Marks(landmarks)
        is_so = {name: flaws.field(name).to_numpy(zero_copy_only=False) for name in FLAWS}
        here = {name: mask[held.frame] for name, mask in is_so.items()}
        gone = pa.array((here["hipless"] & (held.place == 23)) | (here["lame"] & (held.place == 11)))
        source = np.arange(len(held.place)) + np.where(here["flat"] & np.isin(held.place, (11, 12)), 12, 0)
        x, y, z = (held.part(c).take(pa.array(source)) for c in "xyz")
        made = pa.StructArray.from_arrays([pc.if_else(gone, float("nan"), x), y, z, held.part("visibility")], ["x", "y", "z", "visibility"])
        most = np.where(is_so["fewer"], 10, np.where(is_so["few"], 20, derive.LANDMARKS))
        return held.listed(made.filter(pa.array(held.place < most[held.frame])), np.cumsum(np.minimum(held.sizes, most)))

    flaws = F.struct(*[F.expr(test).alias(name) for name, test in FLAWS.items()])
    return whole.withColumn("landmarks", F.arrow_udf(spoilt, kind).asNondeterministic()("landmarks", flaws))


def _mark(place: int, part: str):
    return F.get("landmarks", F.lit(place))[part]


QUERIES = {
    "analyse_clips": lambda s, d: tidy(analyse_clips(s, d), 2),
    "p3_flatten_inspect": lambda s, d: tidy(pose.inspect(pose.flatten(derive.documents(s, d)))),
    "a2_normalising_counts": lambda s, d: pose.step_counts(pose.normalise(flawed(s, d))),
    "a2_aligning_counts": lambda s, d: pose.step_counts(pose.align(flawed(s, d))),
    "a1b_inspection_summary": lambda s, d: tidy(pose.inspection_summary(pose.inspect(derive.frames(s, d)))),
    "p3b_sample_frames": lambda s, d: tidy(pose.sample_frames(derive.frames(s, d), 3, F.lit(30.0)).select("clip_id", "frame_index", "ts")),
    "p5_clean_counts": lambda s, d: pose.cleaning_counts(derive.frames(s, d)),
    "p6_normalise": lambda s, d: tidy(pose.normalise(flawed(s, d)).select("clip_id", "pos", "ok", _mark(0, "x").alias("nose_x"), _mark(28, "y").alias("ankle_y"), _mark(20, "z").alias("z20"))),
    "p6b_normalise_fallback": lambda s, d: tidy(pose.normalise(flawed(s, d), fallback=True).select("clip_id", "pos", "ok", _mark(27, "x").alias("ankle_x"))),
    "p6c_interpolate": lambda s, d: tidy(pose.interpolate(derive.frames(s, d)).select("clip_id", "pos", F.col("landmarks")[15]["x"].alias("wrist_x"), F.col("landmarks")[16]["x"].alias("other_x")), 6),
    "p7_align": lambda s, d: tidy(pose.align(flawed(s, d)).select("clip_id", "pos", "ok", _mark(0, "x").alias("nose_x"), _mark(0, "y").alias("nose_y"))),
    "p8_resample": lambda s, d: pose.resample(derive.cleaned(s, d), 60).select("clip_id", "t", "source_pos", "frame_index"),
    "p19_verify": lambda s, d: pose.verify(derive.frames(s, d)),
    "t8_overlay_frame": lambda s, d: tidy(pose.overlay_frame(derive.frames(s, d))),
    "f8_frame_features": lambda s, d: tidy(frame_table(s, d), 3),
    "a9_clip_features": lambda s, d: tidy(feat.clip_features(derive.cleaned(s, d)), 3),
    "a11_feature_statistics": lambda s, d: tidy(feat.health(feat.statistics(frame_table(s, d))), 3),
    "a11_class_statistics": lambda s, d: tidy(feat.class_statistics(frame_table(s, d).withColumn("shot", F.expr(derive.SHOT.format(k="clip_id")))), 3),
    "a13_correlations": lambda s, d: tidy(feat.correlations(frame_table(s, d), feat.FRAME_FEATURES, 0.95), 3),
    "a14_health_summary": lambda s, d: feat.health_summary(feat.health(feat.statistics(frame_table(s, d)))),
    "a15_scaler": _scaled,
    "p20_clip_checks": lambda s, d: pose_checks(s, d),
    "w8_motion_energy": lambda s, d: tidy(_energy(s, d), 3),
    "st1_state_trace": lambda s, d: tidy(segmentation.trace(_energy(s, d))),
    "st3_segments": lambda s, d: tidy(segmentation.segments(_energy(s, d))),
    "a31_segmentation_summary": lambda s, d: segmentation.segmentation_summary(segmentation.segments(_energy(s, d))),
    "a27_clip_statistics": lambda s, d: tidy(scoring.clip_statistics(frame_table(s, d)), 3),
    "a28_templates": lambda s, d: tidy(scoring.templates(*(lambda st: (st, scoring.training_clips(clip_shots(st))))(scoring.clip_statistics(frame_table(s, d)))), 3),
    "j5_deviations": lambda s, d: tidy(scored_deviations(s, d).select("clip_id", "shot", "component", "feature", "statistic", "score"), 2),
    "a29_components": lambda s, d: tidy(scoring.components(scored_deviations(s, d)).select("clip_id", "component", "score"), 2),
    "a30_score_summary": lambda s, d: tidy(scoring.score_summary(analyse_clips(s, d)), 2),
    "t1_worst_deviations": lambda s, d: scoring.worst_deviations(scored_deviations(s, d)),
    "t2_recommendations": lambda s, d: scoring.recommendations(scoring.components(scored_deviations(s, d))),
    "t3_issues": lambda s, d: scoring.issues(scored_deviations(s, d)),
    "f14_feedback": _feedback,
}


def pose_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with gaps: of some clips the last ones are cut off, of some one value is infinite."""
    table = frame_table(spark, sf_dir).where("NOT (clip_id % 7 = 2 AND t >= 55) AND NOT (clip_id % 7 = 4 AND t = 0)")
    broken = F.when(F.expr("clip_id % 5 = 1 AND t % 20 = 3"), float("inf")).otherwise(F.col("stance_width"))
    return dataset.clip_checks(table.withColumn("stance_width", broken), feat.FRAME_FEATURES)


# ---- comparison SQL: the same chain on the thirteen points that features use ----

_POINTS = ", ".join(derive.point_sql(k) for k in USED)
_AXES = [f"{a}{k}" for k in USED for a in "xyz"]
_CLEAN = f"""{derive.FRAMES_SQL},
cl AS (SELECT clip_id, e, row_number() OVER (PARTITION BY clip_id ORDER BY pos) - 1 AS pos, pos AS frame_index, blank, vis FROM fr WHERE NOT blank AND vis >= 0.3),
pt AS (SELECT *, {_POINTS} FROM cl)"""
#: The flaws of ``flawed``, and the points that they leave.
_SPOILT = _CLEAN + f""",
fl AS (SELECT *, {", ".join(f"{test} AS {name}" for name, test in FLAWS.items())} FROM pt),
sp AS (
  SELECT * REPLACE ({", ".join(f"CASE WHEN lame AND {k} = 11 THEN NULL WHEN flat THEN {c}{k + 12} ELSE {c}{k} END AS {c}{k}" for k in (11, 12) for c in "xyz")},
    {", ".join(f"CASE WHEN hipless THEN NULL ELSE {c}23 END AS {c}23" for c in "xyz")}),
    CASE WHEN few OR fewer THEN NULL ELSE ({derive.Z.format(k=20)})::DOUBLE END AS raw20, CASE WHEN few OR fewer THEN NULL ELSE y28 END AS raw28, CASE WHEN few OR fewer THEN NULL ELSE x27 END AS raw27,
    list_transform(range(0, {derive.LANDMARKS}), lambda k: CASE WHEN flat AND k IN (11, 12) THEN {derive.Y.format(k="k + 12")} ELSE {derive.Y.format(k="k")} END) AS ys
  FROM fl
), sh AS (SELECT *, (x23 + x24) / 2 AS hx, (y23 + y24) / 2 AS hy, (z23 + z24) / 2 AS hz FROM sp),
su AS (SELECT *, sqrt(((x11 + x12) / 2 - hx) ** 2 + ((y11 + y12) / 2 - hy) ** 2 + ((z11 + z12) / 2 - hz) ** 2) AS torso, list_max(ys) - list_min(ys) AS extent FROM sh)"""
_NORM = _CLEAN + f""",
hp AS (SELECT *, (x23 + x24) / 2 AS hx, (y23 + y24) / 2 AS hy, (z23 + z24) / 2 AS hz FROM pt),
un AS (SELECT *, sqrt(((x11 + x12) / 2 - hx) ** 2 + ((y11 + y12) / 2 - hy) ** 2 + ((z11 + z12) / 2 - hz) ** 2) AS unit FROM hp),
nm AS (SELECT clip_id, e, pos, frame_index, {", ".join(f"({a} - h{a[0]}) / unit AS {a}" for a in _AXES)} FROM un)"""
_READY = _NORM + f""",
an AS (SELECT *, -atan2(y12 - y11, x12 - x11) AS turn FROM nm),
al AS (SELECT clip_id, pos, {", ".join(f"x{k} * cos(turn) - y{k} * sin(turn) AS x{k}, x{k} * sin(turn) + y{k} * cos(turn) AS y{k}, z{k}" for k in USED)} FROM an),
nn AS (SELECT clip_id, count(*) AS n FROM al GROUP BY clip_id),
tt AS (SELECT clip_id, t, CASE WHEN n = 60 THEN t ELSE floor(t * (n - 1) / 59.0)::BIGINT END AS pos FROM nn, range(0, 60) r(t)),
rs AS (SELECT tt.t, al.* FROM tt JOIN al ON tt.clip_id = al.clip_id AND tt.pos = al.pos)"""


def _angle(a: str, v: str, b: str) -> str:
    """Degrees at v between points a and b."""
    u, w = [f"({c}{a} - {c}{v})" for c in "xyz"], [f"({c}{b} - {c}{v})" for c in "xyz"]
    return _between(u, w)


def _between(u: list[str], w: list[str]) -> str:
    dot = " + ".join(f"{p} * {q}" for p, q in zip(u, w, strict=True))
    size = "sqrt(" + " + ".join(f"{p} * {p}" for p in u) + ") * sqrt(" + " + ".join(f"{q} * {q}" for q in w) + ")"
    return f"degrees(acos(greatest(-1.0, least(1.0, ({dot}) / CASE WHEN {size} > 1e-12 THEN {size} END))))"


def _dist(a: str, b: str, axes: str = "xyz", pre: str = "") -> str:
    return "sqrt(" + " + ".join(f"({c}{a} - {pre}{c}{b}) ** 2" for c in axes) + ")"


_MIDS = ", ".join(f"({c}23 + {c}24) / 2 AS {c}H, ({c}11 + {c}12) / 2 AS {c}S, (({c}23 + {c}24) / 2 + ({c}11 + {c}12) / 2) / 2 AS {c}B" for c in "xyz")
_FRAME = _READY + f""",
md AS (SELECT *, {_MIDS} FROM rs),
lg AS (SELECT *, {", ".join(f"lag({c}{k}) OVER w AS p{c}{k}" for k in (*range(11, 17), 23, 24, 25, 26, 'B') for c in "xyz")} FROM md WINDOW w AS (PARTITION BY clip_id ORDER BY t)),
stp AS (SELECT *, {", ".join(f"coalesce({_dist(str(k), str(k), pre='p')}, 0) AS s{k}" for k in (*range(11, 17), 23, 24, 25, 26))},
  degrees(atan2(y24 - y23, x24 - x23)) AS hd, degrees(atan2(py24 - py23, px24 - px23)) AS phd FROM lg)"""
_FORMULAS = {
    "lead_elbow_angle": _angle("11", "13", "15"), "trail_elbow_angle": _angle("12", "14", "16"), "lead_knee_angle": _angle("23", "25", "27"), "trail_knee_angle": _angle("24", "26", "28"),
    "lead_shoulder_angle": _angle("13", "11", "23"), "trail_shoulder_angle": _angle("14", "12", "24"), "lead_wrist_relative_x": "x15 - xH", "hip_rotation_angle": "hd",
    "trunk_lean": _between(["(xS - xH)", "(yS - yH)", "(zS - zH)"], ["0.0", "(-1.0)", "0.0"]), "head_over_base_offset": "x0 - xH", "head_to_lead_knee_alignment": "x0 - x25",
    "shoulder_hip_separation": "degrees(atan2(y12 - y11, x12 - x11)) - hd", "stance_width": _dist("27", "28", "xy"), "body_center_offset_x": "xB - xH", "body_center_offset_y": "yB - yH", "upper_body_balance_offset": "xS - xH",
    "lead_wrist_velocity": "s15", "trail_wrist_velocity": "s16", "lead_elbow_velocity": "s13", "trail_elbow_velocity": "s14", "body_center_velocity": _dist("B", "B", pre="p"),
    "lead_wrist_acceleration": "abs(s15 - s16)", "hip_rotation_velocity": "abs(hd - phd - 360 * floor((hd - phd + 180) / 360))", "frame_motion_energy": "s15 + s16 + s13 + s14 + s11 + s12 + s23 + s24 + s25 + s26",
    "front_foot_commitment_signal": "x27 - xH", "back_foot_loading_signal": "0.5 * (y28 - y24)", "weight_transfer_signal": "xB - pxB", "follow_through_height_signal": "y15 - yS", "follow_through_extension_signal": _dist("15", "11"),
    "lead_elbow_extension_signal": f"({_angle('11', '13', '15')}) / 180.0", "bat_side_wrist_height_signal": "y16 - yS", "stance_to_swing_progress_signal": "t / 59.0",
}
_FF = _FRAME + f""",
ff AS (SELECT clip_id, t, {", ".join(f"coalesce({f}, 0.0) AS {n}" for n, f in _FORMULAS.items())} FROM stp)"""

_STATS = {"mean": "avg({f})", "abs_mean": "avg(abs({f}))", "max_abs": "max(abs({f}))", "range": "max({f}) - min({f})", "final_mean": "avg({f}) FILTER (t >= 40)"}
_PAIRS = sorted({p for _, ps in scoring.COMPONENTS.values() for p in ps})
_CS = _FF + ",\ncs AS (" + " UNION ALL ".join(f"SELECT clip_id, '{f}' AS feature, '{s}' AS statistic, {_STATS[s].format(f=f)} AS value FROM ff GROUP BY clip_id" for f, s in _PAIRS) + ")"
_SPECS = "sp(component, weight, comp_pos, spec_pos, feature, statistic) AS (VALUES " + ", ".join(f"('{c}', {w}, {i}, {10 * i + j}, '{f}', '{s}')" for i, (c, (w, ps)) in enumerate(scoring.COMPONENTS.items()) for j, (f, s) in enumerate(ps)) + ")"
_DEV = _CS + f""",
{_SPECS},
ck AS (SELECT DISTINCT clip_id, {derive.SHOT.format(k='clip_id')} AS shot, {derive.QUALITY.format(k='(clip_id * 7)')} AS quality FROM cs),
tr AS (SELECT * FROM (SELECT *, count(*) FILTER (quality = 'good') OVER (PARTITION BY shot) AS g FROM ck) WHERE g < 3 OR quality = 'good'),
tq AS (SELECT shot, feature, statistic, quantile_cont(value, 0.1) AS a, quantile_cont(value, 0.5) AS center, quantile_cont(value, 0.9) AS b, stddev_pop(value) AS std, count(*) AS n FROM cs JOIN tr USING (clip_id) GROUP BY ALL HAVING count(*) >= 3),
te AS (SELECT shot, feature, statistic, CASE WHEN b - a < 1e-6 THEN center - greatest(abs(center) * 0.05, 1e-6) ELSE a END AS low, CASE WHEN b - a < 1e-6 THEN center + greatest(abs(center) * 0.05, 1e-6) ELSE b END AS high, center, std, n FROM tq),
dv AS (
  SELECT *, greatest(0.0, (1.0 - deviation / (greatest(high - low, 1e-6) * 2.0)) * 100.0) AS score
  FROM (SELECT clip_id, shot, feature, statistic, component, weight, comp_pos, spec_pos, value, low, high, CASE WHEN value < low THEN low - value WHEN value > high THEN value - high ELSE 0.0 END AS deviation
        FROM cs JOIN ck USING (clip_id) JOIN te USING (shot, feature, statistic) JOIN sp USING (feature, statistic))
), co AS (SELECT clip_id, shot, component, weight, comp_pos, avg(score) AS score FROM dv GROUP BY ALL),
sc AS (
  SELECT clip_id, shot, round(sum(weight * score), 4) AS technique_score, arg_min(component, score * 1000000000 + comp_pos) AS weakest,
    array_to_string((list(component ORDER BY score DESC, comp_pos))[1:2], ',') AS strongest_two, array_to_string((list(component ORDER BY score, comp_pos))[1:2], ',') AS weakest_two
  FROM co GROUP BY ALL
)"""
_EN = _FF + f""",
rw AS (SELECT clip_id, t, {" + ".join(f"abs({n}) * {w}" for n, w in segmentation.MOTION_WEIGHTS.items())} AS raw FROM ff),
nw AS (SELECT rw.*, greatest(0.0, least(1.0, raw / CASE WHEN p >= 1e-6 THEN p ELSE greatest(m, 1e-6) END)) AS normalised FROM rw JOIN (SELECT clip_id, quantile_cont(raw, 0.95) AS p, max(raw) AS m FROM rw GROUP BY clip_id) USING (clip_id)),
en AS (SELECT a.clip_id, a.t, a.raw, a.normalised, greatest(0.0, least(1.0, sum(b.normalised) / 5)) AS smoothed FROM nw a, range(-2, 3) o(i) JOIN nw b ON b.clip_id = a.clip_id AND b.t = least(59, greatest(0, a.t + o.i)) GROUP BY ALL)"""
_MOVED = ", ".join(f"abs({n} - lag({n}) OVER w) AS d_{n}" for n in feat.FRAME_FEATURES)
_FS = _FF + f""",
mv AS (SELECT *, {_MOVED} FROM ff WINDOW w AS (PARTITION BY clip_id ORDER BY t)),
fs AS ({" UNION ALL ".join(f"SELECT '{n}' AS feature, avg({n}) AS mean, stddev_pop({n}) AS std, min({n}) AS min, max({n}) AS max, max({n}) - min({n}) AS range, var_pop({n}) AS variance, coalesce(avg(d_{n}), 0) AS mean_abs_delta, count(*) FILTER (abs({n}) <= 1e-8) * 100.0 / count(*) AS near_zero_pct FROM mv" for n in feat.FRAME_FEATURES)}),
he AS (SELECT *, CASE WHEN variance = 0 OR range <= 1e-12 THEN 'dead' WHEN variance <= 1e-8 OR mean_abs_delta <= 1e-6 THEN 'near_dead' WHEN mean_abs_delta / range >= 0.35 OR (std / range >= 0.3 AND mean_abs_delta / range >= 0.2) THEN 'noisy' ELSE 'healthy' END AS health_status,
  CASE WHEN variance = 0 OR range <= 1e-12 THEN 'doesn''t vary' ELSE concat_ws('; ', CASE WHEN variance <= 1e-8 OR mean_abs_delta <= 1e-6 THEN 'hardly varies or moves' END,
    CASE WHEN mean_abs_delta / range >= 0.35 THEN 'large steps for its range' END, CASE WHEN std / range >= 0.3 AND mean_abs_delta / range >= 0.2 THEN 'wide spread with large steps' END) END AS notes FROM fs)"""


def _class_sql() -> str:
    """A11 with a mean and deviation of each class beside the totals."""
    shot = derive.SHOT.format(k="clip_id")
    of_class = lambda n: ", ".join(f"avg({n}) FILTER ({shot} = '{c}') AS mean_{c}, stddev_pop({n}) FILTER ({shot} = '{c}') AS std_{c}" for c in SHOTS)
    classes = " UNION ALL ".join(f"SELECT '{n}' AS feature, {of_class(n)} FROM mv" for n in feat.FRAME_FEATURES)
    shown = ["mean", "std", "min", "max", "range", "variance", "mean_abs_delta", "near_zero_pct", *[f"{w}_{c}" for c in SHOTS for w in ("mean", "std")]]
    return tidy_sql(f"{_FS}, of_class AS ({classes})", "SELECT * FROM fs JOIN of_class USING (feature)", ["feature"], shown, 3)


def _clip_sql() -> str:
    """A5-A9 in SQL: lead is left; distances bridge invalid wrists."""
    mids = ", ".join(f"({c}23 + {c}24) / 2 AS {c}H, ({c}11 + {c}12) / 2 AS {c}S" for c in "xyz")
    bridged = ", ".join(f"last_value({c}{k} IGNORE NULLS) OVER (PARTITION BY clip_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p{c}{k}" for k in ("15", "16", "H") for c in "xyz")
    nose = ", ".join(f"lag({c}0) OVER (PARTITION BY clip_id ORDER BY pos) AS p{c}0" for c in "xyz")
    ends = lambda f, v: f"arg_max({f}, pos) FILTER ({v} IS NOT NULL) - arg_min({f}, pos) FILTER ({v} IS NOT NULL)"
    travel = lambda k: "sqrt(" + " + ".join(f"({ends(c + k, 'x' + k)}) ** 2" for c in "xyz") + ")"
    lean = _between(["(xS - xH)", "(yS - yH)"], ["0.0", "(-1.0)"])
    circular = lambda x: f"coalesce(degrees(atan2(avg(sin(radians({x}))), avg(cos(radians({x}))))), 0)"
    wrapped = "abs(turn - pturn - 360 * floor((turn - pturn + 180) / 360))"
    out = {
        "lead_elbow_angle_mean": "avg(elbow)", "lead_elbow_angle_min": "min(elbow)", "trail_elbow_angle_mean": f"avg({_angle('12', '14', '16')})", "lead_knee_angle_mean": "avg(knee)", "lead_knee_angle_min": "min(knee)", "trail_knee_angle_mean": f"avg({_angle('24', '26', '28')})",
        "shoulder_rotation_angle_mean": circular("turn"), "hip_rotation_angle_mean": circular("hturn"), "trunk_lean_mean": f"avg({lean})", "trunk_lean_max": f"max({lean})", "head_stability": f"avg({_dist('0', '0', pre='p')})", "head_over_base_offset": f"avg({_dist('0', 'H')})",
        "shoulder_hip_separation_mean": "avg(turn - hturn)", "stance_width_mean": f"avg({_dist('27', '28')})", "body_center_shift_x": ends("xH", "xH"), "body_center_shift_y": ends("yH", "yH"),
        "lead_wrist_velocity_mean": "avg(v15)", "lead_wrist_velocity_max": "max(v15)", "trail_wrist_velocity_mean": "avg(v16)", "trail_wrist_velocity_max": "max(v16)", "body_center_velocity_mean": "avg(vH)", "body_center_velocity_max": "max(vH)", "shoulder_rotation_velocity_mean": f"avg({wrapped})", "motion_energy_total": "coalesce(sum(v15), 0) + coalesce(sum(v16), 0) + coalesce(sum(vH), 0)",
        "front_foot_commitment": travel("27"), "back_foot_loading": f"avg({_dist('28', 'H')})", "follow_through_height": "abs(arg_max(y15 - yS, pos) FILTER (x15 IS NOT NULL))", "follow_through_extension": f"arg_max({_dist('15', 'H')}, pos) FILTER (x15 IS NOT NULL)",
        "lead_elbow_extension_change": ends("elbow", "elbow"), "lead_knee_flexion_change": ends("knee", "knee"), "head_to_lead_knee_alignment": f"avg({_dist('0', '25')})", "weight_transfer_score": f"{travel('27')} + {travel('H')}",
    }
    return _CLEAN + f""",
m1 AS (SELECT *, {mids}, {_angle('11', '13', '15')} AS elbow, {_angle('23', '25', '27')} AS knee, degrees(atan2(y12 - y11, x12 - x11)) AS turn, degrees(atan2(y24 - y23, x24 - x23)) AS hturn FROM pt),
m2 AS (SELECT *, {bridged}, {nose}, lag(turn) OVER (PARTITION BY clip_id ORDER BY pos) AS pturn FROM m1),
m3 AS (SELECT *, {", ".join(f"{_dist(k, k, pre='p')} AS v{k}" for k in ("15", "16", "H"))} FROM m2),
cf AS (SELECT clip_id, {", ".join(f"coalesce({f}, 0) AS {n}" for n, f in out.items())} FROM m3 GROUP BY clip_id)"""


_NAMES = list(feat.FRAME_FEATURES)
_SCALED = ["lead_elbow_angle", "stance_width", "frame_motion_energy"]
ORACLE = {
    "analyse_clips": tidy_sql(_DEV, "SELECT * FROM sc", ["clip_id", "shot", "weakest", "strongest_two", "weakest_two"], ["technique_score"], 2),
    "p3_flatten_inspect": tidy_sql(
        derive.FRAMES_SQL + """, co AS (
  SELECT clip_id, count(*) AS total_frames, count(*) FILTER (blank) AS missing_frames, count(*) FILTER (NOT blank AND vis < 0.5) AS low_visibility_frames FROM fr GROUP BY clip_id
  UNION ALL SELECT DISTINCT -1 - clip_id, 0, 0, 0 FROM fr WHERE clip_id % 10 = 1)""",
        "SELECT *, CASE WHEN total_frames > 0 THEN missing_frames::DOUBLE / total_frames ELSE 0 END AS missing_ratio, CASE WHEN total_frames > 0 THEN low_visibility_frames::DOUBLE / total_frames ELSE 0 END AS low_visibility_ratio FROM co",
        ["clip_id", "total_frames", "missing_frames", "low_visibility_frames"], ["missing_ratio", "low_visibility_ratio"],
    ),
    "a2_normalising_counts": f"WITH {_SPOILT}, sk AS (SELECT clip_id, NOT few AND NOT fewer AND hx IS NOT NULL AND coalesce(torso > 0, false) AS ok FROM su) SELECT clip_id, count(*) AS frames, count(*) FILTER (ok) AS changed, count(*) FILTER (NOT ok) AS warnings FROM sk GROUP BY ROLLUP (clip_id)",
    "a2_aligning_counts": f"WITH {_SPOILT}, sk AS (SELECT clip_id, NOT fewer AND x11 IS NOT NULL AND x12 IS NOT NULL AS ok FROM su) SELECT clip_id, count(*) AS frames, count(*) FILTER (ok) AS changed, count(*) FILTER (NOT ok) AS warnings FROM sk GROUP BY ROLLUP (clip_id)",
    "a1b_inspection_summary": tidy_sql(derive.FRAMES_SQL, "SELECT count(*) AS clips, avg(n) AS mean_frames, arg_min(clip_id, n * 1000000 + clip_id) AS shortest, arg_min(clip_id, -n * 1000000 + clip_id) AS longest, count(*) FILTER (n < 30 OR m::DOUBLE / n > 0.3) AS with_issues FROM (SELECT clip_id, count(*) AS n, count(*) FILTER (blank) AS m FROM fr GROUP BY clip_id)", ["clips", "shortest", "longest", "with_issues"], ["mean_frames"]),
    "p3b_sample_frames": tidy_sql(derive.FRAMES_SQL, "SELECT clip_id, pos AS frame_index, pos / 30.0 AS ts FROM fr WHERE pos % 3 = 0", ["clip_id", "frame_index"], ["ts"]),
    "p5_clean_counts": f"WITH {derive.FRAMES_SQL} SELECT clip_id, count(*) AS before, count(*) FILTER (blank OR vis < 0.3) AS removed, count(*) FILTER (NOT (blank OR vis < 0.3)) AS \"after\" FROM fr GROUP BY ROLLUP (clip_id)",
    "p6_normalise": tidy_sql(
        _SPOILT + ", sk AS (SELECT *, NOT few AND NOT fewer AND hx IS NOT NULL AND coalesce(torso > 0, false) AS ok FROM su)",
        "SELECT clip_id, pos, ok, CASE WHEN ok THEN (x0 - hx) / torso ELSE x0 END AS nose_x, CASE WHEN ok THEN (y28 - hy) / torso ELSE raw28 END AS ankle_y, CASE WHEN ok THEN (raw20 - hz) / torso ELSE raw20 END AS z20 FROM sk",
        ["clip_id", "pos", "ok"], ["nose_x", "ankle_y", "z20"],
    ),
    "p6b_normalise_fallback": tidy_sql(
        _SPOILT + ", sk AS (SELECT *, NOT few AND NOT fewer AND hx IS NOT NULL AS ok, CASE WHEN torso > 1e-6 THEN torso WHEN extent > 1e-6 THEN extent ELSE 1 END AS unit FROM su)",
        "SELECT clip_id, pos, ok, CASE WHEN ok THEN (x27 - hx) / unit ELSE raw27 END AS ankle_x FROM sk", ["clip_id", "pos", "ok"], ["ankle_x"],
    ),
    "p6c_interpolate": tidy_sql(derive.FRAMES_SQL + f", pw AS (SELECT clip_id, pos, {derive.point_sql(15)}, {derive.point_sql(16)} FROM fr)" + ", " + ", ".join(f"n{k} AS (SELECT clip_id, pos, x{k}, last_value(x{k} IGNORE NULLS) OVER a AS l, last_value(CASE WHEN x{k} IS NOT NULL THEN pos END IGNORE NULLS) OVER a AS lp, first_value(x{k} IGNORE NULLS) OVER b AS r, first_value(CASE WHEN x{k} IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS rp FROM pw WINDOW a AS (PARTITION BY clip_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY clip_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), i{k} AS (SELECT clip_id, pos, coalesce(x{k}, CASE WHEN l IS NULL THEN r WHEN r IS NULL THEN l ELSE l + (r - l) * (pos - lp) / (rp - lp) END, 0) AS v FROM n{k})" for k in (15, 16)), "SELECT i15.clip_id, i15.pos, i15.v AS wrist_x, i16.v AS other_x FROM i15 JOIN i16 ON i15.clip_id = i16.clip_id AND i15.pos = i16.pos", ["clip_id", "pos"], ["wrist_x", "other_x"], 6),
    "p7_align": tidy_sql(
        _SPOILT + ", sk AS (SELECT *, NOT fewer AND x11 IS NOT NULL AND x12 IS NOT NULL AS ok, -atan2(y12 - y11, x12 - x11) AS a FROM su)",
        "SELECT clip_id, pos, ok, CASE WHEN ok THEN x0 * cos(a) - y0 * sin(a) ELSE x0 END AS nose_x, CASE WHEN ok THEN x0 * sin(a) + y0 * cos(a) ELSE y0 END AS nose_y FROM sk",
        ["clip_id", "pos", "ok"], ["nose_x", "nose_y"],
    ),
    "p8_resample": f"WITH {_CLEAN}, nn AS (SELECT clip_id, count(*) AS n FROM cl GROUP BY clip_id), tt AS (SELECT clip_id, t, CASE WHEN n = 60 THEN t ELSE floor(t * (n - 1) / 59.0)::BIGINT END AS pos FROM nn, range(0, 60) r(t)) SELECT tt.clip_id, t, tt.pos AS source_pos, cl.frame_index FROM tt JOIN cl ON tt.clip_id = cl.clip_id AND tt.pos = cl.pos",
    "p19_verify": f"WITH {derive.FRAMES_SQL} SELECT clip_id, issue, count(*) AS n FROM (SELECT clip_id, CASE WHEN blank THEN 'no_landmarks' WHEN e % 23 = 0 THEN 'bad_coordinate' END AS issue FROM fr) WHERE issue IS NOT NULL GROUP BY ALL",
    "t8_overlay_frame": tidy_sql(derive.FRAMES_SQL, "SELECT clip_id, arg_min(pos, round(-vis * 1000000) * 1000 + pos) AS pos, max(vis) AS visibility FROM (SELECT *, count(*) OVER (PARTITION BY clip_id) AS n FROM fr) WHERE NOT blank AND pos >= n // 3 AND pos < greatest(n // 3 + 1, 2 * n // 3) GROUP BY clip_id", ["clip_id", "pos"], ["visibility"]),
    "f8_frame_features": tidy_sql(_FF, "SELECT * FROM ff", ["clip_id", "t"], _NAMES, 3),
    "a9_clip_features": tidy_sql(_clip_sql(), "SELECT * FROM cf", ["clip_id"], list(feat.CLIP_FEATURES), 3),
    "a11_class_statistics": _class_sql(),
    "a11_feature_statistics": tidy_sql(_FS, "SELECT * FROM he", ["feature", "health_status", "notes"], ["mean", "std", "min", "max", "range", "variance", "mean_abs_delta", "near_zero_pct"], 3),
    "a14_health_summary": f"WITH {_FS} SELECT health_status, count(*) AS features, string_agg(feature, ',' ORDER BY feature) AS names FROM he GROUP BY ALL",
    "a13_correlations": tidy_sql(_FF, "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, corr({a}, {b}) AS r FROM ff" for i, a in enumerate(_NAMES) for b in _NAMES[i + 1 :]) + ") WHERE isfinite(r) AND abs(r) > 0.95", ["feature_a", "feature_b"], ["r"], 3),
    "a15_scaler": tidy_sql(_FF, "SELECT clip_id, t, " + ", ".join(f"(({n} - (SELECT avg({n}) FROM ff WHERE clip_id % 5 < 3)) / (SELECT stddev_pop({n}) FROM ff WHERE clip_id % 5 < 3))::FLOAT::DOUBLE AS {n}" for n in _SCALED) + " FROM ff", ["clip_id", "t"], _SCALED, 3),
    "p20_clip_checks": f"""
WITH {_FF}, cu AS (SELECT clip_id, t, {" + ".join(f"coalesce((NOT isfinite({n}))::INT, 1)" for n in feat.FRAME_FEATURES if n != "stance_width")} + CASE WHEN clip_id % 5 = 1 AND t % 20 = 3 THEN 1 ELSE coalesce((NOT isfinite(stance_width))::INT, 1) END AS odd
  FROM ff WHERE NOT (clip_id % 7 = 2 AND t >= 55) AND NOT (clip_id % 7 = 4 AND t = 0)),
ck AS (SELECT clip_id, count(*) AS frames, min(t)::INT AS first, max(t)::INT AS last, sum(odd)::BIGINT AS not_finite FROM cu GROUP BY clip_id)
SELECT *, frames = 60 AND first = 0 AND last = 59 AND not_finite = 0 AS ok FROM ck""",
    "w8_motion_energy": tidy_sql(_EN, "SELECT * FROM en", ["clip_id", "t"], ["raw", "normalised", "smoothed"], 3),
    "a27_clip_statistics": tidy_sql(_CS, "SELECT * FROM cs", ["clip_id", "feature", "statistic"], ["value"], 3),
    "a28_templates": tidy_sql(_DEV, "SELECT * FROM te", ["shot", "feature", "statistic", "n"], ["low", "high", "center", "std"], 3),
    "j5_deviations": tidy_sql(_DEV, "SELECT * FROM dv", ["clip_id", "shot", "component", "feature", "statistic"], ["score"], 2),
    "a29_components": tidy_sql(_DEV, "SELECT * FROM co", ["clip_id", "component"], ["score"], 2),
    "a30_score_summary": tidy_sql(_DEV, "SELECT weakest, count(*) AS clips, round(avg(technique_score), 4) AS mean_score, min(technique_score) AS min_score, max(technique_score) AS max_score FROM sc GROUP BY ROLLUP (weakest)", ["weakest", "clips"], ["mean_score", "min_score", "max_score"], 2),
    "t2_recommendations": f"WITH {_DEV} SELECT clip_id, coalesce(string_agg(component, ',' ORDER BY r) FILTER (score < 85), 'keep_up') AS recommendation FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY score, comp_pos) AS r FROM co) WHERE r <= 3 GROUP BY clip_id",
    "t3_issues": f"WITH {_DEV}, o AS (SELECT *, row_number() OVER (PARTITION BY clip_id, feature ORDER BY score, deviation DESC, spec_pos) AS a FROM dv WHERE score < 75), k AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY score, deviation DESC, spec_pos) AS rank FROM o WHERE a = 1) SELECT clip_id, rank::INT AS rank, feature, component, CASE WHEN score < 40 THEN 'high' WHEN score < 65 THEN 'medium' ELSE 'low' END AS severity, CASE WHEN value < low THEN 'below' WHEN value > high THEN 'above' ELSE 'inside' END AS direction FROM k WHERE rank <= 3",
    "t1_worst_deviations": f"WITH {_DEV}, o AS (SELECT *, row_number() OVER (PARTITION BY clip_id, feature, statistic, round(value, 6) ORDER BY score, deviation DESC, spec_pos) AS a FROM dv WHERE score < 100), k AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY score, deviation DESC, spec_pos) AS rank FROM o WHERE a = 1) SELECT clip_id, rank::INT AS rank, feature, statistic, replace(feature, '_', ' ') || ' ' || replace(statistic, '_', ' ') || ' of ' || printf('%.4f', value) || ' lies ' || CASE WHEN value < low THEN 'below' WHEN value > high THEN 'above' ELSE 'inside' END || ' the usual range' AS sentence FROM k WHERE rank <= 5 UNION ALL SELECT clip_id, 1, NULL, NULL, '{scoring.ALL_INSIDE}' FROM dv GROUP BY clip_id HAVING count(*) FILTER (score < 100) = 0",
}
