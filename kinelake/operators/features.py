"""Movement features: 32 a frame, 32 a clip, and the health of feature tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinelake.functions import geometry as g
from kinelake.functions.labels import SHOTS
from kinelake.operators import contracts

#: Names and order of the features of a frame and of a clip.
FRAME_FEATURES = (
    "lead_elbow_angle", "trail_elbow_angle", "lead_knee_angle", "trail_knee_angle", "lead_shoulder_angle", "trail_shoulder_angle", "lead_wrist_relative_x", "hip_rotation_angle",
    "trunk_lean", "head_over_base_offset", "head_to_lead_knee_alignment", "shoulder_hip_separation", "stance_width", "body_center_offset_x", "body_center_offset_y", "upper_body_balance_offset",
    "lead_wrist_velocity", "trail_wrist_velocity", "lead_elbow_velocity", "trail_elbow_velocity", "body_center_velocity", "lead_wrist_acceleration", "hip_rotation_velocity", "frame_motion_energy",
    "front_foot_commitment_signal", "back_foot_loading_signal", "weight_transfer_signal", "follow_through_height_signal",
    "follow_through_extension_signal", "lead_elbow_extension_signal", "bat_side_wrist_height_signal", "stance_to_swing_progress_signal",
)
CLIP_FEATURES = (
    "lead_elbow_angle_mean", "lead_elbow_angle_min", "trail_elbow_angle_mean", "lead_knee_angle_mean", "lead_knee_angle_min", "trail_knee_angle_mean", "shoulder_rotation_angle_mean", "hip_rotation_angle_mean",
    "trunk_lean_mean", "trunk_lean_max", "head_stability", "head_over_base_offset", "shoulder_hip_separation_mean", "stance_width_mean", "body_center_shift_x", "body_center_shift_y",
    "lead_wrist_velocity_mean", "lead_wrist_velocity_max", "trail_wrist_velocity_mean", "trail_wrist_velocity_max", "body_center_velocity_mean", "body_center_velocity_max", "shoulder_rotation_velocity_mean", "motion_energy_total",
    "front_foot_commitment", "back_foot_loading", "follow_through_height", "follow_through_extension", "lead_elbow_extension_change", "lead_knee_flexion_change", "head_to_lead_knee_alignment", "weight_transfer_score",
)
#: Named points by side: (lead, trail) places in the landmark list; lead is left.
SIDES = {"shoulder": g.SHOULDERS, "elbow": g.ELBOWS, "wrist": g.WRISTS, "hip": g.HIPS, "knee": g.KNEES, "ankle": g.ANKLES}
USED = (g.NOSE, *(place for pair in SIDES.values() for place in pair))
#: Points whose steps are the motion of a frame.
MOVING = ("lead_wrist", "trail_wrist", "lead_elbow", "trail_elbow", "lead_shoulder", "trail_shoulder", "lead_hip", "trail_hip", "lead_knee", "trail_knee")


def used_points(frames: DataFrame, *keep: str) -> DataFrame:
    """keep columns, the number of landmarks, and x, y, z of the points that features use.

    One narrow table of doubles: the landmark arrays go no further. A point whose
    parts aren't all finite is NULL in each of them.
    """
    marks = {f"_m{k}": F.get("landmarks", F.lit(k)) for k in USED}
    parts = frames.select(*keep, F.size("landmarks").alias("marks"), *[mark.alias(name) for name, mark in marks.items()])
    parts = parts.select(*keep, "marks", *[g.finite(F.col(f"_m{k}.{c}")).alias(f"{c}{k}") for k in USED for c in "xyz"])
    whole = {k: (F.col(f"x{k}") + F.col(f"y{k}") + F.col(f"z{k}")).isNotNull() for k in USED}
    return parts.select(*keep, "marks", *[F.when(whole[k], F.col(f"{c}{k}")).alias(f"{c}{k}") for k in USED for c in "xyz"])


def _at(place: int) -> dict[str, Column]:
    return {c: F.col(f"{c}{place}") for c in "xyz"}


def _middle(a: dict, b: dict) -> dict[str, Column]:
    return {c: (a[c] + b[c]) / 2.0 for c in "xyz"}


def prepared_points(frames: DataFrame, *keep: str) -> DataFrame:
    """keep columns and points: ``used_points``, normalised (P6) and aligned (P7), as a list of x, y, z of each; NaN for what is missing.

    Origin at the hips' middle, shoulder-hip distance as unit, turned so that the shoulder
    line is level; unchanged where that can't be told.
    """
    return frames.select(*keep, _packing(True)("landmarks").alias("points"))


def _packing(prepare: bool) -> Callable[..., Column]:
    """Coordinates of the used points, normalised and aligned if prepare is set, over whole Arrow batches."""

    def made(landmarks: pa.Array) -> pa.Array:
        starts = landmarks.offsets.to_numpy()[:-1]
        marks = np.where(landmarks.is_null().to_numpy(zero_copy_only=False), 0, np.diff(landmarks.offsets.to_numpy()))
        known = marks[:, None] > np.array(USED)
        places = np.where(known, starts[:, None] + np.array(USED), 0)
        axes = [pc.struct_field(landmarks.values, c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in "xyz"]
        points = np.stack([np.where(known, axis[places] if len(axis) else np.nan, np.nan) for axis in axes])  # axis, frame, point
        points = np.where(np.isfinite(points).all(axis=0), points, np.nan)
        if prepare:
            points = _aligned(_normalised(points, marks), marks)
        flat = np.ascontiguousarray(points.transpose(1, 2, 0)).ravel()
        return pa.ListArray.from_arrays(pa.array(np.arange(len(marks) + 1, dtype=np.int32) * (3 * len(USED))), pa.array(flat))

    return F.arrow_udf(made, "array<double>").asNondeterministic()


def _normalised(points: np.ndarray, marks: np.ndarray) -> np.ndarray:
    hips, shoulders = ((points[:, :, USED.index(a)] + points[:, :, USED.index(b)]) / 2.0 for a, b in (g.HIPS, g.SHOULDERS))
    torso = _distance(shoulders - hips)
    ok = (marks >= 25) & (torso > 0)
    return (points - np.where(ok, hips, 0.0)[:, :, None]) / np.where(ok, torso, 1.0)[:, None]


def _aligned(points: np.ndarray, marks: np.ndarray) -> np.ndarray:
    left, right = (points[:, :, USED.index(k)] for k in g.SHOULDERS)
    turn = -np.arctan2(right[1] - left[1], right[0] - left[0])
    turn = np.where((marks >= 13) & ~np.isnan(turn), turn, 0.0)[:, None]
    x, y, z = points
    return np.stack([x * np.cos(turn) - y * np.sin(turn), x * np.sin(turn) + y * np.cos(turn), z])


def _named(points: DataFrame, left_handed: Column | None = None) -> tuple[DataFrame, dict[str, dict[str, Column]]]:
    """Points by name (lead_wrist ... nose, hips, shoulders, body); sides are swapped for left-handers."""
    names = {}
    for name, (left, right) in SIDES.items():
        names["lead_" + name], names["trail_" + name] = _at(left), _at(right)
    if left_handed is not None:
        swap = F.coalesce(left_handed, F.lit(False))
        sides = {}
        for left, right in SIDES.values():
            for c in "xyz":
                sides[f"{c}{left}"] = F.when(swap, F.col(f"{c}{right}")).otherwise(F.col(f"{c}{left}"))
                sides[f"{c}{right}"] = F.when(swap, F.col(f"{c}{left}")).otherwise(F.col(f"{c}{right}"))
        points = points.withColumns(sides)
    hips, shoulders = _middle(names["lead_hip"], names["trail_hip"]), _middle(names["lead_shoulder"], names["trail_shoulder"])
    points = points.withColumns({f"hips_{c}": hips[c] for c in "xyz"} | {f"shoulders_{c}": shoulders[c] for c in "xyz"})
    for name in ("hips", "shoulders"):
        names[name] = {c: F.col(f"{name}_{c}") for c in "xyz"}
    points = points.withColumns({f"body_{c}": m for c, m in _middle(names["hips"], names["shoulders"]).items()})
    return points, names | {"nose": _at(g.NOSE), "body": {c: F.col(f"body_{c}") for c in "xyz"}}


def frame_features(frames: DataFrame, length: int = 60) -> DataFrame:
    """The 32 features of every frame (clip_id, t); missing values become 0.

    frames has landmarks, or the points of ``prepared_points``.
    """
    points = frames.select("clip_id", "t", _packing(False)("landmarks").alias("points")) if "landmarks" in frames.columns else frames.select("clip_id", "t", "points")
    staged = points.withColumn("_before", F.lag("points").over(Window.partitionBy("clip_id").orderBy("t")))
    made = staged.select("clip_id", "t", _frame_formulas(length)("points", "_before", F.col("t").cast("double")).alias("_made"))
    return made.select("clip_id", "t", *[F.col(f"_made.{name}").alias(name) for name in FRAME_FEATURES])


def _points(packed: pa.ListArray) -> dict[str, np.ndarray]:
    """Points by name, three rows of coordinates each, from lists of the used points' coordinates; what is missing is NaN."""
    count = 3 * len(USED)
    values = np.full((len(packed), count), np.nan)
    values[~packed.is_null().to_numpy(zero_copy_only=False)] = packed.flatten().to_numpy(zero_copy_only=False).reshape(-1, count)
    place = dict(zip(USED, values.T.reshape(len(USED), 3, -1), strict=True))
    at = {"nose": place[g.NOSE]}
    for name, (left, right) in SIDES.items():
        at["lead_" + name], at["trail_" + name] = place[left], place[right]
    at["hips"], at["shoulders"] = ((at["lead_" + n] + at["trail_" + n]) / 2.0 for n in ("hip", "shoulder"))
    at["body"] = (at["hips"] + at["shoulders"]) / 2.0
    return at


def _length(v: np.ndarray) -> np.ndarray:
    """Lengths of vectors, added as ``geometry.distance`` does."""
    return np.sqrt(sum(p * p for p in v))


def _distance(v: np.ndarray) -> np.ndarray:
    """Lengths of vectors by the C library's powers, as the comparison SQL has them: one in a thousand isn't the square that ``_length`` rounds to."""
    return np.sqrt(sum(np.power(p, np.full_like(p, 2.0)) for p in v))


def _angle(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Degrees between vectors, NaN if either has no length."""
    lengths = _length(u) * _length(v)
    cosine = sum(p * q for p, q in zip(u, v, strict=True)) / np.where(lengths > 1e-12, lengths, np.nan)
    return np.degrees(np.arccos(np.clip(cosine, -1.0, 1.0)))


def _frame_formulas(length: int) -> Callable[..., Column]:
    """The features of frames over whole Arrow batches, from their points, those of the frame before and t.

    As column expressions they made methods too long for the JVM to compile. Being marked
    as not deterministic keeps the optimizer from repeating the work in filters.
    """

    def made(now: pa.Array, before: pa.Array, t: pa.Array) -> pa.Array:
        with np.errstate(all="ignore"):
            at, was = _points(now), _points(before)
            step = {name: np.nan_to_num(_distance(at[name] - was[name]), nan=0.0, posinf=np.inf) for name in MOVING}
            angle = lambda a, v, b: _angle(at[a] - at[v], at[b] - at[v])
            heading = lambda p, a, b: np.degrees(np.arctan2(p[b][1] - p[a][1], p[b][0] - p[a][0]))
            x, y = ({name: p[i] for name, p in at.items()} for i in (0, 1))
            hips, elbow = heading(at, "lead_hip", "trail_hip"), angle("lead_shoulder", "lead_elbow", "lead_wrist")
            up = np.array([[0.0], [-1.0], [0.0]])
            formulas = {
                "lead_elbow_angle": elbow,
                "trail_elbow_angle": angle("trail_shoulder", "trail_elbow", "trail_wrist"),
                "lead_knee_angle": angle("lead_hip", "lead_knee", "lead_ankle"),
                "trail_knee_angle": angle("trail_hip", "trail_knee", "trail_ankle"),
                "lead_shoulder_angle": angle("lead_elbow", "lead_shoulder", "lead_hip"),
                "trail_shoulder_angle": angle("trail_elbow", "trail_shoulder", "trail_hip"),
                "lead_wrist_relative_x": x["lead_wrist"] - x["hips"],
                "hip_rotation_angle": hips,
                "trunk_lean": _angle(at["shoulders"] - at["hips"], up),
                "head_over_base_offset": x["nose"] - x["hips"],
                "head_to_lead_knee_alignment": x["nose"] - x["lead_knee"],
                "shoulder_hip_separation": heading(at, "lead_shoulder", "trail_shoulder") - hips,
                "stance_width": _distance((at["lead_ankle"] - at["trail_ankle"])[:2]),
                "body_center_offset_x": x["body"] - x["hips"],
                "body_center_offset_y": y["body"] - y["hips"],
                "upper_body_balance_offset": x["shoulders"] - x["hips"],
                "lead_wrist_velocity": step["lead_wrist"],
                "trail_wrist_velocity": step["trail_wrist"],
                "lead_elbow_velocity": step["lead_elbow"],
                "trail_elbow_velocity": step["trail_elbow"],
                "body_center_velocity": _distance(at["body"] - was["body"]),
                "lead_wrist_acceleration": np.abs(step["lead_wrist"] - step["trail_wrist"]),
                "hip_rotation_velocity": np.abs(np.mod(hips - heading(was, "lead_hip", "trail_hip") + 180.0, 360.0) - 180.0),
                "frame_motion_energy": sum(step[name] for name in MOVING),
                "front_foot_commitment_signal": x["lead_ankle"] - x["hips"],
                "back_foot_loading_signal": (y["trail_knee"] - y["trail_hip"] + y["trail_ankle"] - y["trail_knee"]) * 0.5,
                "weight_transfer_signal": x["body"] - was["body"][0],
                "follow_through_height_signal": y["lead_wrist"] - y["shoulders"],
                "follow_through_extension_signal": _distance(at["lead_wrist"] - at["lead_shoulder"]),
                "lead_elbow_extension_signal": elbow / 180.0,
                "bat_side_wrist_height_signal": y["trail_wrist"] - y["shoulders"],
                "stance_to_swing_progress_signal": t.to_numpy(zero_copy_only=False) / float(max(length - 1, 1)),
            }
            columns = [pa.array(np.where(np.isfinite(v), v, 0.0)) for v in (formulas[name] for name in FRAME_FEATURES)]
        return pa.StructArray.from_arrays(columns, list(FRAME_FEATURES))

    return F.arrow_udf(made, "struct<" + ", ".join(f"{name}: double" for name in FRAME_FEATURES) + ">").asNondeterministic()


def clip_features(frames: DataFrame, left_handed: Column | None = None) -> DataFrame:
    """The 32 features of every clip, from frames (clip_id, pos, landmarks); 0 where nothing is valid.

    left_handed is an expression over frames. Wrist and body steps bridge invalid
    frames; head steps and shoulder turns don't.
    """
    c = F.col
    hand = [] if left_handed is None else ["_left"]
    source = frames if left_handed is None else frames.withColumn("_left", left_handed)
    points, at = _named(used_points(source, "clip_id", "pos", *hand), c("_left") if hand else None)
    clip = Window.partitionBy("clip_id").orderBy("pos")
    earlier = clip.rowsBetween(Window.unboundedPreceding, -1)
    bridged = ("lead_wrist", "trail_wrist", "hips")
    points = points.withColumns({
        "elbow": g.vertex_angle(at["lead_shoulder"], at["lead_elbow"], at["lead_wrist"]),
        "trail_elbow": g.vertex_angle(at["trail_shoulder"], at["trail_elbow"], at["trail_wrist"]),
        "knee": g.vertex_angle(at["lead_hip"], at["lead_knee"], at["lead_ankle"]),
        "trail_knee": g.vertex_angle(at["trail_hip"], at["trail_knee"], at["trail_ankle"]),
        # The rotation of left-handers is that of the body's own left and right, too.
        "turn": g.heading(at["lead_shoulder"], at["trail_shoulder"], null_if_same=True),
        "hip_turn": g.heading(at["lead_hip"], at["trail_hip"], null_if_same=True),
        "lean": g.angle_between((at["shoulders"]["x"] - at["hips"]["x"], at["shoulders"]["y"] - at["hips"]["y"]), (F.lit(0.0), F.lit(-1.0))),
    })
    last = {f"last_{p}_{a}": F.last(at[p][a], ignorenulls=True).over(earlier) for p in bridged for a in "xyz"}
    lags = {f"nose_before_{a}": F.lag(at["nose"][a]).over(clip) for a in "xyz"} | {"turn_before": F.lag("turn").over(clip)}
    staged = points.select("*", *[column.alias(name) for name, column in (last | lags).items()])
    staged = staged.withColumns({f"v_{p}": g.distance(at[p], {a: c(f"last_{p}_{a}") for a in "xyz"}) for p in bridged} | {
        "head_step": g.distance(at["nose"], {a: c(f"nose_before_{a}") for a in "xyz"}),
        "head_offset": g.distance(at["nose"], at["hips"]),
        "stance": g.distance(at["lead_ankle"], at["trail_ankle"]),
        "turn_step": F.abs(g.wrapped(c("turn") - c("turn_before"))),
        "loading": g.distance(at["trail_ankle"], at["hips"]),
        "head_knee": g.distance(at["nose"], at["lead_knee"]),
        "height": F.abs(at["lead_wrist"]["y"] - at["shoulders"]["y"]),
        "reach": g.distance(at["lead_wrist"], at["hips"]),
        "ankle_pos": F.when(at["lead_ankle"]["x"].isNotNull(), c("pos")),
        "hips_pos": F.when(at["hips"]["x"].isNotNull(), c("pos")),
        "elbow_pos": F.when(c("elbow").isNotNull(), c("pos")),
        "knee_pos": F.when(c("knee").isNotNull(), c("pos")),
        "wrist_pos": F.when(at["lead_wrist"]["x"].isNotNull(), c("pos")),
    }).select("clip_id", *MEASURES, *[f"v_{p}" for p in bridged], *[at["lead_ankle"][a].alias(f"ankle_{a}") for a in "xyz"], *[f"hips_{a}" for a in "xyz"])
    mean = lambda name: F.coalesce(F.avg(name), F.lit(0.0))
    top = lambda name: F.coalesce(F.max(name), F.lit(0.0))
    low = lambda name: F.coalesce(F.min(name), F.lit(0.0))
    ends = {"ankle_x": "ankle", "ankle_y": "ankle", "ankle_z": "ankle", "hips_x": "hips", "hips_y": "hips", "hips_z": "hips", "elbow": "elbow", "knee": "knee"}
    grouped = staged.groupBy("clip_id").agg(
        mean("elbow").alias("lead_elbow_angle_mean"), low("elbow").alias("lead_elbow_angle_min"), mean("trail_elbow").alias("trail_elbow_angle_mean"),
        mean("knee").alias("lead_knee_angle_mean"), low("knee").alias("lead_knee_angle_min"), mean("trail_knee").alias("trail_knee_angle_mean"),
        g.circular_mean(c("turn")).alias("shoulder_rotation_angle_mean"), g.circular_mean(c("hip_turn")).alias("hip_rotation_angle_mean"),
        mean("lean").alias("trunk_lean_mean"), top("lean").alias("trunk_lean_max"),
        mean("head_step").alias("head_stability"), mean("head_offset").alias("head_over_base_offset"),
        F.coalesce(F.avg(c("turn") - c("hip_turn")), F.lit(0.0)).alias("shoulder_hip_separation_mean"), mean("stance").alias("stance_width_mean"),
        mean("v_lead_wrist").alias("lead_wrist_velocity_mean"), top("v_lead_wrist").alias("lead_wrist_velocity_max"),
        mean("v_trail_wrist").alias("trail_wrist_velocity_mean"), top("v_trail_wrist").alias("trail_wrist_velocity_max"),
        mean("v_hips").alias("body_center_velocity_mean"), top("v_hips").alias("body_center_velocity_max"),
        mean("turn_step").alias("shoulder_rotation_velocity_mean"),
        sum((F.coalesce(F.sum(f"v_{p}"), F.lit(0.0)) for p in bridged), F.lit(0.0)).alias("motion_energy_total"),
        mean("loading").alias("back_foot_loading"), mean("head_knee").alias("head_to_lead_knee_alignment"),
        F.max_by("height", "wrist_pos").alias("_height"), F.max_by("reach", "wrist_pos").alias("_reach"),
        *[(F.max_by(name, f"{pos}_pos") - F.min_by(name, f"{pos}_pos")).alias(f"_{name}") for name, pos in ends.items()],
    )
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    travel = lambda p: zero(F.sqrt(sum((c(f"_{p}_{a}") * c(f"_{p}_{a}") for a in "xyz"), F.lit(0.0))))
    return grouped.withColumns({
        "body_center_shift_x": zero(c("_hips_x")),
        "body_center_shift_y": zero(c("_hips_y")),
        "front_foot_commitment": travel("ankle"),
        "follow_through_height": zero(c("_height")),
        "follow_through_extension": zero(c("_reach")),
        "lead_elbow_extension_change": zero(c("_elbow")),
        "lead_knee_flexion_change": zero(c("_knee")),
        "weight_transfer_score": travel("ankle") + travel("hips"),
    }).select("clip_id", *CLIP_FEATURES)


#: What a clip's features are aggregated from, beside steps and positions.
MEASURES = ("elbow", "trail_elbow", "knee", "trail_knee", "turn", "hip_turn", "lean", "head_step", "head_offset", "stance", "turn_step", "loading", "head_knee", "height", "reach", "ankle_pos", "hips_pos", "elbow_pos", "knee_pos", "wrist_pos")


def long_form(table: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """(keys, feature, value): one row a feature."""
    return table.unpivot(keys, names, "feature", "value")


def _deltas(table: DataFrame, names: list[str], *keep: str) -> DataFrame:
    clip = Window.partitionBy("clip_id").orderBy("t")
    return table.select("clip_id", "t", *keep, *names, *[F.abs(F.col(n) - F.lag(n).over(clip)).alias(f"d_{n}") for n in names])


def _facts(n: str, near_zero: float) -> list[Column]:
    return [
        F.avg(n).alias("mean"), F.stddev_pop(n).alias("std"), F.min(n).alias("min"), F.max(n).alias("max"), (F.max(n) - F.min(n)).alias("range"), F.var_pop(n).alias("variance"),
        F.coalesce(F.avg(f"d_{n}"), F.lit(0.0)).alias("mean_abs_delta"), (F.count_if(F.abs(F.col(n)) <= near_zero) * 100.0 / F.count(n)).alias("near_zero_pct"),
    ]


#: What a task knows of a feature: values and their sum, mean, squares about it, ends, values near zero; steps and their sum.
PARTS = ("n", "sum", "mean", "squares", "least", "most", "near", "steps", "moved")


def statistics(table: DataFrame, names: list[str] = FRAME_FEATURES, near_zero: float = 1e-8) -> DataFrame:
    """One row a feature, from (clip_id, t, features); values that are NULL don't count.

    Rows look back once, over an array of their features. A task adds up its Arrow batches and
    gives one row a feature; Spark adds these up. As SQL, hundreds of aggregates made methods
    too long for the JVM to compile.
    """
    clip = Window.partitionBy("clip_id").orderBy("t")
    packed = table.select("clip_id", "t", F.array(*[F.col(n).cast("double") for n in names]).alias("_now"))
    staged = packed.select("_now", F.lag("_now").over(clip).alias("_before"))
    count = len(names)

    def matrix(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Values, a row a list, and which are there."""
        rows = ~lists.is_null().to_numpy(zero_copy_only=False)
        flat = lists.flatten()
        values, there = np.zeros((len(lists), count)), np.zeros((len(lists), count), dtype=bool)
        there[rows] = ~flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, count)
        values[rows] = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False).reshape(-1, count)
        return values, there

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, whole, mean, squares, near, steps, moved = np.zeros((7, count))
        least, most = np.full(count, np.nan), np.full(count, -np.inf)
        for batch in batches:
            (now, here), (before, there) = matrix(batch.column(0)), matrix(batch.column(1))
            with np.errstate(all="ignore"):
                more = here.sum(axis=0)
                added = now.sum(axis=0, where=here)
                own = np.where(more > 0, added / more, 0.0)
                away = np.where(more > 0, own - mean, 0.0)
                off = np.where(here, now - own, 0.0)
                total = np.maximum(n + more, 1)
                squares += (off * off).sum(axis=0) + away * away * n * more / total
                mean += away * more / total
                n += more
                whole += added
                # NaN is the largest value in Spark, and the least only among its like.
                least = np.fmin(least, np.fmin.reduce(np.where(here, now, np.nan), axis=0, initial=np.nan))
                most = np.maximum(most, np.max(now, axis=0, where=here, initial=-np.inf))
                near += (here & (np.abs(now) <= near_zero)).sum(axis=0)
                both = here & there
                steps += both.sum(axis=0)
                moved += np.abs(now - before).sum(axis=0, where=both)
        made = dict(zip(PARTS, (n, whole, mean, squares, least, most, near, steps, moved), strict=True))
        seen = n > 0
        if seen.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen).astype(np.int32)), *[pa.array(made[p][seen]) for p in PARTS]], names=["i", *PARTS])

    found = staged.mapInArrow(add, "i int, " + ", ".join(f"{c} double" for c in PARTS))
    c = F.col
    shares = found.withColumn("pivot", F.min("mean").over(Window.partitionBy("i"))).withColumn("off", c("mean") - c("pivot"))  # one row a task and feature
    total = shares.groupBy("i").agg(
        F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.sum(c("n") * c("off")).alias("offs"), F.sum(c("squares") + c("n") * c("off") * c("off")).alias("squares"),
        F.min("least").alias("min"), F.max("most").alias("max"), F.sum("near").alias("near"), F.sum("steps").alias("steps"), F.sum("moved").alias("moved"),
    )
    left = c("squares") - c("offs") * c("offs") / c("n")
    variance = F.when(left < 0, 0.0).otherwise(left / c("n"))
    known = total.select(
        "i", (c("sum") / c("n")).alias("mean"), F.sqrt(variance).alias("std"), "min", "max", (c("max") - c("min")).alias("range"), variance.alias("variance"),
        F.when(c("steps") > 0, c("moved") / c("steps")).otherwise(0.0).alias("mean_abs_delta"), (c("near") * 100.0 / c("n")).alias("near_zero_pct"),
    )
    every = table.sparkSession.createDataFrame(list(enumerate(names)), "i int, feature string")
    return every.join(F.broadcast(known), "i", "left").drop("i").withColumn("mean_abs_delta", F.coalesce("mean_abs_delta", F.lit(0.0)))  # a row a feature on either side


def class_statistics(table: DataFrame, names: list[str] = FRAME_FEATURES, classes: tuple[str, ...] = SHOTS, label: str = "shot", near_zero: float = 1e-8) -> DataFrame:
    """``statistics``, and beside them mean_<class> and std_<class> of every class: a row a feature.

    One aggregate over grouping sets (all rows, each class); classes are pivoted on its few rows.
    """
    rows = [F.struct(F.lit(n).alias("feature"), *_facts(n, near_zero)) for n in names]
    sets = _deltas(table, names, label).groupingSets([[], [label]], label).agg(F.grouping(label).alias("_all"), F.array(*rows).alias("r"))
    tall = sets.select("_all", F.col(label).alias("_class"), F.inline("r"))
    whole = [c for c in tall.columns if c not in ("_all", "_class", "feature")]
    of_class = lambda c, what: F.max(F.when((F.col("_all") == 0) & (F.col("_class") == c), F.col(what))).alias(f"{what}_{c}")
    return tall.groupBy("feature").agg(*[F.max(F.when(F.col("_all") == 1, F.col(w))).alias(w) for w in whole], *[of_class(c, w) for c in classes for w in ("mean", "std")])


#: What speaks against a feature, in our own words.
NOTES = {"dead": "doesn't vary", "still": "hardly varies or moves", "jumpy": "large steps for its range", "unstable": "wide spread with large steps"}


def health(stats: DataFrame) -> DataFrame:
    """Dead, near_dead, noisy or healthy, with notes on why."""
    ratio = F.when(F.col("range") > 0, F.col("mean_abs_delta") / F.col("range")).otherwise(0.0)
    spread = F.when(F.col("range") > 0, F.col("std") / F.col("range")).otherwise(0.0)
    dead = (F.col("variance") == 0) | (F.col("range") <= 1e-12)
    still = (F.col("variance") <= 1e-8) | (F.col("mean_abs_delta") <= 1e-6)
    jumpy, unstable = ratio >= 0.35, (spread >= 0.30) & (ratio >= 0.20)
    status = F.when(dead, "dead").when(still, "near_dead").when(jumpy | unstable, "noisy").otherwise("healthy")
    notes = F.when(dead, F.array(F.lit(NOTES["dead"]))).otherwise(F.array_compact(F.array(*[F.when(test, NOTES[name]) for name, test in (("still", still), ("jumpy", jumpy), ("unstable", unstable))])))
    return stats.withColumn("health_status", status).withColumn("notes", F.array_join(notes, "; "))


def health_summary(checked: DataFrame) -> DataFrame:
    """Number and names of the features of each status."""
    return checked.groupBy("health_status").agg(F.count(F.lit(1)).alias("features"), F.array_join(F.sort_array(F.collect_list("feature")), ",").alias("names"))


#: What a status calls for, in our own words.
ADVICE = {
    "dead": "No signal: look at these features before any training.",
    "near_dead": "Almost no signal: compare these features with the poses they come from.",
    "noisy": "Jumpy: try smoothing or scaling and compare the models.",
    "healthy": "Ready for experiments; keep watching.",
}
#: Limits of ``health``, by name.
LIMITS = {"dead_range": 1e-12, "near_dead_variance": 1e-8, "near_dead_delta": 1e-6, "noisy_delta_ratio": 0.35, "noisy_spread": 0.30, "noisy_spread_delta": 0.20}


def health_advice(checked: DataFrame) -> DataFrame:
    """Number of features, limits used and advice of each status that occurs."""
    advice = F.element_at(F.create_map(*[F.lit(x) for pair in ADVICE.items() for x in pair]), F.col("health_status"))
    limits = F.lit(", ".join(f"{k}={v}" for k, v in LIMITS.items()))
    return checked.groupBy("health_status").agg(F.count(F.lit(1)).alias("features")).withColumn("advice", advice).withColumn("limits", limits)


def tabular_quality(table: DataFrame, names: tuple[str, ...] = CLIP_FEATURES) -> DataFrame:
    """A10: for each feature the NaN and infinite values, mean, deviation (0 for one value), ends, and whether it varies.

    One wide aggregate; infinite values enter no statistic. Values that aren't numbers count as NaN.
    """
    rows = []
    for n in names:
        value = F.col(n).cast("double")
        good = g.finite(value)
        spread = F.when(F.count(good) > 1, F.stddev_pop(good)).otherwise(0.0)
        gone, infinite = F.count_if(value.isNull() | F.isnan(value)), F.count_if(F.abs(value) == float("inf"))
        parts = {"nan": gone, "infinite": infinite, "mean": F.avg(good), "std": spread, "min": F.min(good), "max": F.max(good)}
        rows.append(F.struct(F.lit(n).alias("feature"), *[column.alias(name) for name, column in parts.items()]))
    tall = table.agg(F.array(*rows).alias("r")).select(F.inline("r"))
    return tall.withColumn("zero_variance", F.col("std") <= 1e-8)


def class_means(table: DataFrame, names: tuple[str, ...] = CLIP_FEATURES, label: str = "shot") -> DataFrame:
    """A10: rows and means of each class, a row a class and feature."""
    wide = table.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *[F.avg(g.finite(F.col(n))).alias(n) for n in names])
    return wide.unpivot([label, "n"], list(names), "feature", "mean")


#: What a task knows of two features a and b: first values, rows, sums, squares, products, values that aren't finite.
PRODUCTS = ("pa", "pb", "n", "a", "b", "aa", "bb", "ab", "odd")


def strongest_pairs(pairs: DataFrame) -> DataFrame:
    """Correlated pairs with their rank by falling absolute value; ties by name."""
    order = Window.orderBy(F.desc(F.abs("r")), "feature_a", "feature_b")  # at most one row a pair of features
    return pairs.withColumn("rank", F.row_number().over(order))


def correlations(table: DataFrame, names: list[str], least: float = 0.95) -> DataFrame:
    """Pairs with a Pearson correlation beyond least; one pass, no self-join.

    A task adds its rows' products as matrices and gives one row a pair; Spark adds these
    up. Rows where either value is NULL don't count for a pair, as in ``corr``; a
    pair that meets a value that isn't finite has none. Sums are taken about the first
    value that a task sees, then moved to the least of these, so large means cancel nothing.
    """
    n = len(names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, sums = np.full(n, np.nan), np.zeros((5, n, n))
        for batch in batches:
            values = np.stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            there = ~np.stack([c.is_null().to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            good = np.isfinite(values) & there
            for i in np.flatnonzero(np.isnan(pivot) & good.any(axis=0)):
                pivot[i] = values[good[:, i], i][0]
            x, w, odd = np.where(good, values - pivot, 0.0), there.astype(np.float64), (there & ~good).astype(np.float64)
            # Of i and j: rows with both, values of i beside j, their squares, products, odd values beside the other.
            sums += np.stack([w.T @ w, x.T @ w, (x * x).T @ w, x.T @ x, odd.T @ w + w.T @ odd])
        a, b = np.triu_indices(n, 1)
        rows, own, squares, both, strange = sums
        start = np.where(np.isnan(pivot), 0.0, pivot)
        made = [a, b, start[a], start[b], rows[a, b], own[a, b], own[b, a], squares[a, b], squares[b, a], both[a, b], strange[a, b]]
        seen = ~(np.isnan(pivot)[a] | np.isnan(pivot)[b]) | (strange[a, b] > 0)
        if seen.any():
            yield pa.RecordBatch.from_arrays([pa.array(m[seen].astype(np.int32 if i < 2 else np.float64)) for i, m in enumerate(made)], names=["i", "j", *PRODUCTS])

    found = table.select(*names).mapInArrow(add, "i int, j int, " + ", ".join(f"{c} double" for c in PRODUCTS))
    pair = Window.partitionBy("i", "j")  # one row a task
    c = F.col
    da, db = c("pa") - F.min("pa").over(pair), c("pb") - F.min("pb").over(pair)
    moved = found.withColumns({"da": da, "db": db}).select(
        "i", "j", "n", "odd", (c("a") + c("n") * c("da")).alias("a"), (c("b") + c("n") * c("db")).alias("b"),
        (c("aa") + 2 * c("da") * c("a") + c("n") * c("da") * c("da")).alias("aa"), (c("bb") + 2 * c("db") * c("b") + c("n") * c("db") * c("db")).alias("bb"),
        (c("ab") + c("da") * c("b") + c("db") * c("a") + c("n") * c("da") * c("db")).alias("ab"),
    )
    total = moved.groupBy("i", "j").agg(*[F.sum(x).alias(x) for x in ("n", "odd", "a", "b", "aa", "bb", "ab")]).where("odd = 0 and n > 0")
    left = lambda s, q: c(q) - c(s) * c(s) / c("n")
    spread = lambda s, q: F.when(left(s, q) > 1e-13 * c(q), left(s, q))  # less is rounding: the values are equal
    r = (c("ab") - c("a") * c("b") / c("n")) / F.sqrt(spread("a", "aa")) / F.sqrt(spread("b", "bb"))
    name = lambda k: F.get(F.array(*[F.lit(x) for x in names]), k)
    pairs = total.select(name("i").alias("feature_a"), name("j").alias("feature_b"), F.when(F.abs(r) > 1.0, F.signum(r)).otherwise(r).alias("r"))
    return pairs.where(g.finite(c("r")).isNotNull() & (F.abs("r") > least))


def feature_vectors(clips: DataFrame, names: list[str] = CLIP_FEATURES) -> DataFrame:
    """Clips with their features in one array, in the contract's order; ContractError with counts.

    Missing or unexpected features are an error at once, values that aren't finite when the
    table has been written, in the same pass.
    """
    contracts.require_columns([c for c in clips.columns if c != "clip_id"], list(names))
    made = contracts.checked(clips.select("clip_id", *names), {"rows with non-finite features": contracts.not_finite(list(names)) > 0})
    return made.select("clip_id", F.array(*[F.col(n).cast("double") for n in names]).alias("features"))


def fit_scaler(train: DataFrame, names: list[str]) -> DataFrame:
    """(feature, mean, std) of the training rows; deviations under 1e-6 count as 1.

    A value that isn't finite fails the job, with its feature and the number of such values.
    """
    rows = []
    for n in names:
        odd = F.sum(contracts.not_finite([n]))
        wrong = F.raise_error(F.concat(F.lit(f"{n}: "), odd.cast("string"), F.lit(" values aren't finite"))).cast("double")
        spread = F.when(F.stddev_pop(n) < 1e-6, 1.0).otherwise(F.stddev_pop(n))
        rows.append(F.struct(F.lit(n).alias("feature"), F.when(odd > 0, wrong).otherwise(F.avg(n)).alias("mean"), spread.alias("std")))
    return train.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def scale(table: DataFrame, scaler: DataFrame, names: list[str]) -> DataFrame:
    """(x - mean) / std in single precision; the scaler, a row a feature, is broadcast.

    A value that isn't finite, before or after, fails the job.
    """
    packed = scaler.agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mean", "std")))).alias("_s"))
    shifted = lambda n: ((F.col(n) - F.col("_s")[n]["mean"]) / F.col("_s")[n]["std"]).cast("float").alias(n)
    made = table.crossJoin(F.broadcast(packed)).select(*[c for c in table.columns if c not in names], *[shifted(n) for n in names])
    return contracts.guard(made, {"a scaled value isn't finite": contracts.not_finite(names) > 0})


def tensor(table: DataFrame, names: list[str] = FRAME_FEATURES) -> DataFrame:
    """One row a clip with its (t, features) matrix of floats, in the order of t."""
    packed = table.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("t", F.array(*[F.col(n).cast("float") for n in names]).alias("v")))).alias("x"))
    return packed.select("clip_id", F.transform("x", lambda s: s["v"]).alias("x"))
