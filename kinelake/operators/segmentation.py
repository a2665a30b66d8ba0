"""Motion energy and the shot automaton."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the motion features and thresholds of the automaton.
MOTION_WEIGHTS = {"lead_wrist_velocity": 1.0, "trail_wrist_velocity": 0.85, "lead_elbow_velocity": 0.45, "trail_elbow_velocity": 0.35, "body_center_velocity": 0.8, "lead_wrist_acceleration": 0.55, "frame_motion_energy": 1.25}
START, ACTIVE, END = 0.28, 0.18, 0.12
LEAST_PREPARATION, LEAST_SWING, STABLE, COOLDOWN = 2, 4, 4, 8
TRACE = "clip_id bigint, step int, t int, energy double, state string, transition string, triggered boolean"
SEGMENT = "clip_id bigint, start_frame int, end_frame int, peak_frame int, trigger_frame int, trigger_count int, completion_reason string, max_energy double, mean_energy double"


def motion_energy(features: DataFrame, weights: dict[str, float] | None = None, window: int = 5) -> DataFrame:
    """(clip_id, t, raw, normalised, smoothed).

    raw is the weighted sum of the features that are there; the scale is the
    clip's 95th percentile (or its maximum where that is tiny). The moving average
    repeats the first and last value beyond the ends and always divides by window.

    Means of the same values in another order tie, and the first of them is the peak only
    as rounding lets it: so the percentile weighs its neighbours with one rounding less
    (a fused multiply-add) and values are added by their time, as the comparison SQL does.
    """
    used = {k: abs(w) for k, w in (weights or MOTION_WEIGHTS).items() if k in features.columns}
    if not used:
        raise ValueError("none of the weighted features is there")
    raw = features.select("clip_id", "t", sum((F.abs(F.col(k)) * w for k, w in used.items()), F.lit(0.0)).alias("raw"))
    clip = Window.partitionBy("clip_id")
    rank, place = F.row_number().over(clip.orderBy(F.asc_nulls_last("raw"))) - 1, (F.count("raw").over(clip) - 1) * 0.95
    ranked = raw.withColumns({"_rank": rank, "_place": place, "top": F.max("raw").over(clip)})
    at = lambda r: F.max(F.when(F.col("_rank") == r, F.col("raw"))).over(clip)
    ends = ranked.withColumns({"_low": at(F.floor("_place")), "_high": at(F.ceil("_place"))})
    part = F.col("_place") - F.floor("_place")
    fused = F.java_method(F.lit("java.lang.Math"), F.lit("fma"), F.col("_low"), F.lit(1.0) - part, F.col("_high") * part).cast("double")
    p95 = F.when(F.col("_low").isNotNull() & F.col("_high").isNotNull(), fused)
    scale = F.when(p95 >= 1e-6, p95).otherwise(F.greatest(F.col("top"), F.lit(1e-6)))
    scaled = ends.select("clip_id", "t", "raw", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("raw") / scale)).alias("normalised"))
    if window <= 1:
        return scaled.select("clip_id", "t", "raw", "normalised", F.col("normalised").alias("smoothed"))
    left, right = window // 2, window - 1 - window // 2
    order = clip.orderBy("t")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = (end("normalised").over(whole) for end in (F.first, F.last))
    beside = [F.coalesce(F.lead("normalised", by).over(order), last if by > 0 else first) for by in range(-left, right + 1)]
    return scaled.select("clip_id", "t", "raw", "normalised", F.greatest(F.lit(0.0), F.least(F.lit(1.0), sum(beside, F.lit(0.0)) / window)).alias("smoothed"))


#: What a frame does to the counters of a state, before its rules are looked at.
TICKS = {
    "preparation": lambda m, e: {"count": m.count + 1},
    "backswing": lambda m, e: {"swing": m.swing + 1},
    "swing": lambda m, e: {"swing": m.swing + 1},
    "follow_through": lambda m, e: {"count": m.count + 1 if e <= m.end else 0},
    "cooldown": lambda m, e: {"count": m.count - 1},
}
#: Of each state: (test, next state, what is set then, suffix of the transition's name); the first test that holds.
RULES = {
    "idle": ((lambda m, e: e >= m.start, "preparation", lambda m, t, e: {"begun": t, "count": 1}, ""),),
    "preparation": (
        (lambda m, e: e < m.active, "idle", lambda m, t, e: {"begun": -1, "count": 0}, ""),
        (lambda m, e: m.count >= LEAST_PREPARATION, "backswing", None, ""),
    ),
    "backswing": (
        (lambda m, e: e >= m.start, "swing", None, ""),
        (lambda m, e: m.swing >= LEAST_SWING, "swing", None, "_by_duration"),
    ),
    "swing": ((lambda m, e: m.swing >= LEAST_SWING and e < m.active, "follow_through", lambda m, t, e: {"count": int(e <= m.end)}, ""),),
    "follow_through": ((lambda m, e: m.count >= STABLE, "completed", lambda m, t, e: {"ended": t}, ""),),
    "completed": ((lambda m, e: True, "cooldown", lambda m, t, e: {"count": COOLDOWN}, ""),),
    "cooldown": ((lambda m, e: m.count <= 0 and e <= m.active, "idle", None, ""),),
}
#: States in which a sequence's end completes the shot.
UNFINISHED = ("preparation", "backswing", "swing", "follow_through")
#: What is kept between frames, and how it begins.
KEPT = {"state": "idle", "count": 0, "begun": -1, "ended": -1, "trigger": -1, "swing": 0, "peak": -1, "peak_energy": 0.0, "energy": 0.0}


class Automaton:
    """ST1: one step a frame through the table of rules; batch trace, segments and stream share it."""

    def __init__(self, start: float = START, active: float = ACTIVE, end: float = END, saved: tuple | None = None) -> None:
        self.start, self.active, self.end = start, active, end
        self.__dict__.update(zip(KEPT, saved, strict=True) if saved else KEPT)

    def saved(self) -> tuple:
        return tuple(getattr(self, name) for name in KEPT)

    def step(self, t: int, energy: float) -> tuple[str, bool]:
        """(transition, triggered) of one frame."""
        self.energy = energy
        if energy > self.peak_energy:
            self.peak_energy, self.peak = energy, t
        was = self.state
        if was in TICKS:
            self.__dict__.update(TICKS[was](self, energy))
        for test, following, effect, suffix in RULES[was]:
            if test(self, energy):
                self.state = following
                self.__dict__.update(effect(self, t, energy) if effect else {})
                return f"{was}_to_{following}{suffix}", following == "completed" and self._fire(t)
        return "", False

    def _fire(self, t: int) -> bool:
        """One trigger until the automaton is armed again."""
        fired = self.trigger < 0
        self.trigger = t if fired else self.trigger
        return fired

    def finish(self, t: int) -> bool:
        """ST2: complete an active shot at the end of its sequence."""
        if self.trigger >= 0 or self.begun < 0 or self.state not in UNFINISHED:
            return False
        self.state, self.ended = "completed", t
        return self._fire(t)


def trace(energy: DataFrame) -> DataFrame:
    """ST1, ST2: one row a frame and clip, and one more where the end forces completion; energy has clip_id, t, smoothed.

    A group is one clip and holds two columns of it.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        machine, rows, clip = Automaton(), [], pdf["clip_id"].iloc[0]
        for step, (t, e) in enumerate(zip(pdf["t"].tolist(), pdf["smoothed"].tolist(), strict=True)):
            why, fired = machine.step(t, e)
            rows.append((clip, step, t, e, machine.state, why, fired))
        if machine.finish(t):
            rows.append((clip, step + 1, t, e, machine.state, "sequence_end_to_completed", True))
        return pd.DataFrame(rows, columns=["clip_id", "step", "t", "energy", "state", "transition", "triggered"])

    return energy.select("clip_id", "t", "smoothed").groupBy("clip_id").applyInPandas(run, TRACE)


def segments(energy: DataFrame) -> DataFrame:
    """ST3: one row a clip; no segment columns without a start or trigger."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        machine, count, clip = Automaton(), 0, pdf["clip_id"].iloc[0]
        for t, e in zip(pdf["t"].tolist(), pdf["smoothed"].tolist(), strict=True):
            count += machine.step(t, e)[1]
        forced = machine.finish(t)
        count += forced
        reason = "sequence_end_completion" if forced else "stabilized_follow_through" if count else "no_shot_detected"
        whole = machine.begun >= 0 and machine.trigger >= 0
        frames = [x if whole and x >= 0 else None for x in (machine.begun, machine.ended, machine.peak, machine.trigger)]
        return pd.DataFrame([(clip, *frames, count, reason, float(pdf["smoothed"].max()), float(pdf["smoothed"].mean()))], columns=["clip_id", "start_frame", "end_frame", "peak_frame", "trigger_frame", "trigger_count", "completion_reason", "max_energy", "mean_energy"]).astype(dict.fromkeys(("start_frame", "end_frame", "peak_frame", "trigger_frame"), "Int64"))

    return energy.select("clip_id", "t", "smoothed").groupBy("clip_id").applyInPandas(run, SEGMENT)


def segmentation_summary(found: DataFrame) -> DataFrame:
    """Sequences, detected ones, those of one trigger, forced ends; passed if all are detected by one trigger."""
    counted = found.agg(
        F.count(F.lit(1)).alias("sequences"), F.count_if(F.col("trigger_frame").isNotNull()).alias("detected"), F.count_if(F.col("trigger_count") == 1).alias("single_trigger"),
        F.count_if(F.col("completion_reason") == "sequence_end_completion").alias("forced"),
    )
    return counted.withColumn("passed", (F.col("detected") == F.col("sequences")) & (F.col("single_trigger") == F.col("sequences")))
