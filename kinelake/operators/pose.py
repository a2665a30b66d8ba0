"""Pose documents: flatten, inspect, clean, normalise, align, resample, interpolate, verify.

Frames are rows (clip_id, pos, frame_index, ts, landmarks); landmarks stay in their
array and are worked on with higher-order functions or over Arrow batches, so nothing but
verification and interpolation multiplies rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StructField, StructType

from kinelake.functions import geometry as g

VISIBLE = 0.3


def flatten(docs: DataFrame) -> DataFrame:
    """One row a frame, with the document's other columns and the frame's other parts (frame_*); clips without frames keep one row with NULL frame columns."""
    others = [c for c in docs.columns if c != "frames"]
    own = [f.name for f in docs.schema["frames"].dataType.elementType.fields if f.name not in ("frame_index", "timestamp", "landmarks")]
    return docs.select(*others, F.posexplode_outer("frames").alias("pos", "frame")).select(
        *others, "pos", F.col("frame.frame_index").alias("frame_index"), F.col("frame.timestamp").alias("ts"), F.col("frame.landmarks").alias("landmarks"),
        *[F.col(f"frame.{name}").alias(f"frame_{name}") for name in own],
    )


def sample_frames(frames: DataFrame, every: int, fps: Column) -> DataFrame:
    """Every n-th frame, timed by index / fps, NULL without a positive fps."""
    return frames.where(F.col("frame_index") % every == 0).withColumn("ts", F.when(fps > 0, F.col("frame_index") / fps))


def mean_visibility(landmarks: Column) -> Column:
    """Missing values count as 0; an empty frame has 0."""
    total = F.aggregate(landmarks, F.lit(0.0), lambda acc, m: acc + F.coalesce(g.finite(m["visibility"]), F.lit(0.0)))
    return F.when(F.size(landmarks) > 0, total / F.size(landmarks)).otherwise(0.0)


def inspect(frames: DataFrame, low: float = 0.5) -> DataFrame:
    """A1: frames, missing and low-visibility frames, and their ratios of each clip."""
    real = F.col("pos").isNotNull()
    missing = real & (F.coalesce(F.size("landmarks"), F.lit(-1)) <= 0)
    weak = real & ~missing & (mean_visibility(F.col("landmarks")) < low)
    counted = frames.groupBy("clip_id").agg(F.count_if(real).alias("total_frames"), F.count_if(missing).alias("missing_frames"), F.count_if(weak).alias("low_visibility_frames"))
    ratio = lambda n: F.when(F.col("total_frames") > 0, F.col(n) / F.col("total_frames")).otherwise(0.0)
    return counted.withColumn("missing_ratio", ratio("missing_frames")).withColumn("low_visibility_ratio", ratio("low_visibility_frames"))


def inspection_summary(inspected: DataFrame, short: int = 30, missing: float = 0.3) -> DataFrame:
    """Lengths over all clips, first clip on ties, and number of clips with issues."""
    return inspected.agg(
        F.count(F.lit(1)).alias("clips"),
        F.avg("total_frames").alias("mean_frames"),
        F.min_by("clip_id", F.struct("total_frames", "clip_id")).alias("shortest"),
        F.min_by("clip_id", F.struct((-F.col("total_frames")).alias("n"), "clip_id")).alias("longest"),
        F.count_if((F.col("total_frames") < short) | (F.col("missing_ratio") > missing)).alias("with_issues"),
    )


def visible(frames: DataFrame, threshold: float = VISIBLE) -> DataFrame:
    """P5: frames with landmarks and a mean visibility of the threshold at least."""
    return frames.where((F.size("landmarks") > 0) & (mean_visibility(F.col("landmarks")) >= threshold))


def renumber(frames: DataFrame) -> DataFrame:
    """P5: a clip's frames numbered from 0 by their order, whatever other columns they have."""
    return frames.withColumn("pos", (F.row_number().over(Window.partitionBy("clip_id").orderBy("pos")) - 1).cast("int"))


def clean(frames: DataFrame, threshold: float = VISIBLE) -> DataFrame:
    """P5: ``visible`` frames, renumbered by their order."""
    return renumber(visible(frames, threshold))


def cleaning_counts(frames: DataFrame, threshold: float = VISIBLE) -> DataFrame:
    """A2: frames before, removed and after, by clip and in total (clip_id NULL)."""
    bad = (F.coalesce(F.size("landmarks"), F.lit(-1)) <= 0) | (mean_visibility(F.col("landmarks")) < threshold)
    return frames.where("pos is not null").rollup("clip_id").agg(F.count(F.lit(1)).alias("before"), F.count_if(bad).alias("removed"), F.count_if(~bad).alias("after"))


def step_counts(frames: DataFrame) -> DataFrame:
    """A2: frames, changed frames and warnings of ``normalise`` or ``align`` (column ok), by clip and in total (clip_id NULL)."""
    return frames.rollup("clip_id").agg(F.count(F.lit(1)).alias("frames"), F.count_if("ok").alias("changed"), F.count_if(~F.col("ok")).alias("warnings"))


class Marks:
    """Landmarks of an Arrow batch: their parts one after the other, and the frame and the place of each."""

    def __init__(self, landmarks: pa.Array) -> None:
        self.absent = landmarks.is_null()
        self.parts = landmarks.flatten()
        self.sizes = pc.fill_null(pc.list_value_length(landmarks), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.frame = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.place = np.arange(len(self.frame)) - self.starts[self.frame]

    def part(self, name: str) -> pa.Array:
        """A part of every landmark, null where the landmark is."""
        return pc.struct_field(self.parts, name)

    def coordinates(self) -> np.ndarray:
        """x, y, z of every landmark; NaN for what isn't a finite number."""
        xyz = np.stack([self.part(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in "xyz"])
        return np.where(np.isfinite(xyz), xyz, np.nan)

    def point(self, xyz: np.ndarray, place: int) -> np.ndarray:
        """A landmark of every frame, NaN if it is missing or any part isn't a finite number."""
        there = np.flatnonzero(self.sizes > place)
        found = np.full((3, len(self.sizes)), np.nan)
        found[:, there] = xyz[:, self.starts[there] + place]
        return np.where(np.isnan(found).any(axis=0), np.nan, found)

    def listed(self, parts: pa.StructArray, ends: np.ndarray) -> pa.ListArray:
        """Landmarks of frames again, that end at ends; absent lists stay so."""
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), parts, mask=self.absent)


def _moved(frames: DataFrame, move: Callable[[Marks, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """frames with moved landmarks and ok; visibility and any other part kept.

    move gets the coordinates of an Arrow batch's landmarks and gives the new ones, which of these
    count, and which frames are ok. As SQL lambdas these were interpreted for every coordinate.
    """
    marks = frames.schema["landmarks"].dataType.elementType
    others = [f for f in marks.fields if f.name not in ("x", "y", "z")]
    kind = ArrayType(StructType([*[StructField(c, DoubleType()) for c in "xyz"], *others]))

    def made(landmarks: pa.Array) -> pa.Array:
        held = Marks(landmarks)
        with np.errstate(all="ignore"):
            moved, told, ok = move(held, held.coordinates())
        changed = ok[held.frame]
        parts = []
        for c, new, counts in zip("xyz", moved, told & changed, strict=True):
            old = held.part(c).cast(pa.float64())
            values = np.where(counts, new, old.to_numpy(zero_copy_only=False))
            parts.append(pa.array(values, mask=~counts & old.is_null().to_numpy(zero_copy_only=False)))
        parts += [held.part(f.name) for f in others]
        # A missing landmark of a changed frame has parts that are missing.
        gone = held.parts.is_null().to_numpy(zero_copy_only=False) & ~changed
        points = pa.StructArray.from_arrays(parts, [*"xyz", *[f.name for f in others]], mask=pa.array(gone))
        return pa.StructArray.from_arrays([held.listed(points, held.ends), pa.array(ok)], ["landmarks", "ok"])

    step = F.arrow_udf(made, StructType([StructField("landmarks", kind), StructField("ok", BooleanType())])).asNondeterministic()
    staged = frames.withColumn("_moved", step("landmarks"))
    return staged.withColumns({"landmarks": F.col("_moved.landmarks"), "ok": F.col("_moved.ok")}).drop("_moved")


def normalise(frames: DataFrame, fallback: bool = False) -> DataFrame:
    """Origin at the hips' middle, shoulder-hip distance as unit; column ok.

    Frames with under 25 landmarks, invalid reference points or no distance stay
    unchanged with ok false. P6b (fallback): the unit is the torso, else the
    extent in y, else 1.
    """

    def move(held: Marks, xyz: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hips, shoulders = (np.add(*(held.point(xyz, k) for k in pair)) / 2.0 for pair in (g.HIPS, g.SHOULDERS))
        away = shoulders - hips
        torso = np.sqrt(sum(d * d for d in away))
        if fallback:
            unit = np.where(torso > 1e-6, torso, 1.0)
            full = np.flatnonzero(held.sizes)
            extent = np.full(len(unit), np.nan)
            if len(full):
                extent[full] = np.fmax.reduceat(xyz[1], held.starts[full]) - np.fmin.reduceat(xyz[1], held.starts[full])
            unit = np.where(~(torso > 1e-6) & (extent > 1e-6), extent, unit)
        else:
            unit = np.where(torso > 0, torso, np.nan)
        ok = (held.sizes >= 25) & ~np.isnan(hips).any(axis=0) & ~np.isnan(unit)
        return (xyz - hips[:, held.frame]) / unit[held.frame], ~np.isnan(xyz), ok

    return _moved(frames, move)


def align(frames: DataFrame) -> DataFrame:
    """Turn every landmark so that the shoulder line is level; unchanged with ok false if it can't be told."""

    def move(held: Marks, xyz: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        left, right = (held.point(xyz, k) for k in g.SHOULDERS)
        turn = -np.arctan2(right[1] - left[1] + 0.0, right[0] - left[0] + 0.0)
        ok = (held.sizes >= 13) & ~np.isnan(turn)
        cos, sin = np.cos(turn)[held.frame], np.sin(turn)[held.frame]
        x, y, z = xyz
        told = ~np.isnan(x) & ~np.isnan(y)
        return np.stack([x * cos - y * sin, x * sin + y * cos, z]), np.stack([told, told, np.zeros_like(told)]), ok

    return _moved(frames, move)


def resample(frames: DataFrame, length: int = 60) -> DataFrame:
    """Length frames a clip, at floor(i (n - 1) / (length - 1)); source index and time stay.

    Each frame finds the places that it fills among the few that can lie at its
    position, so a clip is neither collected nor joined with itself.
    """
    n, pos, last = F.count(F.lit(1)).over(Window.partitionBy("clip_id")), F.col("pos"), max(length - 1, 1)
    place = lambda t: F.floor(t * (F.col("_n") - 1) / F.lit(float(last))).cast("int")
    low = F.greatest(F.lit(0), F.floor(pos * last / (F.col("_n") - 1)).cast("int") - 1)
    high = F.least(F.lit(length - 1), F.ceil((pos + 1) * last / (F.col("_n") - 1)).cast("int") + 1)
    near = F.filter(F.sequence(low, F.greatest(low, high)), lambda t: place(t) == pos)
    fills = (
        F.when(F.col("_n") == length, F.array(pos.cast("int")))
        .when(F.lit(length == 1), F.when(pos == 0, F.array(F.lit(0))))
        .when(F.col("_n") == 1, F.sequence(F.lit(0), F.lit(length - 1))).otherwise(near)
    )
    others = [c for c in frames.columns if c != "pos"]
    return frames.withColumn("_n", n).select(*others, F.col("pos").alias("source_pos"), F.explode(fills).alias("t"))


def fixed_length(docs: DataFrame, length: int = 60) -> DataFrame:
    """Frames arrays cut by truncated equal steps, or padded with their last frame."""
    n = F.size("frames")
    cut = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.get("frames", F.floor(i * (n - 1) / F.lit(float(max(length - 1, 1)))).cast("int")))
    padded = F.concat("frames", F.array_repeat(F.element_at("frames", -1), F.lit(length) - n))
    return docs.withColumn("frames", F.when(n > length, cut).when(n > 0, padded).otherwise(F.col("frames")))


def flat_vector(landmarks: Column) -> Column:
    """X, y, z, visibility of all landmarks in one array."""
    return F.flatten(F.transform(landmarks, lambda m: F.array(m["x"], m["y"], m["z"], m["visibility"])))


def interpolate(frames: DataFrame, chunk: str = "clip_id") -> DataFrame:
    """Fill missing parts over time: linear inside, nearest at the ends, 0 without any valid value.

    Spark flattens the landmarks; an Arrow group a clip is one matrix of frames by
    132 series, and Spark makes landmarks of it again.
    """
    part = lambda m: F.array(*[g.finite(m[c]) for c in "xyz"], F.when(m.isNotNull(), F.coalesce(g.finite(m["visibility"]), F.lit(0.0))))
    places = F.sequence(F.lit(0), F.lit(g.LANDMARKS - 1))
    flat = frames.select("clip_id", "pos", F.flatten(F.transform(places, lambda k: part(F.get("landmarks", k)))).alias("flat"))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        data = np.stack(pdf["flat"].to_numpy()).astype(np.float64)
        times = np.arange(len(data))
        for series in data.T:
            valid = np.flatnonzero(~np.isnan(series))
            series[:] = np.interp(times, valid, series[valid]) if len(valid) else 0.0
        return pdf.assign(flat=list(data))

    filled = flat.groupBy(chunk).applyInPandas(fill, flat.schema)
    mark = lambda k: F.struct(*[F.get("flat", k * 4 + i).alias(c) for i, c in enumerate(("x", "y", "z", "visibility"))])
    return filled.select("clip_id", "pos", F.transform(places, mark).alias("landmarks"))


def verify(frames: DataFrame) -> DataFrame:
    """Issues of each clip: counts by code; clips without frames have no_frames."""
    landmarks = frames.withColumn("m", F.explode_outer("landmarks"))
    bad = lambda c: F.col("m").isNotNull() & g.finite(F.col(f"m.{c}")).isNull()
    code = (
        F.when(F.col("pos").isNull(), "no_frames").when(F.col("m").isNull(), "no_landmarks")
        .when(bad("x") | bad("y") | bad("z"), "bad_coordinate").when(bad("visibility"), "bad_visibility")
    )
    return landmarks.select("clip_id", code.alias("issue")).where("issue is not null").groupBy("clip_id", "issue").count().withColumnRenamed("count", "n")


def overlay_frame(frames: DataFrame) -> DataFrame:
    """Of the middle third of a clip, the frame with the highest mean visibility, first on ties."""
    n = F.count(F.lit(1)).over(Window.partitionBy("clip_id"))
    low, high = F.floor(F.col("n") / 3), F.greatest(F.floor(F.col("n") / 3) + 1, F.floor(F.col("n") * 2 / 3))
    seen = frames.where("pos is not null").withColumn("n", n).where((F.col("pos") >= low) & (F.col("pos") < high) & (F.size("landmarks") > 0)).withColumn("visibility", mean_visibility(F.col("landmarks")))
    return seen.groupBy("clip_id").agg(F.min_by(F.struct("pos", "visibility"), F.struct((-F.col("visibility")).alias("v"), "pos")).alias("best")).select("clip_id", F.col("best.pos").alias("pos"), F.round("best.visibility", 6).alias("visibility"))
