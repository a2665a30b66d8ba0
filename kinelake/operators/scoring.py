"""Technique scores against quantile templates, their ranking, and feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinelake.functions import labels as rules
from kinelake.functions import texts
from kinelake.session import settle

#: Components, their weights, and the (feature, statistic) pairs they score.
COMPONENTS = {
    "head_stability_score": (0.14, (("head_over_base_offset", "abs_mean"), ("head_to_lead_knee_alignment", "abs_mean"), ("upper_body_balance_offset", "abs_mean"))),
    "front_foot_commitment_score": (0.12, (("front_foot_commitment_signal", "final_mean"), ("stance_to_swing_progress_signal", "final_mean"))),
    "lead_elbow_score": (0.13, (("lead_elbow_angle", "mean"), ("lead_elbow_extension_signal", "final_mean"))),
    "knee_bend_score": (0.12, (("lead_knee_angle", "mean"), ("trail_knee_angle", "mean"))),
    "weight_transfer_score": (0.13, (("weight_transfer_signal", "final_mean"), ("body_center_offset_x", "range"))),
    "follow_through_score": (0.14, (("follow_through_height_signal", "final_mean"), ("follow_through_extension_signal", "final_mean"), ("bat_side_wrist_height_signal", "final_mean"))),
    "rotation_score": (0.12, (("hip_rotation_angle", "range"), ("hip_rotation_velocity", "max_abs"), ("shoulder_hip_separation", "mean"))),
    "balance_score": (0.10, (("stance_width", "mean"), ("body_center_offset_y", "abs_mean"), ("upper_body_balance_offset", "abs_mean"))),
}
LEAST_SPAN, LEAST_SAMPLES, TOLERANCE = 1e-6, 3, 2.0
#: Size of a quantile sketch, and how far off the rank of its quantiles is at most, as a share of the values.
SKETCH_K, RANK_ERROR = 400, 0.0073
MAINTAIN, ISSUE = 85.0, 75.0
#: What a clip without deviations is told, in our own words.
ALL_INSIDE = "Everything that was measured lies inside the usual ranges."
#: Quantiles of a template, and steps in which its values are counted.
QUANTILES, CELLS = (0.1, 0.5, 0.9), 1024


def specs(spark: SparkSession) -> DataFrame:
    """The 20 rows (component, weight, comp_pos, spec_pos, feature, statistic)."""
    rows = [(name, weight, i, 10 * i + j, feature, statistic) for i, (name, (weight, pairs)) in enumerate(COMPONENTS.items()) for j, (feature, statistic) in enumerate(pairs)]
    return spark.createDataFrame(rows, "component string, weight double, comp_pos int, spec_pos int, feature string, statistic string")


def clip_statistics(features: DataFrame, length: int = 60) -> DataFrame:
    """(clip_id, feature, statistic, value) of the pairs that components use."""
    late = int(2 * length / 3)
    how = {
        "mean": lambda x: F.avg(x), "abs_mean": lambda x: F.avg(F.abs(x)), "std": lambda x: F.stddev_pop(x), "max": lambda x: F.max(x),
        "max_abs": lambda x: F.max(F.abs(x)), "range": lambda x: F.max(x) - F.min(x), "final_mean": lambda x: F.avg(F.when(F.col("t") >= late, x)),
    }
    pairs = sorted({p for _, ps in COMPONENTS.values() for p in ps})
    wide = features.groupBy("clip_id").agg(*[how[s](F.col(f)).alias(f"{f}|{s}") for f, s in pairs])
    tall = wide.unpivot(["clip_id"], [f"{f}|{s}" for f, s in pairs], "pair", "value")
    return tall.select("clip_id", F.substring_index("pair", "|", 1).alias("feature"), F.substring_index("pair", "|", -1).alias("statistic"), "value")


def training_clips(clips: DataFrame) -> DataFrame:
    """Of (clip_id, shot, quality), the good ones of classes that have enough of them, else all."""
    good = clips.groupBy("shot").agg(F.count_if(F.col("quality") == "good").alias("_good"))  # one row a class
    return clips.join(F.broadcast(good), "shot").where((F.col("_good") < LEAST_SAMPLES) | (F.col("quality") == "good")).select(*clips.columns)


def templates(stats: DataFrame, clips: DataFrame) -> DataFrame:
    """(shot, feature, statistic, low, high, center, std, n); a class of fewer than three clips fails the job.

    Exact quantiles without a class in one task: values are counted in CELLS equal
    steps between the ends of their group; only the cells that hold a wanted rank
    are ranked, and both neighbours of a quantile are interpolated.
    """
    key = ["shot", "feature", "statistic"]
    rows = settle(stats.join(clips.select("clip_id", "shot"), "clip_id").where("value is not null").select(*key, "value"))
    facts = rows.groupBy(*key).agg(F.min("value").alias("_min"), F.max("value").alias("_max"), F.stddev_pop("value").alias("std"), F.count(F.lit(1)).alias("n"))
    facts = F.broadcast(_enough(facts))  # 20 rows a class
    width = F.col("_max") - F.col("_min")
    cell = F.when(width > 0, F.least(F.lit(CELLS - 1), F.floor((F.col("value") - F.col("_min")) / width * CELLS))).otherwise(0).cast("int")
    placed = rows.join(facts, key).withColumn("_cell", cell)
    cells = placed.groupBy(*key, "n", "_cell").agg(F.count(F.lit(1)).alias("_k"))
    before = Window.partitionBy(*key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_first", F.coalesce(F.sum("_k").over(before), F.lit(0)))
    place = lambda q: (F.col("n") - 1) * q
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(place(q)), F.ceil(place(q))) for q in QUANTILES])))
    wanted = cells.where(F.exists(ranks, lambda r: (r >= F.col("_first")) & (r < F.col("_first") + F.col("_k")))).select(*key, "_cell", "_first")
    ranked = placed.join(F.broadcast(wanted), [*key, "_cell"])  # six cells a group at most
    ranked = ranked.withColumn("_rank", F.col("_first") + F.row_number().over(Window.partitionBy(*key, "_cell").orderBy("value")) - 1)
    at = lambda r: F.max(F.when(F.col("_rank") == r, F.col("value")))
    ends = [(at(F.floor(place(q))), at(F.ceil(place(q))), place(q) - F.floor(place(q))) for q in QUANTILES]
    q = ranked.groupBy(*key, "n", "std").agg(*[(a + (b - a) * F.max(part)).alias(f"_q{i}") for i, (a, b, part) in enumerate(ends)])
    return _widened(q, key)


def _enough(facts: DataFrame) -> DataFrame:
    """facts, failing with class and count where a group has fewer than LEAST_SAMPLES values."""
    told = F.concat(F.lit("class "), F.coalesce("shot", F.lit("NULL")), F.lit(": "), F.col("n").cast("string"), F.lit(f" values of "), "feature", F.lit(f", {LEAST_SAMPLES} are needed"))
    return facts.withColumn("n", F.when(F.col("n") < LEAST_SAMPLES, F.raise_error(told).cast("bigint")).otherwise(F.col("n")))


def _widened(q: DataFrame, key: list[str]) -> DataFrame:
    """Templates of quantiles _q0, _q1, _q2: ranges that are too narrow are widened round the median."""
    center, pad = F.col("_q1"), F.greatest(F.abs("_q1") * 0.05, F.lit(LEAST_SPAN))
    narrow = F.col("_q2") - F.col("_q0") < LEAST_SPAN
    return q.select(*key, F.when(narrow, center - pad).otherwise(F.col("_q0")).alias("low"), F.when(narrow, center + pad).otherwise(F.col("_q2")).alias("high"), center.alias("center"), "std", "n")


def template_sketches(stats: DataFrame, clips: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """A28, opt-in for classes of very many clips: (shot, feature, statistic, sketch, n, total, squares), which new clips add to.

    One pass and one row a group whatever its size; before, sketches made earlier, are merged
    in. The KLL sketches keep SKETCH_K values a level; a quantile's rank is off by RANK_ERROR
    of the group's size at most, with 99 % confidence.
    """
    key = ["shot", "feature", "statistic"]
    rows = stats.join(clips.select("clip_id", "shot"), "clip_id").where("value is not null")
    made = rows.groupBy(*key).agg(
        F.kll_sketch_agg_double("value", SKETCH_K).alias("sketch"), F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.sum(F.col("value") * F.col("value")).alias("squares"),
    )
    if before is None:
        return made
    both = made.unionByName(before.select(*made.columns))
    return both.groupBy(*key).agg(F.kll_merge_agg_double("sketch", SKETCH_K).alias("sketch"), *[F.sum(c).alias(c) for c in ("n", "total", "squares")])


def sketched_templates(sketches: DataFrame) -> DataFrame:
    """A28 from ``template_sketches``: the columns of ``templates``, quantiles to RANK_ERROR."""
    key = ["shot", "feature", "statistic"]
    mean = F.col("total") / F.col("n")
    std = F.sqrt(F.greatest(F.lit(0.0), F.col("squares") / F.col("n") - mean * mean)).alias("std")
    quantiles = [F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias(f"_q{i}") for i, q in enumerate(QUANTILES)]
    return _widened(_enough(sketches).select(*key, "n", std, *quantiles), key)


def deviations(stats: DataFrame, predicted: DataFrame, template: DataFrame) -> DataFrame:
    """Clip x spec rows with score and deviation from the template of the predicted class.

    Templates are 20 rows a class, so Spark broadcasts them by their size. A predicted class
    without templates fails the job.
    """
    known = template.select("shot").distinct().withColumn("_known", F.lit(True))
    named = predicted.select("clip_id", "shot").join(F.broadcast(known), "shot", "left")
    lost = F.raise_error(F.concat(F.lit("no templates of class "), F.coalesce("shot", F.lit("NULL"))))
    named = named.select("clip_id", F.when(F.col("_known"), F.col("shot")).otherwise(lost.cast("string")).alias("shot"))
    joined = stats.join(named, "clip_id").join(template, ["shot", "feature", "statistic"]).join(F.broadcast(specs(stats.sparkSession)), ["feature", "statistic"])
    away = F.when(F.col("value") < F.col("low"), F.col("low") - F.col("value")).when(F.col("value") > F.col("high"), F.col("value") - F.col("high")).otherwise(0.0)
    span = F.greatest(F.col("high") - F.col("low"), F.lit(LEAST_SPAN))
    return joined.withColumn("deviation", away).withColumn("score", F.greatest(F.lit(0.0), (1.0 - F.col("deviation") / (span * TOLERANCE)) * 100.0))


def components(devs: DataFrame) -> DataFrame:
    """Mean score of each clip's components."""
    return devs.groupBy("clip_id", "shot", "component", "weight", "comp_pos").agg(F.avg("score").alias("score"))


def scores(comps: DataFrame) -> DataFrame:
    """Total, weakest component (first on ties), two strongest and two weakest."""
    ordered = F.array_sort(F.collect_list(F.struct("score", "comp_pos", "component")))
    best = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "comp_pos", "component")))
    names = lambda a: F.array_join(F.transform(F.slice(a, 1, 2), lambda x: x["component"]), ",")
    return comps.groupBy("clip_id", "shot").agg(F.round(F.sum(F.col("weight") * F.col("score")), 4).alias("technique_score"), F.min_by("component", F.struct("score", "comp_pos")).alias("weakest"), names(best).alias("strongest_two"), names(ordered).alias("weakest_two"))


def score_summary(scored: DataFrame) -> DataFrame:
    """Totals over all clips by weakest component, and over all (weakest NULL)."""
    return scored.rollup("weakest").agg(F.count(F.lit(1)).alias("clips"), F.round(F.avg("technique_score"), 4).alias("mean_score"), F.min("technique_score").alias("min_score"), F.max("technique_score").alias("max_score"))


def component_means(comps: DataFrame) -> DataFrame:
    """Mean, ends and number of scores outside 0 to 100 of each component."""
    outside = ~F.col("score").between(0.0, 100.0)
    return comps.groupBy("component").agg(F.avg("score").alias("mean_score"), F.min("score").alias("min_score"), F.max("score").alias("max_score"), F.count_if(F.coalesce(outside, F.lit(True))).alias("outside"))


def worst_deviations(devs: DataFrame, most: int = 5) -> DataFrame:
    """The five worst scores under 100 of a clip, repeats of feature, statistic and value dropped; a clip without any has one standing sentence."""
    order = [F.col("score"), F.desc("deviation"), F.col("spec_pos")]
    low = devs.where("score < 100").withColumn("again", F.row_number().over(Window.partitionBy("clip_id", "feature", "statistic", F.round("value", 6)).orderBy(*order))).where("again = 1")
    ranked = low.withColumn("rank", F.row_number().over(Window.partitionBy("clip_id").orderBy(*order))).where(F.col("rank") <= most)
    sentence = F.format_string("%s %s of %s lies %s the usual range", F.replace("feature", F.lit("_"), F.lit(" ")), F.replace("statistic", F.lit("_"), F.lit(" ")), texts.fixed(F.col("value"), 4), rules.direction(F.col("value"), F.col("low"), F.col("high")))
    told = ranked.select("clip_id", "rank", "feature", "statistic", sentence.alias("sentence"))
    clean = devs.groupBy("clip_id").agg(F.count_if(F.col("score") < 100).alias("n")).where("n = 0")
    nothing = F.lit(None).cast("string")
    return told.unionByName(clean.select("clip_id", F.lit(1).alias("rank"), nothing.alias("feature"), nothing.alias("statistic"), F.lit(ALL_INSIDE).alias("sentence")))


def issues(devs: DataFrame, most: int = 3) -> DataFrame:
    """Up to three features of a clip that score under 75, worst first, each feature once."""
    order = [F.col("score"), F.desc("deviation"), F.col("spec_pos")]
    once = devs.where(F.col("score") < ISSUE).withColumn("again", F.row_number().over(Window.partitionBy("clip_id", "feature").orderBy(*order))).where("again = 1")
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("clip_id").orderBy(*order))).where(F.col("rank") <= most)
    return ranked.select("clip_id", "rank", "feature", "component", rules.severity(F.col("score")).alias("severity"), rules.direction(F.col("value"), F.col("low"), F.col("high")).alias("direction"))


def recommendations(comps: DataFrame, lowest: int = 3) -> DataFrame:
    """Of the three lowest components those under 85; where there are none, upkeep."""
    ranked = comps.withColumn("rank", F.row_number().over(Window.partitionBy("clip_id").orderBy("score", "comp_pos"))).where(F.col("rank") <= lowest)
    names = F.array_sort(F.collect_list(F.when(F.col("score") < MAINTAIN, F.struct("rank", "component"))))
    return ranked.groupBy("clip_id").agg(names.alias("n")).select("clip_id", F.when(F.size("n") > 0, F.array_join(F.transform("n", lambda x: x["component"]), ",")).otherwise("keep_up").alias("recommendation"))


def feedback(scored: DataFrame, found: DataFrame) -> DataFrame:
    """band, tips, detailed and spoken text of each clip."""
    tips = issue_tips(found).groupBy("clip_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "tip"))), lambda x: x["tip"]).alias("tips"))
    own = scored.join(tips, "clip_id", "left")
    n = F.coalesce(F.size("tips"), F.lit(0))
    upkeep = F.concat(F.lit("Keep up your "), F.replace(F.replace("weakest", F.lit("_score"), F.lit("")), F.lit("_"), F.lit(" ")), F.lit("."))
    first = F.when(n > 0, F.get("tips", F.lit(0))).otherwise(upkeep)
    shot = F.replace("shot", F.lit("_"), F.lit(" "))
    detailed = F.format_string("%s: technique %s of 100 (%s), %d issue(s). %s", shot, texts.fixed(F.col("technique_score"), 1), rules.band(F.col("technique_score")), n, first)
    spoken = F.when((n == 0) & (F.col("technique_score") >= MAINTAIN), F.concat(F.lit("Great "), shot, F.lit("."))).otherwise(F.concat(F.lit("Your "), shot, F.lit(" scored "), texts.fixed(F.col("technique_score"), 0), F.lit(". "), first))
    return own.select("clip_id", n.alias("issue_count"), rules.band(F.col("technique_score")).alias("band"), detailed.alias("detailed"), spoken.alias("spoken"))


def issue_tips(found: DataFrame) -> DataFrame:
    """issues with the texts of their feature (issue, why, tip); a feature without any has its component's tip and side."""
    spark = found.sparkSession
    own, general = F.broadcast(texts.feature_table(spark)), F.broadcast(texts.component_table(spark))
    label = F.replace(F.regexp_replace("component", "_score$", ""), F.lit("_"), F.lit(" "))
    told = found.join(own, "feature", "left").join(general, "component", "left")
    return told.select(
        *found.columns, F.coalesce("issue", F.concat(F.lit("The "), label, F.lit(" lies "), "direction", F.lit(" the usual range."))).alias("issue"),
        F.coalesce("why", F.concat(F.initcap(label), F.lit(" makes a shot repeatable."))).alias("why"), F.coalesce("tip", "general").alias("tip"),
    )


def feedback_summary(made: DataFrame) -> DataFrame:
    """One row: clips, issues, clips with spoken text, and whether all have spoken and detailed texts."""
    filled = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    return made.agg(
        F.count(F.lit(1)).alias("samples"), F.sum("issue_count").alias("issues"), F.count_if(filled("spoken")).alias("with_spoken"),
        F.bool_and(filled("spoken")).alias("spoken_present"), F.bool_and(filled("detailed")).alias("detailed_present"),
    )
