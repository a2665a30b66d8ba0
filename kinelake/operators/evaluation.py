"""Evaluation of classifier predictions: metrics, calibration, comparison of models.

Predictions are (row_index, true_label, probabilities map<string, double>, ...).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinelake.functions.labels import SHOTS

EPSILON = 1e-12


def first_filled_text(*columns: Column) -> Column:
    """the first of several columns that isn't blank."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def score_rows(predictions: DataFrame, labels: tuple[str, ...] = SHOTS) -> DataFrame:
    """p array, predicted label (first on ties), confidence, correct, nll, brier, and error.

    Missing classes count as 0; a negative probability or a sum that isn't
    positive is an error, and such rows have no measures.
    """
    raw = F.transform(F.array(*[F.lit(x) for x in labels]), lambda name: F.coalesce(F.col("probabilities")[name], F.lit(0.0)))
    staged = predictions.withColumn("p", raw).withColumn("_sum", F.aggregate("p", F.lit(0.0), lambda a, x: a + x))
    error = F.when(F.array_min("p") < 0, "negative").when(F.col("_sum") <= 0, "empty").when(~F.col("true_label").isin(*labels) | F.col("true_label").isNull(), "unknown_label")
    staged = staged.withColumn("error", error).withColumn("p", F.when(F.col("error").isNull(), F.transform("p", lambda x: x / F.col("_sum"))))
    best = F.array_position("p", F.array_max("p")).cast("int")
    names = F.array(*[F.lit(x) for x in labels])
    place = F.array_position(names, F.col("true_label")).cast("int")
    true_p = F.get("p", place - 1)
    return staged.withColumns({
        "predicted_label": F.get(names, best - 1),
        "confidence": F.array_max("p"),
        "correct": F.get(names, best - 1) == F.col("true_label"),
        "nll": -F.log(F.greatest(true_p, F.lit(EPSILON))),
        "brier": F.aggregate("p", F.lit(0.0), lambda a, x: a + x * x) - true_p * 2.0 + 1.0,
    }).drop("_sum")


def softmax(logits: Column) -> Column:
    """each exponential and their sum are made once: the sum travels with them in a one-element array."""
    exps = F.transform(F.array(F.array_max(logits)), lambda top: F.transform(logits, lambda x: F.exp(x - top)))
    summed = F.transform(exps, lambda e: F.struct(e.alias("e"), F.aggregate(e, F.lit(0.0), lambda a, y: a + y).alias("s")))
    return F.get(F.transform(summed, lambda r: F.transform(r["e"], lambda x: x / r["s"])), F.lit(0))


def extract_probabilities(rows: DataFrame) -> DataFrame:
    """rows with a probabilities map from the first place that is there, and error where none is.

    Precedence of columns: probabilities, class_probabilities, the same in prediction,
    then prob_<class> columns that aren't blank. Texts are JSON objects.
    """
    kinds = dict(rows.dtypes)

    def parsed(column: Column, kind: str) -> Column:
        return F.from_json(column, "map<string,double>") if kind == "string" else column.cast("map<string,double>")

    places = [parsed(F.col(n), kinds[n]) for n in ("probabilities", "class_probabilities") if n in kinds]
    if kinds.get("prediction", "").startswith("struct"):
        inner = dict(rows.select("prediction.*").dtypes)
        places += [parsed(F.col(f"prediction.{n}"), inner[n]) for n in ("probabilities", "class_probabilities") if n in inner]
    single = [c for c in rows.columns if c.startswith("prob_")]
    if single:
        entries = F.array_compact(F.array(*[F.when(F.trim(F.col(c).cast("string")) != "", F.struct(F.lit(c.removeprefix("prob_")).alias("k"), F.col(c).try_cast("double").alias("v"))) for c in single]))
        places.append(F.when(F.size(entries) > 0, F.map_from_entries(entries)))
    found = F.coalesce(*places) if places else F.lit(None).cast("map<string,double>")
    return rows.withColumn("probabilities", found).withColumn("extraction_error", F.when(F.col("probabilities").isNull(), "missing_probabilities"))


def confusion(scored: DataFrame, labels: tuple[str, ...] = SHOTS) -> DataFrame:
    """Every pair of labels with its count, also those that don't occur."""
    names = scored.sparkSession.createDataFrame([(x,) for x in labels], "true_label string")
    grid = names.crossJoin(names.withColumnRenamed("true_label", "predicted_label"))
    return grid.join(scored.groupBy("true_label", "predicted_label").agg(F.count(F.lit(1)).alias("n")), ["true_label", "predicted_label"], "left").fillna(0, ["n"])


def class_metrics(matrix: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each class; 0 where a ratio has no base."""
    t = matrix.groupBy(F.col("true_label").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("true_label") == F.col("predicted_label"), F.col("n")).otherwise(0)).alias("hits"))
    p = matrix.groupBy(F.col("predicted_label").alias("label")).agg(F.sum("n").alias("predicted"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    own = t.join(p, "label").withColumn("precision", ratio(F.col("hits"), F.col("predicted"))).withColumn("recall", ratio(F.col("hits"), F.col("support")))
    return own.withColumn("f1", ratio(F.col("precision") * F.col("recall") * 2.0, F.col("precision") + F.col("recall"))).select("label", "support", "precision", "recall", "f1")


def overall_metrics(matrix: DataFrame) -> DataFrame:
    """Accuracy, and macro and weighted means of precision, recall and F1."""
    own = class_metrics(matrix)
    hits = matrix.agg(F.try_divide(F.sum(F.when(F.col("true_label") == F.col("predicted_label"), F.col("n")).otherwise(0)), F.sum("n")).alias("accuracy"))
    return own.agg(F.avg("f1").alias("macro_f1"), F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), *[F.try_divide(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(f"weighted_{m}") for m in ("precision", "recall")]).crossJoin(hits)


def calibration_totals(scored: DataFrame) -> DataFrame:
    """One row over all scored predictions; macro F1 is over all known classes."""
    ok = scored.where("error is null")
    own = ok.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("correct").cast("int")).alias("accuracy"), F.avg("nll").alias("nll"), F.avg("brier").alias("brier"), F.avg("confidence").alias("mean_confidence"))
    f1 = class_metrics(confusion(ok)).agg(F.avg("f1").alias("macro_f1"))
    return own.crossJoin(F.broadcast(f1))  # one row each


def prediction_counts(scored: DataFrame) -> DataFrame:
    """Predictions of each label."""
    return scored.where("error is null").groupBy("predicted_label").agg(F.count(F.lit(1)).alias("n"))


def worst_confusions(matrix: DataFrame, most: int = 10) -> DataFrame:
    """Pairs of unlike labels by number, true and predicted label, all descending, with their rank."""
    wrong = matrix.where((F.col("true_label") != F.col("predicted_label")) & (F.col("n") > 0))
    order = Window.orderBy(F.desc("n"), F.desc("true_label"), F.desc("predicted_label"))  # one row a pair of labels
    return wrong.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def reliability(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Bins by comparison with their edges, the last one closed; empty bins stay."""
    spark = scored.sparkSession
    edges = spark.createDataFrame([(i, i / bins, (i + 1) / bins) for i in range(bins)], "bin int, low double, high double")
    last = F.col("bin") == bins - 1
    inside = (F.col("confidence") >= F.col("low")) & ((F.col("confidence") < F.col("high")) | (last & (F.col("confidence") <= F.col("high"))))
    # bins rows are few; counts come first, then the empty ones.
    counted = scored.where("error is null").join(F.broadcast(edges), inside).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("correct").cast("int")).alias("accuracy"), F.avg("confidence").alias("confidence"))
    return edges.select("bin").join(counted, "bin", "left").fillna(0, ["n"]).fillna(0.0, ["accuracy", "confidence"]).withColumn("gap", F.abs(F.col("accuracy") - F.col("confidence")))


def calibration_error(binned: DataFrame) -> DataFrame:
    """Expected and largest gap."""
    return binned.agg(F.coalesce(F.try_divide(F.sum(F.col("gap") * F.col("n")), F.sum("n")), F.lit(0.0)).alias("ece"), F.max("gap").alias("mce"))


def rejection(scored: DataFrame, thresholds: tuple[float, ...] = (0.0, 0.3, 0.4, 0.5, 0.6, 0.8)) -> DataFrame:
    """What stays at each threshold: one aggregate, no join."""
    rows = [F.struct(F.lit(t).alias("threshold"), F.count_if(F.col("confidence") >= t).alias("accepted"), F.count_if(F.col("confidence") < t).alias("rejected"), F.coalesce(F.avg(F.when(F.col("confidence") >= t, F.col("correct").cast("int"))), F.lit(0.0)).alias("accuracy")) for t in thresholds]
    return scored.where("error is null").agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*").withColumn("coverage", F.coalesce(F.try_divide(F.col("accepted"), F.col("accepted") + F.col("rejected")), F.lit(0.0)))


def aggregate_seeds(runs: DataFrame) -> DataFrame:
    """Runs have model, seed, macro_f1, accuracy, gap, loss, parameters."""
    return runs.groupBy("model").agg(F.count(F.lit(1)).alias("seeds"), F.avg("macro_f1").alias("mean_f1"), F.stddev_pop("macro_f1").alias("std_f1"), F.avg("accuracy").alias("mean_accuracy"), F.avg("gap").alias("mean_gap"), F.avg("loss").alias("mean_loss"), F.min_by("parameters", "seed").alias("parameters"))


def best_model(models: DataFrame) -> DataFrame:
    """T6."""
    return models.orderBy(F.desc("mean_f1"), "std_f1", F.abs("mean_gap"), "mean_loss", "parameters", "model").limit(1)


def best_run(runs: DataFrame, models: DataFrame) -> DataFrame:
    """Of the best model's runs (model, seed, macro_f1, loss) the one with the highest F1, then the lowest loss."""
    own = runs.join(F.broadcast(best_model(models).select("model")), "model")
    return own.orderBy(F.desc("macro_f1"), "loss", "seed").limit(1)


def confused_pairs(scored: DataFrame) -> DataFrame:
    """Confusions by true and predicted label, by person and by quality, from one pass."""
    wrong = scored.where("error is null and not correct")
    counted = wrong.groupingSets([["true_label", "predicted_label"], ["person_id"], ["quality"]], "true_label", "predicted_label", "person_id", "quality")
    return counted.agg(F.count(F.lit(1)).alias("n"))


def confident_errors(scored: DataFrame, most: int = 5) -> DataFrame:
    """T7."""
    return scored.where("error is null and not correct").orderBy(F.desc("confidence"), "row_index").limit(most)


def alignment_errors(predictions: DataFrame, index: DataFrame) -> DataFrame:
    """Row indexes that only one side has, or whose labels differ."""
    a = predictions.select("row_index", F.col("true_label").alias("left_label"))
    b = index.select("row_index", F.col("shot_label").alias("right_label"))
    return a.join(b, "row_index", "full").where(~F.col("left_label").eqNullSafe(F.col("right_label")))


def score_clips(tensors: DataFrame, predict: Callable[[np.ndarray], np.ndarray], labels: tuple[str, ...] = SHOTS) -> DataFrame:
    """Probabilities of each clip's (time, features) matrix by the caller's vectorised function."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.stack([np.stack([np.asarray(r, dtype=np.float32) for r in m]) for m in pdf["x"]])
                z = np.asarray(predict(x), dtype=np.float64)
                e = np.exp(z - z.max(axis=1, keepdims=True))
                p = e / e.sum(axis=1, keepdims=True)
                yield pd.DataFrame({"clip_id": pdf["clip_id"].to_numpy()} | {f"probability_{n}": p[:, i] for i, n in enumerate(labels)})

    return tensors.select("clip_id", "x").mapInPandas(run, "clip_id bigint, " + ", ".join(f"probability_{n} double" for n in labels))


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")
