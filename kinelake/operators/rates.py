"""Rate audits over a request log, and metric sums."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinelake.functions import geometry as g
from kinelake.functions import texts


def fixed_window(requests: DataFrame, limit: int, seconds: int) -> DataFrame:
    """Allowed while the number of a key's requests in a window is within the limit; a limit of 0 allows all."""
    bucket = F.floor(F.unix_timestamp("ts") / seconds)
    rank = F.row_number().over(Window.partitionBy("key", "bucket").orderBy("ts", "request_id"))
    return requests.withColumn("bucket", bucket).withColumn("allowed", (rank <= limit) | F.lit(limit <= 0))


def sliding_window(requests: DataFrame, limit: int, seconds: float) -> DataFrame:
    """Only allowed requests count; they expire after more than the window.

    Keys are dealt to partitions and sorted there; a task streams through its batches
    and holds the last limit times of the key at hand, however long its log is.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: deque = deque()
        key = object()
        for pdf in batches:
            out = []
            for own, t in zip(pdf["key"].tolist(), pdf["at"].tolist(), strict=True):
                if own != key:
                    key = own
                    held.clear()
                while held and t - held[0] > seconds * 1e6:
                    held.popleft()
                ok = limit <= 0 or len(held) < limit
                if ok and limit > 0:
                    held.append(t)
                out.append(ok)
            yield pdf.assign(allowed=out)[["request_id", "key", "allowed"]]

    ordered = requests.select("request_id", "key", F.unix_micros(F.col("ts").cast("timestamp")).alias("at")).repartition("key").sortWithinPartitions("key", "at", "request_id")
    return ordered.mapInPandas(run, "request_id bigint, key bigint, allowed boolean")


def metric_sums(metrics: DataFrame) -> DataFrame:
    """Count and sum of each name and label set; metrics have name, labels map, value, kind. Quotes in label values go."""
    entries = F.array_sort(F.map_entries("labels"))
    key = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit('="'), F.replace(e["value"], F.lit('"'), F.lit("")), F.lit('"'))), ",")
    return metrics.groupBy("name", "kind", key.alias("labels")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def general(value: Column) -> Column:
    """A number in six significant digits without trailing zeros, with an exponent below 1e-4 and from 1e6 on."""
    # Rounds the binary value, see texts.fixed; ties of whole numbers go to even as decimals only.
    told, whole = (F.call_function("format_number", v, F.lit("0.00000E0")) for v in (g.finite(value), value.cast("decimal(16,0)")))
    told = F.when((value == F.floor(value)) & (F.abs(value) < 2**53), whole).otherwise(told)
    digits = F.replace(F.regexp_extract(told, r"^-?([0-9.]+)E", 1), F.lit("."), F.lit(""))
    at = F.regexp_extract(told, r"E(-?[0-9]+)$", 1).cast("int")
    power = F.concat(F.when(at < 0, "-").otherwise("+"), F.lpad(F.abs(at).cast("string"), F.greatest(F.lit(2), F.length(F.abs(at).cast("string"))), "0"))
    bare = lambda text: F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    scientific = F.concat(bare(F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, 2, 9))), F.lit("e"), power)
    large = bare(F.concat(F.substring(digits, F.lit(1), at + 1), F.lit("."), F.substring(digits, at + 2, F.lit(9))))
    small = bare(F.concat(F.lit("0."), F.repeat(F.lit("0"), -at - 1), digits))
    text = F.when((at < -4) | (at >= 6), scientific).when(at >= 0, large).otherwise(small)
    return F.when(value == 0, "0").otherwise(F.concat(F.when(value < 0, "-").otherwise(""), text))


def exposition(sums: DataFrame) -> DataFrame:
    """Text lines of counters and observations, in the order of name and labels."""
    tags = F.when(F.col("labels") != "", F.concat(F.lit("{"), "labels", F.lit("}"))).otherwise("")
    counter = F.array(F.concat("name", F.lit("_total"), tags, F.lit(" "), general(F.col("total"))))
    timer = F.array(F.concat("name", F.lit("_seconds_count"), tags, F.lit(" "), F.col("n").cast("string")), F.concat("name", F.lit("_seconds_sum"), tags, F.lit(" "), texts.fixed(F.col("total"), 6)))
    return sums.select("name", "labels", F.posexplode(F.when(F.col("kind") == "counter", counter).otherwise(timer)).alias("place", "line"))


def write_exposition(lines: DataFrame, path: str) -> None:
    """The text lines of ``exposition``, sorted by name and labels over all files."""
    lines.orderBy("name", "labels", "place").select("line").write.text(path)
