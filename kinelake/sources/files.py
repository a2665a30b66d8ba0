"""Readers and writers of pose documents, metadata, manifests, predictions and exports."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.functions.geometry import finite

#: Metadata columns, wrapper keys of prediction files.
METADATA = ("video_id", "file_name", "relative_path", "shot_label", "quality", "person_id", "use_for_v1")
WRAPPERS = ("predictions", "samples", "rows")

_MARK = "struct<x: string, y: string, z: string, visibility: string>"
POSE_SCHEMA = f"video_metadata struct<input_path: string, fps: double, total_frames: int, width: int, height: int, duration: double, extraction_status: string>, frames array<struct<frame_index: int, timestamp: double, landmarks: array<{_MARK}>>>, _corrupt string"


def _number(text: Column) -> Column:
    return finite(text.try_cast("double"))


def read_pose(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects) of JSON files, one document a file.

    Numbers may be quoted; those that aren't finite numbers are NULL, an absent
    z is 0. Unreadable files and those without a frames list are rejects.
    """
    raw = spark.read.schema(POSE_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(folder).withColumn("source_file", F.col("_metadata.file_name"))
    mark = lambda m: F.struct(_number(m["x"]).alias("x"), _number(m["y"]).alias("y"), F.when(m["z"].isNull(), 0.0).otherwise(_number(m["z"])).alias("z"), F.coalesce(_number(m["visibility"]), F.lit(0.0)).alias("visibility"))
    frames = F.transform("frames", lambda f: F.struct(f["frame_index"].alias("frame_index"), f["timestamp"].alias("timestamp"), F.transform(f["landmarks"], mark).alias("landmarks")))
    bad = F.col("_corrupt").isNotNull() | F.col("frames").isNull()
    docs = raw.where(~bad).select("source_file", "video_metadata", frames.alias("frames"))
    rejects = raw.where(bad).select("source_file", F.when(F.col("_corrupt").isNotNull(), "unreadable").otherwise("no_frames").alias("reason"))
    return docs, rejects


def read_metadata(spark: SparkSession, path: str, required: tuple[str, ...] = METADATA) -> DataFrame:
    """All columns as text, so leading zeros stay; ValueError if a required one is missing."""
    df = spark.read.option("header", True).csv(path)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {missing}")
    return df


def list_videos(spark: SparkSession, folder: str) -> DataFrame:
    """S3: path, length, modificationTime of .mov and .mp4 files by their lower-cased paths, without reading their content."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return found.select("path", "length", "modificationTime").where(F.lower("path").rlike(r"\.(mov|mp4)$")).orderBy(F.lower("path"), "path")


def read_rows(spark: SparkSession, path: str, kind: str, wrappers: tuple[str, ...] = WRAPPERS) -> DataFrame:
    """Rows of a CSV, JSONL or JSON file; JSON is a list, or an object with one of the wrappers."""
    if kind == "csv":
        return spark.read.option("header", True).csv(path)
    if kind == "jsonl":
        return spark.read.json(path)
    df = spark.read.option("multiLine", True).json(path)
    wrapper = next((w for w in wrappers if w in df.columns), None)
    return df.select(F.inline(wrapper)) if wrapper else df


def write_rows(df: DataFrame, path: str, kind: str) -> None:
    """CSV in column order, JSONL with sorted keys, or JSON: objects with a list of samples, one for each partition.

    Each file of JSON is one object that ``read_rows`` takes; no list passes through one task.
    """
    if kind == "csv":
        df.write.option("header", True).csv(path)
    elif kind == "jsonl":
        df.select(*sorted(df.columns)).write.json(path)
    elif kind == "json":
        row = F.to_json(F.struct(*sorted(df.columns)))

        def wrap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first = True
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    yield pa.RecordBatch.from_pydict({"value": [('{"samples": [' if first else ",") + text]})
                    first = False
            if not first:
                yield pa.RecordBatch.from_pydict({"value": ["]}"]})

        df.select(row.alias("value")).mapInArrow(wrap, "value string").write.text(path)
    else:
        raise ValueError("kind is csv, jsonl or json")


def write_documents(docs: DataFrame, path: str) -> None:
    """Pose documents (out_name, other columns) as JSON lines, a folder for each output name."""
    docs.write.partitionBy("out_name").json(path)


def union_ragged(parts: list[DataFrame]) -> DataFrame:
    """Rows of tables with different columns; columns in the order in which they are first seen."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def stage_name(path: Column, suffix: str) -> Column:
    """File name of a stage's output: old stage suffixes go, the new one comes."""
    stem = F.regexp_replace(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.json$", ""), r"(_normalized)?(_aligned)?$", "")
    return F.concat(stem, F.lit(suffix), F.lit(".json"))


def export_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Fixed column order; arrays, structs and maps as JSON; columns that aren't there stay empty."""
    kinds = dict(df.dtypes)
    nested = ("array", "struct", "map")
    shown = [F.lit(None).cast("string").alias(c) if c not in kinds else F.to_json(c).alias(c) if kinds[c].startswith(nested) else F.col(c) for c in columns]
    df.select(*shown).write.option("header", True).csv(path)


def read_slice(spark: SparkSession, path: str, **equal: str) -> DataFrame:
    """Rows of a (partitioned) Parquet table by equality; the filters reach the scan."""
    df = spark.read.parquet(path)
    for column, value in equal.items():
        df = df.where(F.col(column) == value)
    return df


def write_tensor(tensors: DataFrame, path: str) -> None:
    """Clip matrices by split."""
    tensors.write.partitionBy("split").parquet(path)
