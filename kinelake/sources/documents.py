"""Pose documents that keep what they hold beside the typed parts, and one file for each of them.

Keys that the data model doesn't know - of a document, a frame or a landmark - stay in
VARIANT maps (``other``) beside the typed columns, pass all pose operators, and are
written again. Files are written by tasks into a staging folder and appear, under
their own names, when all tasks have succeeded.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from kinelake.functions.geometry import finite

#: The keys that have columns of their own.
DOCUMENT, FRAME, MARK = ("video_metadata", "frames"), ("frame_index", "timestamp", "landmarks"), ("x", "y", "z", "visibility")
VIDEO = "struct<input_path: string, fps: double, total_frames: int, width: int, height: int, duration: double, extraction_status: string>"
FORMAT = "kinelake_documents"


def _others(value: Column, known: tuple[str, ...]) -> Column:
    """The keys of an object that aren't known, with their values; NULL if it is no object."""
    return F.map_filter(F.try_variant_get(value, "$", "map<string,variant>"), lambda k, v: ~k.isin(*known))


def _mark(m: Column) -> Column:
    number = lambda c: finite(F.try_variant_get(m, f"$.{c}", "string").try_cast("double"))
    z = F.when(F.try_variant_get(m, "$.z", "string").isNull(), F.lit(0.0)).otherwise(number("z"))
    return F.struct(number("x").alias("x"), number("y").alias("y"), z.alias("z"), F.coalesce(number("visibility"), F.lit(0.0)).alias("visibility"), _others(m, MARK).alias("other"))


def _frame(f: Column) -> Column:
    return F.struct(
        F.try_variant_get(f, "$.frame_index", "int").alias("frame_index"), F.try_variant_get(f, "$.timestamp", "double").alias("timestamp"),
        F.transform(F.try_variant_get(f, "$.landmarks", "array<variant>"), _mark).alias("landmarks"), _others(f, FRAME).alias("other"),
    )


def read_documents(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects) of JSON files, one document a file, with all keys.

    Typed parts are those of ``read_pose``; source_file, video_metadata and frames have other
    keys beside them in ``other``. Files that aren't JSON objects and those without a list of
    frames are rejects; a frame that is no object has NULL parts.
    """
    raw = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("source_file"), F.try_parse_json("value").alias("_doc"))
    frames = F.try_variant_get("_doc", "$.frames", "array<variant>")
    bad = F.col("_doc").isNull() | frames.isNull()
    docs = raw.where(~bad).select(
        "source_file", F.try_variant_get("_doc", "$.video_metadata", VIDEO).alias("video_metadata"), F.transform(frames, _frame).alias("frames"), _others(F.col("_doc"), DOCUMENT).alias("other"),
    )
    rejects = raw.where(bad).select("source_file", F.when(F.col("_doc").isNull(), "unreadable").otherwise("no_frames").alias("reason"))
    return docs, rejects


def _object(other: Column, parts: dict[str, Column]) -> Column:
    """A VARIANT object of typed parts and the keys that were kept beside them."""
    own = F.create_map(*[x for name, value in parts.items() for x in (F.lit(name), value)])
    return F.to_variant_object(F.map_concat(F.coalesce(other, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>"))), own))


def document_text(docs: DataFrame) -> Column:
    """The JSON text of documents as ``read_documents`` gives them."""
    mark = lambda m: _object(m["other"], {c: m[c].cast("variant") for c in MARK})
    frame = lambda f: _object(f["other"], {"frame_index": f["frame_index"].cast("variant"), "timestamp": f["timestamp"].cast("variant"), "landmarks": F.to_variant_object(F.transform(f["landmarks"], mark))})
    return F.to_json(_object(docs["other"], {"video_metadata": F.to_variant_object(docs["video_metadata"]), "frames": F.to_variant_object(F.transform(docs["frames"], frame))}))


def from_frames(frames: DataFrame) -> DataFrame:
    """Documents of cleaned, normalised or aligned frames of ``flatten``ed documents, in the order of pos."""
    constant = [c for c in frames.columns if c not in ("pos", "frame_index", "ts", "landmarks", "frame_other", "ok")]
    frame = F.struct("pos", "frame_index", F.col("ts").alias("timestamp"), "landmarks", F.col("frame_other").alias("other"))
    # A document holds all of its frames; that is what is written.
    held = frames.groupBy("clip_id").agg(*[F.first(c).alias(c) for c in constant if c != "clip_id"], F.array_sort(F.collect_list(frame), lambda a, b: a["pos"] - b["pos"]).alias("frames"))
    return held.withColumn("frames", F.transform("frames", lambda f: f.dropFields("pos")))


@dataclass
class Staged(WriterCommitMessage):
    """Where a task has left its files."""

    folder: str
    files: int


class DocumentWriter(DataSourceWriter):
    """Tasks write rows (name, text) as files of a staging folder; the commit moves them to their place."""

    def __init__(self, path: str, columns: list[str]) -> None:
        if columns != ["name", "text"]:
            raise ValueError("rows are (name, text)")
        self.path, self.stage = path.rstrip("/"), f"_staged-{uuid.uuid4().hex}"

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[Row]) -> Staged:
        store, root = self._store()
        # Another attempt of the task has a folder of its own.
        folder, files = f"{root}/{self.stage}/{uuid.uuid4().hex}", 0
        store.create_dir(folder, recursive=True)
        for row in iterator:
            if "/" in row["name"] or row["name"].startswith("_staged-"):
                raise ValueError(f"no file name: {row['name']}")
            with store.open_output_stream(f"{folder}/{row['name']}") as out:
                out.write(row["text"].encode())
            files += 1
        return Staged(folder, files)

    def commit(self, messages: list) -> None:
        store, root = self._store()
        for message in filter(None, messages):
            found = store.get_file_info(fs.FileSelector(message.folder))
            if len(found) < message.files:
                raise ValueError(f"{message.files - len(found)} documents of a task have the name of another one")
            for info in found:
                target = f"{root}/{info.base_name}"
                if store.get_file_info(target).type != fs.FileType.NotFound:
                    raise ValueError(f"there is a document {info.base_name} already")
                store.move(info.path, target)
        self.abort(messages)

    def abort(self, messages: list) -> None:
        store, root = self._store()
        if store.get_file_info(f"{root}/{self.stage}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/{self.stage}")


class DocumentSource(DataSource):
    """A sink of one file a row."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, text string"

    def writer(self, schema: StructType, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options["path"], schema.names)


def write_files(named: DataFrame, path: str) -> None:
    """Rows (name, text) as files of these names in path, a path or URI that driver and executors share.

    Files appear when the whole job has succeeded. Names that repeat, or are there
    already, are an error.
    """
    named.sparkSession.dataSource.register(DocumentSource)
    named.select("name", "text").write.format(FORMAT).mode("append").save(path)
