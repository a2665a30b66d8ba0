"""One column through a batch function, the other columns untouched (Arrow)."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

ARROW = {
    "string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(),
    "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()),
}

#: Rows handed to a function together.
ROWS = 256
#: Bytes of an Arrow batch that the JVM makes, so that very long texts don't fill its memory.
#: Other queries of the session keep their number of rows a batch.
BYTES_SETTING, BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def bound_batches(df: DataFrame) -> None:
    """Arrow batches of df's session end at BYTES, unless it has a bound already."""
    settings = df.sparkSession.conf
    settings.set(BYTES_SETTING, settings.get(BYTES_SETTING, str(BYTES)))


def give_back() -> None:
    """Hand memory that a worker process holds without use to the system: idle workers share an executor's with its next stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def map_column(df: DataFrame, keep: list[str], column: str, function: Callable[[list], list], out: dict[str, str], release: Callable[[], None] | None = None) -> DataFrame:
    """The columns keep, then those of out, which function makes from a list of column's values.

    function returns one list for each column of out. Kept columns pass as Arrow
    arrays, so nulls and large integers survive; df may hold any other columns.
    release drops what function remembers; a task calls it at its end.
    """
    bound_batches(df)
    value = "_value"
    while value in keep:
        value += "_"
    slim = df.select(*keep, df[column].alias(value))
    made_fields = StructType.fromDDL(", ".join(f"`{name}` {kind}" for name, kind in out.items())).fields
    schema = StructType(slim.schema.fields[:-1] + made_fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                made = function(part.column(len(keep)).to_pylist())
                arrays = [pa.array(values, type=ARROW[kind]) for values, kind in zip(made, out.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(keep))] + arrays, names=[*keep, *out])
        if release is not None:
            release()
        give_back()

    return slim.mapInArrow(run, schema)


def keep_rows(df: DataFrame, column: str, function: Callable[[list], list[bool]], release: Callable[[], None] | None = None) -> DataFrame:
    """Rows of df for which function, given a list of column's values, says true; all columns untouched. release: see ``map_column``."""
    bound_batches(df)
    place = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                yield part.filter(pa.array(function(part.column(place).to_pylist()), type=pa.bool_()))
        if release is not None:
            release()
        give_back()

    return df.mapInArrow(run, df.schema)
