"""Which texts hold others: an index of the rarest runs of characters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.session import settle

#: Characters of a run, of which keys are made; characters of the windows that each give a key; shorter wanted texts have smaller ones.
RUN, WIDEST = 8, 16
#: Bits of a run's cell, by which runs are counted.
CELL_BITS = 16
#: Wanted texts that are broadcast.
FEW_WANTED = 500_000
NOTHING = np.uint64(2**64 - 1)


def _runs(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the run of size characters from each place on, characters that its text still has from there, row) over all texts."""
    coded = [(t or "").encode("utf-32-le", "surrogatepass") for t in texts.to_pylist()]
    lengths = np.array([len(c) // 4 for c in coded], dtype=np.int64)
    codes = np.frombuffer(b"".join(coded), dtype=np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(coded)), lengths)
    left = np.cumsum(lengths)[row] - np.arange(len(codes))
    out = np.zeros(len(codes), dtype=np.uint64)
    padded = np.concatenate([codes, np.zeros(size, dtype=np.uint64)])
    with np.errstate(over="ignore"):
        for place in range(size):
            out = out * np.uint64(0x9E3779B97F4A7C15) + padded[place : place + len(codes)] + np.uint64(1)
        out = (out ^ (out >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        out = (out ^ (out >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(31)), left, row


def _cells(texts: DataFrame, size: int) -> np.ndarray:
    """Rank of each cell by the number of all runs in it: an order of runs in which frequent ones come last."""
    count = 1 << CELL_BITS

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(count, dtype=np.int64)
        for batch in batches:
            runs, left, _ = _runs(batch.column(0), size)
            total += np.bincount((runs[left >= size] >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=count)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["cell", "n"])

    # A row a cell, whatever the number of texts.
    found = texts.mapInArrow(add, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(count, dtype=np.int64)
    total[found["cell"].to_numpy()] = found["n"].to_numpy()
    rank = np.empty(count, dtype=np.uint64)
    rank[np.argsort(total, kind="stable")] = np.arange(count, dtype=np.uint64)
    return rank


def _keys(rank: np.ndarray, size: int, window: int | None) -> Callable[[pa.Array], pa.Array]:
    """Distinct keys of a text: the rarest run of every window of its characters; of the whole text if window is None."""
    shift = np.uint64(64 - CELL_BITS)

    def made(texts: pa.Array) -> pa.Array:
        runs, left, row = _runs(texts, size)
        keys = np.where(left >= size, rank[(runs >> shift).astype(np.int64)] << shift | runs & np.uint64((1 << (64 - CELL_BITS)) - 1), NOTHING)
        if window is None:
            good = left >= size
        else:
            span = window - size + 1
            padded = np.concatenate([keys, np.full(span - 1, NOTHING)])
            keys = np.min(np.lib.stride_tricks.sliding_window_view(padded, span), axis=1) if len(keys) else keys
            good = left >= window
        keys, row = keys[good], row[good]
        order = np.lexsort((keys, row))
        keys, row = keys[order], row[order]
        first = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, dtype=bool)
        kept = first if window is None else first | np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)]
        keys, row = keys[kept], row[kept]
        offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(texts)))])
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(keys.view(np.int64)))

    return F.arrow_udf(made, "array<long>")


def holders(wanted: DataFrame, texts: DataFrame, run: int = RUN, widest: int = WIDEST) -> DataFrame:
    """(stem, then the columns of texts) for each text whose column own contains a wanted stem; wanted holds distinct stems.

    A stem's key is its rarest run of characters, by counts of all texts' runs in cells: any
    such order is exact, as the rarest run of a stem is that of a window which a text that
    holds the stem has too. So a text is indexed by the rarest runs of its windows, a fifth
    of its runs, and a frequent run is a key only where a window has no other.
    """
    sized = settle(wanted.where("stem <> ''").select("stem", F.least(F.length("stem"), F.lit(widest)).alias("size")))
    sizes = sized.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()  # widest rows at most
    # Windows of full width, of a run, or of a text that is shorter than that.
    groups: dict[int, int] = {}
    for r in sizes:
        window = widest if r["size"] >= widest else min(r["size"], run)
        groups[window] = groups.get(window, 0) + r["n"]
    parts = []
    ranks = {size: _cells(texts.select("own"), size) for size in {min(run, window) for window in groups}}
    for window, n in groups.items():
        size = min(run, window)
        own = sized.where(F.col("size") == window if window < run else F.col("size").between(run, widest - 1) if window < widest else F.col("size") >= widest)
        keyed = own.select("stem", F.explode(_keys(ranks[size], size, None)(F.col("stem"))).alias("key"))
        index = texts.select("*", F.explode(_keys(ranks[size], size, window)(F.col("own"))).alias("key"))
        keyed = F.broadcast(keyed) if n <= FEW_WANTED else keyed
        parts.append(index.join(keyed, "key").where(F.contains("own", "stem")).select("stem", *texts.columns))
    if not parts:
        return texts.select(F.lit("").alias("stem"), "*").limit(0)
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found
