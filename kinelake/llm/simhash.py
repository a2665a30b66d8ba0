"""SimHash near duplicates by anchor-point covering.

Anchors are the words of a covering code of 64 bits: two binary Golay codes of 23 bits
(every word is within 3 bits of just one code word), a Hamming code of 15 and the
repetition code of 3 (within 1 bit). The covering radius of their product is the sum
of the parts', and no part's radius is exceeded at a word's own anchor. Take two
fingerprints that differ in at most ``2 * reach`` bits and a word half-way between
them: its anchor is within the covering radius of the half-way word, so both
fingerprints are within covering radius plus ``reach`` of that anchor. Each
fingerprint is replicated to all anchors that close - the bits beyond the parts'
radii are ``reach`` together at most - and compared per anchor. That is the reach
that the threshold needs if both sides are replicated: 17 anchors a fingerprint where
covering radius plus the whole threshold on one side would take 165.

Anchors that many fingerprints share aren't compared in pairs. Their fingerprints
are replicated to all words within ``reach`` of them instead, the anchors of the
code of radius 0: fingerprints that share such a word differ in ``2 * reach`` bits
at most, and each such two share one. So a word's fingerprints link with its least
one, and no word has more of them than it has words around it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinelake.llm.arrow import bound_batches, map_column
from kinelake.llm.components import components
from kinelake.llm.exact_dedup import BROADCAST_IDS
from kinelake.session import discard, settle

SHINGLE, SEED, BITS = 3, 42, 64
#: Length, generator polynomial (lowest bit: the constant term) and covering radius of each part of the code.
PARTS = ((23, 0b101011100011, 3), (23, 0b101011100011, 3), (15, 0b10011, 1), (3, 0b111, 1))
#: Fingerprints of an anchor that are compared in pairs; beyond, half-way words link them.
HOT_ANCHOR = 64
#: Shingles hashed at a time.
HASHES = 65_536


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """SimHash of a text's word shingles, repeats included; 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    line = b" ".join(words)
    starts, ends = [0, *ends[: n - 1].tolist()], (ends[min(size, len(words)) - 1 :] - 1).tolist()
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, HASHES):
        hashes = np.fromiter((xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts[at : at + HASHES], ends[at : at + HASHES], strict=True)), dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of whole texts; words are parted by bytes 9-13 and 32, A-Z count as a-z."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return map_column(slim, ["doc_id"], "text", lambda texts: [[fingerprint(t, size) for t in texts]], {"fp": "long"})


def _rest(words: np.ndarray, length: int, polynomial: int) -> np.ndarray:
    """Remainders of words (bits: coefficients) divided by the polynomial: their syndromes."""
    degree = polynomial.bit_length() - 1
    words = words.copy()
    for shift in range(length - 1, degree - 1, -1):
        words ^= np.where(words >> shift & 1, polynomial << (shift - degree), 0)
    return words


def patterns(length: int, polynomial: int, radius: int, reach: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For 0 .. reach bits beyond the radius: (starts by syndrome, error patterns in that order).

    A word's anchors at that distance are the word xor the patterns of its syndrome.
    """
    made = []
    for over in range(reach + 1):
        weights = range(radius + 1) if over == 0 else (radius + over,)
        masks = np.array([sum(1 << i for i in places) for w in weights for places in combinations(range(length), w)], dtype=np.int64)
        found = _rest(masks, length, polynomial)
        order = np.lexsort((masks, found))
        made.append((np.searchsorted(found[order], np.arange((1 << (polynomial.bit_length() - 1)) + 1)), masks[order]))
    return made


def anchors(fps: np.ndarray, reach: int, tables: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(place in fps, anchor) of all anchors within covering radius plus reach of each of fps (int64)."""
    tables = tables or [patterns(*part, reach) for part in PARTS]
    rows, made, left = np.arange(len(fps)), np.zeros(len(fps), dtype=np.int64), np.full(len(fps), reach)
    shift = 0
    for (length, polynomial, _), table in zip(PARTS, tables, strict=True):
        words = (fps >> shift) & ((1 << length) - 1)
        syndromes = _rest(words, length, polynomial)
        next_rows, next_made, next_left = [], [], []
        for over, (starts, masks) in enumerate(table):
            may = np.flatnonzero(left >= over)
            s = syndromes[rows[may]]
            counts = starts[s + 1] - starts[s]
            source = np.repeat(may, counts)
            place = np.arange(len(source)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts[s], counts)
            next_rows.append(rows[source])
            next_made.append(made[source] | ((words[rows[source]] ^ masks[place]) << shift))
            next_left.append(left[source] - over)
        rows, made, left = (np.concatenate(x) for x in (next_rows, next_made, next_left))
        shift += length
    return rows, made


def around(fps: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(place in fps, word) of all words within reach bits of each of fps."""
    masks = np.array([sum(1 << i for i in places) for w in range(reach + 1) for places in combinations(range(BITS), w)], dtype=np.uint64).view(np.int64)
    return np.repeat(np.arange(len(fps)), len(masks)), (fps[:, None] ^ masks[None, :]).ravel()


def _replicated(fps: DataFrame, places, key: str) -> DataFrame:
    """(key, fp): each fp (long) beside all keys that places gives it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy()
            for at in range(0, len(values), 4096):
                part = values[at : at + 4096]
                rows, keys = places(part)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], names=[key, "fp"])

    return fps.select("fp").mapInArrow(run, f"{key} long, fp long")


def _bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))


def _forest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of the pairs, those that connect what wasn't connected."""
    root: dict = {}

    def top(x: int) -> int:
        while (y := root.get(x, x)) != x:
            root[x] = root.get(y, y)
            x = y
        return x

    kept = []
    for a, b in pairs:
        x, y = top(a), top(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


def compare_runs(keys: np.ndarray, fps: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Links (a spanning forest of each run of equal keys) between fps that differ in threshold bits at most."""
    found: dict = {}
    at = np.arange(len(keys))
    gap = 1
    while True:
        at = at[at + gap < len(keys)]
        at = at[keys[at] == keys[at + gap]]
        if not len(at):
            break
        near = at[_bits(fps[at], fps[at + gap]) <= threshold]
        for i in near.tolist():
            found.setdefault(int(keys[i]), []).append((int(fps[i + gap]), int(fps[i])))
        gap += 1
    return [link for pairs in found.values() for link in (_forest(pairs) if len(pairs) > 1 else pairs)]


def links(fps: DataFrame, threshold: int = 2) -> DataFrame:
    """(a, b) between distinct fps whose bits differ in threshold places at most: enough of them to connect all that do.

    threshold must be even: it is reached half-way from both sides.
    """
    if threshold < 0 or threshold % 2:
        raise ValueError("threshold must be even")
    reach = threshold // 2
    tables = [patterns(*part, reach) for part in PARTS]
    placed = _replicated(fps, lambda part: anchors(part, reach, tables), "anchor")
    counts = settle(placed.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    hot = counts.where(F.col("n") > HOT_ANCHOR).select("anchor")
    cold = counts.where(F.col("n") <= HOT_ANCHOR).select("anchor")
    few = counts.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS

    def at(anchored: DataFrame) -> DataFrame:
        return placed.join(F.broadcast(anchored) if few else anchored, "anchor", "left_semi")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        for batch in batches:
            keys, values = np.concatenate([keys, batch.column(0).to_numpy()]), np.concatenate([values, batch.column(1).to_numpy()])
            # The last run may go on in the next batch; no run has over HOT_ANCHOR rows.
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            yield _edges(compare_runs(keys[:cut], values[:cut], threshold))
            keys, values = keys[cut:], values[cut:]
        yield _edges(compare_runs(keys, values, threshold))

    near = at(cold).repartition("anchor").sortWithinPartitions("anchor", "fp").mapInArrow(compared, "a long, b long")
    if hot.isEmpty():
        return near
    # All words round a fingerprint: each has 1 + 64 fingerprints at most (for a threshold of 2).
    crowded = settle(at(hot).select("fp").distinct())
    words = _replicated(crowded, lambda part: around(part, reach), "word")
    least = words.withColumn("least", F.min("fp").over(Window.partitionBy("word"))).where("fp > least")
    return near.unionByName(least.select(F.col("fp").alias("a"), F.col("least").alias("b")).distinct())


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    table = np.array(pairs, dtype=np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(table[:, 0]), pa.array(table[:, 1])], names=["a", "b"])


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, threshold: int = 2) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), class_id, component_id.

    A fingerprint bit is set if over half of the hashes of the text's word shingles
    have it; null texts and texts without words have fingerprint zero and link like any
    other, a text of fewer words is one shingle. Fingerprints link at threshold or fewer
    differing bits. class_id is the smallest id of the same fingerprint, component_id
    of all that links reach; null ids count only where there is no other, repeated rows
    come out one by one. Texts are read whole, other columns may have any names, an
    empty table gives no rows.
    """
    rows = settle(fingerprints(docs, id_col, text_col, size))
    # Equal fingerprints are summed up before they are dealt out.
    classes = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("class_id")))
    found = components(links(classes, threshold))
    joined = classes.join(found, classes["fp"] == found["node"], "left").select("fp", "class_id", F.coalesce("component", "fp").alias("node"))
    joined = settle(joined)
    least = joined.groupBy("node").agg(F.min("class_id").alias("component_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    least = settle(least)
    slim = F.broadcast(least) if least.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else least
    labels = settle(joined.join(slim, "node", "left").select("fp", "class_id", F.coalesce("component_id", "class_id").alias("component_id")))
    discard(classes, joined, least)
    few = labels.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    # Beyond a broadcast, a frequent fingerprint's rows are split by the join: both sides are plain exchanges.
    made = rows.join(F.broadcast(labels) if few else labels, "fp")
    return made.select("doc_id", F.lower(F.lpad(F.hex("fp"), BITS // 4, "0")).alias("fingerprint"), "class_id", "component_id")


def op11_simhash(spark, sf_dir: str) -> DataFrame:
    return simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "fingerprint", "component_id")
