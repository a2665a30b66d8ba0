"""Sharding by vector bin packing of bytes, tokens and rows.

Equal texts form a group; only a group that no shard can hold is cut into pieces.
Pieces are hashed to buckets, and each bucket packs its pieces - largest first,
each to the bin where the dot product of its (bytes, tokens, rows) with the
residual capacity is highest. Bins of BUCKET_JOIN buckets are the pieces of the
next level, until one bucket is left, whose bins are the shards: no task sees more
than some hundred thousand pieces. The law that the query guarantees is ``bytes``: a share of
the pieces of each bucket, the fillers, is kept for the last level and goes, largest
first, where bytes lack most.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinelake.llm.exact_dedup import BROADCAST_IDS
from kinelake.llm.mixing import word_count
from kinelake.session import discard, settle

#: Pieces that a bucket has on average, and buckets whose bins are packed together.
BUCKET_GROUPS, BUCKET_JOIN = 262_144, 64
#: A group beyond a shard's bytes is cut into pieces of this part of a shard.
PIECES_PER_SHARD = 16
ROW_BYTES = 16
#: Share of the pieces that are fillers, the bundles in which a bucket hands them on, and the
#: bins for each shard in which all buckets that are packed together hand on the others.
FILLERS, BUNDLES, FINER = 0.08, 128, 256
#: Part of a bin that a filler may take.
LARGEST_FILLER = 0.01
#: A group with more than this part of all rows is hot; there are fewer than so many.
HOT_SHARE = 5000
#: Rows of a lane while lanes are few, and lanes of a shard at most: their prefix sums are one window a shard.
LANE_ROWS, MOST_LANES = 50, 4096
MEASURES = ["bytes", "tokens", "rows"]


def pack(loads: np.ndarray, filler: np.ndarray, bins: int) -> np.ndarray:
    """Bin of each item: items (n, 3); the bins' capacities are equal.

    Loads are scaled by capacity, and items come in the order of their largest part,
    equal ones as they stand.
    Among bins whose residual bytes hold the item the largest dot product of item and
    residual wins; where none does, the bin that lacks most bytes. Equal ones go to the
    lowest bin. Fillers come last: every second one takes the bin that lacks most of
    all three, then the others, largest first, take the bin that lacks most bytes.
    """
    items = loads / np.maximum(loads.sum(axis=0) / bins, 1e-9)
    filler = filler & (items.max(axis=1, initial=0.0) < LARGEST_FILLER)
    main = items[~filler].sum(axis=0) / bins
    left = np.tile(main, (bins, 1))
    out = np.empty(len(items), dtype=np.int64)

    def put(i: int, b: int) -> None:
        out[i] = b
        left[b] -= items[i]

    for i in np.argsort(-items.max(axis=1, initial=0.0), kind="stable").tolist():
        if not filler[i]:
            fits = left[:, 0] >= items[i, 0]
            put(i, int(np.argmax(np.where(fits, left @ items[i], -np.inf) if fits.any() else left[:, 0])))
    left += 1 - main
    small = [i for i in np.argsort(-items[:, 0], kind="stable").tolist() if filler[i]]
    for i in small[1::2]:
        put(i, int(np.argmax(left.sum(axis=1))))
    for i in small[::2]:
        put(i, int(np.argmax(left[:, 0])))
    return out


def hand_on(loads: np.ndarray, filler: np.ndarray, bins: int) -> np.ndarray:
    """Bin of each item for the next level: bins of main items, then bundles of fillers of like size."""
    out = np.empty(len(loads), dtype=np.int64)
    out[~filler] = pack(loads[~filler], np.zeros(int((~filler).sum()), dtype=bool), bins)
    small = np.flatnonzero(filler)
    small = small[np.argsort(-loads[small, 0], kind="stable")]
    out[small] = bins + np.arange(len(small)) * BUNDLES // max(len(small), BUNDLES)
    return out


def _measures(part: DataFrame, *keys: str) -> DataFrame:
    return part.groupBy(*keys).agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is UTF-8 bytes plus 16 (null text: no bytes, CRC of nothing). slot counts
    from 0 without gaps in each shard. Equal texts share a shard unless their
    group is larger than a shard; repeated ids are separate rows, null ids too.
    Extra columns are ignored. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Rows are numbered by the written table, so that pieces don't depend on ids.
    rows = settle(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"),
            F.crc32(text).alias("text_crc32"),
            word_count(text).alias("tokens"),
            F.xxhash64(text).alias("digest"),
        ).withColumn("row", F.monotonically_increasing_id())
    )
    groups = settle(_measures(rows, "digest"))
    totals = groups.agg(F.sum("bytes"), F.count(F.lit(1))).first()
    total_bytes, n_groups = (int(x or 0) for x in totals)
    share = max(1.0, total_bytes / shards)

    # Fewer groups than shards are this large.
    large = groups.where((F.col("bytes") > share) & (F.col("rows") > 1)).select("digest", F.ceil(F.col("bytes") * PIECES_PER_SHARD / share).alias("pieces"))
    cut = settle(rows.join(F.broadcast(large), "digest").withColumn("piece", F.pmod(F.xxhash64(F.lit("piece"), "row"), F.col("pieces"))).drop("pieces"))
    pieces = _measures(cut, "digest", "piece").unionByName(groups.join(F.broadcast(large), "digest", "left_anti").withColumn("piece", F.lit(0).cast("long")))
    buckets = max(1, n_groups // BUCKET_GROUPS)
    # Each level's items: their name (digest, piece), what they measure, their bucket.
    chosen = F.pmod(F.xxhash64(F.lit("filler"), "digest", "piece"), F.lit(1000)) < int(1000 * FILLERS)
    chosen = chosen & (F.col("bytes") < LARGEST_FILLER * share)
    items = pieces.withColumn("bucket", F.pmod(F.xxhash64("digest", "piece"), F.lit(buckets))).withColumn("filler", chosen)

    def packed(last: bool, finer: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            # Hashes order the pieces, so that ties in size come in no order of the other measures.
            pdf = pdf.sort_values(["digest", "piece"], ignore_index=True)
            loads, filler = pdf[MEASURES].to_numpy(float), pdf["filler"].to_numpy(bool)
            return pdf.assign(bin=pack(loads, filler, shards) if last else hand_on(loads, filler, finer))[["digest", "piece", "bucket", "bin", *MEASURES]]

        return run

    levels: list[DataFrame] = []
    made = [rows, groups, cut]
    while True:
        last, finer = buckets == 1, -(-FINER // min(buckets, BUCKET_JOIN)) * shards
        levels.append(settle(items.groupBy("bucket").applyInPandas(packed(last, finer), "digest long, piece long, bucket long, bin long, bytes long, tokens long, rows long")))
        if last:
            break
        buckets = -(-buckets // BUCKET_JOIN)
        # A bin is named by its bucket and number; one that holds one large piece is as good as that piece.
        bins = levels[-1].groupBy(F.col("bucket").alias("digest"), F.col("bin").alias("piece")).agg(*[F.sum(c).alias(c) for c in MEASURES])
        items = bins.withColumn("bucket", F.floor(F.col("digest") / BUCKET_JOIN)).withColumn("filler", F.col("piece") >= finer)
    homes = levels.pop().select("digest", "piece", F.col("bin").cast("int").alias("shard"))
    made += levels
    while levels:
        own = homes.withColumnsRenamed({"digest": "bucket", "piece": "bin"})
        homes = levels.pop().select("digest", "piece", "bucket", "bin").join(own, ["bucket", "bin"]).select("digest", "piece", "shard")
    homes = settle(homes)
    made.append(homes)

    # Whole groups meet their home by digest, the rows of cut ones by digest and piece.
    whole = rows.join(F.broadcast(large.select("digest")), "digest", "left_anti").withColumn("piece", F.lit(0).cast("long"))
    rows_in_all = groups.agg(F.sum("rows")).first()[0] or 0
    # Groups with a hot key's share of the rows, HOT_SHARE at most, find their homes by broadcast whatever the size of homes.
    hot = groups.where((F.col("rows") * HOT_SHARE > rows_in_all) & (F.col("rows") > 1)).select("digest")
    placed = whole.unionByName(cut)
    if homes.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        homed = placed.join(F.broadcast(homes), ["digest", "piece"])
    else:
        few = F.broadcast(homes.join(F.broadcast(hot), "digest", "left_semi"))
        homed = placed.join(few, ["digest", "piece"]).unionByName(placed.join(F.broadcast(hot), "digest", "left_anti").join(homes, ["digest", "piece"]))
    lanes_of_shard = min(MOST_LANES, max(4, n_groups // (LANE_ROWS * shards)))
    lane = F.pmod(F.xxhash64("row", "digest"), F.lit(lanes_of_shard))
    where = settle(homed.select("doc_id", "size", "text_crc32", "tokens", "shard", "digest", "row", lane.alias("lane")))
    discard(*made)
    # Slots: counts of lanes, prefix sums over them, ranks inside a lane.
    before = Window.partitionBy("shard").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    lanes = where.groupBy("shard", "lane").agg(F.count(F.lit(1)).alias("n")).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long"))).drop("n")
    inside = Window.partitionBy("shard", "lane").orderBy("row")
    return (
        where.withColumn("rank", F.row_number().over(inside) - 1)
        .join(F.broadcast(lanes) if lanes_of_shard * shards <= BROADCAST_IDS else lanes, ["shard", "lane"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("rank")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def op1_shard(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
