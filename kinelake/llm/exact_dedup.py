"""Exact deduplication with a heavy-hitter split (native: DataFrame functions only).

A Misra-Gries pass (``stat.freqItems`` keeps at most ``1 / support`` counters per
partition and merges them) names the digests that may be frequent. Their exact
counts are verified, and the winners - at most ``1 / support`` rows - are
broadcast, so that rows of a hot digest are resolved where they lie. All other
digests are pre-aggregated and shuffled in the ordinary way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelake.session import settle

#: Types of columns that a row's hash takes in.
HASHED = frozenset(("string", "long", "integer", "short", "byte", "double", "float", "boolean", "date", "timestamp", "decimal", "binary"))

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Rows of an id and a digest that fit a broadcast: some 50 MB once hashed.
BROADCAST_IDS = 500_000


def ascii_lower(text):
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def digest_groups(rows: DataFrame, support: float, *made: Column) -> DataFrame:
    """rows (with a digest column) and, beside each, the aggregates made of its digest's rows.

    Digests that at least ``support`` of all rows have are resolved by a broadcast,
    the others by a shuffle. rows is read several times: settle it before.
    """
    total = rows.count()
    frequent = rows.stat.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    # At most 1 / support candidates, so the verified winners fit any broadcast.
    counted = rows.join(F.broadcast(frequent), "digest", "left_semi").groupBy("digest").agg(*made, F.count(F.lit(1)).alias("_n"))
    winners = settle(counted.where(F.col("_n") >= F.lit(max(2.0, support * total))).drop("_n"))
    cold = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    return rows.join(F.broadcast(winners), "digest").unionByName(cold.join(cold.groupBy("digest").agg(*made), "digest"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = 0.002) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null text counts as
    empty. The row with the largest id of a group stays. Rows with a null id
    never stay unless the whole group has none (then keep_id is null and all are
    kept); rows that repeat both id and text count one by one in group_size and
    share the decision. Extra columns are ignored; an empty table gives no rows.
    """
    rows = settle(docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(ascii_lower(F.col(text_col)), 256)).alias("digest")))
    resolved = digest_groups(rows, support, F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return resolved.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def without_keys(docs: DataFrame, keys: dict[str, Column], dropped: DataFrame) -> DataFrame:
    """Rows of docs whose keys (name: expression over docs) aren't among those of dropped.

    Nulls equal nulls. dropped is broadcast below a checked size only. The rows
    travel as one struct, so no column of docs can clash with the keys.
    """
    if dropped.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        dropped = F.broadcast(dropped)
    packed = docs.select(F.struct("*").alias("_row"), *[key.alias(f"_{name}") for name, key in keys.items()])
    same = [packed[f"_{name}"].eqNullSafe(dropped[name]) for name in keys]
    return packed.join(dropped, same, "left_anti").select("_row.*")


def one_each(docs: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Of rows that repeat the keys, the one with the largest hash of its columns; others as they are.

    Repeats are looked for first, on the keys alone: mostly there are none.
    """
    names = [f"_{name}" for name in keys]
    packed = docs.select(F.struct("*").alias("_row"), *[key.alias(f"_{name}") for name, key in keys.items()])
    repeated = settle(packed.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"))
    if repeated.isEmpty():
        return docs
    if repeated.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        repeated = F.broadcast(repeated)
    same = [packed[name].eqNullSafe(repeated[name]) for name in names]
    hashed = F.xxhash64(*[F.col(f"_row.`{f.name}`") for f in docs.schema.fields if f.dataType.typeName() in HASHED])
    one = packed.join(repeated, same, "left_semi").groupBy(*names).agg(F.max_by("_row", hashed).alias("_row"))
    return packed.join(repeated, same, "left_anti").select("_row.*").unionByName(one.select("_row.*"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = 0.002) -> DataFrame:
    """docs with one row of each group of equal texts: one with the largest id; columns unchanged.

    Decided by text and id together, so rows that repeat an id with another text
    stay. A null id stays only if its whole group has none; null text counts as
    empty. Of rows that repeat both text and id one stays (see ``one_each``). Other
    columns may have any names. An empty table stays empty.
    """
    groups = settle(exact_groups(docs, id_col, text_col, support))
    keys = {"id": F.col(id_col), "digest": F.unhex(F.sha2(ascii_lower(F.col(text_col)), 256))}
    kept = without_keys(docs, keys, groups.where("not kept").select(F.col("doc_id").alias("id"), F.unhex("text_sha256").alias("digest")).distinct())
    counts = groups.agg(F.count_if("kept").alias("rows"), F.count_distinct(F.when(F.col("kept") & (F.col("group_size") > 1), F.col("text_sha256"))).alias("groups"), F.count_if(F.col("kept") & (F.col("group_size") > 1)).alias("shared")).first()
    return one_each(kept, keys) if counts["shared"] > counts["groups"] else kept


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP9_SQL = """
WITH n AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h
  FROM documents
), g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY h)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, n.h AS text_sha256
FROM n JOIN g ON n.h = g.h
"""
