"""Mixing sources to target weights by a low-discrepancy schedule (native).

Slot i of the mix gets the point frac(i * golden ratio), in exact 32-bit integer
arithmetic; the point's place among the cumulative targets names the slot's
source. Slots are ranked within their source and joined with that source's
shuffled blocks of equal token counts; the ranks wrap around, so a source with
few tokens is repeated. Slots hand out whole blocks; what they give a source beyond or
short of its target, a few blocks, is settled in words at the end of the last block
taken, for every source alike. All rankings are two-level (bucket sums, then prefix sums
over a bounded number of buckets), so that a source with a third of all rows is
never sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinelake.llm.exact_dedup import BROADCAST_IDS, one_each
from kinelake.session import settle

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
WORD = r"[^\x20\x09-\x0D]+"

#: Shuffle order: a hexadecimal prefix of the md5 of the id; 4096 buckets a source.
BUCKET_HEX = 3
#: 32-bit golden-ratio multiplier and modulus of the point sequence.
GOLDEN, MODULUS = 2654435769, 2**32
#: A block has at most this many tokens, and the mix at least this many slots.
BLOCK_TOKENS, LEAST_SLOTS = 1024, 50_000
#: Sources whose buckets, and sources that, fit a broadcast.
FEW_SOURCES, MOST_SOURCES = 50, 100_000
#: Slots ranked together; cells that u-space is cut into for the interval join.
SLOT_CHUNK, CELLS = 65_536, 4096


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Targets of (source, source_size): weights 5, 2, 1 repeat in code-point order, null last.

    The common level is found in closed form: sources sorted by cap / weight are
    capped one after the other until the rest fits under the level. One row per
    source; the windows without keys run over these rows only.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    everything = Window.partitionBy()
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    ranked = (
        sizes.withColumn("weight", weight.cast("long"))
        .withColumn("cap", F.col("source_size") * max_repeats)
        .withColumn("left_tokens", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), zero))
        .withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), zero))
        .withColumn("level", F.col("left_tokens") / F.col("left_weight"))
        .withColumn("capped", F.col("level") * F.col("weight") >= F.col("cap"))
    )
    final = F.min(F.when(~F.col("capped"), F.struct((F.col("cap") / F.col("weight")).alias("r"), F.col("level").alias("l")))).over(everything)["l"]
    return ranked.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(final * F.col("weight"))).select("source", "source_size", "weight", "target")


def _prefix(df: DataFrame, keys: list[str], by: str, value: str, name: str) -> DataFrame:
    """Sum of value over earlier rows of the same keys; a bounded number of rows a key."""
    w = Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0).cast("long")))


RESULT = ("doc_id", "size", "source_size", "target", "taken")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken.

    A document without words has size 0 and takes nothing. A null source is a
    source of its own, sorted last. Rows that repeat an id are separate rows and
    each take their own share; equal rows are laid side by side, so the result
    doesn't depend on their order. A slot beyond max_repeats passes over its
    source stays empty, so that no document exceeds max_repeats times its size.
    Extra columns are ignored; an empty table gives no rows.
    """
    return _mix(docs, id_col, text_col, source_col, seed, max_repeats).select(*RESULT)


def _mix(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str, max_repeats: int) -> DataFrame:
    """What ``mix`` returns, with the source and a hash of the text, which tell rows that repeat an id apart."""
    rows = settle(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            word_count(F.col(text_col)).alias("size"),
            F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("order_key"),
            F.xxhash64(F.col(text_col)).alias("text_key"),
        ).withColumn("bucket", F.substring("order_key", 1, BUCKET_HEX))
    )
    by_bucket = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    sources = settle(
        source_targets(by_bucket.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), max_repeats).withColumn("sid", (F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1).cast("long"))
    )
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    block = max(1, min(BLOCK_TOKENS, total // LEAST_SLOTS))
    slots = -(-total // block)

    # Place every document on its source's shuffled line of tokens.
    starts = _prefix(by_bucket, ["source"], "bucket", "bucket_size", "bucket_start").drop("bucket_size")
    inside = Window.partitionBy("source", "bucket").orderBy("order_key", "doc_id", "size", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    same = rows["source"].eqNullSafe(starts["source"]) & (rows["bucket"] == starts["bucket"])
    few = sources.count() <= FEW_SOURCES
    placed = (
        rows.join(F.broadcast(starts) if few else starts, same)
        .select(rows["*"], "bucket_start")
        .withColumn("start", F.col("bucket_start") + F.coalesce(F.sum("size").over(inside), F.lit(0).cast("long")))
        .drop("bucket_start", "bucket", "order_key")
    )

    # Which source each slot takes: its point among the cumulative targets, by cells.
    ends = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = (
        sources.withColumn("hi", F.round(F.sum("target").over(ends) / F.lit(float(max(total, 1))) * MODULUS).cast("long"))
        .withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("sid")), F.lit(0).cast("long")))
        .where("hi > lo")
        .withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / F.lit(MODULUS // CELLS)), F.floor((F.col("hi") - 1) / F.lit(MODULUS // CELLS)))))
        .select("sid", "lo", "hi", "cell")
    )
    points = docs.sparkSession.range(slots).select(
        F.col("id").alias("slot"), F.pmod(F.pmod(F.col("id") + 1, F.lit(MODULUS)) * F.lit(GOLDEN), F.lit(MODULUS)).alias("u")
    ).withColumn("cell", F.floor(F.col("u") / F.lit(MODULUS // CELLS)))
    drawn = points.join(spans, "cell").where("u >= lo and u < hi").select("sid", "slot", F.floor(F.col("slot") / F.lit(SLOT_CHUNK)).alias("chunk"))

    few_sources = lambda *columns: F.broadcast(sources.select(*columns)) if sources.count() <= MOST_SOURCES else sources.select(*columns)

    # Rank slots per source: counts of chunks, then ranks inside a chunk.
    counts = _prefix(drawn.groupBy("sid", "chunk").agg(F.count(F.lit(1)).alias("n")), ["sid"], "chunk", "n", "before").drop("n")
    blocks = F.ceil(F.col("source_size") / F.lit(block))
    ranked = (
        drawn.withColumn("rank_in", F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")) - 1)
        .join(counts, ["sid", "chunk"])
        .join(few_sources("sid", "source_size"), "sid")
        .withColumn("rank", F.col("before") + F.col("rank_in"))
        .where(F.col("rank") < blocks * max_repeats)
    )
    uses = ranked.groupBy("sid", F.pmod(F.col("rank"), blocks).alias("block")).agg(F.count(F.lit(1)).alias("times"))

    # A document takes, of each block it lies in, its overlap times the block's uses.
    turns = ranked.groupBy("sid").agg(F.count(F.lit(1)).alias("turns"))
    turned = sources.join(turns, "sid", "left").select(F.col("source").alias("s_source"), "sid", "source_size", "target", F.coalesce("turns", F.lit(0).cast("long")).alias("turns"))
    info = F.broadcast(turned) if sources.count() <= MOST_SOURCES else turned
    known = placed.join(info, placed["source"].eqNullSafe(F.col("s_source"))).drop("s_source")
    lies = (
        known.where("size > 0")
        .select("sid", "doc_id", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("block"))
        .withColumn("overlap", F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("start"), F.col("block") * block))
    )
    taken = lies.join(uses, ["sid", "block"]).groupBy("sid", F.col("start").alias("t_start")).agg(F.sum(F.col("overlap") * F.col("times")).alias("taken"))
    # Where the slots of a source end on its line of tokens, and where its target does.
    passed = lambda to: F.floor(to / F.col("source_size")) * F.col("size") + F.least(F.greatest(F.pmod(to, F.col("source_size")) - F.col("t_start"), F.lit(0)), F.col("size"))
    reached = F.floor(F.col("turns") / blocks) * F.col("source_size") + F.least(F.pmod(F.col("turns"), blocks) * block, F.col("source_size"))
    meant = F.least(F.round("target").cast("long"), F.col("source_size") * max_repeats)
    settled = (F.coalesce("taken", F.lit(0)) + passed(meant) - passed(reached)).cast("long")
    # (sid, start) names a document with words: documents of a source never overlap.
    return (
        known.where("size > 0").withColumnRenamed("start", "t_start").join(taken, ["sid", "t_start"], "left")
        .select("source", "text_key", "doc_id", "size", "source_size", "target", settled.alias("taken"))
        .unionByName(known.where("size = 0").select("source", "text_key", "doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken")))
    )


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself, in whole documents: each row as often as it is taken, to the nearest
    whole number of times (only the document at a source's end is taken in part).

    Columns as in docs, whatever their names. Null ids are documents like others;
    rows that repeat an id with another text or source are told apart. Of rows that
    repeat id, text and source, one (see ``one_each``) stands for all and is taken as
    often as they are together. Null, empty and wordless texts can't be taken. An
    empty table stays empty.
    """
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0)
    keys = ["doc_id", "source", "text_key"]
    counted = _mix(docs, id_col, text_col, source_col, "mix", MAX_REPEATS).groupBy(*keys).agg(F.sum(times).cast("int").alias("copies"), F.count(F.lit(1)).alias("rows"))
    copies = settle(counted.where("copies > 0"))
    of_row = {"doc_id": F.col(id_col), "source": F.col(source_col), "text_key": F.xxhash64(F.col(text_col))}
    if not copies.where("rows > 1").isEmpty():
        docs = one_each(docs, of_row)
    if copies.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        copies = F.broadcast(copies)
    packed = docs.select(F.struct("*").alias("_row"), *[key.alias(f"_{name}") for name, key in of_row.items()])
    mixed = packed.join(copies, [packed[f"_{name}"].eqNullSafe(copies[name]) for name in keys])
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")


def op3_mix(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5('mix|' || coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents
), s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS sid, source_size * {MAX_REPEATS} AS cap FROM s0
), s2 AS (SELECT *, CASE sid % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s1),
s3 AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM s2 WINDOW w AS (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), s4 AS (SELECT *, level * weight >= cap AS capped FROM s3),
s5 AS (
  SELECT *, CASE WHEN capped THEN cap::DOUBLE ELSE weight * (SELECT arg_min(level, cap / weight) FROM s4 WHERE NOT capped) END AS target FROM s4
), t AS (SELECT sum(source_size)::BIGINT AS total, greatest(1, least({BLOCK_TOKENS}, sum(source_size)::BIGINT // {LEAST_SLOTS})) AS b FROM s5),
s AS (
  SELECT s5.*, round(sum(target) OVER (ORDER BY sid) / (SELECT greatest(total, 1) FROM t) * {MODULUS})::BIGINT AS hi FROM s5
), sp AS (SELECT *, coalesce(lag(hi) OVER (ORDER BY sid), 0) AS lo FROM s),
u AS (SELECT i AS slot, ((i + 1) % {MODULUS}) * {GOLDEN} % {MODULUS} AS u FROM t, range(0, CAST(ceil(total::DOUBLE / b) AS BIGINT)) r(i)),
k AS (
  SELECT sp.sid, sp.source_size, row_number() OVER (PARTITION BY sp.sid ORDER BY slot) - 1 AS rank
  FROM u JOIN sp ON u.u >= sp.lo AND u.u < sp.hi
), n AS (
  SELECT sid, rank % CAST(ceil(source_size::DOUBLE / b) AS BIGINT) AS block, count(*) AS times
  FROM k, t WHERE rank < {MAX_REPEATS} * CAST(ceil(source_size::DOUBLE / b) AS BIGINT) GROUP BY ALL
), m AS (
  SELECT sp.sid, least(round(target)::BIGINT, {MAX_REPEATS} * source_size) AS meant, CAST(ceil(source_size::DOUBLE / b) AS BIGINT) AS blocks,
    coalesce((SELECT sum(n.times) FROM n WHERE n.sid = sp.sid), 0)::BIGINT AS turns FROM sp, t
), e AS (SELECT m.sid, meant, turns // greatest(blocks, 1) * source_size + least(turns % greatest(blocks, 1) * b, source_size) AS reached FROM m JOIN sp USING (sid), t
), p AS (
  SELECT d.doc_id, d.size, sp.sid, sp.source_size, sp.target,
         coalesce(sum(d.size) OVER (PARTITION BY sp.sid ORDER BY k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN sp ON d.source IS NOT DISTINCT FROM sp.source
), l AS (
  SELECT p.sid, p.start, sum((least(start + size, (n.block + 1) * b) - greatest(start, n.block * b)) * times)::BIGINT AS taken
  FROM p JOIN t ON true JOIN n ON n.sid = p.sid AND n.block * b < p.start + p.size AND (n.block + 1) * b > p.start
  WHERE size > 0 GROUP BY ALL
)
SELECT p.doc_id, p.size, p.source_size, p.target, CASE WHEN p.size > 0 THEN CAST(coalesce(l.taken, 0)
  + meant // source_size * size + least(greatest(meant % source_size - p.start, 0), size) - reached // source_size * size - least(greatest(reached % source_size - p.start, 0), size) AS BIGINT) ELSE 0 END AS taken
FROM p JOIN e ON e.sid = p.sid LEFT JOIN l ON p.sid = l.sid AND p.start = l.start AND p.size > 0
"""
