"""Vector code compression: product codebooks learned with limb-split exact products.

Components become integers. All distances come from one identity,
``|x|^2 - 2 x.c + |c|^2``, whose dot products are float64 matrix products of limbs:
integers are broken into pieces so small that every sum of products stays below
2^53, where float64 is exact; the pieces' products are put together again in
int64. Of equal distances the first entry is taken. Tasks hand on sums and
counts by entry; the driver sees the codebooks only (16 entries a part).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.llm.arrow import bound_batches
from kinelake.llm.exact_dedup import BROADCAST_IDS
from kinelake.session import settle

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Integers below this power of two are exact in float64.
EXACT_BITS = 53


def limbs(values: np.ndarray, bits: int) -> list[np.ndarray]:
    """int64 values as float64 limbs, lowest first: values = sum of limb * 2 ** (bits * place).

    All limbs are below 2 ** bits in size; only the last one has a sign.
    """
    made = []
    while values.size and max(values.max(), -values.min()) >= 1 << bits:
        made.append((values & ((1 << bits) - 1)).astype(np.float64))
        values = values >> bits
    return [*made, values.astype(np.float64)]


def exact_dots(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """x @ c.T of int64 matrices, exact where the true results fit int64."""
    bits = (EXACT_BITS - math.ceil(math.log2(x.shape[1] + 1))) // 2
    total = np.zeros((len(x), len(c)), dtype=np.int64)
    right = limbs(c, bits)
    for i, a in enumerate(limbs(x, bits)):
        for j, b in enumerate(right):
            # Places beyond int64 wrap round, and back again in the sum.
            if bits * (i + j) < 64:
                total += (a @ b.T).astype(np.int64) << (bits * (i + j))
    return total


def nearest(x: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each row, the first of equally near ones, and its squared distance."""
    away = (codebook * codebook).sum(axis=1) - 2 * exact_dots(x, codebook)
    found = away.argmin(axis=1)
    return found, away[np.arange(len(x)), found] + (x * x).sum(axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def quantise(vectors: DataFrame, vector_col: str = "embedding", scale: int = SCALE, keep: tuple[str, ...] = ("vec_id", "label")) -> DataFrame:
    """keep and ints, floor(scale * x) of each component x.

    Rows go whose vector is null or holds a null, infinite or NaN component.
    """
    rows = vectors.select(*keep, F.col(vector_col).alias("_vector"))
    finite = F.forall("_vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.col("_vector").isNotNull() & finite).select(*keep, F.transform("_vector", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("ints"))


def learn_codebooks(rows: DataFrame, width: int, first: np.ndarray, rounds: int = ROUNDS, parts: int = PARTS) -> np.ndarray:
    """Codebooks (part, entry, place) after the rounds, starting from the rows of first.

    Every round assigns all rows and moves each entry to the floor of its rows' mean;
    entries that no row has stay.
    """
    size = width // parts
    books = np.ascontiguousarray(first.reshape(len(first), parts, size).transpose(1, 0, 2))
    for _ in range(rounds):

        def partial(batches: Iterator[pa.RecordBatch], books: np.ndarray = books) -> Iterator[pa.RecordBatch]:
            entries = books.shape[1]
            sums, counts = np.zeros(books.shape, dtype=np.int64), np.zeros(books.shape[:2], dtype=np.int64)
            for batch in batches:
                x = _matrix(batch.column(0))
                for part in range(parts):
                    own = x[:, part * size : (part + 1) * size]
                    found, _ = nearest(own, books[part])
                    counts[part] += np.bincount(found, minlength=entries)
                    for entry in np.unique(found):
                        sums[part, entry] += own[found == entry].sum(axis=0)
            part, entry, place = (at.ravel() for at in np.indices(books.shape))
            used = np.repeat(counts.ravel(), size)
            held = used > 0
            yield pa.RecordBatch.from_arrays([pa.array(values[held]) for values in (part, entry, place, sums.ravel(), used)], names=["part", "entry", "place", "total", "n"])

        moved = (
            rows.select("ints")
            .mapInArrow(partial, "part long, entry long, place long, total long, n long")
            .groupBy("part", "entry", "place")
            .agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
        )
        books = books.copy()
        for r in moved.collect():
            books[r["part"], r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return books


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """One row a kept vector: vec_id, code, error, label_error, codebooks_sha256.

    Vectors that are null or hold null or non-finite components are dropped. code has
    two hex digits a part, error the squared distances to the entries summed over the
    parts, label_error the sum of error over equal labels (nulls are equal);
    codebooks_sha256 names the codebooks. They start from the rows with the smallest
    ids (null ids last; of equal ids the smaller vector first), fewer than ``entries``
    if the table has fewer rows. Repeated rows count one by one. Vectors shorter than
    the longest one, or than the next multiple of ``parts``, are filled with zeros. Other columns
    may have any names; an empty table gives no rows. Components so large that a
    squared error might not fit 64 bits are an error.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits a part: entries must be 1 to 256")
    bound_batches(vectors)
    slim = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("_given"))
    settled = settle(quantise(slim, "_given", scale))
    seen = settled.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("ints")).alias("longest"), F.min(F.size("ints")).alias("shortest"), F.max(F.greatest(F.array_max("ints"), -1 - F.array_min("ints"))).alias("most")).first()
    if not seen["n"]:
        return settled.select("vec_id").where("false").selectExpr("vec_id", "'' AS code", "0L AS error", "0L AS label_error", "'' AS codebooks_sha256")
    width = max(1, -(-seen["longest"] // parts)) * parts
    if width * (2 * (int(seen["most"] or 0) + 1)) ** 2 >= 1 << 62:
        raise ValueError(f"components up to {seen['most']} after scaling: their squared errors may not fit 64 bits")
    rows = settled
    if seen["shortest"] < width:
        rows = settled.withColumn("ints", F.concat("ints", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("ints"))))
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "ints").select("ints").limit(entries).collect()
    books = learn_codebooks(rows, width, np.array([r["ints"] for r in first], dtype=np.int64), rounds, parts)
    size = width // parts

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(2))
            codes, error = np.zeros((len(x), parts), dtype=np.uint8), np.zeros(len(x), dtype=np.int64)
            for part in range(parts):
                codes[:, part], away = nearest(x[:, part * size : (part + 1) * size], books[part])
                error += away
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([row.tobytes().hex() for row in codes], type=pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    schema = rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).schema
    coded = settle(rows.select("vec_id", "label", "ints").mapInArrow(encode, schema))
    # Summed before the shuffle, so that a frequent label is a row a task; its rows meet a broadcast or a splittable join.
    labels = settle(coded.groupBy(F.col("label").alias("_label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error")))
    labels = F.broadcast(labels) if labels.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else labels
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return coded.join(labels, coded["label"].eqNullSafe(labels["_label"])).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _op13_sql() -> str:
    """Rounds written out one after the other, in integers."""
    away = "SELECT x.r, x.part, c.entry, sum((x.v - c.v) * (x.v - c.v)) AS away FROM x JOIN c{0} c USING (part, place) GROUP BY ALL"
    near = "SELECT r, part, arg_min(entry, away * 16 + entry) AS entry, min(away) AS away FROM (" + away + ") GROUP BY ALL"
    steps = []
    for i in range(ROUNDS):
        steps.append(f"a{i} AS MATERIALIZED ({near.format(i)})")
        steps.append(
            f"c{i + 1} AS MATERIALIZED (SELECT o.part, o.entry, o.place, coalesce(m.v, o.v) AS v FROM c{i} o LEFT JOIN ("
            f"SELECT part, entry, place, (sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*) AS v FROM x JOIN a{i} USING (r, part) GROUP BY ALL) m USING (part, entry, place))"
        )
    return f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, embedding AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([v FOR v IN embedding IF v IS NULL OR NOT isfinite(v)]) = 0
), p AS (SELECT r, unnest(e) AS f, generate_subscripts(e, 1) - 1 AS spot, len(e) // {PARTS} AS size FROM k),
x AS MATERIALIZED (SELECT r, spot // size AS part, spot % size AS place, CAST(floor(CAST(f AS DOUBLE) * {SCALE}) AS HUGEINT) AS v FROM p),
c0 AS (SELECT part, r - 1 AS entry, place, v FROM x WHERE r <= {ENTRIES}),
{", ".join(steps)},
last AS MATERIALIZED ({near.format(ROUNDS)}),
t AS (SELECT r, string_agg(printf('%02x', CAST(entry AS INTEGER)), '' ORDER BY part) AS code, sum(away) AS error FROM last GROUP BY r),
l AS (SELECT label, sum(error) AS label_error FROM t JOIN k USING (r) GROUP BY label),
h AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM c{ROUNDS})
SELECT k.vec_id, t.code, CAST(t.error AS BIGINT) AS error, CAST(l.label_error AS BIGINT) AS label_error, h.codebooks_sha256
FROM t JOIN k USING (r) JOIN l ON l.label IS NOT DISTINCT FROM k.label CROSS JOIN h
"""


OP13_SQL = _op13_sql()
