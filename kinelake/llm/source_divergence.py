"""Divergence of the sources of each language, by one-hot level products.

How a term is priced between two sources depends on its two counts only. So every
term is a row of indicator columns, one for each (source, count) that occurs, and
the product of that matrix with its own transpose holds, for every two sources,
the joint table of their counts: how many terms have count a in one and b in the other.
The tables are priced cell by cell. Products are taken over blocks of terms sorted by
total, so that a block has few counts; they hold whole numbers far below 2^53, so
float64 matrix products are exact, and prices are 64-bit integers.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinelake.llm.arrow import bound_batches
from kinelake.session import settle

SCALE = 1_000_000_000
LEAST_DOCUMENTS = 3
TOP = 200
#: Sources of all languages together. The result has a row for every two of a language, so it would be out of reach before.
GROUPS_MOST = 100_000
#: Indicator columns of one product; terms of a block.
COLUMNS, TERMS = 512, 4096
#: Terms that a task remembers before it hands its counts on.
REMEMBERED = 200_000
#: Letters A-Z fall to a-z, a-z and all bytes from 128 stay, anything else parts terms.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, occurrences, documents) of whole texts; null lang, source and text count as empty."""
    bound_batches(docs)
    slim = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"))], F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def handed_on(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in held.items():
            # Terms of whole bytes runs are valid UTF-8 wherever the text is.
            terms = [t.decode("utf-8", "replace") for t in counts]
            values = np.array(list(counts.values()), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms), pa.array(values[:, 0]), pa.array(values[:, 1])], names=["lang", "source", "term", "occurrences", "documents"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = defaultdict(dict)
        size = 0
        for batch in batches:
            for lang, source, text in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                own: dict = {}
                for term in text.translate(LETTERS).split():
                    own[term] = own.get(term, 0) + 1
                counts = held[lang, source]
                size -= len(counts)
                for term, n in own.items():
                    if term in counts:
                        entry = counts[term]
                        entry[0] += n
                        entry[1] += 1
                    else:
                        counts[term] = [n, 1]
                size += len(counts)
                if size > REMEMBERED:
                    yield from handed_on(held)
                    held.clear()
                    size = 0
        yield from handed_on(held)

    made = slim.mapInArrow(count, "lang string, source string, term string, occurrences long, documents long")
    return made.groupBy("lang", "source", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("documents").alias("documents"))


def joint_prices(counts: np.ndarray, price_of: list) -> np.ndarray:
    """Of a block of terms (rows) by sources (columns): the value of every two sources, summed over the terms.

    price_of[g] gives the probability of a count in source g.
    """
    terms, groups = counts.shape
    total = np.zeros((groups, groups), dtype=np.int64)
    found = [np.unique(counts[:, g], return_inverse=True) for g in range(groups)]
    widths = [len(levels) for levels, _ in found]
    if sum(widths) > max(COLUMNS, 2 * groups) and terms > 1:
        half = terms // 2
        return joint_prices(counts[:half], price_of) + joint_prices(counts[half:], price_of)
    starts = np.concatenate([[0], np.cumsum(widths)])
    hot = np.zeros((terms, starts[-1]))
    for g, (_, level) in enumerate(found):
        hot[np.arange(terms), starts[g] + level] = 1.0
    p = np.array([price_of[g](int(c)) for g, (levels, _) in enumerate(found) for c in levels], dtype=np.int64)
    group = np.repeat(np.arange(groups), widths)
    joint = hot.T @ hot
    a, b = np.nonzero(joint)
    value = (p[a] - p[b]) ** 2 // p[b] * joint[a, b].astype(np.int64)
    np.add.at(total, (group[a], group[b]), value)
    return total


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_documents: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """Rows lang, source, part, item, value, rank (from 1 within a part of a source, value descending, item ascending).

    Part ``pair``: item is another source of the language, value the divergence from it
    summed over all kept terms; part ``term``: the terms that the source has more of than
    its language, the ``top`` first. Terms are kept that ``least_documents`` documents of
    the language have. p = 1 + floor(10^9 (count + 1) / (N + V)), V kept terms, N their occurrences;
    the value of p against q is floor((p - q)^2 / q). Null text, language and source count as
    empty; sources without terms take part, and a language without kept terms has pairs of
    value 0. Repeated rows count one by one, ids and extra columns don't matter, an empty
    table gives no rows. More than GROUPS_MOST sources are an error.
    """
    groups = settle(docs.select(F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(source_col), F.lit("")).alias("source")).distinct())
    held = groups.limit(GROUPS_MOST + 1).collect()
    if len(held) > GROUPS_MOST:
        raise ValueError(f"over {GROUPS_MOST} sources: merge them before")
    counts = settle(term_counts(docs, text_col, lang_col, source_col))
    by_term = counts.groupBy("lang", "term").agg(F.sum("documents").alias("documents"), F.sum("occurrences").alias("total"), F.collect_list(F.struct("source", "occurrences")).alias("counts"))
    kept = settle(by_term.where(F.col("documents") >= least_documents).drop("documents"))
    # One row a language or source: bounded by GROUPS_MOST.
    langs = {r["lang"]: (r["v"], int(r["n"])) for r in kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum(F.col("total").cast("decimal(38,0)")).alias("n")).collect()}
    each = kept.select("lang", "term", "total", F.explode("counts").alias("c")).select("lang", "term", "total", "c.source", "c.occurrences")
    sizes = {(r["lang"], r["source"]): int(r["n"]) for r in each.groupBy("lang", "source").agg(F.sum(F.col("occurrences").cast("decimal(38,0)")).alias("n")).collect()}
    sources: dict = defaultdict(list)
    for r in sorted(held):
        sources[r["lang"]].append(r["source"])
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(({k: {s: i for i, s in enumerate(v)} for k, v in sources.items()}, sizes, langs))

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, sizes, langs = shared.value
        totals: dict = {}
        for batch in batches:
            column = batch.column(0)
            start = 0
            while start < batch.num_rows:
                lang = column[start].as_py()
                own = places[lang]
                most = max(1, min(TERMS, (1 << 22) // len(own)))
                # Rows are sorted by language: the block ends with it.
                part = column.slice(start, most)
                end = start + next((i for i, x in enumerate(part.to_pylist()) if x != lang), len(part))
                table = np.zeros((end - start, len(own)), dtype=np.int64)
                for row, values in enumerate(batch.column(1).slice(start, end - start).to_pylist()):
                    for value in values:
                        table[row, own[value["source"]]] = value["occurrences"]
                v = langs[lang][0]
                price_of = [lambda c, d=sizes.get((lang, s), 0) + v: 1 + SCALE * (c + 1) // d for s in own]
                if lang not in totals:
                    totals[lang] = np.zeros((len(own), len(own)), dtype=np.int64)
                totals[lang] += joint_prices(table, price_of)
                start = end
        for lang, total in totals.items():
            names = pa.array(list(places[lang]))
            for g, source in enumerate(places[lang]):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(names)), pa.array([source] * len(names)), names, pa.array(total[g])], names=["lang", "source", "item", "value"])

    # A language may hold most terms: ranges of terms, not languages, are dealt out.
    dealt = kept.select("lang", "counts", "total", "term").repartitionByRange("lang", "total", "term").sortWithinPartitions("lang", "total", "term")
    summed = dealt.select("lang", "counts").mapInArrow(price, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    known = spark.createDataFrame([(k, s, sizes.get((k, s), 0)) for k, own in sources.items() for s in own], "lang string, source string, n long")
    pairs = known.select("lang", "source").join(known.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pairs = pairs.join(summed, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    norms = known.join(spark.createDataFrame([(k, v, n) for k, (v, n) in langs.items()], "lang string, v long, n_lang long"), "lang")

    def level(count: str, size: str):
        return F.expr(f"1 + CAST(CAST({count} + 1 AS DECIMAL(28,0)) * {SCALE}BD DIV ({size} + v) AS BIGINT)")

    priced = each.join(F.broadcast(norms), ["lang", "source"]).withColumns({"p": level("occurrences", "n"), "q": level("total", "n_lang")}).where("p > q")
    terms = priced.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) DIV q").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    # The limit of ranks is taken in every task before rows of a source meet.
    ranked = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(ranked)


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
), o AS MATERIALIZED (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term, count(*) AS c FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCUMENTS}),
v AS (SELECT lang, count(*) AS v, sum(c) AS n FROM k GROUP BY lang),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS c FROM o JOIN k USING (lang, term) GROUP BY lang, source, term),
s AS (SELECT g.lang, g.source, coalesce(sum(c.c), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
p AS MATERIALIZED (
  SELECT s.lang, s.source, k.term, coalesce(c.c, 0) AS c, 1 + CAST({SCALE} AS HUGEINT) * (coalesce(c.c, 0) + 1) // (s.n + v.v) AS p
  FROM s JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
), q AS (SELECT k.lang, k.term, 1 + CAST({SCALE} AS HUGEINT) * (k.c + 1) // (v.n + v.v) AS q FROM k JOIN v USING (lang)),
pair AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), u AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL
  SELECT p.lang, p.source, 'term', p.term, (p.p - q.q) * (p.p - q.q) // q.q FROM p JOIN q USING (lang, term) WHERE p.c > 0 AND p.p > q.q
), r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= {TOP}
"""
