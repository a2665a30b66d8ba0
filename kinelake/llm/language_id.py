"""Language identification with hyperdimensional profiles.

Every letter owns a random vector of +1 and -1. The vector of an n-gram binds its
letters' vectors, each permuted by its place (a roll), by multiplication; a text's
vector bundles (sums) its n-grams' vectors; a language's prototype bundles its
sample texts. A text gets the language whose prototype has the highest cosine
with it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.llm.arrow import map_column
from kinelake.session import settle

DIMENSIONS, NGRAM, SEED = 512, 3, 20
#: Training texts of a language, on average over the choice of the hash (documented bound).
TRAIN_DOCS = 1500
#: n-gram vectors that a task remembers: 512 float32 each.
REMEMBERED = 60_000
#: Letters whose vectors a task remembers; the others are drawn again.
LETTERS = 8192
#: Sharpness of the score: exp(SHARPNESS * cosine), normalised over languages.
SHARPNESS = 25.0
NO_LANGUAGE = "und"


class Encoder:
    """Vectors of texts; letters' vectors are drawn from (seed, code point), so all tasks agree."""

    def __init__(self, dimensions: int = DIMENSIONS, ngram: int = NGRAM, seed: int = SEED) -> None:
        self.dimensions, self.ngram, self.seed = dimensions, ngram, seed
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.table = np.empty((1024, dimensions), dtype=np.float32)
        self.is_letter = np.array([chr(c).isalpha() for c in range(0x40000)])

    def _letter(self, code: int) -> np.ndarray:
        """Code 0, anything but letters, is the word boundary and has a vector, too."""
        if code not in self.letters:
            if len(self.letters) >= LETTERS:
                self.letters.clear()
            rng = np.random.default_rng([self.seed, code])
            self.letters[code] = rng.integers(0, 2, self.dimensions).astype(np.float32) * 2 - 1
        return self.letters[code]

    def _bound(self, gram: int) -> np.ndarray:
        out = np.ones(self.dimensions, dtype=np.float32)
        for place in range(self.ngram):
            out *= np.roll(self._letter((gram >> (18 * place)) & 0x3FFFF), place)
        return out

    def _rows_of(self, grams: list[int]) -> np.ndarray:
        if len(self.rows) + len(grams) > max(REMEMBERED, len(grams)):
            self.rows.clear()
        for gram in grams:
            if gram not in self.rows:
                at = self.rows[gram] = len(self.rows)
                if at == len(self.table):
                    self.table = np.concatenate([self.table, np.empty_like(self.table)])
                self.table[at] = self._bound(gram)
        return np.fromiter((self.rows[g] for g in grams), dtype=np.int64, count=len(grams))

    def vector(self, text: str | None) -> np.ndarray | None:
        """Sum of the vectors of all n-grams of the text; None if it has no letter."""
        codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        codes = np.where(self.is_letter[np.minimum(codes, len(self.is_letter) - 1)], codes, 0)
        if not codes.any():
            return None
        codes = np.concatenate([[0], codes, [0]])
        codes = codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]  # one boundary in a row
        grams = sum(codes[p : len(codes) - self.ngram + 1 + p] << (18 * p) for p in range(self.ngram))
        kinds, counts = np.unique(grams, return_counts=True)
        out = np.zeros(self.dimensions, dtype=np.float32)
        for at in range(0, len(kinds), 4096):
            rows = self._rows_of(kinds[at : at + 4096].tolist())
            out += counts[at : at + 4096].astype(np.float32) @ self.table[rows]
        return out


_encoder: Encoder | None = None


def encoder() -> Encoder:
    global _encoder
    _encoder = _encoder or Encoder()
    return _encoder


def forget() -> None:
    """A task's n-gram vectors go with it."""
    global _encoder
    _encoder = None


def held_out(id_col):
    """Rows that no model learns from: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS) -> dict[str, np.ndarray]:
    """Unit prototype of each language, from about train_docs hashed texts of each that aren't held out.

    Only the prototypes, one row a language and dimension, reach the driver. Null
    languages, null ids and texts without a letter teach nothing; an empty table, no language.
    """
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rates = settle(usable.groupBy("lang").agg((F.lit(float(train_docs)) / F.count(F.lit(1))).alias("rate")))
    if rates.count() <= 10_000:  # language codes; with more, Spark chooses the join
        rates = F.broadcast(rates)
    chosen = usable.join(rates, "lang").where(F.pmod(F.xxhash64(F.lit("train"), "doc_id"), F.lit(1 << 20)) < F.col("rate") * (1 << 20)).select("lang", "text")

    def run(texts: list) -> list:
        own = encoder()
        # Every text weighs alike, however long it is.
        vectors = [own.vector(text) for text in texts]
        return [[[] if v is None else np.round(v / (np.linalg.norm(v) or 1.0) * 1e6).astype(np.int64) for v in vectors]]

    parts = map_column(chosen, ["lang"], "text", run, {"vector": "array<long>"}, forget)
    sums = parts.select("lang", F.posexplode("vector").alias("place", "value")).groupBy("lang", "place").agg(F.sum("value").alias("value"))
    prototypes: dict[str, np.ndarray] = {}
    for row in sums.toLocalIterator():
        prototypes.setdefault(row["lang"], np.zeros(DIMENSIONS))[row["place"]] = row["value"]
    return {lang: (v / (np.linalg.norm(v) or 1.0)).astype(np.float32) for lang, v in sorted(prototypes.items())}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row.

    lang_pred is ``und`` with score 0 for a null text or one without letters, and
    where no language was learned. Equal cosines go to the first language by code
    point. Texts are read whole. Repeated rows, and rows with a null id, are predicted
    one by one; other columns are ignored. An empty table gives no rows.
    """
    names = list(prototypes)
    matrix = np.stack([prototypes[n] for n in names]) if names else np.zeros((0, DIMENSIONS), dtype=np.float32)

    def run(texts: list) -> list:
        own = encoder()
        langs, scores = [], []
        for text in texts:
            vector = own.vector(text) if names else None
            if vector is None:
                langs.append(NO_LANGUAGE)
                scores.append(0.0)
                continue
            cosines = (matrix @ vector).astype(np.float64) / max(float(np.linalg.norm(vector)), 1e-9)
            best = int(cosines.argmax())
            langs.append(names[best])
            scores.append(float(1.0 / np.exp(SHARPNESS * (cosines - cosines[best])).sum()))
        return [langs, scores]

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_column(slim, ["doc_id"], "text", run, {"lang_pred": "string", "score": "double"}, forget)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, learned from those not held out."""
    found = predict(docs, learn(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
