"""Toxicity of restored text: noisy-channel deobfuscation, then a linear score.

Spans that may be disguised - any with a digit or sign that stands for a letter,
letters set apart one by one, letters that are repeated - become lattices of what
each character may stand for. A Viterbi search under a character trigram model
finds the likeliest reading; all other words stay as they are, since their
lattice has one path. Words of the restored text, and their first letters, then
enter a logistic model that is learned from labelled rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.llm.arrow import ROWS, bound_batches, keep_rows, map_column
from kinelake.llm.exact_dedup import BROADCAST_IDS
from kinelake.llm.language_id import held_out
from kinelake.session import settle

#: What signs and digits are used for.
READINGS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "§": "s"}

#: Costs, in nats, of one disguise, of keeping a sign as it is, of a dropped repeat or separator.
DISGUISE, LITERAL, DROPPED = 1.0, 3.0, 0.4
SIGNS = re.escape("".join(READINGS))
SPAN = re.compile(
    rf"(?<![^\W_])(?:[^\W\d_]|[{SIGNS}])(?:[ .\-_*·][^\W\d_{SIGNS}]|[ .\-_*·][{SIGNS}]){{2,}}(?![^\W_])"
    rf"|(?:(?<![^\W_])[^\W_{SIGNS}]+)?[{SIGNS}](?:[^\W_]|[{SIGNS}])*"
    r"|(?<![^\W\d_])[^\W\d_]*?([^\W\d_])\1[^\W\d_]*"
)
SPACED = re.compile(rf"(?<![^\W_])(?<![{SIGNS}])(?:[^\W\d_]|[{SIGNS}])(?:\s+[^\W\d_{SIGNS}]|\s+[{SIGNS}]){{2,}}(?![^\W_])")
SEPARATOR, SEPARATORS = re.compile(r"[ .\-_*·]"), frozenset(" .-_*·")
DOUBLE, TRIPLE, RUN = re.compile(r"(.)\1"), re.compile(r"(.)\1\1"), re.compile(r"(.)\1+")
TRAILING, EDGES = "".join(READINGS), ".,;:?()\"'"
WORD = re.compile(r"[^\W\d_]+")

#: Bounds of what is learned: labelled rows (on average), word starts, toxic rows that a feature needs.
TRAIN_ROWS, STARTS, SUPPORT = 24_000, (4, 5, 6, 7), 3
#: Cells of each of the rows of the sketch of character counts (4 MB a row), and the rows' seeds.
CELLS, SEEDS = 1 << 19, (0x9E3779B1, 0x85EBCA77)
#: Tokens and spans that a process remembers, and characters of one.
REMEMBERED, LONG = 30_000, 48
#: Distinct trigrams that a task counts before it hands them on, and characters that it looks at together.
GRAMS_HELD, STRETCH = 300_000, 1 << 19
#: Bits of a code point in a packed trigram.
POINT = 21


def cells_of(gram: str) -> tuple[int, ...]:
    """Cell of a gram in each row of the sketch."""
    data = gram.encode("utf-32-le", "surrogatepass")
    return tuple(row * CELLS + zlib.crc32(data, seed) % CELLS for row, seed in enumerate(SEEDS))


def cell_counts(grams: dict[str, int]) -> Counter[int]:
    """What trigram counts add to the cells: for the trigram, its first two and its last character, and in all."""
    counts: Counter[str] = Counter(grams)
    for gram, n in grams.items():
        counts[gram[:2]] += n
        counts[gram[2]] += n
        counts[""] += n
    cells: Counter[int] = Counter()
    for gram, n in counts.items():
        for cell in cells_of(gram):
            cells[cell] += n
    return cells


class Counts:
    """Counts of character trigrams, pairs and single characters over all texts: a count-min sketch.

    No gram is left out and none is counted too low; one whose cells are all shared is
    counted too high, by the least of what shares them. Its size is the same for any input.
    """

    def __init__(self, table: np.ndarray) -> None:
        self.table = table

    @classmethod
    def of(cls, grams: dict[str, int]) -> Counts:
        """The sketch of given trigram counts."""
        table = np.zeros(CELLS * len(SEEDS), dtype=np.int64)
        for cell, n in cell_counts(grams).items():
            table[cell] = n
        return cls(table)

    def __getitem__(self, gram: str) -> int:
        return int(min(self.table[cell] for cell in cells_of(gram)))


class Restorer:
    """Viterbi decoder under character counts (or counts by trigram); space is the word boundary."""

    def __init__(self, counts: Counts | dict[str, int]) -> None:
        self.counts = counts if isinstance(counts, Counts) else Counts.of(counts)
        self.total = self.counts[""] + 1.0
        self.memory: dict[str, str] = {}
        self.tokens: dict[str, frozenset[str]] = {}
        self.costs: dict[tuple[str, str], float] = {}

    def cost(self, before: str, char: str) -> float:
        key = (before, char)
        found = self.costs.get(key)
        if found is None:
            if len(self.costs) > REMEMBERED:
                self.costs.clear()
            base = (self.counts[char] + 0.1) / (self.total + 10)
            found = self.costs[key] = -math.log((self.counts[before + char] + 20 * base) / (self.counts[before] + 20))
        return found

    def restore(self, span: str) -> str:
        """Likeliest reading of one span, in lower case."""
        key = " ".join(span.lower().split())
        if len(key) > LONG:
            return self._search(key)
        if key not in self.memory:
            if len(self.memory) > REMEMBERED:
                self.memory.clear()
            self.memory[key] = self._search(key)
        return self.memory[key]

    def words(self, token: str) -> Iterable[str]:
        """Words of a token without white space, and of its restored spans."""
        bare = token.strip(EDGES)
        if bare.isalpha() and not DOUBLE.search(bare):
            return (bare,)  # one path through its lattice
        found = self.tokens.get(token)
        if found is None:
            found = self.read(token)
            if len(token) <= LONG:
                if len(self.tokens) > REMEMBERED:
                    self.tokens.clear()
                self.tokens[token] = found
        return found

    def read(self, token: str) -> frozenset[str]:
        """``words``, without remembering the token."""
        bare = token.strip(EDGES)
        if bare.isalpha() and not TRIPLE.search(bare):
            return frozenset((bare, self.doubles(bare)))
        # Signs at the end are read both ways: as letters, and as none.
        spans = {form for m in SPAN.finditer(token) for form in (m[0], m[0].rstrip(TRAILING)) if form}
        restored = (word for span in spans for word in WORD.findall(self.restore(span)))
        return frozenset(WORD.findall(token)).union(restored)

    def doubles(self, word: str) -> str:
        """``restore`` of a word of letters, none of them three times in a row.

        The readings of a double letter lead to the same state at the next character, so each is
        decided by itself.
        """
        padded, kept, start = "  " + word + " ", [], 0
        for m in DOUBLE.finditer(word):
            at = m.end() - 1
            state, char, after = padded[at : at + 2], word[at], padded[at + 3]
            if DROPPED + self.cost(state, after) < self.cost(state, char) + self.cost(char + char, after):
                kept.append(word[start:at])
                start = at + 1
        return "".join(kept) + word[start:]

    def _search(self, span: str) -> str:
        spaced = SEPARATOR.search(span) is not None
        signs = READINGS.keys() | SEPARATORS if spaced else READINGS
        choices = [i for i, (a, b) in enumerate(zip("\0" + span, span, strict=False)) if b in signs or (a == b and b.isalpha())]
        # State: the last two characters read; value: cost and the way back.
        states: dict[str, tuple[float, tuple | None]] = {"  ": (0.0, None)}
        at = 0
        for place in [*choices, len(span)]:
            while at < place and len(states) > 1:
                states = self._step(states, [(span[at], 0.0)])
                at += 1
            if at < place:
                # One state is left and each character has one reading: what that costs decides nothing.
                ((state, (spent, way)),) = states.items()
                states = {(state + span[at:place])[-2:]: (spent, (span[at:place], way))}
            if place < len(span):
                char = span[place]
                if spaced and char in SEPARATORS:
                    steps = [("", DROPPED), (" ", LITERAL)]
                elif char in READINGS:
                    steps = [(c, DISGUISE) for c in READINGS[char]] + [(" ", LITERAL)]
                else:
                    steps = [(char, 0.0)]
                if place and char == span[place - 1] and char.isalpha():
                    steps.append(("", DROPPED))
                states = self._step(states, steps)
            at = place + 1
        best = min(states, key=lambda state: (states[state][0] + self.cost(state, " "), state)) if len(states) > 1 else next(iter(states))
        way = states[best][1]
        out: list[str] = []
        while way:
            out.append(way[0])
            way = way[1]
        return " ".join("".join(reversed(out)).split())

    def _step(self, states: dict[str, tuple[float, tuple | None]], steps: list[tuple[str, float]]) -> dict[str, tuple[float, tuple | None]]:
        """The cheapest way to each state after one character, which is read as one of steps."""
        fresh: dict[str, tuple[float, tuple | None]] = {}
        for state, (spent, way) in states.items():
            for out, price in steps:
                if not out:
                    new, total, path = state, spent + price, way
                else:
                    new, total, path = state[1] + out, spent + price + self.cost(state, out), (out, way)
                if new not in fresh or total < fresh[new][0]:
                    fresh[new] = (total, path)
        return fresh


def shortened(word: str) -> list[str] | None:
    """A word of letters with its runs of equal letters cut to any length from one on, as the lattice allows; None if that gives over 16."""
    made, at = [""], 0
    for m in RUN.finditer(word):
        cut = [word[at : m.start()] + m[1] * n for n in range(1, len(m[0]) + 1)]
        made, at = [head + tail for head in made for tail in cut], m.end()
        if len(made) > 16:
            return None
    return [head + word[at:] for head in made]


def words_of(text: str | None, restorer: Restorer) -> set[str]:
    """Distinct words of the text in lower case, and of its restored spans."""
    lower = (text or "").lower()
    tokens = lower.split()
    words = set().union(*map(restorer.words, set(tokens)))
    return words | spaced_words(lower, tokens, restorer)


def spaced_words(lower: str, tokens: list[str], restorer: Restorer) -> set[str]:
    """Words of spans that are written letter by letter with spaces."""
    if b"\1\1\1" not in bytes(map(min, map(len, tokens), repeat(9))):
        return set()
    return {word for m in SPACED.finditer(lower) for word in WORD.findall(restorer.restore(m[0]))}


def features_of(words: set[str]) -> set[str]:
    """Words, and word starts with one star for each distinct word that has them, three at most."""
    out = set(words)
    for n in STARTS:
        counts = Counter(w[:n] for w in words if len(w) >= n)
        out.update(start + "*" * stars for start, k in counts.items() for stars in range(1, min(k, 3) + 1))
    return out


def _sampled(rows: DataFrame, bound: int, salt: str) -> DataFrame:
    """About bound rows, chosen by a hash of doc_id; all of them if there are fewer."""
    n = rows.count()
    return rows.where(F.pmod(F.xxhash64(F.lit(salt), "doc_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, bound / max(n, 1))))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether WORD takes it, for every code point."""
    table = np.zeros(0x110000, dtype=bool)
    for m in WORD.finditer("".join(map(chr, range(len(table))))):
        table[m.start() : m.end()] = True
    return table


def trigrams(texts: list[str | None]) -> Iterable[tuple[np.ndarray, np.ndarray]]:
    """(packed trigrams, how often each occurs) of the texts' words in lower case, two spaces before and one after each; a stretch of characters at a time."""
    joined = "  " + " ".join((text or "").lower() for text in texts) + " "
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letters, space = _letters(), ord(" ")
    for at in range(0, len(points) - 2, STRETCH):
        part = points[at : at + STRETCH + 2]
        part = np.where(letters[part], part, space).astype(np.int64)
        first, middle, last = part[:-2], part[1:-1], part[2:]
        first = np.where(middle == space, space, first)
        inside = (middle != space) | (last != space)
        yield np.unique(((first << 2 * POINT) | (middle << POINT) | last)[inside], return_counts=True)


def _unpacked(gram: int) -> str:
    mask = (1 << POINT) - 1
    return chr(gram >> 2 * POINT) + chr(gram >> POINT & mask) + chr(gram & mask)


def character_model(texts: DataFrame) -> Counts:
    """Sketch of how often each character trigram of words, its first two and its last character occur in all texts.

    A task counts trigrams over all its texts and hands on cells once; when it holds
    GRAMS_HELD trigrams, it hands on what it has. Neither a shuffle nor the driver has more than
    the sketch's cells.
    """
    bound_batches(texts)

    def cells(grams: Counter[int]) -> pa.RecordBatch:
        found = cell_counts({_unpacked(gram): n for gram, n in grams.items()})
        return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.int64())], names=["cell", "n"])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        grams: Counter[int] = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                for found, n in trigrams(batch.column(0).slice(at, ROWS).to_pylist()):
                    for gram, k in zip(found.tolist(), n.tolist(), strict=True):
                        grams[gram] += k
                if len(grams) > GRAMS_HELD:
                    yield cells(grams)
                    grams.clear()
        yield cells(grams)

    counted = texts.select("text").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    table = np.zeros(CELLS * len(SEEDS), dtype=np.int64)
    for batch in counted.toArrow().to_batches():
        table[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return Counts(table)


def fit_weights(rows: list[tuple[list[int], int]], n_features: int, l2: float = 0.5, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic weights and intercept of documents given as feature numbers, by accelerated gradient steps."""
    weights, bias = np.zeros(n_features), 0.0
    if not rows:
        return weights, bias
    doc = np.repeat(np.arange(len(rows)), [len(f) for f, _ in rows])
    feature = np.array([x for f, _ in rows for x in f], dtype=np.int64)
    label = np.array([y for _, y in rows], dtype=float)
    share = min(max(label.mean(), 1e-3), 1 - 1e-3)
    # Both classes weigh alike, whichever is more frequent.
    importance = np.where(label > 0, 0.5 / share, 0.5 / (1 - share)) / len(label)
    m, v, mb, vb = np.zeros(n_features), np.zeros(n_features), 0.0, 0.0
    for step in range(1, steps + 1):
        z = bias + np.bincount(doc, weights=weights[feature], minlength=len(rows))
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label) * importance
        g, gb = np.bincount(feature, weights=error[doc], minlength=n_features) + l2 * weights / max(n_features, 1), error.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.1 / (1 + step / 100)
        weights -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        bias -= rate * (mb / (1 - 0.9**step)) / (math.sqrt(vb / (1 - 0.99**step)) + 1e-8)
    return weights, bias


class Model:
    """Character counts, feature weights and intercept: what a task needs to score texts."""

    def __init__(self, grams: Counts, weights: dict[str, float], bias: float) -> None:
        self.grams, self.weights, self.bias = grams, weights, bias
        self.starts = {f.rstrip("*") for f in weights if f.endswith("*")}
        self.heads = {start[: STARTS[0]] for start in self.starts}
        #: By their first letters, how long known starts are.
        self.lengths = {head: tuple(n for n in STARTS if any(len(s) == n for s in own)) for head, own in _grouped(self.starts).items()}
        self.forget()

    def forget(self) -> None:
        """Drop what was remembered: tokens' telling words by two generations, words that tell, tokens that tell nothing."""
        self.telling: dict[str, tuple[str, ...]] = {}
        self.before: dict[str, tuple[str, ...]] = {}
        self.known: set[str] = set()
        self.silent: set[str] = set()
        self.made = None

    def restorer(self) -> Restorer:
        """One restorer a task process, with its memory."""
        self.made = self.made or Restorer(self.grams)
        return self.made

    def _tells(self, word: str) -> bool:
        return word in self.weights or word[: STARTS[0]] in self.heads

    def _telling(self, token: str, bare: str) -> tuple[str, ...]:
        """Words of a token that the model knows, or whose start it knows; bare is the token without its edges."""
        found = self.before.get(token)
        if found is None:
            # A word that only repeats letters is read as one of few words: no search if none of them tells.
            read = shortened(bare) if bare.isalpha() and TRIPLE.search(bare) else None
            found = tuple(w for w in self.restorer().read(token) if self._tells(w)) if read is None or any(map(self._tells, read)) else ()
        if found and len(token) <= LONG:
            # Two generations: what is met again in time isn't forgotten.
            if len(self.telling) > REMEMBERED:
                self.before, self.telling = self.telling, {}
            self.telling[token] = found
        return found

    def score(self, text: str | None) -> float:
        lower = (text or "").lower()
        tokens = lower.split()
        words = spaced_words(lower, tokens, self.restorer())
        weights, heads, head = self.weights, self.heads, STARTS[0]
        own = set(tokens) - self.silent
        plain = own & self.known
        words |= plain
        silent, known = [], []
        for token in own - plain:
            found = self.telling.get(token)
            if found is None:
                bare = token.strip(EDGES)
                if bare.isalpha() and not DOUBLE.search(bare):
                    # One path through its lattice: there is nothing to search.
                    if bare in weights or bare[:head] in heads:
                        words.add(bare)
                        if bare == token:
                            known.append(token)
                    else:
                        silent.append(token)
                    continue
                found = self._telling(token, bare)
                if not found:
                    silent.append(token)
            words.update(found)
        self.silent, self.known = _remembered(self.silent, silent), _remembered(self.known, known)
        found = words & self.weights.keys()
        lengths, starts = self.lengths, self.starts
        started = Counter(w[:n] for w in words for n in lengths.get(w[: STARTS[0]], ()) if w[:n] in starts and len(w) >= n)
        found |= {start + "*" * stars for start, k in started.items() for stars in range(1, min(k, 3) + 1)} & self.weights.keys()
        z = self.bias + sum(self.weights[f] for f in sorted(found))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _remembered(tokens: set[str], more: list[str]) -> set[str]:
    """tokens and those of more that aren't too long; only the latter when there were REMEMBERED."""
    if len(tokens) > REMEMBERED:
        tokens = set()
    tokens.update(token for token in more if len(token) <= LONG)
    return tokens


def _grouped(starts: set[str]) -> dict[str, list[str]]:
    """Word starts by their first letters."""
    out: dict[str, list[str]] = {}
    for start in starts:
        out.setdefault(start[: STARTS[0]], []).append(start)
    return out


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Model of labelled rows that aren't held out: about TRAIN_ROWS of them, equal texts once.

    All features are kept that at least SUPPORT toxic and relatively few other texts
    have; the bound of labelled rows bounds them. Without any
    labelled row of either class all scores are those of the intercept, 0.
    """
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).alias("label"))
    chosen = settle(_sampled(marks, TRAIN_ROWS, "toxic"))
    # TRAIN_ROWS bounds the ids; the check guards against an odd hash.
    side = F.broadcast(chosen) if chosen.count() <= BROADCAST_IDS else chosen
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    joined = texts.join(side, "doc_id").groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")).agg(F.max("label").alias("label"), F.max("text").alias("text"), F.min("doc_id").alias("doc_id"))
    train = settle(joined)
    grams = character_model(texts)
    shared = docs.sparkSession.sparkContext.broadcast(Model(grams, {}, 0.0))

    def run(values: list) -> list:
        own = shared.value.restorer()
        return [[sorted(features_of(words_of(value, own))) for value in values]]

    listed = settle(map_column(train, ["doc_id", "label"], "text", run, {"features": "array<string>"}))
    positives = listed.where("label > 0").count()
    negatives = listed.count() - positives
    if not positives or not negatives:
        return Model(grams, {}, -1.0)
    rate1, rate0 = (F.col("pos") + 0.5) / (positives + 1), (F.col("neg") + 0.5) / (negatives + 1)
    ranked = (
        listed.select("label", F.explode("features").alias("feature")).groupBy("feature")
        .agg(F.sum(F.when(F.col("label") > 0, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col("label") > 0, 0).otherwise(1)).alias("neg"))
        .where((F.col("pos") >= SUPPORT) & (rate1 > 4 * rate0))
        .orderBy("feature").collect()
    )
    number = {r["feature"]: i for i, r in enumerate(ranked)}
    hits = map_column(listed, ["label"], "features", lambda lists: [[sorted(number[f] for f in own if f in number) for own in lists]], {"found": "array<int>"})
    rows = sorted((list(r["found"]), int(r["label"] > 0)) for r in hits.toLocalIterator())
    weights, bias = fit_weights(rows, len(number))
    return Model(grams, {f: float(weights[i]) for f, i in number.items() if weights[i]}, min(bias, -0.5))


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep columns, then score (0 to 1) and predicted (1 from 0.5 on).

    Null and empty texts get the score of the intercept. Every row is scored by
    itself, over its whole text; repeated rows get equal scores.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(values: list) -> list:
        scores = [shared.value.score(value) for value in values]
        return [scores, [int(s >= 0.5) for s in scores]]

    return map_column(docs, keep, text_col, run, {"score": "double", "predicted": "int"})


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = score(docs.select("doc_id", "text"), model, ["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose predicted label is 1; columns unchanged, whatever their names.

    Each row is judged by itself over its whole text: null and empty texts stay,
    rows that repeat an id are judged by their own texts, null ids have no label
    to learn from but are judged alike. An empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, id_col, text_col))
    return keep_rows(docs, text_col, lambda values: [shared.value.score(value) < 0.5 for value in values], lambda: shared.value.forget())
