"""op11, op12 and op13 against versions written from their definitions."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from kinelake.llm import simhash, source_divergence, vector_codes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, value int, item string, node long"


def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and clashing extra columns."""
    long = " ".join(f"word{i % 700}" for i in range(4000))
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t", "en", "a"), (4, "One two", "en", "a"), (5, "one TWO", "de", "b"), (5, "one TWO", "de", "b"), (6, long, "en", None), (7, long + " x", "en", "b"), (8, "Éa 1d10t i d i o t", "fr", "c"), (None, "Éa two", "en", "a"), (9, "two TWO éa ÉA", "en", "c")]
    return spark.createDataFrame([(*r, 0, 1, 2, "i", 3) for r in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_fingerprint(text):
    words = [w.decode("utf-8", "surrogateescape") for w in re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))]
    shingles = [words] if 0 < len(words) < 3 else [words[i : i + 3] for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64(" ".join(s).encode("utf-8", "surrogateescape"), seed=42).intdigest() for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_components(nodes):
    """Least id of each node's component; nodes: id -> fingerprint."""
    least = {i: i for i in nodes}

    def top(i):
        while least[i] != i:
            i = least[i]
        return i

    for a in nodes:
        for b in nodes:
            if a < b and (nodes[a] ^ nodes[b]).bit_count() <= 2:
                x, y = top(a), top(b)
                least[max(x, y)] = min(x, y)
    return {i: top(i) for i in nodes}


def test_fingerprints(spark):
    texts = [r["text"] for r in odd(spark).collect()]
    assert [simhash.fingerprint(t.encode() if t is not None else None) % (1 << 64) for t in texts] == [plain_fingerprint(t) for t in texts]


def test_half_way_anchors():
    rng = np.random.default_rng(5)
    fps = rng.integers(-(2**63), 2**63 - 1, 400, dtype=np.int64)
    rows, at = simhash.anchors(fps, 1)
    assert len(at) < 18 * len(fps)
    # all anchors within the parts' radii are found: each word has just one
    assert len(simhash.anchors(fps, 0)[1]) == len(fps)
    flips = rng.integers(0, 64, (400, 2))
    other = fps.copy()
    for i, (a, b) in enumerate(flips):
        for bit in {a, b}:
            other[i] ^= np.uint64(1 << int(bit)).view(np.int64) if bit == 63 else np.int64(1 << int(bit))
    rows_b, at_b = simhash.anchors(other, 1)
    for i in range(400):
        assert set(at[rows == i]) & set(at_b[rows_b == i])


def test_anchor_distance_is_exact():
    """Of one part of the code, the anchors by distance are those of all code words."""
    length, polynomial, radius = 15, 0b10011, 1
    words = np.arange(1 << length)
    code = words[simhash._rest(words, length, polynomial) == 0]
    assert len(code) == 1 << 11
    starts, masks = zip(*simhash.patterns(length, polynomial, radius, 1), strict=True)
    for word in (0, 77, 20001):
        s = int(simhash._rest(np.array([word]), length, polynomial)[0])
        for over in (0, 1):
            found = {int(word ^ m) for m in masks[over][starts[over][s] : starts[over][s + 1]]}
            want = {int(c) for c in code if (lambda d: d <= radius if over == 0 else d == radius + 1)(int(c ^ word).bit_count())}
            assert found == want


@pytest.mark.parametrize("hot", [64, 2])
def test_simhash_links_against_all_pairs(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT_ANCHOR", hot)
    rng = np.random.default_rng(hot)
    centres = rng.integers(0, 2**63, 30, dtype=np.uint64)
    values = []
    for c in centres.tolist():
        values.append(c)
        for _ in range(8):
            # chains: each one or two bits from an earlier one
            values.append(values[-1 - int(rng.integers(0, 3)) % len(values)] ^ (1 << int(rng.integers(0, 64))) ^ (1 << int(rng.integers(0, 64))))
    # a ball round one word: all words within two bits of it, far more than an anchor compares in pairs
    values += [centres.tolist()[0] ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(i)]
    nodes = {i: v for i, v in enumerate(dict.fromkeys(values))}
    fps = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in nodes.values()], "fp long")
    edges = [(r["a"], r["b"]) for r in simhash.links(fps).collect()]
    by_fp = {int(np.uint64(v).view(np.int64)): i for i, v in nodes.items()}
    assert all((nodes[by_fp[a]] ^ nodes[by_fp[b]]).bit_count() <= 2 for a, b in edges)
    least = {i: i for i in nodes}

    def top(i):
        while least[i] != i:
            i = least[i]
        return i

    for a, b in edges:
        x, y = top(by_fp[a]), top(by_fp[b])
        least[max(x, y)] = min(x, y)
    assert {i: top(i) for i in nodes} == plain_components(nodes)


def test_simhash_groups(spark):
    got = simhash.simhash_groups(odd(spark)).collect()
    assert len(got) == 11
    rows = {r["doc_id"]: r for r in got}
    # null, empty and wordless texts have fingerprint zero and link
    assert {rows[i]["component_id"] for i in (1, 2, 3)} == {1} and rows[1]["fingerprint"] == "0" * 16
    assert rows[4]["component_id"] == rows[5]["component_id"] == 4
    assert rows[6]["component_id"] == rows[7]["component_id"] == 6
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    nodes = {r["doc_id"]: plain_fingerprint(r["text"]) for r in docs.collect()}
    want = plain_components(nodes)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.simhash_groups(docs).collect()} == {i: (f"{nodes[i]:016x}", want[i]) for i in nodes}
    assert simhash.simhash_groups(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        simhash.links(docs, 1)


def plain_divergence(rows, least=3, top=200):
    docs = [((lang or ""), (source or ""), [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        seen, groups = Counter(), defaultdict(Counter)
        for _, source, words in (d for d in docs if d[0] == lang):
            seen.update(set(words))
            groups[source].update(words)
        kept = sorted(t for t, n in seen.items() if n >= least)
        all_of = Counter()
        for c in groups.values():
            all_of.update(c)

        def p(c, t, kept=kept):
            return 1 + 10**9 * (c[t] + 1) // (sum(c[k] for k in kept) + len(kept))

        for source, c in groups.items():
            pair = [(other, sum((p(c, t) - p(o, t)) ** 2 // p(o, t) for t in kept)) for other, o in groups.items() if other != source]
            term = [(t, (p(c, t) - p(all_of, t)) ** 2 // p(all_of, t)) for t in kept if c[t] and p(c, t) > p(all_of, t)]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize("columns", [512, 8])
def test_divergence_against_definition(spark, monkeypatch, columns):
    monkeypatch.setattr(source_divergence, "COLUMNS", columns)
    monkeypatch.setattr(source_divergence, "REMEMBERED", 40)
    docs = odd(spark).unionByName(odd(spark)).unionByName(odd(spark).withColumn("source", F.col("item")))
    rows = [(r["text"], r["lang"], r["source"]) for r in docs.collect()]
    got = sorted(tuple(r) for r in source_divergence.divergence(docs).collect())
    assert got == plain_divergence(rows) and {r[2] for r in got} == {"pair", "term"}
    assert sorted(tuple(r) for r in source_divergence.divergence(docs, top=5).collect()) == plain_divergence(rows, top=5)
    # without kept terms pairs have the value 0
    assert {r["value"] for r in source_divergence.divergence(odd(spark), least_documents=99).collect()} == {0}
    assert source_divergence.divergence(empty(spark)).count() == 0


def plain_codes(rows, entries=16, rounds=6, parts=8, scale=4096):
    kept = [(i, [int(np.floor(float(np.float32(x)) * scale)) for x in v]) for i, v, _ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    size = len(kept[0][1]) // parts
    first = [v for _, v in sorted(kept)[:entries]]
    books = [[v[p * size : (p + 1) * size] for v in first] for p in range(parts)]

    def assign():
        found = []
        for _, v in kept:
            own = []
            for p in range(parts):
                away = [sum((a - b) ** 2 for a, b in zip(v[p * size : (p + 1) * size], e, strict=True)) for e in books[p]]
                own.append((away.index(min(away)), min(away)))
            found.append(own)
        return found

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                held = [v[p * size : (p + 1) * size] for (_, v), own in zip(kept, found, strict=True) if own[p][0] == e]
                if held:
                    books[p][e] = [sum(x) // len(held) for x in zip(*held, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return {(i, "".join(f"{e:02x}" for e, _ in own), sum(a for _, a in own), digest) for (i, _), own in zip(kept, assign(), strict=True)}


VECTORS = "vec_id long, embedding array<float>, label int, ints int, code string, _label int"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, "c", 2) for r in rows], VECTORS)


def test_exact_dots():
    rng = np.random.default_rng(2)
    for d, most in ((8, 40), (8, 1 << 29), (300, 1 << 27), (64, 5000)):
        x, c = rng.integers(-most, most, (50, d)), rng.integers(-most, most, (16, d))
        want = [[sum(int(a) * int(b) for a, b in zip(p, q, strict=True)) for q in c] for p in x]
        assert vector_codes.exact_dots(x, c).tolist() == want
        bits = 20
        parts = vector_codes.limbs(x, bits)
        assert (sum(p.astype(np.int64) << (bits * i) for i, p in enumerate(parts)) == x).all() and all(abs(p).max() < 1 << bits for p in parts)
    # equally near entries: the first
    assert vector_codes.nearest(np.array([[0, 0]]), np.array([[5, 5], [1, 0], [0, 1]]))[0].tolist() == [1]


@pytest.mark.parametrize("size", [1.0, 10000.0])
def test_codes_against_definition(spark, size):
    rng = np.random.default_rng(3)
    values = (rng.normal(0, size, (90, 16))).astype(np.float32).astype(float).tolist()
    rows = [(i * 7 % 90, v, i % 4 if i % 5 else None) for i, v in enumerate(values)]
    rows += [(200, None, 1), (201, [None, *values[0][1:]], 1), (202, [float("nan"), *values[0][1:]], 1), (203, [float("-inf"), *values[0][1:]], None), (204, values[3], 2), (205, values[3], 2), (205, values[3], 2)]
    got = vector_codes.compress(vectors(spark, rows)).collect()
    assert len(got) == 93
    assert {(r["vec_id"], r["code"], r["error"], r["codebooks_sha256"]) for r in got} == plain_codes(rows)
    label = {}
    kept = Counter()
    of = {r[0]: r[2] for r in rows}
    for r in got:
        kept[of[r["vec_id"]]] += r["error"]
        label[of[r["vec_id"]]] = r["label_error"]
    assert label == dict(kept)


def test_codes_of_few_odd_and_no_rows(spark):
    assert vector_codes.compress(vectors(spark, [])).count() == 0
    assert vector_codes.compress(vectors(spark, [(1, None, 1)])).count() == 0
    got = vector_codes.compress(vectors(spark, [(1, [0.5, 1.0], 1), (None, [], None), (3, [0.25] * 9, 1)])).collect()
    assert {(r["vec_id"], r["error"]) for r in got} == {(1, 0), (None, 0), (3, 0)}
    with pytest.raises(ValueError, match="64 bits"):
        vector_codes.compress(vectors(spark, [(1, [3e30] * 8, 1)]))
    with pytest.raises(ValueError, match="entries"):
        vector_codes.compress(vectors(spark, []), entries=300)
