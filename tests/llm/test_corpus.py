import hashlib
import struct
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kinelake.llm import exact_dedup, html_extract, jaccard_join, language_id, media, mixing, sentencepiece_codec, sharding, substring_dedup, toxicity
from kinelake.llm.components import components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and clashing extra columns."""
    long = " ".join(f"word{i}" for i in range(4000))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t", "en", "a", 3), (4, "One two", "en", "a", 7), (5, "one TWO", "de", "b", 7), (5, "one TWO", "de", "b", 7), (6, long, "en", None, len(long)), (7, long + " x", "en", "b", 1), (8, "Éa 1d10t i d i o t", "fr", "c", 1)]
    return spark.createDataFrame(rows, SCHEMA).withColumns({"size": F.lit(1), "key": F.lit("k"), "digest": F.lit(0), "ids": F.lit(1), "score": F.lit(2)})


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(spark, odd):
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(odd).collect()}
    assert (4, 5, 3, False) in got and (5, 5, 3, True) in got and (1, 2, 2, False) in got and (6, 6, 1, True) in got
    hashes = {r["doc_id"]: r["text_sha256"] for r in exact_dedup.exact_groups(odd).collect()}
    assert hashes[4] == hashlib.sha256(b"one two").hexdigest()
    assert exact_dedup.exact_groups(empty(spark)).count() == 0
    hot = spark.createDataFrame([(i, "same" if i % 3 == 0 else f"t{i}", "en", "s", 1) for i in range(900)], SCHEMA)
    assert exact_dedup.exact_groups(hot).where("kept").count() == 601
    assert {r["doc_id"] for r in exact_dedup.drop_exact_copies(odd).collect()} == {2, 3, 5, 6, 7, 8}


def test_mixing(spark, odd):
    got = mixing.mix(odd).collect()
    assert len(got) == odd.count() and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert mixing.mix(empty(spark)).count() == 0
    sizes = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 10), (None, 0)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    # by hand: a and c are capped at 300 and 30, b takes the rest
    assert got == {"a": 300.0, "b": 780.0, "c": 30.0, None: 0.0}


def test_sharding(spark, odd):
    for rows in (odd, spark.read.parquet(f"{SF}/documents.parquet")):
        got = sharding.shard(rows, 4).toPandas()
        assert len(got) == rows.count()
        for _, part in got.groupby("shard"):
            assert sorted(part["slot"]) == list(range(len(part)))
    loads = got.groupby("shard")["size"].sum()
    assert loads.max() - loads.min() < 0.02 * loads.mean()
    assert sharding.shard(empty(spark)).count() == 0
    first = {r["doc_id"]: r for r in sharding.shard(odd, 4).collect()}
    assert first[4]["text_crc32"] == zlib.crc32(b"One two") and first[1]["size"] == 16


def test_packing_against_brute_force():
    """The rule by its definition, item by item, and the spreads that it leaves."""
    rng = np.random.default_rng(1)
    loads = rng.integers(1, 1000, (400, 3)).astype(float)
    filler = rng.random(400) < 0.3
    bins = sharding.pack(loads, filler, 8)
    capacity = loads.sum(axis=0) / 8
    scaled = loads / capacity
    filler &= scaled.max(axis=1) < sharding.LARGEST_FILLER
    left = [[sum(scaled[i][d] for i in range(400) if not filler[i]) / 8 for d in range(3)] for _ in range(8)]
    for i in sorted((i for i in range(400) if not filler[i]), key=lambda i: -max(scaled[i])):
        holds = [b for b in range(8) if left[b][0] >= scaled[i][0]]
        if holds:
            best = max(sum(x * y for x, y in zip(scaled[i], left[b], strict=True)) for b in holds)
            assert bins[i] in holds and sum(x * y for x, y in zip(scaled[i], left[bins[i]], strict=True)) >= best - 1e-9
        for d in range(3):
            left[bins[i]][d] -= scaled[i][d]
    for d, most in enumerate((0.01, 0.06, 0.06)):
        sums = np.bincount(bins, weights=loads[:, d])
        assert sums.max() - sums.min() < most * sums.mean()
    assert len(sharding.pack(loads[:0], filler[:0], 8)) == 0


def test_levels_of_packing(spark, monkeypatch):
    """Several levels of buckets: groups stay whole, slots have no gaps, bytes are near equal."""
    monkeypatch.setattr(sharding, "BUCKET_GROUPS", 30)
    monkeypatch.setattr(sharding, "BUCKET_JOIN", 4)
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    got = sharding.shard(docs, 4).toPandas()
    assert len(got) == docs.count() and got.groupby("text_crc32")["shard"].nunique().max() == 1
    loads = got.groupby("shard")["size"].sum()
    assert loads.max() - loads.min() < 0.02 * loads.mean()
    assert all(sorted(part["slot"]) == list(range(len(part))) for _, part in got.groupby("shard"))
    one = spark.createDataFrame([(i, "x" * 1000 if i % 3 else f"t{i}", "en", "s", 1) for i in range(300)], SCHEMA)
    loads = sharding.shard(one, 10).groupBy("shard").agg(F.sum("size").alias("n")).toPandas()["n"]
    assert loads.max() < 1.6 * loads.mean()


def test_html():
    page = '<html><head><title>t</title><style>p{}</style></head><body><nav><a>Home</a></nav><div class="ad">Buy now, a long advert text that is here</div><article><h1>Ti&amp;tle</h1><p>One <b>t</b>wo\n three<br>four<p>&eacute;</article><div class="comments">No!</div><footer>f</footer>'
    assert html_extract.main_text(page) == "Ti&tle One two three four é"
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<script>x") == ""
    loose = "<div>Menu</div>" * 3 + "<p>" + "Long text of the story. " * 20 + "</p><p>" + "More of the story here. " * 20 + "</p>" + "<div>x</div>" * 3
    assert "Long text" in html_extract.main_text(loose) and "More of" in html_extract.main_text(loose)


def test_html_extra_columns(spark):
    rows = spark.createDataFrame([(1, None, "u", 5)], "page_id long, html string, url string, n_chars long")
    assert html_extract.extract(rows).collect()[0].asDict() == {"page_id": 1, "url": "u", "text": "", "n_chars": 0}


def test_media_round_trip(spark, odd):
    got = {r["doc_id"]: r for r in media.read_media(media.store_texts(odd)).collect()}
    for doc_id, text in ((1, ""), (4, "One two"), (8, "Éa 1d10t i d i o t")):
        raw = text.encode()
        payload = raw + b"\xff" * (576 - len(raw))
        assert got[doc_id]["payload_sha256"] == hashlib.sha256(payload).hexdigest() and got[doc_id]["n_bytes"] == len(raw)
        assert got[doc_id]["tail_crc32"] == zlib.crc32(payload[-32:])
    assert got[1]["media_sha256"] == got[2]["media_sha256"]


def test_png_filters_and_checksums():
    rng = np.random.default_rng(0)
    samples = rng.integers(0, 256, (24, 48), dtype=np.uint8)
    assert (media.read_png(media.write_png(samples)) == samples).all()
    # the five row filters, applied here by their definition
    rows = []
    for y in range(24):
        kind, row = y % 5, [y % 5]
        for x in range(48):
            a, b, c = (int(samples[y, x - 1]) if x else 0), (int(samples[y - 1, x]) if y else 0), (int(samples[y - 1, x - 1]) if x and y else 0)
            p = min((a, b, c), key=lambda v: (abs(a + b - c - v), (a, b, c).index(v)))
            row.append((int(samples[y, x]) - (0, a, b, (a + b) // 2, p)[kind]) & 255)
        rows.append(row)
    assert (media._unfilter(np.array(rows, dtype=np.uint8)) == samples).all()
    broken = bytearray(media.write_png(samples))
    broken[60] ^= 1
    with pytest.raises(ValueError):
        media.read_png(bytes(broken))


def brute_components(texts, size, percent):
    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}

    sets = {i: shingles(t) for i, t in texts}
    parent = {i: i for i in sets}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                ra, rb = a, b
                while parent[ra] != ra:
                    ra = parent[ra]
                while parent[rb] != rb:
                    rb = parent[rb]
                parent[max(ra, rb)] = min(ra, rb)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    return {i: root(i) for i in sets}


@pytest.mark.parametrize("hot", [64, 3])
def test_jaccard_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(jaccard_join, "HOT_KEY", hot)
    monkeypatch.setattr(jaccard_join, "BLOCK", 7)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows = [(0, None), (1, ""), (2, "a b"), (3, "A  b"), (4, "a b c")]
    for i in range(5, 60):
        words = [w if rng.random() > 0.012 else f"e{rng.integers(99)}" for w in base] if i % 2 else [f"x{rng.integers(40)}" for _ in range(rng.integers(1, 60))]
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.link(docs, size=4, percent=85).collect()}
    assert got == brute_components(rows, 4, 85)


@pytest.mark.parametrize("hot", [64, 2])
def test_links_are_the_same_whatever_counts_as_frequent(spark, monkeypatch, hot):
    monkeypatch.setattr(jaccard_join, "HOT_KEY", hot)
    rng = np.random.default_rng(8)
    rows = []
    for i in range(90):
        words = [f"x{rng.integers(6)}" for _ in range(rng.integers(8, 70))]
        copy = rows[rng.integers(len(rows))][1].split() if i % 3 == 2 else words
        rows.append((i, " ".join(w if rng.random() > 0.02 else "e" for w in copy)))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    tokens = np.unique(np.concatenate([jaccard_join.shingle_set(t, 4) for _, t in rows])).view(np.int64)
    for frequent in (tokens[:0], tokens, rng.permutation(tokens)[: len(tokens) // 3]):
        monkeypatch.setattr(jaccard_join, "frequent_tokens", lambda texts, size, frequent=frequent: frequent)
        got = {r["doc_id"]: r["component_id"] for r in jaccard_join.link(docs, size=4, percent=80).collect()}
        assert got == brute_components(rows, 4, 80)


def test_frequent_tokens_of_larger_tables(spark):
    """A tenth of the texts has a passage: it is frequent however few texts are sampled at least."""
    texts = spark.range(2000).selectExpr("id AS doc_id", "concat(CASE WHEN id % 10 = 3 THEN 'to be or not ' ELSE '' END, 'a', id, ' b', id, ' c', id, ' d', id) AS text")
    assert jaccard_join.shingle_set("to be or not", 4).view(np.int64)[0] in jaccard_join.frequent_tokens(texts, 4, sample_docs=16)


def test_a_small_set_does_not_blunt_the_bitmaps_of_large_ones():
    rng = np.random.default_rng(3)
    sets = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (9, 3000, 3000, 3000)]
    sets.append(np.concatenate([sets[3][:2950], rng.integers(0, 1 << 63, 50, dtype=np.uint64)]))
    maps = [jaccard_join._parities(t, 16 if len(t) < 99 else 256) for t in sets]
    assert jaccard_join._surviving(maps, np.array([len(t) for t in sets]), 0, 85).tolist() == [False, False, False, True, True]


def test_hot_keys_meet_by_themselves_unless_copies_share_them(spark):
    chain = [(100 + k, k + i, 9) for k in range(0, 30, 2) for i in range(3)]  # each key shares a set with the next
    copies = [(200 + k, 1000 + i, 9) for k in range(5) for i in range(4)]
    found = jaccard_join._groups(spark.createDataFrame(chain + copies, "key long, id long, n int")).groupBy("component").count().collect()
    assert sorted(r["count"] for r in found) == [3] * 15 + [4]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40) if i != 20] + [(7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {i: 0 if i <= 20 else 21 for i in range(41)}


def test_near_copies_keep_one(spark, odd):
    kept = sorted(r["doc_id"] for r in jaccard_join.drop_near_copies(odd).collect())
    assert kept == [1, 2, 3, 4, 6, 8]
    assert jaccard_join.link(empty(spark)).count() == 0


def test_language(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang_pred = lang").count() >= 0.95 * got.count()
    found = {r["doc_id"]: r for r in language_id.identify(odd).collect()}
    assert found[1]["lang_pred"] == found[2]["lang_pred"] == "und" and found[1]["score"] == 0
    assert language_id.identify(empty(spark)).count() == 0


def test_toxicity(spark, odd):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.learn(docs, labels)
    assert model.score("what an idiot and moron, a clown") > 0.5 > model.score("what a fine day for the clouds")
    assert model.score("what an 1d10t and m0r0n, a cl0wn i d i o t") > 0.5
    assert model.score(None) == model.score("") < 0.5
    none = toxicity.learn(odd, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert toxicity.score(odd, none, ["doc_id"]).where("predicted = 0").count() == odd.count()


def test_sentencepiece(spark, odd):
    got = {r["doc_id"]: r for r in sentencepiece_codec.round_trip(odd).collect()}
    assert all(r["parity"] and r["restored"] for r in got.values()) and got[1]["n_tokens"] == 0
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    texts = ["a  b ", "<s> x", "\n漢字 😀\n", " ", "x" * 500]
    ids, same, back = sentencepiece_codec.Codec(Path(sentencepiece_codec.MODEL).read_bytes()).encode(texts, verify=True)
    assert [x.tolist() for x in ids] == own.encode(texts) and all(same) and all(back)


def unigram_model(normal):
    """Bytes of a unigram model file with control, unknown, unused and byte pieces."""

    def field(number, wire, body):
        return bytes([number << 3 & 127 | wire | (128 if number > 15 else 0)]) + (bytes([number >> 4]) if number > 15 else b"") + (bytes([len(body)]) + body if wire == 2 else body)

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] + [("unused", -0.5, 5)] + [(p, s, 1) for p, s in normal]
    made = b"".join(field(1, 2, field(1, 2, p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, bytes([k]))) for p, s, k in pieces)
    trainer = field(3, 0, bytes([1])) + field(35, 0, bytes([1]))
    normaliser = field(1, 2, b"identity") + field(3, 0, bytes([1])) + field(4, 0, bytes([0])) + field(5, 0, bytes([1]))
    return made + field(2, 2, trainer) + field(3, 2, normaliser)


def test_unigram_model_is_rebuilt():
    import sentencepiece

    letters = [(c, -6.0 - i / 10) for i, c in enumerate("▁abcdenorstux<>/048")]
    data = unigram_model([*letters, ("▁a", -1.0), ("▁ab", -2.5), ("un", -3.0), ("used", -3.5), ("▁not", -3.0), ("s>", -4.0), ("</", -4.5), ("0x", -4.0)])
    codec, own = sentencepiece_codec.Codec(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    assert codec.model.kind == sentencepiece_codec.UNIGRAM and codec.bytes
    texts = ["ab a", "<s> a</s>", "<unk> not", "unused", "<0x41> 0x", "a é 漢😀 b", "  a  ", "", "a\nb", "zzz" * 30, "x" * 200]
    ids, same, back = codec.encode(texts, verify=True)
    assert [x.tolist() for x in ids] == own.encode(texts) and all(same) and all(back)
    assert codec.decode([x.tolist() for x in ids]) == texts


def test_chains_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(30):
        points = sorted({(int(a), int(b)) for a, b in rng.integers(0, 40, (12, 2))})
        best = [0.0] * len(points)
        for i, (p, r) in enumerate(points):
            best[i] = substring_dedup.SEED_SCORE + max([0.0] + [best[j] - substring_dedup.GAP_COST * (p - q + r - s) for j, (q, s) in enumerate(points) if q < p and s < r])
        chain = max(substring_dedup.chains(points), key=len, default=[])
        assert all(a < c and b < d for (a, b), (c, d) in zip(chain, chain[1:], strict=False))
        top = int(np.argmax(best))
        if best[top] > substring_dedup.SEED_SCORE:
            assert any(points[top] in c for c in substring_dedup.chains(points))


def test_passages_are_found(spark, odd):
    shared = [f"p{i}" for i in range(70)]
    fuzzy = [w if i % 25 else "edit" for i, w in enumerate(shared)]
    alone = lambda k: [f"u{k}_{i}" for i in range(60)]
    texts = [" ".join(alone(1) + shared + alone(2)), " ".join(alone(3) + shared), " ".join(fuzzy + alone(4)), " ".join(alone(5)), None, "short"]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate([*texts, texts[0]])], SCHEMA)
    got = {(r["doc_id"], r["other_id"]): r for r in substring_dedup.repeated_passages(docs).collect()}
    assert got[1, 0]["start"] == 60 and got[1, 0]["end"] == 130 and got[1, 0]["identity"] == 1.0
    assert got[2, 0]["words"] >= 60 and got[2, 0]["identity"] < 1 and got[6, 0]["words"] == 190
    assert 3 not in {i for pair in got for i in pair}
    assert substring_dedup.repeated_passages(empty(spark)).count() == 0
    assert substring_dedup.repeated_passages(odd).where("doc_id = 7").count() == 1


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.toxicity(spark, docs, SF)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    once = corpus_pipeline.exact_dedup(spark, docs, SF)
    lowered = [(r["doc_id"], (r["text"] or "").lower() if (r["text"] or "").isascii() else r["text"]) for r in docs.collect()]
    assert once.count() == docs.selectExpr("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t").distinct().count() <= len(lowered)
    near = corpus_pipeline.near_dedup(spark, once, SF)
    want = brute_components([(r["doc_id"], (r["text"] or "").encode().lower().decode()) for r in once.collect()], 5, 80)
    assert {r["doc_id"] for r in near.collect()} == set(want.values())
    mixed = corpus_pipeline.mixing(spark, near, SF)
    assert mixed.columns == docs.columns and 0 < mixed.count()
    assert corpus_pipeline.run(spark, SF).where("n_tokens <> size(ids) or not parity").count() == 0


def test_recombined_frequent_lines_are_found(spark):
    """Documents of frequent lines: every run of 50 words that an earlier text has lies in a passage."""
    rng = np.random.default_rng(3)
    lines = [[f"l{k}_{i}" for i in range(30)] for k in range(8)]
    alone = lambda k: [f"u{k}_{i}" for i in range(20)]
    orders = [[0], [1], [0, 1], [0], [1], [0, 1]] + [rng.integers(0, 8, rng.integers(1, 5)).tolist() for _ in range(60)]
    texts = [alone(n) + [w for k in order for w in lines[k]] + alone(n + 1000) for n, order in enumerate(orders, 1)]
    docs = spark.createDataFrame([(n, " ".join(t), "en", "s", 0) for n, t in enumerate(texts, 1)], SCHEMA)
    found = substring_dedup.repeated_passages(docs).collect()
    assert any((r["doc_id"], r["other_id"]) == (6, 3) and r["words"] >= 60 for r in found)
    size, seen = substring_dedup.MIN_WORDS, set()
    for n, t in enumerate(texts, 1):
        runs = [tuple(t[i : i + size]) for i in range(len(t) - size + 1)]
        for i, run in enumerate(runs):
            if run in seen:
                assert any(r["doc_id"] == n and r["start"] <= i and i + size <= r["end"] for r in found), (n, i)
        seen.update(runs)


def test_html_without_containers_and_with_several():
    def page(lengths):
        return "".join(f"<p>{f'w{i} ' * (n // 3)}</p>" for i, n in enumerate(lengths))

    def kept(text):
        return {int(w[1:]) for w in text.split()}

    assert kept(html_extract.main_text(page([100] * 4 + [20000] + [100] * 4))) == set(range(9))
    assert kept(html_extract.main_text(page([300] * 6 + [6] * 12 + [300] * 5))) == set(range(23))
    several = "<nav>Home</nav>" + "".join(f"<article><p>{f'w{i} ' * 60}</p></article>" for i in range(3)) + "<footer>f</footer>"
    assert kept(html_extract.main_text(several)) == {0, 1, 2}


def test_small_sources_meet_their_targets(spark):
    """300 words and 2.1 blocks in a corpus of over 51 million words."""
    big = spark.range(52, numPartitions=8).selectExpr("id AS doc_id", "repeat('w ', 1000000) AS text", "'en' AS lang", "'a' AS source", "0L AS n_chars")
    tail = spark.createDataFrame([(100 + i, "x " * 100, "en", "b", 0) for i in range(3)] + [(200 + i, "y " * 430, "en", "c", 0) for i in range(5)], SCHEMA)
    got = {r["source_size"]: (r["taken"], r["target"]) for r in mixing.mix(big.unionByName(tail)).groupBy("source_size").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()}
    assert got[300] == (900, 900.0) and got[2150] == (6450, 6450.0)


def test_character_model_counts_all_texts(spark):
    """More texts than were once sampled; one of them, without a label, has a rare word."""
    rows = [(i, f"plain words {i}", "en", "s", 0) for i in range(5000)] + [(5000, "zyx zyx Éab", "xx", "s", 0)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    grams = toxicity.learn(spark.createDataFrame(rows, SCHEMA), labels).grams
    assert grams["zyx"] == 2 and grams["éab"] == 1 and grams["pla"] == 5000


def test_disguises_at_the_end_doubled_and_spaced():
    grams = {}
    for word in ["idiot", "worthless", "stupid", "idol", "words", "less"]:
        for i in range(len(word) + 1):
            gram = f"  {word} "[i : i + 3]
            grams[gram] = grams.get(gram, 0) + 100
    restorer = toxicity.Restorer(grams)
    for text, word in (("idio7", "idiot"), ("worthle$$", "worthless"), ("worthle55", "worthless"), ("stuupid", "stupid"), ("1d10t!", "idiot"), ("idiot!", "idiot")):
        assert word in toxicity.words_of(text, restorer), text
    for text in ("1 d i o t", "i  d  i  o  t", "i\td\ti\to\tt", "so 1 d 1 0 7 ."):
        assert "idiot" in toxicity.words_of(text, restorer), text


def planted(rng, length, change):
    """Texts in pairs: each pair shares a passage of length words, of which change(i) are other words in the second."""
    word = lambda: f"v{rng.integers(4000)}"
    texts = []
    for _ in range(60):
        passage = [word() for _ in range(length)]
        texts.append([word() for _ in range(30)] + passage + [word() for _ in range(30)])
        texts.append([word() for _ in range(25)] + [word() if change(i) else w for i, w in enumerate(passage)] + [word() for _ in range(25)])
    return [" ".join(t) for t in texts]


def test_recall_of_fuzzy_passages(spark):
    """Share of planted passages of which four fifths or more are found; figures are in the README."""
    rng, docs, cases = np.random.default_rng(11), [], {}
    for length in (60, 80):
        for k in (20, 12, 10, 8):
            cases[f"{length} words, one in {k}"] = planted(rng, length, lambda i, k=k: i % k == k // 2)
        cases[f"{length} words, random 1/8"] = planted(rng, length, lambda i: rng.random() < 0.125)
    places = {}
    for name, texts in cases.items():
        for text in texts:
            docs.append((len(docs), text, "en", "s", 0))
        places[name] = range(len(docs) - len(texts), len(docs), 2)
    found = substring_dedup.repeated_passages(spark.createDataFrame(docs, SCHEMA)).collect()
    best = {}
    for r in found:
        pair = (r["doc_id"], r["other_id"])
        best[pair] = max(best.get(pair, 0), r["words"])
    recall = {name: np.mean([best.get((i + 1, i), 0) >= 0.8 * int(name[:2]) for i in own]) for name, own in places.items()}
    print(recall)
    assert min(recall.values()) >= 0.9
    assert all(abs(a - b) == 1 and max(a, b) % 2 for a, b in best)


CLASHES = ("score", "predicted", "_text", "copies", "_mixed", "_value", "_row", "_id", "digest", "row", "text_key", "node", "label", "rows")


@pytest.fixture(scope="module")
def clashing(spark):
    """Null ids, ids with several texts, repeated rows, and columns named like those that operators make."""
    near = " ".join(f"n{i}" for i in range(60))
    texts = [(5, "aaa"), (5, "unique text"), (9, "AAA"), (7, "dup one"), (7, "dup one"), (None, "no id"), (None, "no id"), (None, "aaa"), (3, None), (3, ""), (4, None), (2, near), (2, near + " end"), (None, near + " last"), (1, "other words here")]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(n) for n, c in enumerate(CLASHES)})


def counted(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_stages_neither_lose_nor_keep_rows_by_id(spark, clashing):
    once = exact_dedup.drop_exact_copies(clashing)
    near = [t for i, t in ((r["doc_id"], r["text"]) for r in clashing.collect()) if t and t.startswith("n0 ")]
    assert once.columns == clashing.columns
    want = [(5, "unique text"), (9, "AAA"), (7, "dup one"), (None, "no id"), (4, None), (1, "other words here"), (2, near[0]), (2, near[1]), (None, near[2])]
    assert counted(once) == sorted(want, key=str)
    left = jaccard_join.drop_near_copies(clashing)
    assert left.columns == clashing.columns
    kept = counted(left)
    # wordless texts stay, one near copy under the smallest id stays, of equal sets the smallest id
    assert [r for r in kept if r[1] in (None, "")] == [(3, ""), (3, None), (4, None)]
    assert sum(1 for _, t in kept if t and t.startswith("n0 ")) == 1 and (2 in [i for i, t in kept if t and t.startswith("n0 ")])
    assert sorted((i, t) for i, t in kept if t and not t.startswith("n0 ") and i is not None) == [(1, "other words here"), (5, "aaa"), (5, "unique text"), (7, "dup one")]
    assert [r for r in kept if r[0] is None] == [(None, "no id")]
    labels = spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int")
    calm = toxicity.drop_toxic(clashing, labels)
    assert calm.columns == clashing.columns and counted(calm) == counted(clashing)
    mixed = mixing.mix_documents(clashing)
    words = [t for _, t in counted(clashing) if t]
    assert mixed.columns == clashing.columns and sorted(t for _, t in counted(mixed)) == sorted(words)
    assert sum(i is None for i, _ in counted(mixed)) == 4
    encoded = sentencepiece_codec.encode(clashing)
    assert encoded.count() == clashing.count() and set(CLASHES) < set(encoded.columns)


def test_repeated_and_null_ids_in_joins(spark, clashing):
    got = jaccard_join.link(clashing, size=4, percent=85).collect()
    assert len(got) == clashing.count()
    near = {(r["n_shingles"], r["component_id"]) for r in got if r["n_shingles"] > 50}
    assert near == {(57, 2), (58, 2)}
    found = substring_dedup.repeated_passages(clashing).collect()
    assert sorted((str(r["doc_id"]), str(r["other_id"])) for r in found) == [("2", "2"), ("None", "2"), ("None", "2")] and all(r["words"] == 60 for r in found)


def test_empty_tables(spark):
    none = empty(spark)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for made in (
        sentencepiece_codec.round_trip(none), sentencepiece_codec.encode(none), media.read_media(media.store_texts(none)), toxicity.drop_toxic(none, labels),
        exact_dedup.drop_exact_copies(none), jaccard_join.drop_near_copies(none), mixing.mix_documents(none),
        html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")),
    ):
        assert made.count() == 0


def test_language_vectors_by_definition():
    own = language_id.Encoder(dimensions=64)
    text = "Ab c, éa"
    letters = lambda c: np.random.default_rng([language_id.SEED, ord(c) if c else 0]).integers(0, 2, 64) * 2.0 - 1
    codes = ["", "a", "b", "", "c", "", "é", "a", ""]
    want = np.zeros(64)
    for i in range(len(codes) - 2):
        bound = np.ones(64)
        for place in range(3):
            bound *= np.roll(letters(codes[i + place]), place)
        want += bound
    got = own.vector(text)
    assert np.allclose(got, want)
    other = own.vector("zz top")
    cosine = sum(a * b for a, b in zip(got.tolist(), other.tolist(), strict=True)) / (sum(a * a for a in got.tolist()) ** 0.5 * sum(b * b for b in other.tolist()) ** 0.5)
    assert abs(cosine - float(got @ other) / np.linalg.norm(got) / np.linalg.norm(other)) < 1e-6
    assert own.vector("12 !") is None and own.vector(None) is None


def test_viterbi_against_all_readings():
    grams = {}
    for word in ("idiot", "stupid", "tool", "list", "belt"):
        for i in range(len(word) + 1):
            gram = f"  {word} "[i : i + 3]
            grams[gram] = grams.get(gram, 0) + 50
    restorer = toxicity.Restorer(grams)

    def readings(span):
        if not span:
            yield "", 0.0
            return
        char, spaced = span[-1], any(c in " .-_*" for c in whole)
        steps = [("", toxicity.DROPPED), (" ", toxicity.LITERAL)] if spaced and char in " .-_*" else [(c, toxicity.DISGUISE) for c in toxicity.READINGS[char]] + [(" ", toxicity.LITERAL)] if char in toxicity.READINGS else [(char, 0.0)]
        if len(span) > 1 and span[-2] == char and char.isalpha():
            steps.append(("", toxicity.DROPPED))
        for before, price in readings(span[:-1]):
            for out, more in steps:
                yield before + out, price + more

    def cost(reading):
        state, total = "  ", 0.0
        for c in [*reading, " "]:
            total += restorer.cost(state, c)
            state = state[1] + c
        return total

    for whole in ("1d10t", "stuupid", "t00l", "b3l7", "i d i o t", "l1$7", "t-0-0-l", "xx1"):
        best = min(price + cost(reading) for reading, price in readings(whole))
        found = restorer._search(whole)
        assert min(price + cost(reading) for reading, price in readings(whole) if " ".join(reading.split()) == found) <= best + 1e-9, whole


def test_long_runs_of_letters_are_read_in_linear_time():
    import time

    restorer, began = toxicity.Restorer({"abc": 5}), time.process_time()
    for text in ("acgt" * 50_000, "abcd" * 50_000 + "ee", "1234" * 5000):
        toxicity.words_of(text, restorer)
    assert time.process_time() - began < 20


def test_cosine_hash_by_definition_and_split_chunks():
    rng = np.random.default_rng(3)
    samples = rng.integers(0, 256, (24, 48), dtype=np.uint8)
    h, w = samples.shape
    waves = [[sum(float(samples[y, x]) * np.cos(np.pi * u * (2 * y + 1) / (2 * h)) * np.cos(np.pi * v * (2 * x + 1) / (2 * w)) for y in range(h) for x in range(w)) / (h * w) for v in range(8)] for u in range(8)]
    flat = np.round(np.array(waves).ravel(), 9)
    bits = flat > np.median(flat[1:])
    assert media.cosine_hash(samples) == "%016x" % int("".join("01"[int(b)] for b in bits), 2)
    whole = media.write_png(samples)
    at = whole.index(b"IDAT") - 4
    size = struct.unpack(">I", whole[at : at + 4])[0]
    body = whole[at + 8 : at + 8 + size]
    parts = b"".join(media._chunk(b"IDAT", body[i : i + 100]) for i in range(0, size, 100))
    assert (media.read_png(whole[:at] + parts + whole[at + 12 + size :]) == samples).all()


def test_windows_decide_without_containers():
    """Given pages with article and main renamed: the text is the same on 95 % and more."""
    import re

    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.1/pages.parquet", columns=["html"]).column("html").to_pylist()
    same = sum(html_extract.main_text(re.sub(r"<(/?)(article|main)\b", r"<\1div", page)) == html_extract.main_text(page) for page in pages)
    assert same >= 0.95 * len(pages)
    long = "<nav>Menu</nav>" + "".join(f"<p>word{i} text of a long page.</p>" for i in range(20_000)) + "<footer>f</footer>"
    assert html_extract.main_text(long).count("word") == 20_000 and "Menu" not in html_extract.main_text(long)
    tie = "<p>one two three</p><nav>x</nav><p>one two three</p>"
    assert html_extract.main_text(tie) == "one two three one two three"


def test_stretches_against_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(100):
        lengths = np.where(rng.random(30) < 0.3, 0, rng.integers(1, 200, 30))
        parts = html_extract.stretches(lengths)
        inside = {i for first, last, _ in parts for i in range(first, last)}
        assert {i for i in range(30) if lengths[i]} <= inside
        # lines of one stretch are never parted by a window of empty lines
        for first, last, _ in parts:
            filled = [i for i in range(first, last) if lengths[i]]
            assert all(b - a <= html_extract.WINDOW for a, b in zip(filled, filled[1:], strict=False))
    assert html_extract.stretches(np.array([0, 0], dtype=np.int64)) == []
