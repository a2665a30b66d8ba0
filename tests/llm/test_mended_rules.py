"""Rules that hold at every size: mixing of tiny sources, hot groups of shards, page wrappers, character counts."""

import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelake.llm import html_extract, language_id, mixing, sentencepiece_codec, sharding, substring_dedup, toxicity
from kinelake.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_tiny_sources_get_their_words_and_equal_sql(spark, tmp_path):
    """A source of 300 words beside one of 60,000: the same rule, and the same result by SQL."""
    rows = [(i, " ".join(f"w{i}" for _ in range(i % 7 * 9)), "en", "big", 0) for i in range(2300)] + [(9000 + i, "a b c d e f g h i j" * (i % 3), "en", f"t{i % 5}", 0) for i in range(60)] + [(9900, "one", "en", None, 0), (None, "two words", "en", "t1", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["doc_id"], r["size"], r["taken"]) for r in mixing.mix(docs).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == {(r[0], r[1], r[4]) for r in con.execute(mixing.OP3_SQL).fetchall()}
    by_source = mixing._mix(docs, "doc_id", "text", "source", "mix", 3).groupBy("source", "target").agg(F.sum("taken").alias("taken")).collect()
    assert all(r["taken"] == round(r["target"]) for r in by_source) and len(by_source) == 7


def test_shards_of_hot_groups_with_null_ids(spark, monkeypatch):
    """A third of all rows is one text without ids: cut into pieces by row numbers, found by broadcast and by shuffle alike."""
    rows = [(None if i % 3 == 0 else i, "the same text of a hot group" if i % 3 == 0 else f"text number {i} " * (i % 9), "en", "s", 0) for i in range(3000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for most in (500_000, 10):
        monkeypatch.setattr(sharding, "BROADCAST_IDS", most)
        got = sharding.shard(docs, 8).toPandas()
        assert len(got) == 3000
        for _, part in got.groupby("shard"):
            assert sorted(part["slot"]) == list(range(len(part)))
        hot = got[got["doc_id"].isna()]
        assert len(hot) == 1000
        loads = got.groupby("shard")["size"].sum()
        assert len(loads) == 8 and loads.max() - loads.min() < 0.02 * loads.mean()


def test_null_ids_teach_no_language(spark):
    rows = [(None, "ein deutscher satz", "de", "s", 0)] * 20 + [(i, "an english sentence", "en", "s", 0) for i in range(20)]
    assert set(language_id.learn(spark.createDataFrame(rows, SCHEMA))) == {"en"}


def test_counts_are_never_too_low():
    random.seed(2)
    grams = {"".join(random.choices("abcdefghijklmnop ", k=3)): random.randint(1, 90) for _ in range(2000)}
    counts = toxicity.Counts.of(grams)
    pairs, singles = {}, {}
    for gram, n in grams.items():
        pairs[gram[:2]] = pairs.get(gram[:2], 0) + n
        singles[gram[2]] = singles.get(gram[2], 0) + n
    for want in (grams, pairs, singles):
        assert all(counts[k] >= n for k, n in want.items())
        assert np.mean([counts[k] == n for k, n in want.items()]) > 0.99
    assert counts[""] == sum(grams.values()) and counts["zzz"] <= 90


def paragraphs(n, first=0):
    return "".join(f"<p>Paragraph {i} has some words of the article that go on for a good while, as they do in any real text.</p>" for i in range(first, first + n))


def test_names_never_empty_an_article():
    for wrapper in ('class="layout has-sidebar"', 'class="content-sidebar-wrap"', 'class="post no-comments"', 'data-id="ad-free"', 'id=comments-off'):
        page = f"<html><body><nav>Home</nav><div {wrapper}><h1>Title</h1>{paragraphs(12)}<div class='sidebar'><p>Aside from it</p></div></div><footer>f</footer></body></html>"
        text = html_extract.main_text(page)
        assert text.startswith("Title Paragraph 0") and text.count("Paragraph") == 12 and "Aside" not in text, wrapper


def test_boilerplate_between_and_beside_goes():
    advert = "<div class='ad-slot banner'><p>Buy this now, it is the best thing that there ever was for anyone</p></div>"
    text = html_extract.main_text(f"<body><div>{paragraphs(5)}{advert}{paragraphs(5, 5)}</div><div id='comments'>{'<p>A reader says that it was nice</p>' * 3}</div></body>")
    assert text.count("Paragraph") == 10 and "Buy" not in text and "reader" not in text


def test_comment_headings_and_lists_of_links():
    reader = "".join(f"<li>Reader {i} found this very good and hopes for more of it in the coming weeks</li>" for i in range(8))
    for heading in ("<h3>Comments</h3>", "<h2>8 Comments</h2>", "<h4>Kommentare (8)</h4>"):
        text = html_extract.main_text(f"<body><div><h1>Title</h1>{paragraphs(8)}</div>{heading}<ul>{reader}</ul></body>")
        assert text.count("Paragraph") == 8 and "Reader" not in text
    # a page about comments isn't one of comments, and a heading as high ends them
    assert html_extract.main_text(f"<body><h1>Comments</h1>{paragraphs(4)}</body>").count("Paragraph") == 4
    linked = "".join(f"<div><a href='/{i}'>Linked title {i} that could be of interest to you</a></div>" for i in range(20))
    text = html_extract.main_text(f"<body><div>{paragraphs(8)}</div><div>{linked}</div></body>")
    assert text.count("Paragraph") == 8 and "Linked" not in text
    assert html_extract.main_text("<body><p><a href='x'>Only a link</a></p></body>") == "Only a link"
    assert html_extract.main_text(f"<body><p>Start <a href='x'>here</a> now</p>{paragraphs(3)}</body>").startswith("Start here now")


def plain_stretches(lengths, window=html_extract.WINDOW):
    """Surge and dive points by their definition, line by line."""
    filled = sorted(x for x in lengths if x)
    if not filled:
        return []
    middle = len(filled) // 2
    median = filled[middle] if len(filled) % 2 else (filled[middle - 1] + filled[middle]) / 2
    capped = [min(x, int(html_extract.LONG * median) + 1) for x in lengths]
    n = len(lengths)
    sums = {i: sum(capped[k] for k in range(max(0, i), min(n, i + window))) for i in range(1 - window, n)}
    some = [x for x in sums.values() if x]
    level = min(sum(some) / len(some), max(some) / 4)
    best = [max(sums[i] for i in range(line - window + 1, line + 1)) for line in range(n)]
    far = [b * html_extract.FAR < level for b in best]
    cuts, line = set(), 0
    while line < n:
        if far[line]:
            stop = line
            while stop < n and far[stop]:
                stop += 1
            if stop - line >= html_extract.LASTING:
                cuts |= {line, stop}
            line = stop
        line += 1
    cuts |= {i for i in range(n - window + 1) if not any(lengths[i : i + window])}
    found, start = [], 0
    for stop in sorted((cuts - {0}) | {n}):
        weight = sum(capped[start:stop])
        if weight:
            found.append((start, stop, weight if max(best[start:stop]) >= level else 0))
        start = stop
    return found


def test_surge_and_dive_points_by_definition():
    random.seed(7)
    for _ in range(400):
        lengths = [random.choice((0, 0, 0, 3, 20, 80, 300, 2000)) for _ in range(random.randint(html_extract.WINDOW, 60))]
        got = html_extract.stretches(np.array(lengths, dtype=np.int64))
        assert got == plain_stretches(lengths), lengths


def scores(a, b):
    """Best score of each pair of prefixes, by the whole table: 1 an equal word, EDIT off an exchanged one, half a word more off others."""
    gap = substring_dedup.EDIT + 0.5
    rows = [[-gap * j for j in range(len(b) + 1)]]
    for i, x in enumerate(a):
        row = [-gap * (i + 1)]
        for j, y in enumerate(b):
            row.append(max(rows[-1][j] + (1 if x == y else -substring_dedup.EDIT), rows[-1][j + 1] - gap, row[-1] - gap))
        rows.append(row)
    return rows


def test_growth_beyond_chains_against_the_whole_table(monkeypatch):
    random.seed(8)
    monkeypatch.setattr(substring_dedup, "DROP", 1000)
    for _ in range(400):
        a = [random.choice("abcd") for _ in range(random.randint(0, 14))]
        b = [random.choice("abcd") if random.random() < 0.3 else x for x in a if random.random() < 0.9] + ["z"] * random.randint(0, 2)
        for step in (1, -1):
            words, other, equal = substring_dedup._outwards(a, b, 0 if step > 0 else len(a) - 1, 0 if step > 0 else len(b) - 1, step)
            table = scores(a, b) if step > 0 else scores(a[::-1], b[::-1])
            assert table[words][other] == max(map(max, table)) and equal <= min(words, other)


def edited(rng, passage, k, random_places):
    """Words dropped or inserted at every k-th place, or at places chosen with that probability."""
    out = []
    for i, word in enumerate(passage):
        if not ((rng.random() < 1 / k) if random_places else (i % k == k // 2)):
            out.append(word)
        elif rng.random() < 0.5:
            out += [word, f"i{rng.integers(1 << 40)}"]
    return out


def test_recall_of_inserted_and_dropped_words(spark):
    """Passages of 52 and 60 words whose core, from first to last common word, is long enough on both sides."""
    rng = np.random.default_rng(21)
    word = lambda: f"w{rng.integers(1 << 40)}"
    docs, cases = [], {}
    for length in (52, 60):
        for k, chance in ((10, False), (8, False), (8, True)):
            for _ in range(40):
                passage = [word() for _ in range(length)]
                other = edited(rng, passage, k, chance)
                common = set(passage) & set(other)
                core = [max(i for i, w in enumerate(p) if w in common) - min(i for i, w in enumerate(p) if w in common) + 1 for p in (passage, other)]
                n = len(docs)
                docs.append((n, " ".join([word() for _ in range(40)] + passage + [word() for _ in range(40)]), "en", "s", 0))
                docs.append((n + 1, " ".join([word() for _ in range(30)] + other + [word() for _ in range(30)]), "en", "s", 0))
                if min(core) >= substring_dedup.MIN_WORDS:
                    cases.setdefault((length, k, chance), []).append((n + 1, n, core[1]))
    best = {}
    for r in substring_dedup.repeated_passages(spark.createDataFrame(docs, SCHEMA)).collect():
        best[r["doc_id"], r["other_id"]] = max(best.get((r["doc_id"], r["other_id"]), 0), r["words"])
    recall = {case: np.mean([best.get((i, j), 0) >= 0.8 * n for i, j, n in own]) for case, own in cases.items()}
    assert min(recall.values()) >= 0.9, recall


def test_runs_in_many_places_meet_by_broadcast(spark, monkeypatch):
    """A frequent passage gives the same rows whether its places are joined or broadcast."""
    shared = " ".join(f"s{i}" for i in range(70))
    docs = spark.createDataFrame([(i, " ".join(f"d{i}x{k}" for k in range(20)) + " " + shared, "en", "s", 0) for i in range(30)], SCHEMA)
    found = []
    for most in (2000, 5):
        monkeypatch.setattr(substring_dedup, "HOT_RUN", most)
        found.append(sorted(tuple(r) for r in substring_dedup.repeated_passages(docs).collect()))
    assert found[0] == found[1] and {r[0] for r in found[0]} == set(range(1, 30)) and all(r[6] == 70 for r in found[0])


def test_components_of_hubs_and_paths(spark):
    edges = [(0, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000), (7, 2000), (2000, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in (*range(400), 2000)) and all(got[1000 + i] == 1000 for i in range(61)) and 5000 not in got


def test_trigrams_and_double_letters_as_searched():
    texts = ["Ab  a9é_ßx b", None, "", "x" * 3 + " ÀÉ-zz", "\U0001d4b6b 1²c"]
    brute: Counter[str] = Counter()
    for text in texts:
        for word in toxicity.WORD.findall((text or "").lower()):
            padded = f"  {word} "
            brute.update(padded[i : i + 3] for i in range(len(padded) - 2))
    for stretch in (1, 2, 7, toxicity.STRETCH):
        made: Counter[str] = Counter()
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(toxicity, "STRETCH", stretch)
            for grams, counts in toxicity.trigrams(texts):
                made.update({toxicity._unpacked(g): n for g, n in zip(grams.tolist(), counts.tolist(), strict=True)})
        assert made == brute
    rng = random.Random(3)
    restorer = toxicity.Restorer({"".join(rng.choices(" abc", k=3)): rng.randint(1, 900) for _ in range(60)})
    words = {"".join(rng.choices("abc", k=rng.randint(2, 9))) for _ in range(400)}
    for word in words:
        if toxicity.DOUBLE.search(word) and not toxicity.TRIPLE.search(word):
            assert restorer.doubles(word) == restorer._search(word)
    # Characters with one reading decide nothing, so nothing is priced for them: one double letter takes three prices.
    priced = toxicity.Restorer({"abc": 5})
    assert priced.words("wordilly") >= {"wordilly"} and len(priced.costs) == 3


def test_tables_of_seeds_and_runs_go_before_texts_are_aligned(spark, monkeypatch):
    made, settle = [], substring_dedup.settle
    monkeypatch.setattr(substring_dedup, "settle", lambda df: made.append(settle(df)) or made[-1])
    rng = random.Random(5)
    shared = " ".join(f"s{rng.randint(0, 9999)}" for _ in range(90))
    rows = [(i, " ".join(f"w{rng.randint(0, 9999)}" for _ in range(30)) + " " + shared, "en", "s", 0) for i in range(3)]
    found = substring_dedup.repeated_passages(spark.createDataFrame(rows, SCHEMA))
    assert {(r["doc_id"], r["other_id"]) for r in found.collect()} >= {(1, 0), (2, 0)}
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    left = [df.columns for df in made if jvm.Path(df.settled_path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm.Path(df.settled_path))]
    assert left and not any({"seed", "run"} & set(columns) for columns in left)


def test_encoding_is_the_same_however_much_is_remembered():
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choices("abcdeé ", k=6)) for _ in range(40)) for _ in range(60)]
    made = []
    for remembered in (3, 100_000):
        codec = sentencepiece_codec.Carried(sentencepiece_codec.MODEL, remembered).codec()
        found = [codec.encode(texts[at : at + 5] * 2, True) for at in range(0, 60, 5)]
        made.append([([x.tolist() for x in ids], same, back) for ids, same, back in found])
    assert made[0] == made[1]
