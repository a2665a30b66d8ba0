"""Texts that hold others, by their rarest runs."""

import random

from kinelake.operators import holding


def _made(n):
    draw = random.Random(3)
    names = [f"{draw.choice(('cover_drive', 'pull_shot', 'é_ß'))}_{draw.choice(('good', 'bad'))}_{i}" for i in range(n)]
    return [f"x{i}_{name}_take2" for i, name in enumerate(names)], [*draw.sample(names, n // 2), "a", "ta", "_take2", "drive_go", "not_there_at_all_9", "é_ß_goo", ""]


def test_holders_are_those_of_all_pairs(spark):
    own, stems = _made(300)
    texts = spark.createDataFrame([(i, x) for i, x in enumerate([*own, own[0], None, ""])], "id long, own string").repartition(5)
    got = {(r["stem"], r["id"]) for r in holding.holders(spark.createDataFrame([(s,) for s in stems], "stem string"), texts).collect()}
    want = {(s, i) for s in stems if s for i, x in enumerate([*own, own[0]]) if s in x}
    assert got == want and len({s for s, _ in got}) > 150
    assert holding.holders(spark.createDataFrame([], "stem string"), texts).count() == 0


def test_texts_are_indexed_by_a_part_of_their_runs(spark):
    own, _ = _made(300)
    rank = holding._cells(spark.createDataFrame([(x,) for x in own], "own string"), holding.RUN)
    import pyarrow as pa

    keys = holding._keys(rank, holding.RUN, holding.WIDEST).func(pa.array(own))
    runs = sum(len(x) - holding.RUN + 1 for x in own)
    assert len(keys.flatten()) < runs / 3
