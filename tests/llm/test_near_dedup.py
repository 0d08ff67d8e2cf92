import random

import numpy as np
import pytest

from curvelake.llm import near_dedup as nd
from helpers import PROSE, awkward, components, empty, shingles


def run(df, percent):
    return {r.doc_id: r for r in nd.near_duplicates(df, percent).collect()}


@pytest.mark.parametrize("percent", [80, 85])
def test_equal_to_brute_force(spark, percent):
    draw, rows = random.Random(percent), []
    vocabulary = [f"w{i}" for i in range(400)]
    passage = draw.choices(vocabulary, k=60)
    for group in range(40):
        base = passage * (group % 3 == 0) + draw.choices(vocabulary, k=draw.randint(3, 320))
        for _ in range(draw.choice([1, 1, 2, 5, 12])):
            words = list(base)
            for _ in range(draw.randint(0, max(1, len(words) // 25))):
                words[draw.randrange(len(words))] = draw.choice(vocabulary)
            rows.append((len(rows), " ".join(words).title()))
    got = run(spark.createDataFrame(rows, "doc_id long, text string"), percent)
    sets = {i: shingles(t) for i, t in rows}
    want = components(sets, percent)
    assert len(set(want.values())) < len(rows) - 20
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.n_shingles == len(sets[i]) and r.kept == (r.component_id == i) for i, r in got.items())


def test_large_group_in_many_blocks(spark, monkeypatch):
    """Blocks of a few documents give the same components as one block."""
    monkeypatch.setattr(nd, "BLOCK_DOCS", 4)
    draw, rows = random.Random(5), []
    base = [f"w{i}" for i in range(150)]
    for i in range(120):
        words = list(base)
        for _ in range(draw.randint(0, 6)):
            words[draw.randrange(150)] = f"x{draw.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    got = run(spark.createDataFrame(rows, "doc_id long, text string"), 85)
    assert {i: r.component_id for i, r in got.items()} == components({i: shingles(t) for i, t in rows}, 85)


def test_driver_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = components({r.doc_id: shingles(r.text) for r in docs.collect()}, 85)
    assert {i: r.component_id for i, r in run(docs, 85).items()} == want


def test_awkward_rows(spark):
    rows = nd.near_duplicates(awkward(spark), 85).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert len(rows) == 11 and by[1] == by[2] == by[3] == [(0, i, True) for i in (1,)] or by[2] == [(0, 2, True)]
    assert by[4] == [(1, 4, True)] and len(by[5]) == 2 and by[5][0] == by[5][1]
    assert by[6][0][1:] == (6, True) and by[7][0][1:] == (6, False)
    assert all(c is None and kept for _, c, kept in by[None])
    assert nd.near_duplicates(empty(spark), 85).count() == 0


def test_no_links_at_all(spark):
    rows = [(1, PROSE), (2, PROSE[::-1])]
    assert all(r.kept for r in run(spark.createDataFrame(rows, "doc_id long, text string"), 85).values())


def test_overlaps_and_estimate():
    sets = [np.unique(np.random.default_rng(i % 3).integers(0, 900, 300)) for i in range(6)]
    both = nd.overlaps(sets)
    assert all(both[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(6) for j in range(6))
    least = np.array([nd.least_shared(n, 0.85) for n in range(129)])
    assert nd.possible(sets, least, 64)[0, 3] and nd.least_shared(64, 0.85) < 0.85 * 64
