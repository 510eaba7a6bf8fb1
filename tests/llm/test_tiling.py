import random

import numpy as np

from gridloom.llm import tiling
from tests.llm.conftest import passage


def greedy(text, item, least):
    """The definition: mark the longest common run of unmarked words, again and again."""
    free_t, free_i, tiles = [True] * len(text), [True] * len(item), []
    while True:
        best = (0, 0, 0)
        for a in range(len(text)):
            for b in range(len(item)):
                n = 0
                while a + n < len(text) and b + n < len(item) and free_t[a + n] and free_i[b + n] and text[a + n] == item[b + n]:
                    n += 1
                best = max(best, (n, -a, -b))
        n, a, b = best[0], -best[1], -best[2]
        if n < least:
            return tiles
        tiles.append((a, b, n))
        for k in range(n):
            free_t[a + k] = free_i[b + k] = False


def test_tiles_cover_like_the_definition():
    rng = random.Random(1)
    for _ in range(150):
        item = [rng.randint(0, 5) for _ in range(rng.randint(3, 25))]
        text = [rng.randint(0, 5) for _ in range(rng.randint(0, 40))]
        got = tiling.tile(np.array(text, np.int64), np.array(item, np.int64), 3)
        assert sorted(t[2] for t in got) == sorted(t[2] for t in greedy(text, item, 3))
        assert all(text[a : a + n] == item[b : b + n] for a, b, n in got)


def test_repeated_words_cost_what_they_are_long():
    import time

    began = time.time()
    assert tiling.tile(np.zeros(20_000, np.int64), np.zeros(500, np.int64)) == [(0, 0, 500)]
    runs = np.array(([0] * 7 + [1] + [-1]) * 2500)
    tiles = tiling.tile(runs, np.array([0] * 250 + [1] + [0] * 249))
    assert sum(t[2] for t in tiles) >= 490 and time.time() - began < 2
    seeds = tiling.Seeds([(1, "x " * 500), (2, "y z")], 5, 0.5)
    assert [f[:4] for f in seeds.find("x " * 20_000)] == [(1, 1.0, 500, 500)] and time.time() - began < 3


def test_short_items_are_found_whole():
    seeds = tiling.Seeds([(1, "one two"), (2, "one three"), (3, ""), (4, "a b c d e f")], 5, 0.5)
    assert {f[0] for f in seeds.find("x one TWO y three a b c d e")} == {1, 4}
    assert seeds.find("two one") == [] and seeds.find("") == []


def items(spark, rows):
    return spark.createDataFrame([(i, t, "q") for i, t in rows], "item_id long, text string, tiles string")


def test_reordered_passages_are_found(spark, edge_docs, no_docs):
    rng = random.Random(5)
    item = passage(rng, 40, 10_000).split()
    noise = lambda n: passage(rng, n, 10_000)
    turned = " ".join([noise(50), " ".join(item[20:]).upper(), noise(30), ", ".join(item[:20]), noise(10)])
    rows = [(100, turned), (101, " ".join(item[:15]) + " " + noise(99)), (102, noise(200)), (103, " ".join(item))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = items(spark, [(1, " ".join(item)), (2, "too short"), (3, None), (4, noise(30)), (4, noise(30))])
    got = {(r.doc_id, r.item_id): r for r in tiling.contaminated(docs, bench).collect()}
    assert set(got) == {(100, 1), (103, 1)}
    assert got[100, 1].coverage == 1.0 and got[100, 1].n_tiles == 2
    blocked = {(r.doc_id, r.item_id) for r in tiling.contaminated(docs, bench, block_bytes=60).collect()}
    assert blocked == set(got)
    kept = tiling.decontaminated(docs, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [101, 102]
    assert tiling.contaminated(edge_docs, bench).count() == 0 and tiling.contaminated(no_docs, bench).count() == 0
    assert tiling.contaminated(docs, bench.limit(0)).count() == 0
    assert tiling.decontaminated(edge_docs, bench).columns == edge_docs.columns


def test_whole_table_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    want = set()
    for item_id, text in bench.collect():
        item = tiling.words_of(text)
        runs = {tuple(item[i : i + 5]) for i in range(len(item) - 4)}
        for doc in docs.collect():
            words = tiling.words_of(doc.text)
            if any(tuple(words[i : i + 5]) in runs for i in range(len(words) - 4)):
                ids = {w: k for k, w in enumerate(set(item))}
                tiles = greedy([ids.get(w, -1 - k) for k, w in enumerate(words)], [ids[w] for w in item], 5) if len(words) < 1500 else tiling.tile(np.array([ids.get(w, -1) for w in words]), np.array([ids[w] for w in item]))
                if sum(t[2] for t in tiles) >= 0.5 * len(item):
                    want.add((doc.doc_id, item_id))
    assert {(r.doc_id, r.item_id) for r in tiling.contaminated(docs, bench).collect()} == want and want
