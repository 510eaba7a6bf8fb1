import random
from collections import Counter, defaultdict

import pytest

from pyspark.sql import functions as F

from gridloom.llm import forest
from tests.llm.conftest import passage
from tests.llm.test_suffixes import split, thue_morse


def shingles(text):
    w = split(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """doc_id -> (class_id, copy_id, n_copies, n_links)."""
    by = defaultdict(list)
    for d, t in rows:
        by[shingles(t)].append(d)
    sets = {min(ids): s for s, ids in by.items()}
    root, links = {u: u for u in sets}, Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    order = sorted(sets)
    for i, u in enumerate(order):
        for v in order[:i]:
            common = len(sets[u] & sets[v])
            if common and 10 * common >= 8 * (len(sets[u]) + len(sets[v]) - common):
                links[u] += 1
                links[v] += 1
                a, b = find(u), find(v)
                root[max(a, b)] = min(a, b)
    return {d: (find(min(ids)), min(ids), len(ids), links[min(ids)]) for ids in by.values() for d in ids}


def rows_of(seed):
    rng = random.Random(seed)
    rows = []
    for d in range(40):
        words = passage(rng, rng.randint(1, 120), 3000).split()
        rows.append((5 * d, " ".join(words)))
        for k in range(rng.randint(0, 4)):
            own = list(words)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = f"e{rng.randint(0, 99)}"
            rows.append((5 * d + 1 + k, " ".join(own)))
    return rows


@pytest.mark.parametrize("cell", [forest.CELL, 150])
def test_against_brute_force(spark, cell):
    rows = rows_of(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.class_id, r.copy_id, r.n_copies, r.n_links) for r in forest.jaccard_classes(docs, cell=cell).collect()}
    want = brute(rows)
    assert got == want and sum(w[3] for w in want.values()) > 10
    kept = forest.one_of_each(docs, cell=cell)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({w[0] for w in want.values()})


def test_a_chain_is_one_class(spark):
    words = passage(random.Random(9), 200, 10**6).split()
    rows = [(k, " ".join(words[6 * k : 6 * k + 80])) for k in range(18)]
    got = {r.doc_id: (r.class_id, r.copy_id, r.n_copies, r.n_links) for r in forest.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), cell=100).collect()}
    assert got == brute(rows) and {g[0] for g in got.values()} == {0}


def test_depth_meets_the_recall():
    d = forest.depth()
    assert forest.chance(0.8, d) >= forest.RECALL > forest.chance(0.8, d + 1)
    assert forest.depth(0.2, 4) == 1


def test_sets_rest_on_words(spark):
    one = thue_morse(1024)
    two = one.translate(str.maketrans("ab", "ba"))
    rows = [(1, one), (2, two), (3, " ".join(["x"] * 19 + [one])), (4, " ".join(["x"] * 19 + [two]))]
    got = {r.doc_id: (r.class_id, r.copy_id, r.n_copies, r.n_links) for r in forest.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
    texts = [" ".join(random.Random(k % 7).choices("abcdefgh", k=k)).encode() for k in range(60)]
    want = [shingles(t.decode()) for t in texts]
    sets = [set(x.tolist()) for x in forest.exact_sets(texts, 5)]
    for i in range(60):
        for j in range(60):
            assert len(sets[i] & sets[j]) == len(want[i] & want[j])


@pytest.mark.parametrize("parts", [1, 7])
def test_links_connect_what_shares_a_prefix(spark, parts):
    """For each depth the links' components are those of equal prefixes, over partition borders too."""
    rng = random.Random(parts)
    rows = [(bytes([k]), t, rng.choice([0, 1, 255]) << 56 | rng.choice([0, 7]) << 48 | rng.choice([0, 9]) << 40 | rng.randint(0, 3)) for k in range(120) for t in range(2)]
    rows = [(k, t, x - (1 << 64) if x >> 63 else x) for k, t, x in rows]
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    links = forest.forest_links(spark.createDataFrame(rows, "key binary, tree int, label long"), 2).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    for d in range(2, 9):
        def joined(pairs):
            root = {bytes([k]): bytes([k]) for k in range(120)}

            def find(x):
                while root[x] != x:
                    x = root[x]
                return x

            for a, b in pairs:
                root[max(find(a), find(b))] = min(find(a), find(b))
            return {k: find(k) for k in root}

        by = defaultdict(list)
        for k, t, x in rows:
            by[t, (x % (1 << 64)) >> (64 - 8 * d)].append(k)
        assert joined((bytes(r.a), bytes(r.b)) for r in links if r.level >= d) == joined((own[0], k) for own in by.values() for k in own)


def test_prefix_is_shortened_until_the_recall(spark):
    """Pairs right above the threshold ask for a shorter prefix than near copies."""
    rng = random.Random(4)

    def pairs(change):
        rows = []
        for d in range(60):
            words = passage(rng, 104, 10**6).split()
            other = list(words)
            for k in range(change):
                other[20 * k + 10] = "changed"
            rows += [(2 * d, " ".join(words)), (2 * d + 1, " ".join(other))]
        return spark.createDataFrame(rows, "doc_id long, text string")

    def reached(docs):
        rows = forest.signed(docs)
        least = F.min(F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id"), F.col("fp")))
        classes = rows.groupBy("key").agg(least.alias("rep"), F.first("n").alias("n"), F.first("labels").alias("labels"))
        return forest.linked(docs, classes, 5, 0.8, forest.TREES, forest.RECALL, forest.CELL)[1]

    assert reached(pairs(1)) == forest.DEEPEST  # similarity 0.905
    assert forest.depth() <= reached(pairs(2)) < forest.DEEPEST  # 0.818
    got = forest.jaccard_classes(pairs(2)).where("n_links = 1").count()
    assert got == 120


def test_recall_on_a_table(spark):
    """Links of the whole table against brute force over shared shingles."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").where("length(text) < 4000")
    by = defaultdict(list)
    for r in docs.collect():
        by[shingles(r.text)].append(r.doc_id)
    holders, links = defaultdict(list), 0
    for s, ids in sorted(by.items(), key=lambda x: min(x[1])):
        common = Counter(o for x in s for o in holders[x])
        links += sum(10 * c >= 8 * (len(s) + n - c) for (_, n), c in common.items())
        for x in s:
            holders[x].append((min(ids), len(s)))
    found = forest.jaccard_classes(docs).groupBy("copy_id").agg(F.first("n_links").alias("n")).agg(F.sum("n")).first()[0] // 2
    assert links > 20 and found == links


@pytest.mark.parametrize("hub", [False, True])
def test_components_of_a_hub_and_a_path(spark, hub):
    edges = [(0 if hub else k, k + 1) for k in range(300)] + [(1000, 1001), (7, 7)]
    got = {r.node: r.root for r in forest.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(301), 0), 1000: 1000, 1001: 1000}
    assert forest.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edges(spark, edge_docs, no_docs):
    got = defaultdict(list)
    for r in forest.jaccard_classes(edge_docs).collect():
        got[r.doc_id].append((r.class_id, r.copy_id, r.n_copies, r.n_links))
    assert got[1] == got[2] == [(1, 1, 3, 1)] and (1, 1, 3, 1) in got[None]
    assert sorted(got[3]) == [(1, 3, 2, 1), (1, 3, 2, 1), (3, 3, 1, 0)]
    assert got[4] == got[5] == got[6] == [(4, 4, 4, 0)] and got[7] == got[8] == [(7, 7, 2, 0)]
    kept = forest.one_of_each(edge_docs)
    assert kept.columns == edge_docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 3, 4, 7, 9, 10, 11, 12, 13, -5, 14, None])
    assert forest.jaccard_classes(no_docs).count() == 0 and forest.one_of_each(no_docs).count() == 0
