import hashlib
import random
import re
import time

import numpy as np
import pytest

from gridloom.llm import common, suffixes
from gridloom.llm.common import Words
from tests.llm.conftest import passage


def split(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def brute(rows, window):
    """(doc_id, words, removed, digest) by the definition; equal rows are one document."""
    seen, out = {}, []
    for d, text in sorted(rows):
        words = split(text)
        cover = [False] * len(words)
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if seen.setdefault(key, (d, text, i)) != (d, text, i):
                cover[i : i + window] = [True] * window
        kept = [w for w, c in zip(words, cover, strict=True) if not c]
        out.append((d, len(words), sum(cover), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out)


def rows_of(seed):
    rng = random.Random(seed)
    shared = [passage(rng, rng.randint(18, 90)) for _ in range(6)]
    rows = []
    for d in range(60):
        parts = [rng.choice([passage(rng, rng.randint(1, 40)), rng.choice(shared), " ".join([rng.choice(["be", "of"])] * rng.randint(1, 60))]) for _ in range(rng.randint(0, 6))]
        rows.append((d * 3, rng.choice([" ", "\n", " \t\v"]).join(parts)))
    return rows


@pytest.mark.parametrize("options", [{}, {"crowd": 1, "bin_windows": 7}, {"window": 10, "gram": 4, "crowd": 3}])
def test_against_brute_force(spark, options):
    rows = rows_of(len(options))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = suffixes.without_repeats(docs, **options)
    got = sorted(tuple(r)[:4] for r in out.collect())
    assert got == brute(rows, options.get("window", 20))
    assert sum(r[2] for r in got) > 0
    for r in out.collect():
        assert sum(int(b) - int(a) for a, b in (x.split("-") for x in r.removed_spans.split(",") if x)) == r.n_removed


def test_subtree_nodes():
    # Spans of 4 words have two windows of 3; their anchors are words 2 and 1.
    tree = suffixes.Subtree([b"a b c d", b"x c d b", b"b c d e"], np.array([2, 1, 1]), 3)
    places = list(zip(tree.text.tolist(), tree.start.tolist(), strict=True))

    def below(depth):
        return {frozenset(places[i] for i in tree.order[a:b]) for a, b in zip(*tree.nodes(depth), strict=True)}

    # Suffixes: "c$ba", "cd$b" | "cd$x", "cdb$" | "cd$b", "cde$".
    assert below(4) == {frozenset({(0, 1), (2, 0)})}
    assert below(3) == {frozenset({(0, 1), (2, 0), (1, 0)})}
    assert below(1) == {frozenset(places)}
    twice = suffixes.Subtree([b"a b c d", b"a b c d"], np.array([1, 1]), 3)
    later, first = twice.repeats()
    assert sorted(later.tolist()) == [2, 3] and sorted(first.tolist()) == [0, 1]


def thue_morse(n):
    out = "a"
    while len(out) < n:
        out += out.translate(str.maketrans("ab", "ba"))
    return out[:n]


def test_words_of_equal_polynomials_differ(spark):
    one = thue_morse(1024)
    two = one.translate(str.maketrans("ab", "ba"))
    rows = [(1, " ".join(["x"] * 19 + [one])), (2, " ".join(["x"] * 19 + [two])), (3, one), (4, two)]
    got = sorted(tuple(r)[:4] for r in suffixes.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows, 20) and all(r[2] == 0 for r in got)


def test_hot_prefixes(spark):
    """A passage, a gram and a line that are everywhere, over many tasks, with prefixes that are lengthened twice."""
    rng = random.Random(11)
    hot, gram = passage(rng, 45), passage(rng, 6)
    rows = []
    for d in range(150):
        parts = [passage(rng, rng.randint(5, 30)), hot, passage(rng, 9), gram, passage(rng, rng.randint(9, 25)), gram, passage(rng, 20)]
        rng.shuffle(parts)
        rows.append((d if d % 10 else (1 << 63) - 1 - d, " ".join(parts)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(13)
    got = sorted(tuple(r)[:4] for r in suffixes.without_repeats(docs, crowd=5, bin_windows=50).collect())
    assert got == brute(rows, 20)


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert sorted(tuple(r)[:4] for r in suffixes.without_repeats(docs).collect()) == brute(rows, 20)


def test_ids(spark):
    rows = [((1 << 63) - 1, "w " * 30), (None, "v " * 30)]
    assert {r.doc_id for r in suffixes.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {(1 << 63) - 1, None}
    with pytest.raises(TypeError):
        suffixes.without_repeats(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_words_are_those_of_the_pattern(edge_docs):
    texts = [r.text or "" for r in edge_docs.select("text").collect()]
    words = Words([t.encode() for t in texts])
    for t, a, b in zip(texts, words.first, words.last, strict=True):
        assert [words.data[x:y].decode() for x, y in zip(words.start[a:b], words.end[a:b], strict=True)] == split(t)


def test_edges(spark, edge_docs, no_docs):
    got = {}
    for r in suffixes.without_repeats(edge_docs).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.n_removed))
    assert len(got[3]) == 3 and len(got[None]) == 3
    assert got[1] == [(300, 0)] and got[2] == [(300, 300)] and (300, 300) in got[None]
    assert got[4] == got[5] == got[6] == [(0, 0)]
    assert got[13] == [(62, 60)] and got[11] == [(500, 499)]
    assert suffixes.without_repeats(no_docs).count() == 0


def test_exchanges_go_with_their_step(spark):
    """Shuffle files of a checkpoint that is made clean are deleted as it ends, and the setting is put back."""
    rows = spark.range(1000).selectExpr("id", "id % 7 AS k").repartition(5, "k")
    manager = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def stored():
        files = manager.getAllFiles()
        return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}

    before, setting = stored(), spark.conf.get(common._CLEAN)
    made = common.saved(rows, clean=True)
    for _ in range(50):
        if not (new := stored() - before):
            break
        time.sleep(0.1)
    assert not new and made.count() == 1000 and spark.conf.get(common._CLEAN) == setting
    common.saved(rows.select("*"))
    assert stored() - before  # else there is nothing to delete
