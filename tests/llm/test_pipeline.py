"""The pipeline and the registered queries, stage by stage against plain versions."""

import hashlib
import importlib.util

import duckdb
import numpy as np
import pytest

from gridloom.llm import entry, quality, surrogates, tiling
from tests.llm.test_forest import brute, shingles
from tests.llm.test_media_and_bpe import coders  # noqa: F401

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline is not there")


def test_stages(spark, coders):  # noqa: F811
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = [f for _, f in corpus_pipeline.STAGES]
    good = quality.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1")
    one = stages[0](spark, docs, SF)
    assert sorted(r.doc_id for r in one.collect()) == sorted(r.doc_id for r in good.collect()) and one.columns == docs.columns
    two = stages[1](spark, one, SF)
    want = brute([(r.doc_id, r.text) for r in one.collect()])
    assert sorted(r.doc_id for r in two.collect()) == sorted({w[0] for w in want.values()})
    three = stages[2](spark, two, SF)
    items = [set(shingles(" ".join(tiling.words_of(r.text)))) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    gone = {r.doc_id for r in two.collect() if any(len(s & shingles(" ".join(tiling.words_of(r.text)))) >= 0.5 * len(s) for s in items)}
    assert {r.doc_id for r in two.collect()} - {r.doc_id for r in three.collect()} == gone
    four = stages[3](spark, three, SF)
    assert four.columns == docs.columns and four.count() == three.count()
    assert four.where("n_chars <> length(text)").count() == 0
    found = surrogates.entity_map(surrogates.matches(three)).select("entity").collect()
    assert found and not {r.entity for r in found} & {r.entity for r in surrogates.entity_map(surrogates.matches(four)).collect()}
    five = {r.doc_id: r for r in stages[4](spark, four, SF).collect()}
    for r in four.collect():
        ids = coders[1].encode_ordinary(r.text)
        assert (five[r.doc_id].n_tokens, five[r.doc_id].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())


def folder_of(spark, path, docs, labels, items):
    docs.write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    items.write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_run(spark):
    """All stages in turn give what the operators give one after the other."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = docs
    for _, stage in corpus_pipeline.STAGES:
        want = stage(spark, want, SF)
    row = lambda r: (r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256)
    got = corpus_pipeline.run(spark, SF).collect()
    assert got and sorted(map(row, got)) == sorted(map(row, want.collect()))


def test_run_on_odd_rows(spark, edge_docs, coders, tmp_path):  # noqa: F811
    """Nulls, empty and long texts, ties, repeated rows and columns of internal names go through every stage."""
    import corpus_pipeline

    labels = spark.createDataFrame([(i, 1, None) for i in range(20)] + [(None, None, None)], "doc_id long, quality int, toxic int")
    leaked = "the benchmark item that some document has copied word by word without any change"
    docs = edge_docs.union(spark.createDataFrame([(50, f"before {leaked} after", None, None, 9, "k", 1, 2, "m", 3, 0.5), (51, "write to ann.lee@mail.example.com soon", None, None, 7, "k", 1, 2, "m", 3, 0.5)], edge_docs.schema))
    sf = folder_of(spark, tmp_path, docs, labels, spark.createDataFrame([(1, leaked), (2, None), (3, "")], "item_id long, text string"))
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(r.text or "")
    # All labels are good, so all documents pass; one of each group of near copies stays, the contaminated one goes.
    want = sorted([1, 3, 4, 7, 9, 10, 11, 12, 13, -5, 14, 51, 0])
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted(r.doc_id or 0 for r in got) == want
    for r in got:
        if r.doc_id != 51:
            ids = [coders[1].encode_ordinary(t) for t in texts[r.doc_id]]
            assert r.ids_sha256 in {hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest() for x in ids}
    changed = next(r for r in got if r.doc_id == 51)
    assert changed.decoded_sha256 != hashlib.sha256(texts[51][0].encode()).hexdigest()
    step = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, sf)
        assert step.columns == docs.columns


def test_run_on_empty_tables(spark, no_docs, tmp_path):
    import corpus_pipeline

    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    assert corpus_pipeline.run(spark, folder_of(spark, tmp_path, no_docs, labels, items)).count() == 0


@pytest.mark.parametrize("name", sorted(entry.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    ran = con.execute(entry.ORACLES[name])
    columns = [c[0] for c in ran.description]
    want = sorted(repr(tuple(r)) for r in ran.fetchall())
    assert sorted(repr(tuple(r)) for r in entry.QUERIES[name](spark, SF).select(*columns).collect()) == want
