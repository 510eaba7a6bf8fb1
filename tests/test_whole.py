"""Queries take part with all rows of their tables, whatever the size of a group."""

from gridloom.plans import evaluation
from gridloom.plans import fixtures as fx
from gridloom.plans import registry
from tests.test_queries import SF


def test_sql_has_no_caps():
    """No filter on places or ids keeps the SQL cheap."""
    for name in ("best_mask", "nms", "suppress_b", "containment_a", "wbf", "wbf_all", "result_gate", "fuse_a", "fuse_b", "combined_gate", "cosine"):
        for cap in ("ord <= 25", "ord <= 9", "vec_id < ", "id < 400", "% 500"):
            assert cap not in registry.ORACLES[name], (name, cap)


def test_every_embedding_is_dealt(spark):
    sf = "/root/testdata/sf0.1"
    n = {r.id: r.emb for r in fx.vectors(spark, sf).collect()}
    rows = evaluation._with_vectors(spark, sf, fx.preds(spark, SF)).collect()
    assert len(n) > 500 and len(rows) == fx.preds(spark, SF).count()
    assert all(r.emb == n[(r.img * 31 + r.ord * 7 + r.cls) % len(n)] for r in rows)
