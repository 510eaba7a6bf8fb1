"""Geometry on hand-made rows, against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import boxes, text, vectors


def row(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def unit(cx, cy, w, h):
    return tuple(F.lit(float(v)) for v in (cx, cy, w, h))


@pytest.mark.parametrize(
    ("box", "padding", "inside", "want"),
    [
        ((0.05, 0.5, 0.1, 0.1), 0.05, False, (0, 44, 10, 55)),
        ((0.95, 0.5, 0.1, 0.1), 0.05, False, (89, 44, 100, 55)),
        ((0.95, 0.5, 0.1, 0.1), 0.05, True, (89, 44, 99, 55)),
        ((0.505, 0.5, 0.001, 0.1), 0.0, False, (50, 45, 50, 55)),
    ],
)
def test_pixels(spark, box, padding, inside, want):
    out = boxes.centre_to_pixels(*unit(*box), F.lit(100), F.lit(100), padding, inside)
    assert tuple(row(spark, b=boxes.boxed(out)).b) == want


def test_zero_area_is_empty(spark):
    out = boxes.centre_to_pixels(*unit(0.505, 0.5, 0.001, 0.1), F.lit(100), F.lit(100))
    assert row(spark, e=boxes.is_empty(out)).e


def test_overlaps(spark):
    a, b, far, point = ((0.0, 0.0, 10.0, 10.0), (5.0, 5.0, 15.0, 15.0), (50.0, 50.0, 60.0, 60.0), (5.0, 5.0, 5.0, 5.0))
    lit = lambda v: tuple(F.lit(x) for x in v)
    got = row(
        spark, ab=boxes.iou(lit(a), lit(b)), ba=boxes.iou(lit(b), lit(a)), no=boxes.iou(lit(a), lit(far)), con=boxes.containment(lit(a), lit(b)),
        zero=boxes.containment(lit(a), lit(point)), guarded=boxes.guarded_iou(lit(point), lit(point)), px=boxes.pixel_containment(lit(a), lit(point)),
    )
    assert got.ab == got.ba == 25 / 175
    assert (got.no, got.con, got.zero, got.guarded, got.px) == (0.0, 0.25, 0.0, 0.0, 0.0)


def test_canvas_round_trip(spark):
    lay = boxes.canvas_layout(F.lit(1008), F.lit(0.5), F.lit(False))
    got = row(spark, **lay)
    assert (got.ref_w, got.ref_h, got.tgt_x, got.tgt_w) == (504, 1008, 504, 504)
    inside = boxes.from_canvas(tuple(F.lit(float(v)) for v in (500, 0, 756, 504)), (F.lit(504), F.lit(0)), (F.lit(504), F.lit(1008)), (F.lit(504), F.lit(1008)))
    outside = boxes.from_canvas(tuple(F.lit(float(v)) for v in (0, 0, 504, 504)), (F.lit(504), F.lit(0)), (F.lit(504), F.lit(1008)), (F.lit(504), F.lit(1008)))
    got = row(spark, i=inside, o=outside)
    assert tuple(got.i) == (0.0, 0.0, 252.0, 504.0)
    assert got.o is None


def test_mask_bounds(spark):
    mask = np.zeros((4, 5), bool)
    mask[1:3, 2:4] = True
    df = spark.createDataFrame([(mask.tolist(),), ([[False, False]],)], "m array<array<boolean>>").select(boxes.mask_bounds(F.col("m")).alias("b"))
    got = [r.b for r in df.collect()]
    assert tuple(got[0]) == (2, 1, 3, 2) and got[1] is None


def test_names_and_lines(spark):
    df = spark.createDataFrame([("a_cls1_b_cls2_3",), ("plain",)], "n string").select(*[text.crop_part(F.col("n"), g).alias(f"p{g}") for g in (1, 2, 3)])
    assert [tuple(r) for r in df.collect()] == [("a_cls1_b", "2", "3"), (None, None, None)]
    lines = ["  3%|#| 1/9", "[x] 3%|#|", " Done 3%|#|", "no bar 3%", "", "a|b"]
    df = spark.createDataFrame([(x,) for x in lines], "l string").select(text.is_progress_line(F.col("l")).alias("p"))
    assert [r.p for r in df.collect()] == [True, False, True, False, False, False]


def test_vectors(spark):
    v = np.random.default_rng(1).normal(size=(2, 64)).astype(np.float32)
    df = spark.createDataFrame([(v[0].tolist(), v[1].tolist())], "a array<float>, b array<float>")
    got = df.select(vectors.dot(F.col("a"), F.col("b")).alias("d"), vectors.euclid(F.col("a"), F.col("b")).alias("e"), vectors.hamming(vectors.sign_bits(F.col("a")), vectors.sign_bits(F.col("b"))).alias("h"), vectors.normalised(F.col("a")).alias("n")).first()
    w = v.astype(float)
    assert got.d == pytest.approx(w[0] @ w[1]) and got.e == pytest.approx(np.linalg.norm(w[0] - w[1]))
    assert got.h == int(((v[0] > 0) != (v[1] > 0)).sum()) and np.allclose(got.n, w[0] / np.linalg.norm(w[0]))
