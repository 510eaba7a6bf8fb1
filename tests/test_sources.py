"""Readers and writers on files and hand-made rows."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import boxes
from gridloom.models import apply, from_table
from gridloom.operators import aggregates, joins
from gridloom.operators.ranked import numbered
from gridloom.sources import images, labels, summary, writers

LINES = ["0 0.5 0.5 0.1", "0 .5 .5 .1 .1 .9", "x .5 .5 .1 .1", "0 a .5 .1 .1", "", "2 .25 .5 .1 .2", "0.0 .5 .5 .1 .1"]


@pytest.fixture()
def lines(spark):
    return spark.createDataFrame([("s", i, x) for i, x in enumerate(LINES)], "stem string, line_no int, line string")


def test_lenient_parse(lines):
    got = [(r.line_no, r.cls, r.cx) for r in labels.parse(lines, strict=False).orderBy("line_no").collect()]
    assert got == [(1, 0, 0.5), (5, 2, 0.25)]
    assert sorted(r.cls for r in labels.discover_classes(lines).collect()) == [0, 2]


def test_strict_parse_raises(lines):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        labels.parse(lines).collect()


def test_files_round_trip(spark, tmp_path):
    dets = spark.createDataFrame([("a", 1, 2, 0.0, 0.0, 4.0, 3.0), ("a", 0, 1, 10.0, 10.0, 20.0, 30.0)], "stem string, cls int, ord int, x1 double, y1 double, x2 double, y2 double")
    stems = spark.createDataFrame([("a",), ("b",)], "stem string")
    writers.write_files(writers.label_files(dets, stems, 512.0, 640.0), str(tmp_path / "out"))
    assert (tmp_path / "out" / "a.txt").read_text() == "\n".join("%d %.6f %.6f %.6f %.6f" % x for x in ((0, 15 / 512, 20 / 640, 10 / 512, 20 / 640), (1, 2 / 512, 1.5 / 640, 4 / 512, 3 / 640)))
    assert (tmp_path / "out" / "b.txt").read_text() == ""
    back = labels.parse(labels.read_lines(spark, str(tmp_path / "out")))
    assert sorted((r.stem, r.cls) for r in back.collect()) == [("a", 0), ("a", 1)]


def test_label_line_rounds_like_python(spark):
    row = spark.range(1).select(writers.label_line(F.lit(0), *[F.lit(v) for v in (4 / 512, 3 / 640, 0.0, 1.0)]).alias("l")).first()
    assert row.l == "0 0.007812 0.004687 0.000000 1.000000"


def test_summary_shapes(spark):
    a = '{"d/x.jpg": {"label_file": "x.txt", "preview_file": null, "n_final_total": 2, "classes": {"3": {"n_proposals": 5, "n_wbf": 2, "n_final": 2, "boxes": [{"xyxy": [1, 2, 3, 4], "score": 0.5}, {"xyxy": [1, 2, 3, 4], "score": 0.25}]}, "4": {"n_proposals": 0, "n_wbf": 0, "n_final": 0, "boxes": []}}}}'
    b = '{"y.png": {"label_file": "y.txt", "preview_file": "p.png", "boxes": [{"class_id": 1, "box": [1, 2, 3, 4], "sam3_score": 0.9, "dino_sim": null, "combined_score": null}, {"class_id": 1, "box": [1, 2, 3, 4], "sam3_score": 0.9, "dino_sim": 0.5, "combined_score": 0.6}]}}'
    entries = summary.parse(spark.createDataFrame([(a,), (b,)], "json string"))
    got = sorted((r.stem, r.cls, r.pos, r.score) for r in summary.scores(entries).collect())
    assert got == [("x", 3, 0, 0.5), ("x", 3, 1, 0.25), ("y", 1, 0, 0.0), ("y", 1, 1, 0.6)]
    assert [tuple(r) for r in summary.gallery(entries).collect()] == [("p.png", "y | ? box(es)")]
    counts = summary.export_counts(entries, spark.createDataFrame([("x.txt",)], "path string")).first()
    assert (counts.copied, counts.missing) == (1, 1)


def png(width, height):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0" * (width + 1) * height)) + chunk(b"IEND", b"")


def test_images(spark, tmp_path):
    (tmp_path / "a.PNG").write_bytes(png(7, 5))
    (tmp_path / "b.bmp").write_bytes(b"BM" + b"\0" * 16 + struct.pack("<ii", 9, -4) + b"\0" * 8)
    (tmp_path / "c.jpg").write_bytes(b"\xff\xd8\xff\xe0\x00\x04\x00\x00\xff\xc0\x00\x11\x08\x00\x06\x00\x08\x03" + b"\0" * 20)
    (tmp_path / "d.webp").write_bytes(b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (10).to_bytes(3, "little") + (11).to_bytes(3, "little"))
    (tmp_path / "e.png").write_bytes(b"broken")
    (tmp_path / "f.txt").write_text("no")
    found = images.scan(spark, str(tmp_path), content=True)
    assert sorted(r.stem for r in found.collect()) == ["a", "b", "c", "d", "e"]
    assert sorted((r.path[-5], r.width, r.height) if not r.path.endswith("webp") else ("d", r.width, r.height) for r in images.sizes(found).collect()) == [("a", 7, 5), ("b", 9, 4), ("c", 8, 6), ("d", 11, 12)]


def test_perceptual_hash():
    grey = np.random.default_rng(0).integers(0, 255, (64, 48)).astype(float)
    bits = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    own = images.perceptual_hash(grey)
    assert own == images.perceptual_hash(grey) and bits(own, images.perceptual_hash(grey + 3)) <= 4
    assert bits(own, images.perceptual_hash(grey.T[:48, :48])) > 10


def test_p90_and_small_classes(spark):
    rows = [(0, float(i), 1.0) for i in range(1, 11)] + [(1, 0.5, 1.0)]
    df = spark.createDataFrame(rows, "cls int, w double, h double")
    p90 = aggregates.p90_area(df)
    assert {r.cls: r.p90_area for r in p90.collect()} == {0: 10.0, 1: 0.5}
    wanted = spark.createDataFrame([(0,), (1,), (2,)], "cls int")
    assert sorted(r.cls for r in aggregates.small_classes(p90, wanted, 0.6, [2, 7]).collect()) == [1, 2]


def test_zip_scores_mismatch(spark):
    boxed = spark.createDataFrame([(0, [1, 2, 3]), (1, [1]), (2, [1])], "k int, boxes array<int>")
    scores = spark.createDataFrame([(0, [0.5, 0.4]), (1, [0.3])], "k int, scores array<double>")
    assert {r.k: r.scores for r in joins.zip_scores(boxed, scores, ["k"]).collect()} == {0: [1.0, 1.0, 1.0], 1: [0.3], 2: [1.0]}


def test_best_containment_takes_the_first(spark):
    schema = "img int, ord int, x1 double, y1 double, x2 double, y2 double"
    prompts = spark.createDataFrame([(0, 0, 0.0, 0.0, 10.0, 10.0), (0, 1, 90.0, 90.0, 99.0, 99.0)], schema)
    outputs = spark.createDataFrame([(0, 0, 0.0, 0.0, 4.0, 4.0), (0, 1, 0.0, 0.0, 20.0, 20.0), (0, 2, 98.0, 98.0, 120.0, 120.0)], schema)
    assert {r.ord: r.match for r in joins.best_containment(prompts, outputs, ["img"]).collect()} == {0: 0, 1: None}


def test_numbered(spark):
    df = spark.createDataFrame([(f"img/{i:05d}",) for i in range(500)], "path string").repartition(7)
    assert all(int(r.path[-5:]) == r.n for r in numbered(df, [F.col("path")], "n").collect())
    assert numbered(df.limit(0), [F.col("path")], "n").count() == 0


class Doubler:
    schema = "id long, twice long"

    def open(self):
        self.factor = 2

    def run(self, batch):
        if (batch["id"] == 13).any():
            raise ValueError("13")
        return batch.assign(twice=batch["id"] * self.factor)


def test_model_stage(spark):
    assert sorted(r.twice for r in apply(spark.range(0, 4, 1, 2), Doubler()).collect()) == [0, 2, 4, 6]
    assert apply(spark.range(13, 14, 1, 1), Doubler()).count() == 0
    results = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    assert [r.v for r in from_table(spark.range(2), results, ["id"]).collect()] == ["a"]


def test_label_stream(spark, tmp_path):
    from gridloom.streaming.evaluation import class_counts, label_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("0 .5 .5 .1 .1\n1 .5 .5 .1 .1\nbad\n")
    query = class_counts(label_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("label_counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    (tmp_path / "in" / "b.txt").write_text("1 .5 .5 .1 .1")
    query.processAllAvailable()
    query.stop()
    assert {r.cls: r.n for r in spark.table("label_counts").collect()} == {0: 1, 1: 2}


def test_boxes_from_corners(spark):
    out = boxes.corners_to_centre(tuple(F.lit(float(v)) for v in (0, 0, 10, 20)), F.lit(100), F.lit(100))
    assert tuple(spark.range(1).select(boxes.boxed(out).alias("b")).first().b) == (0.05, 0.1, 0.1, 0.2)
