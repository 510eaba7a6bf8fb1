"""Pixels, crops, documents, exports, reports and the command line, on files; and rows that joins must keep."""

import json
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import cli, report
from gridloom.config import FuseA
from gridloom.functions import vectors
from gridloom.models import apply
from gridloom.operators import aggregates, joins, metrics
from gridloom.plans import fixtures as fx
from gridloom.sources import images, labels, summary, writers
from tests.test_sources import Doubler

NAMES = ("a b", "ü+ 1%", "plain")


@pytest.fixture()
def folder(spark, tmp_path):
    """Three images of 40 x 30 with a bright corner, and a label file for each, in names that a URL would change."""
    (tmp_path / "images").mkdir()
    (tmp_path / "labels").mkdir()
    for k, name in enumerate(NAMES):
        px = np.random.default_rng(k).integers(0, 200, (30, 40, 3)).astype(np.uint8)
        px[:10, :10] = (10, 20, 250)  # blue, green, red
        (tmp_path / "images" / f"{name}.png").write_bytes(images.png(px))
        (tmp_path / "labels" / f"{name}.txt").write_text("\t0 .125 .1666667 .25 .3333333 \n1 0.51 0.52 0.001 0.001\n2 .9 .9 .4 .4\t\n0 .5 .5 .1\t\n")
    (tmp_path / "images" / "broken.png").write_bytes(b"no image")
    (tmp_path / "classes.txt").write_text("one\n\n two\nthree\n")
    return tmp_path


def test_stems_of_labels_are_those_of_images(spark, folder):
    found = labels.read_lines(spark, str(folder / "labels"))
    assert {r.stem for r in found.collect()} == set(NAMES) == {r.stem for r in images.scan(spark, str(folder / "images")).where("stem <> 'broken'").collect()}
    assert {r.stem for r in images.pixels(spark, str(folder / "images")).collect()} == set(NAMES)
    assert sorted((r.cls, r.line_no) for r in labels.parse(found).where("stem = 'a b'").collect()) == [(0, 0), (1, 1), (2, 2)]
    paths = [r.path for r in images.scan(spark, str(folder / "images")).collect()]
    assert paths == sorted(paths)


def test_white_space_of_any_kind(spark):
    rows = ["\t1 0.5 0.5 0.1 0.1", "1 0.5 0.5 0.1\t", "\x0b2\t0.5\x0c0.5 0.1 0.1 \x1f", " 3 0.5 0.5 0.1 0.1　", " \t ", ""]
    got = labels.parse(spark.createDataFrame([("s", i, x) for i, x in enumerate(rows)], "stem string, line_no int, line string"))
    assert sorted((r.line_no, r.cls) for r in got.collect()) == [(0, 1), (2, 2), (3, 3)]
    assert [r.cls for r in labels.discover_classes(spark.createDataFrame([("s", 0, "\t7 x")], "stem string, line_no int, line string")).collect()] == [7]


def test_crops(spark, folder):
    px = images.pixels(spark, str(folder / "images"))
    boxes = spark.createDataFrame([(n, 0, 0, -5, -5, 10, 10) for n in NAMES] + [("plain", 1, 1, 39, 29, 80, 80), ("plain", 1, 2, 40, 5, 50, 9), ("plain", 2, 3, 7, 7, 7, 9)], "stem string, cls int, idx int, x1 int, y1 int, x2 int, y2 int")
    cut = images.crops(px, boxes)
    got = {(r.stem, r.cls, r.idx): (r.width, r.height) for r in cut.collect()}
    assert got == {**{(n, 0, 0): (10, 10) for n in NAMES}, ("plain", 1, 1): (1, 1)}
    writers.write_crops(cut, str(folder / "out"))
    assert (folder / "out" / "cls0" / "a b_cls0_0.png").exists()
    back = {r.stem: r for r in images.pixels(spark, str(folder / "out" / "cls0")).collect()}
    assert set(back) == {f"{n}_cls0_0" for n in NAMES}
    assert set(np.frombuffer(back["plain_cls0_0"].data, np.uint8).reshape(-1, 3).tolist().__repr__().replace(" ", "").strip("[]").split("],[")) == {"10,20,250"}
    hashes = {r.path.rpartition("/")[2]: r.hash for r in images.hashes(px).collect()}
    assert len(hashes) == 3 and all(isinstance(h, int) for h in hashes.values())
    assert len({r.hash for r in cut.where("cls = 0").collect()}) == 1


def test_one_document(spark, tmp_path):
    entries = spark.createDataFrame([("b.jpg", '{"b.jpg":{"label_file":"b.txt","n_final_total":1}}'), ("a.jpg", '{"a.jpg":{"label_file":"a.txt","preview_file":null,"n_final_total":0}}')], "file string, json string")
    summary.write_document(entries, str(tmp_path / "s"))
    text = (tmp_path / "s" / "summary.json").read_text()
    want = {"a.jpg": {"label_file": "a.txt", "preview_file": None, "n_final_total": 0}, "b.jpg": {"label_file": "b.txt", "n_final_total": 1}}
    assert text == json.dumps(want, indent=2)
    assert {r.file for r in summary.parse(spark.createDataFrame([(text,)], "json string")).collect()} == {"a.jpg", "b.jpg"}


def test_export(spark, folder, capsys):
    (folder / "s").mkdir()
    (folder / "s" / "summary.json").write_text(json.dumps({f"{n}.png": {"label_file": f"old/{n}.txt"} for n in (*NAMES, "gone")}))
    cli.main(["export", "--summary", str(folder / "s"), "--labels", str(folder / "labels"), "--out", str(folder / "copy")], spark)
    assert "3 copied, 1 missing" in capsys.readouterr().out
    for n in NAMES:
        assert (folder / "copy" / f"{n}.txt").read_text() == (folder / "labels" / f"{n}.txt").read_text()


def test_report_and_commands(spark, folder, capsys):
    cli.main(["evaluate", "--truths", str(folder / "labels"), "--predictions", str(folder / "labels"), "--classes", str(folder / "classes.txt"), "--iou", "0.4"], spark)
    out = capsys.readouterr().out.splitlines()
    assert out[1].split() == ["one", "1.000", "1.000", "1.000", "1.000", "1.000", "3", "3"]
    assert out[4].split() == ["ALL", "1.000", "1.000", "9", "9"] and out[6].split()[-3:] == ["1/0/0"] * 3
    cli.main(["crops", "--images", str(folder / "images"), "--labels", str(folder / "labels"), "--out", str(folder / "c"), "--stride", "1", "--hash-distance", "0"], spark)
    assert len(list((folder / "c" / "cls0").iterdir())) == 3 and len(list((folder / "c" / "cls2").iterdir())) == 3 and not (folder / "c" / "cls1").exists()
    cli.main(["crops", "--images", str(folder / "images"), "--labels", str(folder / "labels"), "--out", str(folder / "d"), "--stride", "1", "--hash-distance", "6"], spark)
    assert len(list((folder / "d" / "cls0").iterdir())) == 1
    cli.main(["parameters"])
    assert "small_area=0.02" in capsys.readouterr().out


def test_classes_without_truths_are_named(spark):
    names = spark.createDataFrame([(0, "x"), (1, "y")], "cls int, name string")
    rows = spark.createDataFrame([(0, 1, 0, 1, 1, 2, 1.0, 0.5, 2 / 3, 0.5, 0.25)], "cls int, tp long, fp long, fn long, n_pred long, n_gt long, prec double, rec double, f1 double, ap50 double, ap_coco double")
    text = list(report.lines(report.report_rows(rows, metrics.overall(rows), names)))
    assert text[2].startswith("y ") and "left out" in text[2] and text[3].split() == ["ALL", "0.500", "0.250", "1", "2"]


def test_similarity_keeps_every_row(spark):
    rng = random.Random(1)
    unit = lambda: [rng.gauss(0, 1) for _ in range(4)]
    props = [(0, 1, [1.0, 0.0, 0.0, 0.0]), (0, 1, [0.0, 1.0, 0.0, 0.0]), (0, 1, [0.0, 1.0, 0.0, 0.0]), (0, 2, None), (9, 3, [1.0, 0.0, 0.0, 0.0]), (None, 4, [1.0, 0.0, 0.0, 0.0])] + [(k % 2, 10 + k, unit()) for k in range(40)]
    bank = [(0, "late", 5, [1.0, 0.0, 0.0, 0.0]), (0, "first", 2, [1.0, 0.0, 0.0, 0.0]), (0, "other", 1, [0.0, 0.5, 0.0, 0.0])] + [(k % 2, f"r{k}", 20 + k, unit()) for k in range(30)]
    p = spark.createDataFrame(props, "cls int, id int, emb array<double>").repartition(3)
    b = spark.createDataFrame(bank, "cls int, ref_name string, ord int, emb array<double>")
    want = []
    for c, i, e in props:
        own = sorted(((-round(sum(x * y for x, y in zip(e, r[3])), 9), r[2], r[1]) for r in bank if r[0] == c and c is not None), key=lambda x: x[:2]) if e else []
        want.append((c, i, -own[0][0] if own else None, own[0][2] if own else None))
    key = lambda r: str(r)
    for rows in (joins.BROADCAST_ROWS, 4):
        got = [(r.cls, r.id, None if r.sim is None else round(r.sim, 9) + 0.0, r.best_ref) for r in joins.max_similarity(p, b, rows_at_once=rows).collect()]
        assert sorted(got, key=key) == sorted(want, key=key)
    assert joins.max_similarity(p, b.limit(0)).where("sim IS NULL").count() == len(props)


def test_lost_rows_are_counted(spark):
    lost = spark.sparkContext.accumulator(0)
    got = sorted(r.id for r in apply(spark.range(0, 30, 1, 2), Doubler(), lost=lost).collect())
    assert got == [i for i in range(30) if i != 13] and lost.value == 1


def test_pooling_modes(spark):
    rows = [(0, True, True, [9.0, 9.0]), (0, False, True, [3.0, 0.0]), (0, False, False, [0.0, 5.0]), (1, True, None, [1.0, 1.0]), (1, False, None, [5.0, 7.0]), (2, True, False, [0.0, 2.0]), (2, False, False, [4.0, 4.0])]
    t = spark.createDataFrame(rows, "crop int, is_cls boolean, masked boolean, emb array<double>")
    pooled = lambda **k: {(r.crop, r.i): r.v for r in aggregates.masked_pool(t, **k).collect()}
    assert pooled() == {(0, 0): 3.0, (0, 1): 0.0, (1, 0): 3.0, (1, 1): 4.0, (2, 0): 0.0, (2, 1): 2.0}
    assert pooled(every=True)[2, 0] == 2.0 and pooled(every=True)[0, 1] == pytest.approx(14 / 3)
    assert pooled(unit=True)[1, 0] == pytest.approx(0.6) and pooled(unit=True)[0, 0] == 1.0
    assert spark.range(1).select(vectors.normalised(F.array(F.lit(3.0), F.lit(4.0))).alias("v")).first().v == [0.6, 0.8]


@pytest.mark.parametrize("ranges", [2, 256])
def test_ranks_in_ranges(spark, ranges):
    rng = random.Random(ranges)
    rows = [(k % 3, float(rng.choice([1, 2, 2, 2, rng.randint(0, 50)]))) for k in range(400)] + [(7, 4.0), (8, None)]
    df = spark.createDataFrame(rows, "g int, v double").repartition(3)
    got = {r.g: (r.low, r.mid, r.high) for r in aggregates.at_ranks(df, "g", {"low": lambda n: F.lit(0), "mid": lambda n: F.floor(n / 2), "high": lambda n: n - 1}, ranges).collect()}
    by = {g: sorted(v for c, v in rows if c == g) for g in (0, 1, 2, 7)}
    assert got == {g: (v[0], v[len(v) // 2], v[-1]) for g, v in by.items()}


def test_default_parameters():
    assert FuseA().small_area == 0.01 and cli.CONFIGS["fuse-a-interactive"].small_area == 0.02
    args = cli.parser().parse_args(["fuse-b", "--proposals", "p", "--bank", "b", "--out", "o", "--vertical", "false", "--combined", "0.3"])
    config = cli.config_of(args, cli.CONFIGS["fuse-b"])
    assert config.vertical is False and config.combined == 0.3 and config.canvas == 1008


def test_similarity_is_summed_in_order(spark):
    """Whatever the batch, a cosine has the bits of the SQL's sum over the vector."""
    rng = np.random.default_rng(5)
    unit = lambda n: (v := rng.normal(size=(n, 64))) / np.linalg.norm(v, axis=1, keepdims=True)
    rows, refs = unit(60).tolist(), unit(40).tolist()
    p = spark.createDataFrame([(i % 2, i, v) for i, v in enumerate(rows)], "cls int, id long, emb array<double>").repartition(7)
    b = spark.createDataFrame([(i % 2, i, f"r{i}", v) for i, v in enumerate(refs)], "cls int, ord long, ref_name string, emb array<double>")

    def dot(x, y):
        out = 0.0
        for u, v in zip(x, y, strict=True):
            out += u * v
        return out

    want = {i: max((dot(v, r), f"r{k}") for k, r in enumerate(refs) if k % 2 == i % 2) for i, v in enumerate(rows)}
    for at_once in (1000, 7):
        assert {r.id: (r.sim, r.best_ref) for r in joins.max_similarity(p, b, rows_at_once=at_once).collect()} == want


def test_rounding_is_that_of_the_sql(spark):
    rng = np.random.default_rng(3)
    values = [*np.round(rng.uniform(0, 1000, 3000), 6) + 5e-7, -1.5, -2.4999995, 0.0, 0.49999999999999994e-6]
    want = [duckdb.execute("SELECT round(?::DOUBLE, 6)", [float(v)]).fetchone()[0] for v in values]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")
    assert [r.v for r in df.select("i", fx.rounded(F.col("v"), 6).alias("v")).orderBy("i").collect()] == want
