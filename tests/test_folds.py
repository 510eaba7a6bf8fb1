"""Order-dependent reductions against sequential Python on random boxes with many ties."""

import numpy as np
import pytest

from gridloom.operators import cluster, folds, metrics

SCHEMA = "img long, cls int, ord int, score double, x1 double, y1 double, x2 double, y2 double"


def random_boxes(seed, n=60):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x, y = rng.integers(0, 30, 2)
        w, h = rng.integers(5, 25, 2)
        rows.append((int(i % 3), int(i % 2), i, float(rng.integers(0, 6)) / 5, float(x), float(y), float(x + w), float(y + h)))
    return rows


def overlap(a, b):
    inter = max(0.0, min(a[6], b[6]) - max(a[4], b[4])) * max(0.0, min(a[7], b[7]) - max(a[5], b[5]))
    size = lambda r: (r[6] - r[4]) * (r[7] - r[5])
    return (inter / (size(a) + size(b) - inter) if inter else 0.0), (inter / min(size(a), size(b)) if inter else 0.0)


def by_group(rows):
    out = {}
    for r in rows:
        out.setdefault(r[:2], []).append(r)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_suppression(spark, seed):
    rows = random_boxes(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want_nms, want_b, want_a = set(), set(), set()
    for own in by_group(rows).values():
        order = sorted(own, key=lambda r: (-r[3], r[2]))
        kept = []
        for r in order:
            if not any(overlap(r, k)[0] > 0.3 for k in kept):
                kept.append(r)
        want_nms |= {r[2] for r in kept}
        kept = []
        for r in order:
            if not any(overlap(r, k)[1] >= 0.6 or overlap(r, k)[0] >= 0.5 for k in kept):
                kept.append(r)
        want_b |= {r[2] for r in kept}
        gone = set()
        own = sorted(own, key=lambda r: r[2])
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                if a[2] not in gone and b[2] not in gone and overlap(a, b)[1] > 0.5:
                    gone.add(a[2] if a[3] < b[3] else b[2])
        want_a |= {r[2] for r in own} - gone
    got = lambda out: {r.ord for r in out.where("kept").collect()}
    assert got(folds.nms(df, ["img", "cls"], 0.3)) == want_nms
    assert got(folds.containment_and_duplicates(df, ["img", "cls"], 0.6, 0.5)) == want_b
    assert got(folds.contained_pairs(df, ["img", "cls"], 0.5)) == want_a


@pytest.mark.parametrize("seed", [1, 2])
def test_matching_and_average_precision(spark, seed):
    preds, gts = random_boxes(seed), [(*r[:2], r[2], *r[4:]) for r in random_boxes(seed + 50)]
    p = spark.createDataFrame(preds, SCHEMA).repartition(3)
    g = spark.createDataFrame(gts, "img long, cls int, ord int, x1 double, y1 double, x2 double, y2 double")
    flags = folds.greedy_match(p, g, ["img", "cls"], [0.2, 0.5])
    got = {(r.thr, r.ord): r.tp for r in flags.collect()}
    truth = by_group([(*r[:3], 0.0, *r[3:]) for r in gts])
    want = {}
    for thr in (0.2, 0.5):
        for key, own in by_group(preds).items():
            taken = set()
            for r in sorted(own, key=lambda r: (-r[3], r[2])):
                best, at = 0.0, None
                for t in sorted(truth.get(key, []), key=lambda t: t[2]):
                    v = overlap(r, t)[0]
                    if t[2] not in taken and v > best:
                        best, at = v, t[2]
                hit = best >= thr
                taken |= {at} if hit else set()
                want[thr, r[2]] = int(hit)
    assert got == want
    curve = metrics.pr_curve(flags, g, ["thr", "cls"], [folds.F.col("img"), folds.F.col("ord")])
    ap = {(r.thr, r.cls): r.ap for r in metrics.average_precision(curve, g, ["thr", "cls"]).collect()}
    grid = np.linspace(0, 1, 101)
    for (thr, cls), value in ap.items():
        own = sorted([r for r in preds if r[1] == cls], key=lambda r: (-r[3], r[0], r[2]))
        tp = np.cumsum([want[thr, r[2]] for r in own])
        precision, recall = tp / np.arange(1, len(own) + 1), tp / sum(t[1] == cls for t in gts)
        assert value == pytest.approx(sum(precision[recall >= t].max(initial=0.0) for t in grid) / 101, abs=1e-12)


def test_average_precision_grid_is_exact(spark):
    """With 20 truths, 7 leading hits have a recall just below the grid point 35."""
    p = spark.createDataFrame([(0, 0, i, 1.0 - i / 100, 10.0 * i, 0.0, 10.0 * i + 9, 9.0) for i in range(7)], SCHEMA)
    g = spark.createDataFrame([(0, 0, i, 10.0 * i, 0.0, 10.0 * i + 9, 9.0) for i in range(20)], "img long, cls int, ord int, x1 double, y1 double, x2 double, y2 double")
    curve = metrics.pr_curve(folds.greedy_match(p, g, ["img", "cls"], [0.5]), g, ["cls"], [folds.F.col("img"), folds.F.col("ord")])
    assert metrics.average_precision(curve, g, ["cls"]).first().ap == pytest.approx(35 / 101)


def test_no_predictions_is_undefined(spark):
    p = spark.createDataFrame([], SCHEMA)
    g = spark.createDataFrame([(0, 0, 0, 0.0, 0.0, 9.0, 9.0)], "img long, cls int, ord int, x1 double, y1 double, x2 double, y2 double")
    flags = folds.greedy_match(p, g, ["img", "cls"], [0.5])
    curve = metrics.pr_curve(flags, g, ["cls"], [folds.F.col("img"), folds.F.col("ord")])
    assert metrics.average_precision(curve, g, ["cls"]).first().ap is None
    with pytest.raises(ValueError):
        folds.greedy_match(p, g, ["img", "cls"], [0.0])


@pytest.mark.parametrize("seed", [4, 5])
def test_weighted_fusion(spark, seed):
    rows = [(*r[:3], r[3] + 0.1, *r[4:]) for r in random_boxes(seed)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = {}
    for key, own in by_group(rows).items():
        clusters = []
        for r in sorted(own, key=lambda r: (-r[3], r[2])):
            fused = [tuple(np.average([m[4:] for m in c], axis=0, weights=[m[3] for m in c])) for c in clusters]
            ious = [overlap((0, 0, 0, 0, *f), r)[0] for f in fused]
            if ious and max(ious) > 0.4:
                clusters[int(np.argmax(ious))].append(r)
            else:
                clusters.append([r])
        for i, c in enumerate(clusters):
            want[(*key, i)] = (*np.average([m[4:] for m in c], axis=0, weights=[m[3] for m in c]), np.mean([m[3] for m in c]) * min(len(c), 2) / 2, len(c))
    got = {(r.img, r.cls, r.cluster): (r.x1, r.y1, r.x2, r.y2, r.score, r.n) for r in folds.weighted_fusion(df, ["img", "cls"], 0.4, models=2).collect()}
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k]) for k in got)


def test_hash_dedup(spark):
    rows = [(0, i, h) for i, h in enumerate([0, 1, 3, 7, -1, -2, 1 << 62])]
    df = spark.createDataFrame(rows, "cls int, ord long, hash long")
    kept = []
    for _, i, h in rows:
        if not any(((h ^ k) & (2**64 - 1)).bit_count() <= 1 for _, k in kept):
            kept.append((i, h))
    assert {r.ord for r in folds.hash_dedup(df, ["cls"], 1).where("kept").collect()} == {i for i, _ in kept}
    assert folds.hash_dedup(df, ["cls"], 0).where("kept").count() == len(rows)


@pytest.mark.parametrize("block", [1 << 16, 25])
def test_hash_dedup_by_rounds(spark, block):
    """Blocks of any length keep what one after the other does: copies, ties in place, rows without a class or hash."""
    rng = np.random.default_rng(9)
    few = [int(x) for x in rng.integers(-(1 << 62), 1 << 62, 50)]
    rows = [(int(i % 3) if i % 3 else None, int(i // 2) if i > 9 else None, few[int(rng.integers(0, 50))] ^ int(1 << rng.integers(0, 62)) if i % 17 else None) for i in range(200)] + [(1, 9, few[0])] * 2
    df = spark.createDataFrame(rows, "cls int, ord long, hash long").repartition(5)
    for distance in (2, 24):
        kept, want = {}, []
        for c, o, h in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or 0)):
            if c is None or h is None:
                want.append((c, o, h))
            elif all(((h ^ k) & (2**64 - 1)).bit_count() > distance for k in kept.setdefault(c, [])):
                kept[c].append(h)
                want.append((c, o, h))
        out = folds.hash_dedup(df, ["cls"], distance, block=block).collect()
        assert len(out) == len(rows) and sorted(map(repr, (tuple(r)[:3] for r in out if r.kept))) == sorted(map(repr, want))


def test_a_pile_of_hashes_is_not_compared_in_pairs(spark):
    """Plans of hash dedup join no row with the rows near to it, whatever the distance."""
    df = spark.range(10).selectExpr("0 AS cls", "id AS ord", "id AS hash")
    for distance in (4, 20):
        plan = folds.hash_dedup(df, ["cls"], distance)._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "bit_count" not in plan


def test_farthest_points():
    v = np.random.default_rng(0).normal(size=(30, 4))
    ten = cluster.farthest_points(v, 10)
    assert cluster.farthest_points(v, 4) == ten[:4] and len(set(ten)) == 10
    assert len(cluster.farthest_points(v, 99)) == 30 and cluster.farthest_points(v, 0) == [] and cluster.farthest_points(v[:0], 3) == []


def test_density_clusters():
    angle = np.deg2rad([0, 1, 2, 90, 91, 92, 180, 3.9])
    unit = np.stack([np.cos(angle), np.sin(angle)], 1)
    eps = 1 - np.cos(np.deg2rad(2))
    assert cluster.density_clusters(unit, eps + 1e-12, 3).tolist() == [0, 0, 0, 1, 1, 1, -1, 0]
    assert [m[2] for m in cluster.medoids(unit, np.array([0, 0, 0, 1, 1, 1, -1, -1]))] == [1, 4]
    assert cluster.select(unit, 8, None, 3, 85.0) == list(range(8))
    assert cluster.select(unit, 3, eps + 1e-12, 3, 85.0)[-1] == 6


def test_fusion_of_zero_scores(spark):
    """Boxes without any score are fused to their plain mean."""
    rows = [(0, 0, 0, 0.0, 0.0, 0.0, 10.0, 10.0), (0, 0, 1, 0.0, 2.0, 0.0, 12.0, 10.0), (0, 0, 2, 0.0, 50.0, 50.0, 60.0, 60.0), (0, 1, 0, 0.5, 0.0, 0.0, 10.0, 10.0), (0, 1, 1, 0.0, 2.0, 0.0, 12.0, 10.0)]
    got = {(r.cls, r.cluster): (r.x1, r.x2, r.score, r.n) for r in folds.weighted_fusion(spark.createDataFrame(rows, SCHEMA), ["img", "cls"], 0.4).collect()}
    assert got == {(0, 0): (1.0, 11.0, 0.0, 2), (0, 1): (50.0, 60.0, 0.0, 1), (1, 0): (0.0, 10.0, 0.25, 2)}


@pytest.mark.parametrize("distance", [0, 3, 6, 20, 40])
def test_near_hashes(spark, distance):
    rng = np.random.default_rng(distance)
    base = rng.integers(0, 1 << 63, 12)
    rows = [(int(i % 2), i, int(base[i % 12]) ^ int(np.bitwise_or.reduce(1 << rng.integers(0, 63, rng.integers(1, 9))))) for i in range(80)]
    df = spark.createDataFrame(rows, "cls int, ord long, hash long")
    got = sorted((r.x, r.y) for r in folds.near_hashes(df, df, ["cls"], distance).select(folds.F.col("a.ord").alias("x"), folds.F.col("b.ord").alias("y")).collect())
    assert got == sorted((i, j) for c, i, h in rows for d, j, k in rows if c == d and (h ^ k).bit_count() <= distance)


def clustered(spark, n=140):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 8))
    v = centres[rng.integers(0, 6, n)] + rng.normal(size=(n, 8)) * rng.choice([0.15, 1.0], (n, 1), p=[0.7, 0.3])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(int(i % 2), 1000 - 3 * i, [float(x) for x in u]) for i, u in enumerate(v)] + [(7, 5, [1.0] + [0.0] * 7)]
    return spark.createDataFrame(rows, "cls int, id long, emb array<double>").repartition(3)


def test_large_classes_below_the_cap(spark):
    """Classes above the limit that the cap does not touch stay whole, in order, with an eps that is to be tuned."""
    df = clustered(spark)
    rows = sorted((r.cls, r.id) for r in df.collect())
    got = [(r.cls, r.pos, r.id) for r in cluster.cluster_select(df, 100, None, 4, limit=30).orderBy("cls", "pos").collect()]
    assert [(c, i) for c, _, i in got] == rows and [p for c, p, _ in got] == [sum(d == c for d, _ in rows[:k]) for k, (c, _) in enumerate(rows)]


def test_large_classes_have_the_same_results(spark):
    """Classes above the limit go through blocks and rounds, and come out as in one task."""
    df = clustered(spark)
    same = lambda f, key: (sorted(map(key, f(cluster.LIMIT).collect())), sorted(map(key, f(30).collect())))
    plain = lambda r: tuple(r)
    one, two = same(lambda m: cluster.dbscan(df, 0.1, 4, limit=m), plain)
    assert one == two and {r[2] for r in one} > {-1, 0, 1}
    for f in (lambda m: cluster.cluster_medoids(df, 0.1, 4, limit=m), lambda m: cluster.fps(df, 6, limit=m), lambda m: cluster.cluster_select(df, 9, 0.1, 4, limit=m), lambda m: cluster.cluster_select(df, 9, None, 4, limit=m)):
        one, two = same(f, plain)
        assert one == two and one
    one, two = same(lambda m: cluster.auto_eps(df, 4, 85.0, limit=m), lambda r: (r.cls, round(r.eps, 12)))
    assert one == two


def test_stratified_split(spark):
    from gridloom.operators.split import stratified

    rng = np.random.default_rng(3)
    rows = [(int(i), int(c)) for i in range(80) for c in range(5) if rng.random() < (0.04, 0.1, 0.5, 0.9, 0.9)[c]] + [(0, 3), (0, 3)]
    df = spark.createDataFrame(rows, "img long, cls int").repartition(3)
    got = [r.img for r in stratified(df, 6, 30, seed=1).orderBy("pos").collect()]
    assert got == [r.img for r in stratified(df.repartition(5), 6, 30, seed=1).orderBy("pos").collect()] != [r.img for r in stratified(df, 6, 30, seed=2).orderBy("pos").collect()]
    assert len(set(got)) == len(got) == 30
    own = {c: {i for i, k in rows if k == c} for c in range(5)}
    assert all(len(own[c] & set(got)) >= min(6, len(own[c])) for c in own)
    assert stratified(df, 6, 10**6).count() == len({i for i, _ in rows}) and stratified(df.limit(0)).count() == 0
