import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from gridloom.llm import quality, toxicity

SF = "/root/testdata/sf0.01"


def test_discriminant_is_the_normal_log_ratio():
    rng = np.random.default_rng(0)
    x = [rng.normal(0, 1, (500, 3)), rng.normal(1, 2, (300, 3))]
    sums = np.array([len(v) for v in x]), np.array([v.sum(0) for v in x]), np.array([v.T @ v for v in x])
    model = quality.Discriminant.fit(*sums, shrinkage=0.3)
    z = [(v - model.centre) / model.scale for v in x]

    def log_density(v, own):
        cov = np.cov(own.T, bias=True)
        cov = 0.7 * cov + 0.3 * np.trace(cov) / 3 * np.eye(3)
        d = v - own.mean(0)
        return -0.5 * (d @ np.linalg.inv(cov) @ d + np.linalg.slogdet(cov)[1])

    for v in rng.normal(0, 1, (5, 3)):
        u = (v - model.centre) / model.scale
        margin = log_density(u, z[1]) - log_density(u, z[0]) + np.log(300 / 500)
        assert model.score(v[None])[0] == pytest.approx(1 / (1 + np.exp(-margin)))


def held(doc_id, modulus, rest):
    return zlib.crc32(str(doc_id).encode()) % modulus == rest


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == docs.count() and all(r.held_out == held(r.doc_id, 4, 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    out = [(r.quality, got[r.doc_id].predicted) for r in labels.collect() if got[r.doc_id].held_out]
    assert sum(a == b for a, b in out) / len(out) >= 0.95


def test_quality_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (7, 0, 0), (11, 0, 1), (11, 0, 1), (12, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.classify(edge_docs, labels).count() == edge_docs.count()
    assert quality.classify(no_docs, labels).count() == 0
    assert {r.score for r in quality.classify(edge_docs, labels.limit(0)).collect()} == {0.5}
    kept = quality.filtered(edge_docs, labels.where("quality = 1"))
    assert kept.columns == edge_docs.columns and kept.count() == edge_docs.count()


def test_noisy_or_finds_the_sentence():
    rng = random.Random(3)
    clean = lambda n: " ".join(f"v{rng.randint(0, 60)}" for _ in range(n)) + "."
    texts, labels = [], []
    for k in range(300):
        own = [clean(8) for _ in range(6)]
        if k % 3 == 0:
            own[rng.randrange(6)] = f"you {rng.choice(['rotter', 'swine'])} {clean(4)}"
        texts.append(" ".join(own))
        labels.append(int(k % 3 == 0))
    model = toxicity.train(texts, labels)
    assert model.weights["rotter"] > 1 and model.weights["swine"] > 1
    for t, y in zip(texts, labels, strict=True):
        own, p = model.sentence_scores(t)
        assert (toxicity.noisy_or(p) >= 0.5) == bool(y)
        assert toxicity.noisy_or(p) == pytest.approx(1 - np.prod(1 - p))
        if y:
            assert "rotter" in own[int(p.argmax())] or "swine" in own[int(p.argmax())]


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    out = [(r.toxic, got[r.doc_id].predicted) for r in labels.collect() if got[r.doc_id].held_out]
    assert all(r.held_out == held(r.doc_id, 5, 0) for r in got.values())
    hits = sum(a == b == 1 for a, b in out)
    assert hits / sum(a for a, _ in out) >= 0.85 and hits / max(1, sum(b for _, b in out)) >= 0.9


def test_toxicity_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (7, 0, 0), (11, 0, 1), (11, 0, 1), (12, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.classify(edge_docs, labels).collect()
    assert len(got) == edge_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.classify(no_docs, labels).count() == 0
    assert {r.score for r in toxicity.classify(edge_docs, labels.limit(0)).collect()} == {0.5}


def plain_statistics(text):
    """The 14 statistics, a character at a time."""
    data = text.encode()
    words = [w for w in re.split(rb"[ \t\n\r\v\f]+", data) if w]
    n, size, letters = len(words), len(data), sum(len(w) for w in words)
    share = lambda chars: math.sqrt(sum(chr(c) in chars for c in data if c < 128) / (size + 100))
    lines = [x for x in data.split(b"\n") if x]
    distinct = set(words)
    top = max((words.count(w) for w in distinct), default=1) if n < 3000 else max(Counter(words).values())
    return [
        math.log(n + 30), math.log((letters + 100) / (n + 20)), share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share("0123456789"), share("#$%&*+/<=>@[\\]^_`{|}~"), share("!?"),
        math.sqrt(sum(c > 127 for c in data) / (size + 100)), math.log((len(distinct) + 20) / (n + 20)), math.sqrt(sum(a == b for a, b in zip(words, words[1:])) / (n + 20)),
        math.sqrt((len(lines) - len(set(lines))) / (len(lines) + 5)), math.log((len(zlib.compress(data, 1)[2:-4]) + 6 + 40) / (size + 100)), math.sqrt((top - 1) / (n + 20)), share(".,;:"),
        math.sqrt(sum(chr(w[-1]) in "#$%&*+/<=>@[\\]^_`{|}~!" for w in distinct) / (len(distinct) + 20)),
    ]


def test_quality_against_a_plain_version(spark):
    """Every score of a whole table: statistics, fit and densities made without the operator's code."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    x = {r.doc_id: np.array(plain_statistics(r.text or "")) for r in docs.collect()}
    y = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    train = [[x[d] for d, label in y.items() if label == c and d in x and not held(d, 4, 2)] for c in (0, 1)]
    both = np.array(train[0] + train[1])
    centre, scale = both.mean(0), both.std(0)
    margin = {d: math.log(len(train[1]) / len(train[0])) for d in x}
    for c, sign in ((0, -1), (1, 1)):
        z = (np.array(train[c]) - centre) / scale
        cov = np.cov(z.T, bias=True)
        cov = (1 - quality.SHRINKAGE) * cov + quality.SHRINKAGE * np.trace(cov) / len(cov) * np.eye(len(cov))
        for d, v in x.items():
            away = np.clip((v - centre) / scale, -quality.CLIP, quality.CLIP) - z.mean(0)
            margin[d] -= sign * 0.5 * (away @ np.linalg.solve(cov, away) + np.linalg.slogdet(cov)[1])
    got = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    assert set(got) == set(x)
    for d, m in margin.items():
        assert got[d] == pytest.approx(1 / (1 + math.exp(-m)) if m > -500 else 0.0, abs=1e-6)
    kept = {r.doc_id for r in quality.filtered(docs, labels).collect()}
    assert kept == {d for d, s in got.items() if s >= 0.7}


def test_toxicity_against_a_plain_version(spark):
    """Every score of a whole table, with the sample drawn and the sentences scored without the operator's code."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    y = {r.doc_id: r.toxic for r in labels.collect() if r.toxic in (0, 1)}
    place = lambda *parts: _chained(parts)
    fit = [d for d in y if d in texts and not held(d, 5, 0) and len(texts[d].encode()) <= toxicity.SAMPLE_BYTES]
    chosen = [d for c in (0, 1) for d in sorted((d for d in fit if y[d] == c), key=lambda d: (place(d), d))[: toxicity.SAMPLE]]
    chosen.sort(key=lambda d: (place(d, texts[d]), d))
    model = toxicity.train([texts[d] for d in chosen], [y[d] for d in chosen])
    got = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    assert set(got) == set(texts)
    for d, text in texts.items():
        clean, offending, n = 1.0, [], 0
        for s in re.split(r"(?<=[.!?])\s+|\n+", text):
            if s.strip() or (not text.strip() and n == 0):
                z = toxicity.BIAS
                for w in set(re.findall(r"\w+", s.lower())):
                    z += round(1024 * sum(model.weights.get(f, 0.0) for f in [w] + [w[:k] + "-" for k in (4, 5) if len(w) > k])) / 1024
                p = 1 / (1 + math.exp(-max(-60, min(60, z))))
                clean *= 1 - p
                if p >= toxicity.OFFENDS:
                    offending.append(n)
                n += 1
        assert got[d].score == pytest.approx(1 - clean, abs=1e-9) and got[d].offending == offending and got[d].n_sentences == max(n, 1)


def _chained(parts):
    """Spark's 64-bit hash of a number, or of a number and a text."""
    seed = 42
    for x in parts:
        seed = xxhash.xxh64_intdigest(x.encode() if isinstance(x, str) else (x % (1 << 64)).to_bytes(8, "little"), seed=seed)
    return seed - (1 << 64) if seed >> 63 else seed


def test_sample_of_repeated_ids_is_fair(spark):
    """Rows that share ids fill the sample; no id is left out for being large."""
    rows = [(d, f"text {k} of {d} " + ("rotten" if d % 2 else "fine")) for d in range(20) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(d, d % 2) for d in range(20)], "doc_id long, toxic int")
    seen = []
    own = toxicity.train
    try:
        toxicity.train = lambda texts, ys: seen.extend(texts) or own(texts, ys)
        toxicity.fit(docs, labels, sample=10)
    finally:
        toxicity.train = own
    assert len(seen) == 20 and len({t.split()[3] for t in seen}) > 8 and max(int(t.split()[3]) for t in seen) > 14
