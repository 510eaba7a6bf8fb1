"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

One pass over the texts gives each document a vector of statistics (logs of counts, square roots of shares, which are
nearer to normal than raw ones). Class means and covariances come from sums over all labelled training rows, gathered by
a distributed aggregation; covariances are shrunk towards a scaled identity, factored once (Cholesky), and a score is the
logistic of the class prior plus the difference of the Mahalanobis log densities.

Defined cases: null and empty texts have the statistics of no words and a score like any other; without training rows of both
classes every score is the training share of label 1 (0.5 without any rows); rows with null labels don't train; several
labels of one doc_id count as one, the largest; repeated documents are scored each; other columns are not read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import arrow_map, saved, utf8

FEATURES = (
    "log_words", "log_mean_word", "sqrt_upper", "sqrt_digit", "sqrt_symbol", "sqrt_shout", "sqrt_high_bytes", "log_type_ratio",
    "sqrt_adjacent_repeats", "sqrt_repeated_lines", "log_compression", "sqrt_top_word", "sqrt_stops", "sqrt_symbol_words",
)
SHRINKAGE = 0.2
CLIP = 6.0
THRESHOLD = 0.7
#: Labels that may be broadcast (16 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000

_UPPER, _DIGIT, _SYMBOL, _SHOUT, _HIGH, _STOP = 1, 2, 3, 4, 5, 6
_KIND = np.zeros(256, np.uint8)
_KIND[ord("A") : ord("Z") + 1] = _UPPER
_KIND[ord("0") : ord("9") + 1] = _DIGIT
_KIND[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = _SYMBOL
_KIND[[ord(c) for c in "!?"]] = _SHOUT
_KIND[128:] = _HIGH
_KIND[[ord(c) for c in ".,;:"]] = _STOP
_ENDS = frozenset(b"#$%&*+/<=>@[\\]^_`{|}~!")


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of one whole text."""
    words = text.split()
    n, size = len(words), len(text)
    kinds = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=7)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    adjacent = sum(map(bytes.__eq__, words, words[1:]))
    lines = [x for x in text.split(b"\n") if x]
    symbol_words = sum(w[-1] in _ENDS for w in counts)
    letters = sum(map(len, words))
    root = lambda k: float(np.sqrt(kinds[k] / (size + 100)))
    # Counts have constants added to them, so that the statistics of a few words stay near those of a usual text.
    return [
        float(np.log(n + 30)),
        float(np.log((letters + 100) / (n + 20))),
        root(_UPPER),
        root(_DIGIT),
        root(_SYMBOL),
        root(_SHOUT),
        root(_HIGH),
        float(np.log((len(counts) + 20) / (n + 20))),
        float(np.sqrt(adjacent / (n + 20))),
        float(np.sqrt((len(lines) - len(set(lines))) / (len(lines) + 5))),
        float(np.log((_deflated(text) + 40) / (size + 100))),
        float(np.sqrt((max(counts.values(), default=1) - 1) / (n + 20))),
        root(_STOP),
        float(np.sqrt(symbol_words / (len(counts) + 20))),
    ]


def _deflated(text: bytes, piece: int = 1 << 16) -> int:
    """Compressed size of the whole text, a piece at a time."""
    squeeze = zlib.compressobj(1)
    return sum(len(squeeze.compress(text[i : i + piece])) for i in range(0, len(text), piece)) + len(squeeze.flush())


@dataclass(frozen=True)
class Discriminant:
    """Two normal densities in standardised statistics, with their Cholesky factors' inverses kept."""

    share: float
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    means: np.ndarray | None = None
    inverse_factors: np.ndarray | None = None
    log_dets: np.ndarray | None = None

    @staticmethod
    def fit(counts: np.ndarray, sums: np.ndarray, products: np.ndarray, shrinkage: float = SHRINKAGE) -> Discriminant:
        """counts[2], sums[2, d], products[2, d, d]: of the training rows by class."""
        total = counts.sum()
        share = float(counts[1] / total) if total else 0.5
        if min(counts) < 2:
            return Discriminant(share)
        d = sums.shape[1]
        centre = sums.sum(0) / total
        spread = np.diag(products.sum(0)) / total - centre**2
        scale = np.sqrt(np.maximum(spread, 1e-8))
        means, inverses, dets = [], [], []
        for c in (0, 1):
            mean = sums[c] / counts[c]
            covariance = products[c] / counts[c] - np.outer(mean, mean)
            covariance = covariance / np.outer(scale, scale)
            target = np.trace(covariance) / d
            covariance = (1 - shrinkage) * covariance + shrinkage * max(target, 1e-3) * np.eye(d)
            factor = np.linalg.cholesky(covariance)
            means.append((mean - centre) / scale)
            inverses.append(np.linalg.inv(factor))
            dets.append(2 * np.log(np.diag(factor)).sum())
        return Discriminant(share, centre, scale, np.array(means), np.array(inverses), np.array(dets))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows of statistics."""
        if self.centre is None:
            return np.full(len(x), self.share)
        z = np.clip((x - self.centre) / self.scale, -CLIP, CLIP)
        logs = []
        for c in (0, 1):
            away = (z - self.means[c]) @ self.inverse_factors[c].T
            logs.append(-0.5 * ((away**2).sum(1) + self.log_dets[c]))
        margin = logs[1] - logs[0] + np.log(self.share / (1 - self.share))
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x array<double>) for each row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = [statistics(t) for t in utf8(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    return arrow_map(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), each, f"doc_id {kind}, x array<double>")


def moments(rows: DataFrame, label: Column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, sums and sums of products of x by label 0 and 1; partial sums per task, one small row for each."""
    d = len(FEATURES)

    def sums(batches):
        counts, first, second = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column("x").flatten()).reshape(-1, d)
                y = np.asarray(batch.column("y"))
                for c in (0, 1):
                    own = x[y == c]
                    counts[c] += len(own)
                    first[c] += own.sum(0)
                    second[c] += own.T @ own
        flat = np.concatenate([counts, first.ravel(), second.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], ["k", "v"])

    parts = rows.select("x", label.cast("int").alias("y")).where(F.col("y").isin(0, 1)).mapInArrow(sums, "k int, v double")
    flat = np.zeros(2 + 2 * d + 2 * d * d)
    for k, v in parts.groupBy("k").agg(F.sum("v")).collect():  # one row for each moment
        flat[k] = v
    return flat[:2], flat[2 : 2 + 2 * d].reshape(2, d), flat[2 + 2 * d :].reshape(2, d, d)


def held_out(id_col: str, modulus: int, rest: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(modulus)) == rest


def known_labels(labels: DataFrame, label_col: str) -> DataFrame:
    """(doc_id, y) of label 0 or 1, the largest of a doc_id's; to be broadcast if they were counted to be few."""
    known = saved(labels.where(F.col(label_col).isin(0, 1)).groupBy("doc_id").agg(F.max(label_col).alias("y")))
    return F.broadcast(known) if known.count() <= BROADCAST_ROWS else known


def fit(features: DataFrame, known: DataFrame, out: Column, shrinkage: float = SHRINKAGE) -> Discriminant:
    """From the statistics of documents and labels by doc_id; rows for which ``out`` holds don't train."""
    return Discriminant.fit(*moments(features.where(~out).join(known, "doc_id"), F.col("y")), shrinkage)


def scored(features: DataFrame, model: Discriminant, *keep: str) -> DataFrame:
    """features' ``keep`` columns with the score."""
    kinds = [f"{c} {features.schema[c].dataType.simpleString()}" for c in keep]

    def run(batches):
        for batch in batches:
            x = np.asarray(batch.column("x").flatten()).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(model.score(x))], [*keep, "score"])

    return features.select(*keep, "x").mapInArrow(run, ", ".join([*kinds, "score double"]))


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", modulus: int = 4, rest: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each document; rows whose crc32(doc_id) mod ``modulus`` is ``rest`` don't train."""
    features = saved(document_statistics(docs))  # for the fit and for the scores
    out = held_out("doc_id", modulus, rest)
    model = fit(features, known_labels(labels, label_col), out)
    return scored(features, model, "doc_id").select("doc_id", out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def filtered(docs: DataFrame, labels: DataFrame, label_col: str = "quality", modulus: int = 4, rest: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all their columns, that the classifier accepts. The texts are read twice rather than shuffled."""
    out, known = held_out("doc_id", modulus, rest), known_labels(labels, label_col)
    # Only labelled documents' statistics are needed for the fit. They are saved, so that no task has two Python workers at once.
    model = fit(saved(document_statistics(docs.where(~out).join(known.select("doc_id"), "doc_id", "left_semi"))), known, out)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([statistics(t) for t in utf8(batch.column("text"))])
        return batch.filter(pa.array(model.score(x) >= threshold))

    return arrow_map(docs, each, docs.schema)
