"""Benchmark decontamination by greedy string tiling.

Texts are cut into words (``\\w+`` of the lower-cased text). A benchmark item's runs of ``least`` words are seeds; a
document that shares seeds with an item is a candidate pair if the item's words under shared seeds could reach the
threshold at all. On candidates greedy string tiling runs: the longest common runs of unmarked words are found by running
Karp-Rabin (window hashes at a search length that falls from the longest match to ``least``, each hit checked word by word),
marked and never used again. The share of the item's words under tiles is its coverage; since tiles may lie anywhere,
passages put in another order are caught.

The benchmark is the stated query set: it goes to the tasks in blocks of at most ``BLOCK_BYTES`` of text (a single longer
item is a block), each held against all documents, so nothing grows with the documents and no row is shuffled.

Defined cases: null and empty texts match nothing; an item of fewer than ``least`` words is found where all of its words stand in
a row, one without words never; equal items are found each; rows with null ids are kept as such; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gridloom.llm.common import Rolling, arrow_map, utf8

LEAST, COVERAGE = 5, 0.5
BLOCK_BYTES = 4 << 20
_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _windows(tokens: np.ndarray, free: np.ndarray, size: int, rolling: Rolling) -> tuple[np.ndarray, np.ndarray]:
    """Starts of windows of unmarked words, and their hashes."""
    if len(tokens) < size:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    marks = np.append(0, np.cumsum(~free))
    starts = np.flatnonzero(marks[size:] == marks[:-size])
    prefix = rolling.prefix(tokens.astype(np.uint64) + np.uint64(1))
    return starts, rolling.ranges(prefix, starts, starts + size)


def _longest(text: np.ndarray, item: np.ndarray, free_text: np.ndarray, free_item: np.ndarray, least: int, most: int, rolling: Rolling) -> int:
    """The longest length from least to most at which some windows of unmarked words have equal hashes, 0 if there is none."""
    low, high = least - 1, most
    while low < high:
        size = (low + high + 1) // 2
        _, found = _windows(text, free_text, size, rolling)
        _, wanted = _windows(item, free_item, size, rolling)
        if np.isin(wanted, found).any():
            low = size
        else:
            high = size - 1
    return low if low >= least else 0


def tile(text: np.ndarray, item: np.ndarray, least: int = LEAST, rolling: Rolling | None = None) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in text, start in item, words) of two sequences of word numbers; negative numbers match nothing.

    The search length falls from the longest match to ``least``, by bisection over running hashes. At each length all matches are as
    long as that; of those the earlier in the text goes first, then the earlier in the item. Marked windows of the item are
    passed once, so a length costs what the sequences are long, however often their words repeat.
    """
    rolling = rolling or Rolling(0x9E3779B97F4A7C15)
    free_text, free_item = text >= 0, item >= 0
    tiles: list[tuple[int, int, int]] = []
    most = min(len(item), len(text))
    while size := _longest(text, item, free_text, free_item, least, most, rolling):
        starts, hashes = _windows(item, free_item, size, rolling)
        places: dict[int, list[int]] = {}
        for s, h in zip(starts[::-1].tolist(), hashes[::-1].tolist(), strict=True):
            places.setdefault(h, []).append(s)  # the earliest is last
        at, found = _windows(text, free_text, size, rolling)
        hit, end = np.isin(found, hashes), 0
        for a, h in zip(at[hit].tolist(), found[hit].tolist(), strict=True):
            if a < end:  # inside the tile before
                continue
            own, passed = places[h], []
            while own:
                b = own.pop()
                if not free_item[b : b + size].all():
                    continue
                if np.array_equal(text[a : a + size], item[b : b + size]):
                    free_text[a : a + size] = free_item[b : b + size] = False
                    tiles.append((a, b, size))
                    end = a + size
                    break
                passed.append(b)  # other words of the same hash
            own += passed[::-1]
        most = size - 1
    return tiles


class Seeds:
    """The runs of ``least`` words of a block of items; a shorter item is one run of all its words."""

    def __init__(self, items: list[tuple[object, str]], least: int, coverage: float):
        self.coverage = coverage
        self.ids = [i for i, _ in items]
        words = [words_of(t) for _, t in items]
        self.vocabulary = {w: n for n, w in enumerate(sorted(set().union(*words)))} if words else {}
        self.items = [np.array([self.vocabulary[w] for w in own], np.int64) for own in words]
        self.least = [min(least, len(own)) for own in self.items]
        self.rolling = Rolling(0x9E3779B97F4A7C15)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # by length: sorted hashes, items, places
        for size in sorted(set(self.least) - {0}):
            hashes, owners, places = [], [], []
            for k, own in enumerate(self.items):
                if self.least[k] == size:
                    starts, found = _windows(own, np.ones(len(own), bool), size, self.rolling)
                    hashes.append(found)
                    owners.append(np.full(len(starts), k))
                    places.append(starts)
            every = np.concatenate(hashes)
            order = np.argsort(every, kind="stable")
            self.tables[size] = every[order], np.concatenate(owners)[order], np.concatenate(places)[order]

    def find(self, text: str) -> list[tuple[object, float, int, int, list[tuple[int, int, int]]]]:
        """(item id, coverage, covered words, words, tiles) of each item that the text covers."""
        if not self.tables:
            return []
        get = self.vocabulary.get
        ids = np.array([get(w, -1) for w in words_of(text)], np.int64)
        out = []
        for size, (table, owners, places) in self.tables.items():
            hashes = np.unique(_windows(ids, ids >= 0, size, self.rolling)[1])
            left, right = np.searchsorted(table, hashes, "left"), np.searchsorted(table, hashes, "right")
            count = right - left
            if not count.any():
                continue
            # The seeds that the text has: of each hash the range left:right.
            seeds = np.repeat(left - (np.cumsum(count) - count), count) + np.arange(count.sum())
            owner = owners[seeds]
            for k in np.unique(owner).tolist():
                item = self.items[k]
                under = np.zeros(len(item) + 1, np.int64)
                own = places[seeds[owner == k]]
                np.add.at(under, own, 1)
                np.add.at(under, own + size, -1)
                if np.count_nonzero(np.cumsum(under)[:-1] > 0) < self.coverage * len(item):
                    continue
                tiles = tile(ids, item, size, self.rolling)
                covered = sum(n for _, _, n in tiles)
                if covered >= self.coverage * len(item):
                    out.append((self.ids[k], covered / len(item), covered, len(item), tiles))
        return out


def blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[object, str]]]:
    """Lists of (item_id, text), each of about ``block_bytes`` of text at most."""
    items = items.select("item_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, ceil(total / block_bytes))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for k in range(n):
        yield [tuple(r) for r in items.where(part == k).orderBy("item_id", "text").collect()]


def contaminated(docs: DataFrame, items: DataFrame, least: int = LEAST, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, coverage, covered_words, item_words, n_tiles, tiles) of each document and item that it covers."""
    doc_kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    item_type = to_arrow_type(items.schema["item_id"].dataType)
    docs = docs.select("doc_id", "text")
    schema = f"doc_id {doc_kind}, item_id {item_kind}, coverage double, covered_words int, item_words int, n_tiles int, tiles string"
    sc, out = docs.sparkSession.sparkContext, None
    for block in blocks(items, block_bytes):
        seeds = sc.broadcast(Seeds(block, least, coverage))  # of a bounded block

        def each(batch: pa.RecordBatch, seeds=seeds) -> pa.RecordBatch:
            rows = [(i, f) for i, t in enumerate(utf8(batch.column(1))) for f in seeds.value.find(t.decode())]
            names = ["doc_id", "item_id", "coverage", "covered_words", "item_words", "n_tiles", "tiles"]
            cols = [
                batch.column(0).take(pa.array([i for i, _ in rows], pa.int64())),
                pa.array([f[0] for _, f in rows], item_type),
                pa.array([f[1] for _, f in rows], pa.float64()),
                pa.array([f[2] for _, f in rows], pa.int32()),
                pa.array([f[3] for _, f in rows], pa.int32()),
                pa.array([len(f[4]) for _, f in rows], pa.int32()),
                pa.array([",".join(":".join(map(str, t)) for t in f[4]) for _, f in rows], pa.string()),
            ]
            return pa.RecordBatch.from_arrays(cols, names)

        found = arrow_map(docs, each, schema)
        out = found if out is None else out.unionByName(found)
    return out


def decontaminated(docs: DataFrame, items: DataFrame, least: int = LEAST, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, all their columns, that cover no item."""
    sc, kept = docs.sparkSession.sparkContext, docs
    for block in blocks(items, block_bytes):
        seeds = sc.broadcast(Seeds(block, least, coverage))

        def each(batch: pa.RecordBatch, seeds=seeds) -> pa.RecordBatch:
            return batch.filter(pa.array([not seeds.value.find(t.decode()) for t in utf8(batch.column("text"))], pa.bool_()))

        kept = arrow_map(kept, each, docs.schema)
    return kept
