"""Substring dedup by prefix-partitioned suffix trees.

Each window of ``window`` consecutive words that also starts earlier in the corpus is removed. A window's suffix is read from its
anchor, the run of ``gram`` words with the least hash in it: from the anchor to the window's end, an end mark, then the words before
the anchor backwards. Equal windows have equal suffixes and the other way round. Consecutive windows of a document with one
anchor make a span, which is one row for all its suffixes.

1. Candidates. Suffixes begin with the anchor's words, so the anchor is their first prefix. Spans are dealt and sorted by (anchor,
   document, place), where range partitions cut any group, and anchors that occur once are dropped: such a subtree has no internal
   node. Hashes serve only for this; a collision keeps a span too many.
2. Partial trees. Each task brings its candidates' words, and spans of equal words become one leaf with its first place; the others
   start later. So a passage that is everywhere is a row for each task (and ``HELD`` bytes), not for each copy.
3. Prefixes. Suffixes are counted by prefix. A prefix of more than ``crowd`` suffixes is lengthened, by windows now: ``gram``, then
   twice that, at last the whole suffix; the lengths that occur follow from the counts. Leaves that become equal are merged again.
4. Subtrees. Groups of prefixes are dealt to bins of ``bin_windows`` suffixes. Each is a subtree, held as sorted suffixes with the
   lengths of their common prefixes. Its internal nodes of full depth are the repeats; all but the first leaf of a node start earlier.

All repeats are decided in 2 and 4, on words. The runs that they cover are the maximal repeats (``removed_spans``).

Defined cases: null texts have no words; documents of fewer words than a window lose none; the earlier of two places is that
of the smaller doc_id (null counts as the largest), then of the smaller 64-bit row hash, then of the earlier start; rows repeated as
they are count as one document and have equal results; an empty table gives no rows; other columns are not read; doc_id must be
an integer column.
"""

from __future__ import annotations

import hashlib
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import Rolling, Words, arrow_map, saved, slices, utf8

WINDOW, GRAM = 20, 6
#: Suffixes of one prefix before it is lengthened (some 10 MB as a subtree), and suffixes in a bin of subtrees.
CROWD, BIN = 20_000, 8000
#: Bytes of leaves that a task holds to merge equal ones.
HELD = 16 << 20
#: Rows of a side that may be broadcast.
BROADCAST_ROWS = 200_000
_SEED, _BASE = 0x165667B1, 0xC2B2AE3D27D4EB4F
_PLAIN = bytes.maketrans(b"\t\n\v\f\r", b"     ")

# A place is a span's first window's start, its number of windows and the anchor's distance from that start.


def _place(start, count, anchor):
    return (start << 20) | (count << 10) | anchor


def spans(words: Words, rolling: Rolling, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of each span: the anchor's hash, its text, its first window's start in that text, its windows, and the anchor's distance."""
    n, empty = len(words.start), np.empty(0, np.int64)
    nothing = (empty.astype(np.uint64), empty, empty, empty, empty)
    if n < window:
        return nothing
    owner = words.text_of_word()
    starts = np.arange(n - window + 1)
    starts = starts[owner[starts] == owner[starts + window - 1]]
    if not len(starts):
        return nothing
    prefix = rolling.prefix(words.hashes[0])
    at = np.arange(n - gram + 1)
    grams = rolling.ranges(prefix, at, at + gram)
    choices = np.lib.stride_tricks.sliding_window_view(grams, window - gram + 1)
    anchor = np.empty(len(starts), np.int64)
    for a in range(0, len(starts), 1 << 18):
        s = starts[a : a + (1 << 18)]
        anchor[a : a + len(s)] = s + choices[s[0] : s[-1] + 1].argmin(1)[s - s[0]]
    # A span ends where the anchor changes; windows with one anchor can't belong to two texts.
    first = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)))
    low = starts[first]
    return grams[anchor[first]], owner[low], low - words.first[owner[low]], np.diff(np.append(first, len(starts))), anchor[first] - low


class Subtree:
    """The suffixes of spans' windows, sorted, with the number of symbols that each shares with the one before.

    texts are spans in the order of their places; anchors their anchors' distances.
    """

    def __init__(self, texts: list[bytes], anchors: np.ndarray, window: int):
        table: dict[bytes, int] = {}
        ids = [[table.setdefault(w, len(table) + 1) for w in t.split(b" ")] for t in texts]  # 0 is the end mark
        sizes = np.array([len(x) for x in ids], np.int64)
        flat = np.array([i for x in ids for i in x], np.int32)
        begin = np.cumsum(sizes) - sizes
        windows = sizes - window + 1
        self.depth = window + 1
        self.text = np.repeat(np.arange(len(ids)), windows)
        self.start = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        rows = np.zeros((len(self.text), self.depth), np.int32)
        rows[:, :window] = flat[(begin[self.text] + self.start)[:, None] + np.arange(window)]
        read = np.array([[*range(o, window), window, *range(o - 1, -1, -1)] for o in range(window)])
        rows = np.take_along_axis(rows, read[np.asarray(anchors)[self.text] - self.start], 1)
        self.order = np.lexsort(rows.T[::-1])  # stable: equal suffixes stay in the order of places
        rows = rows[self.order]
        self.lcp = np.append(0, np.cumprod(rows[1:] == rows[:-1], axis=1).sum(1)).astype(np.int64)[: len(rows)]

    def nodes(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the sorted suffixes below the internal nodes of that depth or more."""
        edge = np.diff(np.append(self.lcp >= depth, False).astype(np.int8))
        return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1

    def repeats(self) -> tuple[np.ndarray, np.ndarray]:
        """(leaf, first leaf of its node) of the leaves below full-depth nodes, but the first ones; leaves number windows in order."""
        low, high = self.nodes(self.depth)
        first = np.repeat(self.order[low], high - low - 1)
        later = np.concatenate([self.order[a + 1 : b] for a, b in zip(low.tolist(), high.tolist(), strict=True)]) if len(low) else self.order[:0]
        return later, first


def _ordered(docs: DataFrame) -> DataFrame:
    """(doc_id, doc, fp, text): the order of documents, and what tells rows apart."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    if kind not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError(f"doc_id must be an integer column and is {kind}")
    last = F.lit((1 << 63) - 1)
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), last).alias("doc"), F.xxhash64("doc_id", "text").alias("fp"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def _spanned(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """(anchor, doc, fp, place) of all spans."""
    rolling = Rolling(_BASE)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        anchor, text, start, count, away = spans(Words(utf8(batch.column("text")), _SEED), rolling, window, gram)
        index = pa.array(text)
        return pa.RecordBatch.from_arrays(
            [pa.array(anchor.view(np.int64)), batch.column("doc").take(index), batch.column("fp").take(index), pa.array(_place(start, count, away), pa.int64())],
            ["anchor", "doc", "fp", "place"],
        )

    return arrow_map(rows.select("doc", "fp", "text"), each, "anchor long, doc long, fp long, place long")


def _several(sorted_spans: DataFrame) -> DataFrame:
    """The rows whose anchor the row before or after has too, once each. A partition's first and last rows stay, as the
    anchor may go on in the next one."""
    names = ["anchor", "doc", "fp", "place"]

    def run(batches):
        held, joined, again = None, True, False  # the last row, whether the one before has its anchor, or is the same row
        for whole in batches:
            for batch in slices(whole):
                cols = [np.asarray(batch.column(c)) for c in names]
                if held is not None:
                    cols = [np.append(h, c) for h, c in zip(held, cols, strict=True)]
                same = cols[0][1:] == cols[0][:-1]
                row = same.copy()
                for c in cols[1:]:
                    row &= c[1:] == c[:-1]
                before, repeated = np.append(joined, same), np.append(again, row)
                keep = np.flatnonzero((before[:-1] | same) & ~repeated[:-1])
                if len(keep):
                    yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in cols], names)
                held, joined, again = [c[-1:] for c in cols], before[-1], repeated[-1]
        if held is not None and not again:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], names)

    return sorted_spans.mapInArrow(run, "anchor long, doc long, fp long, place long")


_LEAF = "key long, doc long, fp long, place long, words binary"


class _Leaves:
    """Leaves of a task's partial trees: of those with equal words and anchor the first place stays, others are later."""

    def __init__(self):
        self.first: dict[tuple[bytes, int], tuple[int, int, int, int]] = {}  # -> doc, fp, place, key
        self.later: list[tuple[int, int, int]] = []
        self.bytes = 0

    def add(self, words: bytes, doc: int, fp: int, place: int, key: int) -> None:
        name, own = (words, place & 1023), (doc, fp, place, key)
        known = self.first.get(name)
        if known is None:
            self.first[name] = own
            self.bytes += len(words) + 300
        elif known[:3] != own[:3]:
            self.first[name] = min(known, own)
            self.later.append(max(known, own)[:3])

    def full(self) -> bool:
        return self.bytes + 100 * len(self.later) > HELD

    def flush(self) -> pa.RecordBatch:
        own, n = [*self.first.values(), *((*x, None) for x in self.later)], len(self.later)
        cols = [pa.array([x[i] for x in own], pa.int64()) for i in (3, 0, 1, 2)]
        words = pa.array([w for w, _ in self.first] + [None] * n, pa.binary())
        self.__init__()
        return pa.RecordBatch.from_arrays([*cols, words], ["key", "doc", "fp", "place", "words"])


def _span_leaves(rows: DataFrame, window: int) -> DataFrame:
    """Leaves (key, doc, fp, place, words) of the spans listed with each text; words are null for those that start later."""

    def run(batches):
        leaves = _Leaves()
        for whole in batches:
            for batch in slices(whole):
                words = Words(utf8(batch.column("text")))
                sizes = np.append(0, np.cumsum(words.end - words.start))
                plain = words.data.translate(_PLAIN)
                for i, (doc, fp, own) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc", "fp", "spans")), strict=True)):
                    for s in own:
                        place = s["place"]
                        a = words.first[i] + (place >> 20)
                        b = a + (place >> 10 & 1023) + window - 1
                        low, high = words.start[a], words.end[b - 1]
                        text = plain[low:high]
                        if high - low != sizes[b] - sizes[a] + b - a - 1:  # some gap is longer than a blank
                            text = b" ".join(text.split())
                        leaves.add(text, doc, fp, place, s["anchor"])
                    if leaves.full():
                        yield leaves.flush()
        yield leaves.flush()

    return rows.select("doc", "fp", "text", "spans").mapInArrow(run, _LEAF)


def _longer(rows: DataFrame, window: int, length: int) -> DataFrame:
    """The leaves' windows, each by the first ``length`` symbols of its suffix."""

    def run(batches):
        leaves = _Leaves()
        for whole in batches:
            for batch in slices(whole):
                for doc, fp, place, words in zip(*(batch.column(c).to_pylist() for c in ("doc", "fp", "place", "words")), strict=True):
                    own, start, away = words.split(b" "), place >> 20, place & 1023
                    for i in range(len(own) - window + 1):
                        w, o = own[i : i + window], away - i
                        suffix = [*w[o:], b"", *w[:o][::-1]]
                        key = hashlib.blake2b(b" ".join(suffix[:length]), digest_size=8).digest()
                        leaves.add(b" ".join(w), doc, fp, _place(start + i, 1, o), int.from_bytes(key, "little", signed=True))
                    if leaves.full():
                        yield leaves.flush()
        yield leaves.flush()

    return rows.select("doc", "fp", "place", "words").mapInArrow(run, _LEAF)


def _bin(table: pa.Table, window: int) -> pa.Table:
    """One bin's subtrees: the places of windows that start earlier."""
    doc, fp, place = (np.asarray(table[c].combine_chunks()) for c in ("doc", "fp", "place"))
    order = np.lexsort((place, fp, doc))
    texts = table["words"].to_pylist()
    tree = Subtree([texts[i] for i in order], place[order] & 1023, window)
    row = order[tree.text]
    doc, fp, start = doc[row], fp[row], (place[row] >> 20) + tree.start
    later, first = tree.repeats()
    apart = (doc[later] != doc[first]) | (fp[later] != fp[first]) | (start[later] != start[first])  # else a row sent twice
    later = later[apart]
    return pa.table({"doc": doc[later], "fp": fp[later], "place": _place(start[later], 1, 0)})


def _kept(rows: DataFrame, window: int) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, removed_spans of texts with the places to remove."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "removed_spans"]

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(utf8(batch.column("text")))
        total, removed, digest, runs = [], [], [], []
        for i, (a, b) in enumerate(zip(words.first.tolist(), words.last.tolist(), strict=True)):
            begin, end, spans_of = words.start[a:b], words.end[a:b], ""
            if own := batch.column("places")[i].as_py():
                places = np.array(own, np.int64)
                cover = np.zeros(b - a + 1, np.int64)
                np.add.at(cover, places >> 20, 1)
                np.add.at(cover, (places >> 20) + (places >> 10 & 1023) + window - 1, -1)
                gone = np.cumsum(cover) > 0  # the last is False
                edge = np.diff(np.append(False, gone).astype(np.int8))
                spans_of = ",".join(f"{x}-{y}" for x, y in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))
                begin, end = begin[~gone[:-1]], end[~gone[:-1]]
            total.append(b - a)
            removed.append(b - a - len(begin))
            digest.append(hashlib.sha256(b" ".join([words.data[x:y] for x, y in zip(begin.tolist(), end.tolist(), strict=True)])).hexdigest())
            runs.append(spans_of)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(runs, pa.string())], names)

    return arrow_map(rows.select("doc_id", "text", "places"), each, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, removed_spans string")


def _few(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it was counted to be small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, crowd: int = CROWD, bin_windows: int = BIN) -> tuple[DataFrame, DataFrame]:
    """(rows, found): the rows as (doc_id, doc, fp, text), and by (doc, fp) the places of windows that start earlier."""
    if not 0 < gram <= window <= 1000:
        raise ValueError("0 < gram <= window <= 1000 must hold")
    rows = _ordered(docs)
    keys = ["anchor", "doc", "fp", "place"]
    dealt = _spanned(rows, window, gram).repartitionByRange(*keys).sortWithinPartitions(*keys)
    candidates = _several(dealt).groupBy("doc", "fp").agg(F.collect_list(F.struct("place", "anchor")).alias("spans"))
    # Leaves are all that later steps read of this: the exchanges of spans, candidates and texts go before the next ones come.
    leaves = saved(_span_leaves(rows.join(candidates, ["doc", "fp"]), window), clean=True)
    later, pending, trees, length = [leaves.where("words IS NULL")], leaves.where("words IS NOT NULL"), [], gram
    number = F.sum(F.shiftright("place", 10).bitwiseAND(F.lit(1023)))
    while True:
        crowded = saved(pending.groupBy("key").agg(number.alias("n")).where(F.col("n") > crowd).select("key"), clean=True)
        if length > window or not crowded.take(1):
            trees.append(pending)
            break
        heavy = _few(crowded)
        trees.append(pending.join(heavy, "key", "left_anti"))
        length = window + 1 if 2 * length > window else 2 * length
        # Equal leaves of different tasks meet before they are cut into windows.
        longer = saved(_longer(pending.join(heavy, "key", "left_semi").repartition(F.xxhash64("words")), window, length), clean=True)
        later.append(longer.where("words IS NULL"))
        pending = longer.where("words IS NOT NULL")
    grouped = trees[0]
    for t in trees[1:]:
        grouped = grouped.unionByName(t)
    bins = max(1, ceil((grouped.agg(number).first()[0] or 0) / bin_windows))
    dealt = grouped.select(F.pmod(F.xxhash64("key"), F.lit(bins)).alias("bin"), "doc", "fp", "place", "words")
    found = dealt.groupBy("bin").applyInArrow(lambda t: _bin(t, window), "doc long, fp long, place long")
    for x in later:
        found = found.unionByName(x.select("doc", "fp", "place"))
    return rows, found.groupBy("doc", "fp").agg(F.collect_list("place").alias("places"))


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and removed_spans (word ranges, the end excluded) of each document."""
    rows, found = repeats(docs.select("doc_id", "text"), **options)
    return _kept(rows.join(found, ["doc", "fp"], "left"), options.get("window", WINDOW))
