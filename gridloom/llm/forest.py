"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

A document's set is that of its runs of five words (``[^\\x20\\x09-\\x0D]+``, unchanged; fewer words make one run). Rows with
equal sets (by 128-bit hashes) are copies and collapse into one class first.

Forest. Each class has a label in each of ``TREES`` prefix tries: ``DEEPEST`` minima of as many hash functions, a byte of each, so
that labels sort as the trie does and labels that begin alike share a node. Labels are dealt and sorted by (tree, label), and
one pass over the sorted labels links each class to the head of the longest run of a common prefix it is in. Links of at least
``d`` common values therefore connect exactly the classes that share a prefix of ``d`` in some tree, for every ``d``, from one sort.

Adaptive prefix. Candidates begin at the full depth: classes linked there are joined into components, and inside these every
pair that sizes allow is verified exactly. A link of similarity s shares a prefix of d in some tree with chance
p(s, d) = 1 - (1 - s^d)^TREES, so links that were found tell how many were not: found / sum(1 / p) is the recall. While it is below the
target, the prefix is shortened, to the longest depth at which these links promise the target, and at most to the depth
that meets it for pairs right at the threshold (``depth``). Only components that a shorter prefix joins are verified anew.

Verification. Nothing emits pairs of a group. A component's classes are dealt to cells of a bounded number of set elements: a small
component is one cell; a large one is cut into chunks by set size and hash, and a cell holds two chunks, of equal or neighbouring
size bands (a Jaccard similarity of t needs sizes within a factor of t). A cell gets texts, numbers their words and runs, and
counts links with matrix products, so what it finds rests on words and not on hashes. It returns one row for each member: its
number of links there and the least member it is connected to.

Result: one row per document with ``class_id`` (the least doc_id of all documents connected to it by links or copies),
``copy_id`` (the least doc_id with the same set), ``n_links`` (other sets of similarity >= threshold) and ``n_copies``.

Defined cases: null and empty texts have the empty set: they are copies of each other and link to nothing else; null
doc_ids are kept, and sort last as a class' least id; repeated rows are copies; ties in doc_id are told apart by a
64-bit hash of the row; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import Rolling, Rounds, Words, arrow_map, give_back, saved, slices, utf8

SHINGLE, THRESHOLD = 5, 0.8
TREES, DEEPEST, RECALL = 32, 8, 0.9999
#: Set elements in a cell's chunk, about; a class counts as EACH more, as links of all pairs in a cell are held at once.
CELL, EACH = 600_000, 250
#: Rows of a side that may be broadcast (of 8 to 60 bytes each); beyond, the join shuffles.
BROADCAST_ROWS = 300_000
#: Row keys that a task remembers, so that rows repeated as they are go out once.
REMEMBERED = 100_000
_SEEDS, _BASES = (0x9E3779B9, 0x85EBCA6B), (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def chance(similarity: float, d: int, trees: int = TREES) -> float:
    """That a pair shares a prefix of d in some tree."""
    return 1 - (1 - similarity**d) ** trees


def depth(threshold: float = THRESHOLD, trees: int = TREES, deepest: int = DEEPEST, recall: float = RECALL) -> int:
    """The longest prefix at which a pair of that similarity shares a prefix in some tree with the target recall."""
    return next((d for d in range(deepest, 1, -1) if chance(threshold, d, trees) >= recall), 1)


def shingle_sets(texts: list[bytes], shingle: int, rolling: tuple[Rolling, Rolling]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's distinct shingles as 128-bit hashes, sorted: their first and their second halves."""
    words = Words(texts, *_SEEDS)
    prefix = [r.prefix(h) for r, h in zip(rolling, words.hashes, strict=True)]
    out = []
    for a, b in zip(words.first.tolist(), words.last.tolist(), strict=True):
        starts = np.arange(a, max(a + 1, b - shingle + 1)) if a < b else np.empty(0, np.int64)
        one, two = (r.ranges(p, starts, np.minimum(starts + shingle, b)) for r, p in zip(rolling, prefix, strict=True))
        order = np.lexsort((two, one))
        one, two = one[order], two[order]
        new = np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]))[: len(one)]
        out.append((one[new], two[new]))
    return out


def rollings() -> tuple[Rolling, Rolling]:
    return Rolling(_BASES[0]), Rolling(_BASES[1])


def set_key(shingles: tuple[np.ndarray, np.ndarray]) -> bytes:
    """128 bits for a set."""
    digest = hashlib.blake2b(shingles[0].tobytes(), digest_size=16)
    digest.update(shingles[1].tobytes())
    return digest.digest()


def exact_sets(texts: list[bytes], shingle: int) -> list[np.ndarray]:
    """Each text's distinct shingles as numbers, equal for equal words and only for them."""
    table: dict[bytes, int] = {}
    flat = [np.array([table.setdefault(w, len(table) + 1) for w in t.split()], np.int64) for t in texts]
    runs = [max(1, len(x) - shingle + 1) if len(x) else 0 for x in flat]
    # Shorter texts are one run, filled up with zeros.
    padded = np.concatenate([np.append(x, np.zeros(max(0, shingle - len(x)), np.int64)) if len(x) else x for x in flat]) if texts else np.empty(0, np.int64)
    sizes = np.array([r + shingle - 1 if r else 0 for r in runs], np.int64)
    begin, count = np.cumsum(sizes) - sizes, np.array(runs, np.int64)
    at = np.repeat(begin, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    base = len(table) + 1
    code, span = np.zeros(len(at), np.int64), 1
    for k in range(shingle):
        if span * base >= 1 << 62:  # numbers anew before they overflow
            code = np.unique(code, return_inverse=True)[1].astype(np.int64)
            span = len(at)
        code, span = code * base + padded[at + k], span * base
    ends = np.cumsum(count)
    return [np.unique(code[e - n : e]) for e, n in zip(ends.tolist(), runs, strict=True)]


class Signer:
    """Labels of the forest: for each tree a byte of each of its minima, the first one on top."""

    def __init__(self, trees: int, deepest: int = DEEPEST, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.trees, self.deepest = trees, deepest
        self.a = rng.integers(1, 1 << 32, trees * deepest, dtype=np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, trees * deepest, dtype=np.uint32)

    def labels(self, shingles: np.ndarray) -> np.ndarray:
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.a), np.iinfo(np.uint32).max, np.uint32)
        for at in range(0, len(x), 256):
            np.minimum(least, (x[at : at + 256, None] * self.a + self.b).min(0), out=least)
        spread = least * np.uint32(0x85EBCA6B)
        spread ^= spread >> np.uint32(15)
        byte = ((spread * np.uint32(0xC2B2AE35)) >> np.uint32(24)).reshape(self.trees, self.deepest)
        label = np.zeros(self.trees, np.uint64)
        for d in range(self.deepest):
            label |= byte[:, d].astype(np.uint64) << np.uint64(56 - 8 * d)
        return label.view(np.int64)


def common_values(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """How many values two labels share from the top, 0 to 8."""
    return 8 - np.searchsorted(np.uint64(1) << np.arange(0, 64, 8, dtype=np.uint64), one.view(np.uint64) ^ two.view(np.uint64), "right")


def fingerprint(docs: DataFrame) -> Column:
    """Tells rows apart, however often a doc_id is there."""
    return F.xxhash64(docs["doc_id"], docs["text"])


def signed(docs: DataFrame, shingle: int = SHINGLE, trees: int = TREES) -> DataFrame:
    """(doc_id, fp, key, n, labels) of each row: its set's key and size, and the forest's labels (none for the empty set)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    signer, rolling = Signer(trees), rollings()

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(utf8(batch.column("text")), shingle, rolling)
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("fp"),
                pa.array([set_key(s) for s in sets], pa.binary()),
                pa.array([len(s[0]) for s in sets], pa.int64()),
                pa.array([signer.labels(s[0]) if len(s[0]) else [] for s in sets], pa.list_(pa.int64())),
            ],
            ["doc_id", "fp", "key", "n", "labels"],
        )

    return arrow_map(docs.select("doc_id", fingerprint(docs).alias("fp"), "text"), each, f"doc_id {kind}, fp long, key binary, n long, labels array<long>")


def forest_links(labels: DataFrame, shortest: int) -> DataFrame:
    """(a, b, level) from (key, tree, label), repeated ones too: links of classes whose labels in some tree share ``level`` values,
    ``shortest`` at least. Those of level >= d connect the classes that share a prefix of d, for each d from ``shortest``."""
    keys = ["tree", "label", "key"]
    dealt = labels.repartitionByRange(*keys).sortWithinPartitions(*keys)

    def run(batches):
        heads: list[bytes] = []  # of the open runs, by depth from ``shortest``
        last = None  # (tree, label, key) of the row before
        for whole in batches:
            for batch in slices(whole):
                tree, label = np.asarray(batch.column("tree")), np.asarray(batch.column("label"))
                key, n = np.array(batch.column("key").to_pylist(), object), batch.num_rows
                level = np.zeros(n, np.int64)
                level[1:] = np.where(tree[1:] == tree[:-1], common_values(label[1:], label[:-1]), 0)
                if last is None:
                    heads = [key[0]] * (9 - shortest)
                    yield _border([tree[0]], [label[0]], [key[0]])
                elif last[0] == tree[0]:
                    level[0] = common_values(label[:1], np.array([last[1]]))[0]
                head_of = []
                for d in range(shortest, 9):
                    at = np.maximum.accumulate(np.where(level < d, np.arange(n), -1))
                    own = key[at]
                    own[at < 0] = heads[d - shortest]
                    head_of.append(own)
                a = [own[level == d] for d, own in zip(range(shortest, 9), head_of, strict=True)]
                b = [key[level == d] for d in range(shortest, 9)]
                sizes = [len(x) for x in b]
                if sum(sizes):
                    one, two = np.concatenate(a).tolist(), np.concatenate(b).tolist()
                    yield pa.RecordBatch.from_arrays([pa.array(one, pa.binary()), pa.array(two, pa.binary()), pa.array(np.repeat(np.arange(shortest, 9), sizes), pa.int32()), pa.nulls(len(one), pa.int32()), pa.nulls(len(one), pa.int64())], _LINK)
                heads = [own[-1] for own in head_of]
                last = (tree[-1], label[-1], key[-1])
        if last is not None:
            yield _border([last[0]], [last[1]], [last[2]])
        give_back()

    out = saved(dealt.mapInArrow(run, "a binary, b binary, level int, tree int, label long"))
    # Partitions' first and last rows, two for each partition whatever the input is: neighbours among them are linked.
    order = Window.partitionBy(F.lit(0)).orderBy("tree", "label", "a")
    ends = out.where("b IS NULL").select("tree", "label", "a", *[F.lag(c).over(order).alias(f"_{c}") for c in ("tree", "label", "a")])
    same = F.length(F.regexp_extract(F.lpad(F.hex(F.col("label").bitwiseXOR(F.col("_label"))), 16, "0"), "^(00)*", 0)) / 2
    ends = ends.where((F.col("tree") == F.col("_tree")) & (F.col("a") != F.col("_a"))).select(F.col("_a").alias("a"), F.col("a").alias("b"), same.cast("int").alias("level")).where(F.col("level") >= shortest)
    return out.where("b IS NOT NULL").select("a", "b", "level").unionByName(ends)


_LINK = ["a", "b", "level", "tree", "label"]


def _border(tree: list, label: list, key: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int32()), pa.array(tree, pa.int32()), pa.array(label, pa.int64())], _LINK)


#: Rounds after which components that still change are an error; each at least halves paths.
MOST_ROUNDS = 200


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the connected components of edges (a, b); root is the least node. Large-star and small-star in turn, each a
    grouped minimum and a join, until all edges are stars.

    The minima are written before they are joined: then both sides of a join are plain exchanges, and adaptive execution
    splits the rows of a node with many edges (a hub) over tasks.
    """
    spark = edges.sparkSession
    ends, stars, least = Rounds(spark), Rounds(spark), Rounds(spark)
    edges = ends.next(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(MOST_ROUNDS):
        # Done when all edges are stars: each upper end has one edge, and no lower end is an upper one.
        ends_of = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))).alias("e")).select("e.*")
        nodes = ends_of.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
        if not nodes.agg(F.max((F.col("ups") > 1) | ((F.col("ups") > 0) & (F.col("least") == 0)))).first()[0]:
            for done in (stars, least):
                done.drop()
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        minima = least.next(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("b"), F.least("a", "m").alias("m")))
        large = stars.next(edges.join(minima, "b").select("a", F.col("m").alias("b")).distinct())
        minima = least.next(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(minima, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = ends.next(small.where("a <> b").distinct())
    raise RuntimeError(f"components have not settled in {MOST_ROUNDS} rounds")


def _verify(sets: list[np.ndarray], side: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of each set, the index of the least one it is connected to, and the links' similarities in thousandths, counted.
    side: 0 all pairs, 1 and 2 pairs across."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.float64)
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(n), sizes.astype(np.int64))
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    row, column = row[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((n, n), np.float32)
    width = max(64, (4 << 20) // max(n, 1))
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        low, high = np.searchsorted(column, [at, at + width])
        part = np.zeros((n, int(column[high - 1]) - at + 1), np.float32)
        part[row[low:high], column[low:high] - at] = 1
        common += part @ part.T
    links = common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-6
    np.fill_diagonal(links, False)
    if side.any():
        links &= side[:, None] != side[None, :]
    seen = np.zeros(1001, np.int64)
    for at in range(0, n, 256):
        i, j = np.nonzero(links[at : at + 256])
        shared = common[at + i, j]
        seen += np.bincount((1000 * shared / (sizes[at + i] + sizes[j] - shared) + 1e-6).astype(np.int64), minlength=1001)[:1001]
    root = np.arange(n)
    while True:  # the least index spreads along links
        new = np.concatenate([np.minimum(root[a : a + 256], np.where(links[a : a + 256], root[None, :], n).min(1)) for a in range(0, n, 256)])
        new = np.minimum(new, new[new])
        if (new == root).all():
            return links.sum(1), root, seen
        root = new


_CELL = "key binary, links long, root binary, multi boolean, seen array<long>"


def _cell(table: pa.Table, threshold: float, shingle: int) -> pa.Table:
    """One cell: its components one after the other. ``seen`` is in the first row."""
    comp, keys = table["comp"].to_pylist(), table["key"].to_pylist()
    order = sorted(range(table.num_rows), key=lambda i: (comp[i], keys[i]))
    text, side, multi = table["text"].to_pylist(), table["side"].to_pylist(), table["multi"].to_pylist()
    out_key, out_links, out_root, out_multi, total = [], [], [], [], np.zeros(1001, np.int64)
    at = 0
    while at < len(order):
        end = at
        while end < len(order) and comp[order[end]] == comp[order[at]]:
            end += 1
        own = [i for k, i in enumerate(order[at:end]) if not k or keys[i] != keys[order[at + k - 1]]]
        links, root, seen = _verify(exact_sets([text[i] for i in own], shingle), np.array([side[i] for i in own]), threshold)
        out_key += [keys[i] for i in own]
        out_links += links.tolist()
        out_root += [keys[own[r]] for r in root]
        out_multi += [multi[i] for i in own]
        total += seen
        at = end
    give_back()
    first = [total.tolist()] + [None] * (len(out_key) - 1)
    cols = [pa.array(out_key, pa.binary()), pa.array(out_links, pa.int64()), pa.array(out_root, pa.binary()), pa.array(out_multi, pa.bool_()), pa.array(first, pa.list_(pa.int64()))]
    return pa.table(cols, ["key", "links", "root", "multi", "seen"])


def _cells(candidates: DataFrame, threshold: float, cell: int) -> DataFrame:
    """candidates (key, fp, comp, n) with the array of cells (name, side) of each, and whether its component has several."""
    weight = F.sum(F.col("n") + EACH)
    total = candidates.agg(weight).first()[0] or 0
    bins = max(1, ceil(total / cell))
    sizes = candidates.groupBy("comp").agg(weight.alias("total"))
    small = F.array(F.struct(F.concat(F.lit("s"), F.pmod(F.xxhash64("comp"), F.lit(bins)).cast("string")).alias("cell"), F.lit(0).alias("side")))
    rows = candidates.join(sizes, "comp")
    one = rows.where(F.col("total") <= cell).select("key", "fp", "comp", "n", small.alias("cells"), F.lit(False).alias("multi"))
    step = log(1 / threshold)
    large = rows.where(F.col("total") > cell).withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.lit(step)))
    # Chunks of a band: as many as its elements ask for.
    bands = large.groupBy("comp", "band").agg(F.ceil(weight / F.lit(cell)).alias("m"))
    above = bands.select("comp", (F.col("band") - 1).alias("band"), F.col("m").alias("up"))
    below = bands.select("comp", (F.col("band") + 1).alias("band"), F.col("m").alias("down"))
    bands = bands.join(above, ["comp", "band"], "left").join(below, ["comp", "band"], "left").na.fill(0)
    large = large.join(bands, ["comp", "band"]).withColumn("i", F.pmod(F.xxhash64("key"), F.col("m")))
    name = lambda b, i, j, kind: F.concat_ws(":", F.hex("comp"), b.cast("string"), i.cast("string"), j.cast("string"), F.lit(kind))
    upto = lambda m: F.sequence(F.lit(0).cast("long"), F.col(m) - 1)
    empty = F.array().cast("array<struct<cell:string,side:int>>")
    same = F.transform(upto("m"), lambda j: F.struct(name(F.col("band"), F.least("i", j), F.greatest("i", j), "same").alias("cell"), F.when(j == F.col("i"), 0).when(F.col("i") < j, 1).otherwise(2).alias("side")))
    up = F.when(F.col("up") > 0, F.transform(upto("up"), lambda j: F.struct(name(F.col("band"), F.col("i"), j, "next").alias("cell"), F.lit(1).alias("side")))).otherwise(empty)
    down = F.when(F.col("down") > 0, F.transform(upto("down"), lambda j: F.struct(name(F.col("band") - 1, j, F.col("i"), "next").alias("cell"), F.lit(2).alias("side")))).otherwise(empty)
    return one.union(large.select("key", "fp", "comp", "n", F.concat(same, up, down).alias("cells"), F.lit(True).alias("multi")))


def _few(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it was counted to be small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def recalls(verified: DataFrame, now: int, shortest: int, trees: int) -> dict[int, float] | None:
    """What links found at a prefix of ``now`` say of the recall at each depth from ``now`` to ``shortest``; None without links."""
    counted = verified.where("seen IS NOT NULL").select(F.posexplode("seen").alias("s", "c")).where("c > 0").groupBy("s").agg(F.sum("c")).collect()  # 1001 rows at most
    if not counted:
        return None
    real = {s: c / chance(s / 1000, now, trees) for s, c in counted}  # links there are, found or not
    return {d: sum(c * chance(s / 1000, d, trees) for s, c in real.items()) / sum(real.values()) for d in range(now, shortest - 1, -1)}


def linked(docs: DataFrame, classes: DataFrame, shingle: int, threshold: float, trees: int, recall: float, cell: int) -> tuple[DataFrame, int]:
    """The verified cells' rows, and the prefix at which the recall is reached. classes: key, n, rep, labels."""
    shortest = depth(threshold, trees, recall=recall)
    links = forest_links(classes.select("key", F.posexplode("labels").alias("tree", "label")), shortest)
    sizes = classes.select("key", "n", F.col("rep.fp").alias("fp"))

    def checked(found: DataFrame) -> DataFrame:
        """The cells of components (key, comp), verified."""
        # Saved first, so that large components are counted by partial sums and their joins can be split.
        return saved(_verified(docs, saved(_cells(saved(found.join(sizes, "key")), threshold, cell)), shingle, threshold))

    found = saved(components(links.where(F.col("level") >= DEEPEST).select("a", "b"))).withColumnsRenamed({"node": "key", "root": "comp"})
    verified = checked(found)
    said = recalls(verified, DEEPEST, shortest, trees)
    # Without links nothing is known of the recall but for pairs at the threshold.
    then = shortest if said is None else next((d for d, r in said.items() if r >= recall), shortest)
    if then == DEEPEST:
        return verified, then
    # What the shorter prefix adds: components that are linked now, and classes that were in none.
    a, b = (found.select(F.col("key").alias(c), F.col("comp").alias(f"_{c}")) for c in "ab")
    more = links.where(F.col("level").between(then, DEEPEST - 1)).select("a", "b").distinct().join(a, "a", "left").join(b, "b", "left")
    more = saved(more.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")).where("a <> b").distinct())
    if not more.take(1):
        return verified, then
    merged = saved(components(more))
    alone = merged.select(F.col("node").alias("key"), F.col("node").alias("comp")).join(found, "key", "left_anti")
    changed = saved(found.union(alone).join(merged.select(F.col("node").alias("comp"), F.col("root").alias("_to")), "comp").select("key", F.col("_to").alias("comp")))
    return verified.join(changed.select("key"), "key", "left_anti").unionByName(checked(changed)), then


def groups(docs: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL, cell: int = CELL) -> tuple[DataFrame, DataFrame]:
    """The rows' (doc_id, fp, key), and by key the (key, copy_id, n_copies, n_links, class_id, class_fp) of its documents."""
    docs = docs.select("doc_id", "text")
    rows = saved(signed(docs, shingle, trees))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id"), F.col("fp")))
    classes = saved(rows.groupBy("key").agg(least.alias("rep"), F.count(F.lit(1)).alias("n_copies"), F.first("n").alias("n"), F.first("labels").alias("labels")))
    verified, _ = linked(docs, classes, shingle, threshold, trees, recall, cell)
    links = verified.groupBy("key").agg(F.sum("links").alias("n_links"))
    # Components of one cell are done; others' parts are joined.
    single = verified.where(~F.col("multi")).select(F.col("key").alias("node"), "root")
    parts = verified.where(F.col("multi"))
    roots = single.union(components(parts.select(F.col("root").alias("a"), F.col("key").alias("b")))) if parts.take(1) else single
    rooted = classes.join(links, "key", "left").join(roots.withColumnRenamed("node", "key"), "key", "left")
    rooted = rooted.select("key", "rep", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "key").alias("root"))
    first = rooted.groupBy("root").agg(F.min("rep").alias("first"))
    classed = rooted.join(first, "root").select("key", F.col("rep.doc_id").alias("copy_id"), "n_copies", "n_links", F.col("first.doc_id").alias("class_id"), F.col("first.fp").alias("class_fp"))
    return rows.select("doc_id", "fp", "key"), classed


def _verified(docs: DataFrame, candidates: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """(key, links, root, multi, seen) of each candidate and cell."""
    rolling = rollings()
    texts = docs.select("text", fingerprint(docs).alias("fp"))
    joined = texts.join(_few(candidates.select("fp", "key", "comp", "cells", "multi")), "fp")

    def run(batches):
        seen: set[bytes] = set()
        for whole in batches:
            for batch in slices(whole):
                keys = batch.column("key").to_pylist()
                fresh = [i for i, k in enumerate(keys) if k not in seen and not seen.add(k)]
                if len(seen) > REMEMBERED:
                    seen.clear()
                if not fresh:
                    continue
                part = batch.take(pa.array(fresh))
                sets = shingle_sets(utf8(part.column("text")), shingle, rolling)
                cells = part.column("cells").to_pylist()
                keep = [set_key(s) == k for s, k in zip(sets, part.column("key").to_pylist(), strict=True)]
                take = [(i, c) for i, own in enumerate(cells) if keep[i] for c in own]
                if not take:
                    continue
                index = pa.array([i for i, _ in take], pa.int64())
                part = part.take(index)
                for at in range(0, len(take), 64):  # a text may go to many cells
                    some = part.slice(at, 64)
                    own = [c for _, c in take[at : at + 64]]
                    cols = [pa.array([c["cell"] for c in own], pa.string()), pa.array([c["side"] for c in own], pa.int32()), *(some.column(n) for n in ("comp", "key", "multi")), some.column("text").cast(pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, ["cell", "side", "comp", "key", "multi", "text"])
        give_back()

    sent = joined.select("text", "key", "comp", "cells", "multi").mapInArrow(run, "cell string, side int, comp binary, key binary, multi boolean, text binary")
    return sent.groupBy("cell").applyInArrow(lambda t: _cell(t, threshold, shingle), _CELL)


def jaccard_classes(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, class_id, copy_id, n_copies, n_links."""
    rows, classed = groups(docs, **options)
    return rows.join(classed, "key").select("doc_id", "class_id", "copy_id", "n_copies", "n_links")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, all their columns, without those of a group but its first (least doc_id, then row hash)."""
    rows, classed = groups(docs, **options)
    gone = saved(rows.join(classed, "key").where(F.col("fp") != F.col("class_fp")).select("fp").distinct())
    again = saved(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("fp"))
    fp = "_" * (1 + max(map(len, docs.columns)))  # a name that no column has
    own = docs.withColumn(fp, fingerprint(docs))
    kept = own.join(_few(gone.withColumnRenamed("fp", fp)), fp, "left_anti")
    if again.take(1):  # rows that are repeated as they are
        some = _few(again.withColumnRenamed("fp", fp))
        kept = kept.join(some, fp, "left_anti").select(*own.columns).union(kept.join(some, fp, "left_semi").select(*own.columns).dropDuplicates([fp]))
    return kept.select(*docs.columns)
