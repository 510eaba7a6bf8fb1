"""Greedy dedup of 64-bit hashes: in order, a hash is out if one that was kept is near.

Equal hashes are one, so each class is a list of different hashes in order. Up to ``BLOCK`` of them are one piece of numpy work. Longer
lists are cut into blocks: the first block of each class is reduced, the blocks after it lose, in tasks of their own, what is near
to a hash that it keeps, and are packed anew; then it is the next block's turn. Hashes that were kept are all that later ones meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from gridloom.operators.cluster import _cut

#: Different hashes of a class that one task reduces, and large classes whose kept hashes are broadcast in a round.
BLOCK, BROADCAST = 1 << 16, 64


def far(hashes: np.ndarray, kept: np.ndarray, distance: int) -> np.ndarray:
    """Places of the hashes that differ from each of ``kept`` in more than ``distance`` bits."""
    out = []
    for a in range(0, len(hashes), 1024):
        left = np.arange(a, min(a + 1024, len(hashes)))
        for b in range(0, len(kept), 2048):
            bits = np.bitwise_count((hashes[left][:, None] ^ kept[b : b + 2048][None, :]).view(np.uint64))
            left = left[bits.min(1) > distance]
            if not len(left):
                break
        out.append(left)
    return np.concatenate(out) if out else np.empty(0, np.int64)


def greedy(hashes: np.ndarray, distance: int) -> np.ndarray:
    """The hashes that are kept, in order."""
    kept, n = np.empty_like(hashes), 0
    for a in range(0, len(hashes), 256):
        part = hashes[a : a + 256]
        part = part[far(part, kept[:n], distance)]
        near = np.bitwise_count((part[:, None] ^ part[None, :]).view(np.uint64)) <= distance
        alive = np.ones(len(part), bool)
        for i in range(len(part)):
            if alive[i]:
                alive[i + 1 :] &= ~near[i, i + 1 :]
        own = part[alive]
        kept[n : n + len(own)] = own
        n += len(own)
    return kept[:n]


def _array(column: pa.Array, i: int) -> np.ndarray:
    return np.asarray(column[i].values, np.int64)


def _changed(df: DataFrame, change, *drop: str) -> DataFrame:
    """df (with ``hashes``) without the columns of drop, and change(batch, row) for its hashes; rows that have none left go."""
    schema = StructType([f for f in df.schema.fields if f.name not in drop])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(whole.num_rows):
                new = change(whole, i)
                if len(new):
                    row = whole.slice(i, 1)
                    yield pa.RecordBatch.from_arrays([pa.array([new], pa.list_(pa.int64())) if c == "hashes" else row.column(c) for c in names], names)

    return df.mapInArrow(run, schema)


def _by_rounds(ranked: DataFrame, group: list[str], distance: int, block: int) -> DataFrame:
    """(group, _hash) of what is kept of ranked (group, _hash, _r)."""
    reduce = lambda batch, i: greedy(_array(batch.column("hashes"), i), distance)
    rest_of = lambda batch, i: (h := _array(batch.column("hashes"), i))[far(h, _array(batch.column("_kept"), i), distance)]
    own = F.sort_array(F.collect_list(F.struct("_r", "_hash")))
    cut = ranked.withColumn("_b", F.floor((F.col("_r") - 1) / block).cast("long"))
    blocks = _cut(cut.groupBy(*group, "_b").agg(own.alias("m")).select(*group, "_b", F.transform("m", lambda x: x["_hash"]).alias("hashes")))
    out = None
    while True:
        chosen = _cut(_changed(blocks.where("_b = 0"), reduce, "_b"))
        found = chosen.select(*group, F.explode("hashes").alias("_hash"))
        out = found if out is None else out.unionByName(found)
        rest = blocks.where("_b > 0")
        if not rest.take(1):
            return out
        kept = chosen.withColumnRenamed("hashes", "_kept")
        kept = F.broadcast(kept) if kept.count() <= BROADCAST else kept
        left = _cut(_changed(rest.join(kept, group), rest_of, "_kept"))
        before = F.coalesce(F.sum(F.size("hashes")).over(Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        # Windows see blocks' sizes only; blocks themselves are joined to their new numbers.
        numbers = left.select(*group, "_b", "hashes").withColumn("_new", F.floor(before / block).cast("long")).select(*group, "_b", "_new")
        packed = left.join(numbers, [*group, "_b"]).groupBy(*group, F.col("_new").alias("_b")).agg(F.sort_array(F.collect_list(F.struct(F.col("_b").alias("o"), "hashes"))).alias("m"))
        blocks = _cut(packed.select(*group, "_b", F.flatten(F.transform("m", lambda x: x["hashes"])).alias("hashes")))


def kept_hashes(ranked: DataFrame, group: list[str], distance: int, block: int = BLOCK) -> DataFrame:
    """(group, _hash) of those kept of ranked (group, _hash, _r): different hashes of each group with their numbers from 1 on."""
    ranked = ranked.select(*group, "_hash", "_r")
    if ranked.where(F.col("_r") > block).take(1):
        return _by_rounds(ranked, group, distance, block)
    schema = StructType([*(ranked.schema[g] for g in group), StructField("_hash", LongType())])

    def one(table: pa.Table) -> pa.Table:
        kept = greedy(np.asarray(table.sort_by("_r")["_hash"].combine_chunks(), np.int64), distance)
        return pa.table({**{g: table[g].combine_chunks().take(pa.array(np.zeros(len(kept), np.int64))) for g in group}, "_hash": kept})

    return ranked.groupBy(*group).applyInArrow(one, schema)
