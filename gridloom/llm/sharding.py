"""Reproducible shuffle and sharding by a Feistel permutation of global row numbers.

Rows get a global number 0..n-1 in the order of (doc_id, CRC-32, size, 64-bit text hash), nulls first; a keyed Feistel
network over Z_a x Z_b (a * b >= n, a * b - n < a) permutes the numbers, and numbers that leave 0..n-1 walk their cycle
until they are back. From the permuted place p follow shard = p mod shards and slot = p div shards, so a row's place can
be computed from its number alone, and back (``place``, ``number_at``). All of it is built-in expressions.

Defined cases: a null text has size 16 and CRC-32 0, like an empty one; equal rows (also with null or repeated doc_id)
get different numbers, in an order that the output can't tell; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import near_square, numbered

ROUNDS = 4
#: Steps of a cycle walk. A walk from inside 0..n-1 meets each of the a*b-n < a outside values at most once, so 64 steps
#: suffice for n <= 4096; above, an outside value follows with chance under 1/64 at each step, 2**-384 for all of them. A walk
#: that is longer still raises an error.
WALK = 64


def _network(x: Column, key: int, a: int, b: int) -> Column:
    """One pass of the network over x = left * b + right; a fold, so that no round's text is repeated in the next."""
    right = F.pmod(x, F.lit(b).cast("long"))
    start = F.struct(((x - right) / b).cast("long").alias("l"), right.alias("r"))

    def step(s: Column, r: Column) -> Column:
        left = F.pmod(s["l"] + F.pmod(F.xxhash64(F.lit(key).cast("long") + r, s["r"]), F.lit(a).cast("long")), F.lit(a).cast("long"))
        right = F.pmod(s["r"] + F.pmod(F.xxhash64(F.lit(key).cast("long") + r + ROUNDS, left), F.lit(b).cast("long")), F.lit(b).cast("long"))
        return F.struct(left.alias("l"), right.alias("r"))

    rounds = F.array(*[F.lit(r).cast("long") for r in range(ROUNDS)])
    return F.aggregate(rounds, start, step, lambda s: s["l"] * b + s["r"])


def permuted(x: Column, n: int, key: int) -> Column:
    """The place 0..n-1 of the row number x."""
    a, b = near_square(n)
    once = _network(x, key, a, b)
    if a * b == n:
        return once
    step = lambda y, _: F.when(y < n, y).otherwise(_network(y, key, a, b))
    lost = F.raise_error(F.format_string("the walk from %d is longer than %d", x, F.lit(WALK))).cast("long")

    def walk(y: Column) -> Column:
        end = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), y, step)
        return F.transform(F.array(end), lambda z: F.when(z < n, z).otherwise(lost))[0]

    # Few numbers leave the range at all; only these walk.
    return F.transform(F.array(once), lambda y: F.when(y < n, y).otherwise(walk(y)))[0]


def _hash(*values: int) -> int:
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest((v % (1 << 64)).to_bytes(8, "little"), seed=seed)
    return seed - (1 << 64) if seed >> 63 else seed


def place(x: int, n: int, key: int) -> int:
    """``permuted`` on the driver, for one number."""
    a, b = near_square(n)
    while True:
        left, right = divmod(x, b)
        for r in range(ROUNDS):
            left = (left + _hash(key + r, right) % a) % a
            right = (right + _hash(key + r + ROUNDS, left) % b) % b
        x = left * b + right
        if x < n:
            return x


def number_at(p: int, n: int, key: int) -> int:
    """The row number whose place is p."""
    a, b = near_square(n)
    while True:
        left, right = divmod(p, b)
        for r in reversed(range(ROUNDS)):
            right = (right - _hash(key + r + ROUNDS, left) % b) % b
            left = (left - _hash(key + r, right) % a) % a
        p = left * b + right
        if p < n:
            return p


def feistel_shards(docs: DataFrame, shards: int = 40, key: int = 20240229, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns: the id, size, text_crc32, row_number, place, shard, slot; law ``rows``: counts are at most one apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col),
        (F.octet_length(text).cast("long") + F.lit(16).cast("long")).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("_text"),
    )
    rows = numbered(rows, [F.col(id_col).asc_nulls_first(), F.col("text_crc32"), F.col("size"), F.col("_text")], name="row_number")
    n = rows.count()
    placed = rows.drop("_text").withColumn("place", permuted(F.col("row_number"), max(n, 1), key))
    return placed.select(
        "*",
        F.lit("rows").alias("law"),
        F.pmod("place", F.lit(shards).cast("long")).cast("int").alias("shard"),
        F.expr(f"place div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
