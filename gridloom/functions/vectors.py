"""Vectors (array<float>) and 64-bit hashes as column expressions; all arithmetic is in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Dot product; the cosine of unit vectors."""
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(_double(v), F.lit(0.0), lambda s, x: s + x * x))


def normalised(v: Column) -> Column:
    """v over its length, which is made once; a zero vector stays."""
    return F.transform(F.array(norm(v)), lambda n: F.when(n > 0, F.transform(_double(v), lambda x: x / n)).otherwise(_double(v)))[0]


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def sign_bits(v: Column) -> Column:
    """The signs of 64 values packed in a bigint: bit i is set where value i is above 0."""
    return F.aggregate(F.transform(v, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, b: s.bitwiseOR(b))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
