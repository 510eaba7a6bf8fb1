"""Image folders: listing, sizes from headers alone, and perceptual hashes."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.text import stem
from gridloom.sources.labels import SUFFIXES


def scan(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = SUFFIXES, content: bool = False) -> DataFrame:
    """(path, stem, ext) of the images in a folder, in any letter case, in the order of paths; with their bytes only where asked for."""
    files = spark.read.format("binaryFile").load(folder)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    found = files.select("path", stem(F.col("path")).alias("stem"), ext.alias("ext"), *(["content"] if content else [])).where(F.col("ext").isin(*suffixes))
    return found.orderBy("path")


def pixels(spark: SparkSession, folder: str) -> DataFrame:
    """(path, stem, width, height, channels, data) of a folder's images: decoded by the JVM, blue, green, red row by row.

    Files that it can't decode are left out, as are those of no image type.
    """
    rows = spark.read.format("image").option("dropInvalid", True).load(folder).select("image.*")
    path = F.url_decode(F.replace(F.col("origin"), F.lit("+"), F.lit("%2B")))
    return rows.select(path.alias("path"), stem(path).alias("stem"), "width", "height", F.col("nChannels").alias("channels"), "data")


def grey(data: bytes, width: int, height: int, channels: int) -> np.ndarray:
    """Luminance of blue, green, red (and alpha) rows."""
    px = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels == 1:
        return px[:, :, 0].astype(float)
    # The usual integer form: 299 parts of red, 587 of green, 114 of blue.
    return (px[:, :, 2].astype(int) * 19595 + px[:, :, 1].astype(int) * 38470 + px[:, :, 0].astype(int) * 7471 + 0x8000 >> 16).astype(float)


def crops(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """(stem, cls, idx, width, height, png, hash) of boxes (stem, cls, idx, x1, y1, x2, y2 in whole pixels) cut from ``pixels``.

    Corners are clamped to the image; a box that is empty then is left out. ``hash`` is the crop's perceptual hash.
    """
    own = images.select("stem", F.col("width").alias("_w"), F.col("height").alias("_h"), F.col("channels").alias("_ch"), "data")
    wanted = boxes.groupBy("stem").agg(F.collect_list(F.struct("cls", "idx", "x1", "y1", "x2", "y2")).alias("b"))
    schema = "stem string, cls int, idx int, width int, height int, png binary, hash long"

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():  # an image at a time
                px = np.frombuffer(row["data"], np.uint8).reshape(row["_h"], row["_w"], row["_ch"])
                out = []
                for b in row["b"]:
                    x1, y1, x2, y2 = clamped(b["x1"], b["y1"], b["x2"], b["y2"], row["_w"], row["_h"])
                    if x2 > x1 and y2 > y1:
                        part = np.ascontiguousarray(px[y1:y2, x1:x2])
                        hashed = perceptual_hash(grey(part.tobytes(), x2 - x1, y2 - y1, row["_ch"]))
                        out.append((row["stem"], b["cls"], b["idx"], x2 - x1, y2 - y1, png(part), hashed))
                kinds = [pa.string(), *[pa.int32()] * 4, pa.binary(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], [c.split()[0] for c in schema.split(", ")])

    return own.join(wanted, "stem").select("stem", "_w", "_h", "_ch", "data", "b").mapInArrow(run, schema)


def clamped(x1: int, y1: int, x2: int, y2: int, width: int, height: int) -> tuple[int, int, int, int]:
    """Whole-pixel corners inside the image."""
    return min(max(0, x1), width), min(max(0, y1), height), min(max(0, x2), width), min(max(0, y2), height)


def png(px: np.ndarray) -> bytes:
    """A PNG file of blue, green, red (and alpha) or grey rows."""
    height, width, channels = px.shape
    order = {1: [0], 3: [2, 1, 0], 4: [2, 1, 0, 3]}[channels]
    raw = np.zeros((height, 1 + width * channels), np.uint8)  # each row begins with its filter, none
    raw[:, 1:] = px[:, :, order].reshape(height, -1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw.tobytes())) + chunk(b"IEND", b"")


def hashes(images: DataFrame) -> DataFrame:
    """``pixels`` rows' (path, hash): perceptual hashes as a column."""

    def run(batches):
        for batch in batches:
            rows = [(r["path"], perceptual_hash(grey(r["data"], r["width"], r["height"], r["channels"]))) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["path", "hash"])

    return images.select("path", "data", "width", "height", "channels").mapInArrow(run, "path string, hash long")


def header_size(data: bytes) -> tuple[int, int] | None:
    """Width and height from the header of a PNG, JPEG, BMP or WebP file; None if it can't be told."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return struct.unpack(">II", data[16:24])
        if data[:2] == b"BM":
            w, h = struct.unpack("<ii", data[18:26])
            return w, abs(h)
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            kind = data[12:16]
            if kind == b"VP8X":
                return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
            if kind == b"VP8L":
                bits = int.from_bytes(data[21:25], "little")
                return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
            if kind == b"VP8 ":
                w, h = struct.unpack("<HH", data[26:30])
                return w & 0x3FFF, h & 0x3FFF
        if data[:2] == b"\xff\xd8":
            at = 2
            while at + 9 < len(data):
                marker = data[at + 1]
                if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                    h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                    return w, h
                at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    except (struct.error, IndexError):
        pass
    return None


def sizes(images: DataFrame) -> DataFrame:
    """(path, width, height) from the bytes' headers; unreadable and empty images are left out."""

    def run(batches):
        for batch in batches:
            found = [(p, s) for p, c in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True) if (s := header_size(c)) and min(s) > 0]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([s[0] for _, s in found], pa.int32()), pa.array([s[1] for _, s in found], pa.int32())], ["path", "width", "height"])

    return images.select("path", "content").mapInArrow(run, "path string, width int, height int")


def perceptual_hash(grey: np.ndarray) -> int:
    """64 bits of a grey image: of its 32 x 32 means the low 8 x 8 cosine frequencies, whether each is above their median. Signed."""
    h, w = grey.shape
    small = np.array([[grey[y * h // 32 : max((y + 1) * h // 32, y * h // 32 + 1), x * w // 32 : max((x + 1) * w // 32, x * w // 32 + 1)].mean() for x in range(32)] for y in range(32)])
    basis = np.cos(np.pi * (2 * np.arange(32) + 1)[None, :] * np.arange(32)[:, None] / 64)
    low = (basis @ small @ basis.T)[:8, :8]
    bits = np.packbits((low > np.median(low)).ravel()).tobytes()
    return int.from_bytes(bits, "big", signed=True)
