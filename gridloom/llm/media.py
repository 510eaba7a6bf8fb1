"""Media columns: baseline JPEG files written and read in numpy.

A payload is stored losslessly in the format's own unit, the quantised DCT coefficient: its bytes, less 128, are the
coefficients in scan order of the three blocks of a 4:4:4 MCU (192 bytes), all quantisers being 1. Each MCU is a
restart interval, so intervals are independent: the encoder packs the bits of many of them at once, and the decoder steps
through all intervals of a batch in lockstep, one Huffman symbol of each at a time. The reader parses the markers (SOI,
COM, DQT, SOF0, DHT, DRI, SOS, RSTn, EOI) of the file itself, and takes other restart intervals, component tables and
run lengths, subsampled components (4:2:0 and the like) and grey files too; progressive, arithmetic and 12-bit files raise
ValueError.

A thumbnail is the luminance of the DC coefficients alone, one sample a block; its difference hash is kept.

Defined cases of ``media_columns``: a null text is empty; an empty text's payload is 192 bytes of 32; texts of any length
are coded in slices of a bounded number of MCUs; repeated rows give equal values; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import arrow_map, slices, utf8

MCU = 192
#: MCUs that are coded at once.
AT_ONCE = 6000
#: Blocks in a row of the image.
ACROSS = 64


def _code_lengths() -> tuple[dict[int, int], dict[int, int]]:
    """Code lengths by symbol, DC and AC. Fixed, as equal texts must give equal files; short for the sizes that letters and
    spaces have. Both leave the code of all ones free, as the format asks."""
    dc = {size: 4 for size in range(12)}
    ac = {0x05: 2, 0x07: 2, 0x06: 3, 0x04: 3, 0x03: 4, 0x08: 5, 0x00: 5, 0x02: 6, 0x01: 7}
    ac |= {16 * run + size: 11 for run in range(1, 16) for size in range(1, 9)} | {0xF0: 11}
    return dc, ac


def _canonical(lengths: dict[int, int]) -> tuple[bytes, bytes, np.ndarray, np.ndarray]:
    """DHT's counts and symbols, and each symbol's code and length."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    counts = bytes(sum(n == k for n in lengths.values()) for k in range(1, 17))
    codes, sizes = np.zeros(256, np.int64), np.zeros(256, np.int64)
    code = before = 0
    for s in order:
        code <<= lengths[s] - before
        before = lengths[s]
        codes[s], sizes[s] = code, before
        code += 1
    return counts, bytes(order), codes, sizes


_DC_LENGTHS, _AC_LENGTHS = _code_lengths()
_DC, _AC = _canonical(_DC_LENGTHS), _canonical(_AC_LENGTHS)
#: Size category of a coefficient by its value + 256.
_SIZE = np.array([abs(v).bit_length() for v in range(-256, 257)], np.int64)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def grid(n_mcu: int) -> tuple[int, int]:
    """MCUs across and down of the image that holds n_mcu ones."""
    across = min(n_mcu, ACROSS)
    if n_mcu > 8191 * across:  # 65535 lines at most
        across = -(-n_mcu // 8191)
        if across > 8191:
            raise ValueError("the payload is larger than an image can be")
    return across, -(-n_mcu // across)


def header(n_mcu: int, n_payload: int) -> bytes:
    """All that stands before the scan."""
    across, down = grid(n_mcu)
    tables = b"".join(bytes([16 * kind]) + t[0] + t[1] for kind, t in ((0, _DC), (1, _AC)))
    return b"".join(
        (
            b"\xff\xd8",
            _segment(0xFE, struct.pack(">Q", n_payload)),
            _segment(0xDB, b"\0" + b"\1" * 64),
            _segment(0xC0, struct.pack(">BHHB", 8, 8 * down, 8 * across, 3) + b"".join(bytes([c, 0x11, 0]) for c in (1, 2, 3))),
            _segment(0xC4, tables),
            _segment(0xDD, struct.pack(">H", 1)),
            _segment(0xDA, b"\3" + b"".join(bytes([c, 0]) for c in (1, 2, 3)) + b"\0\x3f\0"),
        )
    )


def encode_intervals(payload: np.ndarray, marker: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stuffed bytes of intervals, each followed by its marker; and the byte after each. payload: (m, 192) uint8."""
    m = len(payload)
    v = payload.reshape(-1).astype(np.int64) - 128
    token = v != 0
    token[::64] = True  # DC is always coded
    at = np.flatnonzero(token)
    value = v[at]
    is_dc = (at & 63) == 0
    run = np.empty_like(at)
    run[0], run[1:] = 0, np.diff(at) - 1
    run[is_dc] = 0
    size = _SIZE[value + 256]
    block_ends = np.empty(len(at), bool)
    block_ends[-1], block_ends[:-1] = True, is_dc[1:]
    eob = block_ends & ((at & 63) != 63)
    bits = np.where(value < 0, value + (1 << size) - 1, value)
    symbol = ((run & 15) << 4) | size
    code = np.where(is_dc, _DC[2][size], _AC[2][symbol])
    length = np.where(is_dc, _DC[3][size], _AC[3][symbol]) + size
    code = (code << size) | bits
    zrl = run >> 4
    extra = zrl + eob
    if extra.any():
        main = np.cumsum(1 + extra) - 1 - eob
        total = int((1 + extra).sum())
        codes, lengths, owner = np.full(total, _AC[2][0xF0]), np.full(total, _AC[3][0xF0]), np.repeat(at, 1 + extra)
        codes[main], lengths[main] = code, length
        codes[main[eob] + 1], lengths[main[eob] + 1] = _AC[2][0], _AC[3][0]
    else:
        codes, lengths, owner = code, length, at
    interval = owner // MCU
    first = np.searchsorted(interval, np.arange(m))
    ends = np.cumsum(lengths)
    begin = ends - lengths
    base = begin[first]
    n_bits = np.append(base[1:], ends[-1]) - base
    n_bytes = (n_bits + 7) >> 3
    byte_base = np.cumsum(n_bytes) - n_bytes
    position = begin - base[interval] + 8 * byte_base[interval]
    # Each token adds to two 32-bit words at most (length <= 26); tokens stand in order, so sums by word are reduceat's.
    word, shift = position >> 5, position & 31
    wide = codes.astype(np.uint64) << (64 - shift - lengths).astype(np.uint64)
    n_words = int((byte_base[-1] + n_bytes[-1] + 3) >> 2) + 1
    words = np.zeros(n_words, np.uint64)
    starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    words[word[starts]] += np.add.reduceat(wide >> np.uint64(32), starts)
    words[word[starts] + 1] += np.add.reduceat(wide & np.uint64(0xFFFFFFFF), starts)
    raw = words.astype(">u4").view(np.uint8)[: int(byte_base[-1] + n_bytes[-1])].copy()
    last = byte_base + n_bytes - 1
    raw[last] |= ((1 << (8 * n_bytes - n_bits)) - 1).astype(np.uint8)  # padding of ones
    # Stuffing: a zero after each 255; and two bytes of marker after each interval.
    width = 1 + (raw == 255).astype(np.int64)
    width[last] += 2
    place = np.cumsum(width) - width
    out = np.zeros(int(place[-1] + width[-1]), np.uint8)
    out[place] = raw
    after = place[last] + width[last]
    out[after - 2], out[after - 1] = 255, marker
    return out, after


def encode(payloads: list[bytes]) -> list[bytes]:
    """A JPEG file for each payload of a positive multiple of 192 bytes."""
    sizes = [len(p) // MCU for p in payloads]
    whole = [grid(n)[0] * grid(n)[1] for n in sizes]
    files = [[header(n, len(p))] for n, p in zip(sizes, payloads, strict=True)]
    queue: list[tuple[int, int, np.ndarray]] = []
    waiting = 0

    def flush() -> None:
        nonlocal waiting
        if not queue:
            return
        markers = []
        for d, start, part in queue:
            marks = 0xD0 + (np.arange(start, start + len(part)) & 7)
            if start + len(part) == whole[d]:
                marks[-1] = 0xD9
            markers.append(marks)
        out, after = encode_intervals(np.concatenate([part for _, _, part in queue]), np.concatenate(markers).astype(np.uint8))
        done = row = 0
        for d, _, part in queue:
            row += len(part)
            files[d].append(out[done : after[row - 1]].tobytes())
            done = int(after[row - 1])
        queue.clear()
        waiting = 0

    for d, (p, n) in enumerate(zip(payloads, sizes, strict=True)):
        rows = np.frombuffer(p, np.uint8).reshape(n, MCU)
        if whole[d] > n:
            rows = np.concatenate([rows, np.full((whole[d] - n, MCU), 128, np.uint8)])
        for at in range(0, whole[d], AT_ONCE):
            part = rows[at : at + AT_ONCE]
            queue.append((d, at, part))
            waiting += len(part)
            if waiting >= AT_ONCE:
                flush()
    flush()
    return [b"".join(parts) for parts in files]


@dataclass
class Frame:
    """What the markers say, and where the scan's intervals lie in the file."""

    width: int
    height: int
    n_payload: int | None
    quantisers: dict[int, np.ndarray]
    components: list[tuple[int, int, int]]  # quantiser, DC table, AC table
    sampling: list[tuple[int, int]]  # blocks across and down of each component in an MCU
    tables: dict[tuple[int, int], tuple[bytes, bytes]]
    restart: int
    scan: int


    @property
    def mcus(self) -> tuple[int, int]:
        """MCUs down and across."""
        across, down = max(a for a, _ in self.sampling), max(d for _, d in self.sampling)
        return -(-self.height // (8 * down)), -(-self.width // (8 * across))


def parse(data: bytes) -> Frame:
    """The markers up to the scan."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG file")
    at, payload, quantisers, tables, restart, frame = 2, None, {}, {}, 0, None
    while True:
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker, n = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xFE and len(body) == 8:
            payload = struct.unpack(">Q", body)[0]
        elif marker == 0xDB:
            while body:
                if body[0] >> 4:
                    raise ValueError("16-bit quantisers are not baseline")
                quantisers[body[0] & 15], body = np.frombuffer(body[1:65], np.uint8).astype(np.int64), body[65:]
        elif marker == 0xC4:
            while body:
                total = sum(body[1:17])
                tables[body[0] >> 4, body[0] & 15], body = (body[1:17], body[17 : 17 + total]), body[17 + total :]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xC0:
            precision, height, width, n_parts = struct.unpack(">BHHB", body[:6])
            parts = [tuple(body[6 + 3 * i : 9 + 3 * i]) for i in range(n_parts)]
            if precision != 8 or any(not 1 <= p[1] >> 4 <= 4 or not 1 <= p[1] & 15 <= 4 for p in parts):
                raise ValueError("only 8-bit frames")
            frame = (width, height, {p[0]: (p[2], (p[1] >> 4, p[1] & 15)) for p in parts})
        elif marker == 0xDA:
            if frame is None or body[0] != len(frame[2]):
                raise ValueError("only one interleaved scan")
            names = [body[1 + 2 * i] for i in range(body[0])]
            own = [(frame[2][c][0], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i, c in enumerate(names)]
            sampling = [frame[2][c][1] for c in names] if len(names) > 1 else [(1, 1)]  # a component alone is not interleaved
            return Frame(frame[0], frame[1], payload, quantisers, own, sampling, tables, restart, at)
        elif 0xC1 <= marker <= 0xCF:
            raise ValueError("not a baseline frame")


def _lookup(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and code length by the next 16 bits; length 0 where no code fits."""
    symbol, length = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
    code = at = 0
    for n in range(1, 17):
        for _ in range(counts[n - 1]):
            span = slice(code << (16 - n), (code + 1) << (16 - n))
            symbol[span], length[span] = symbols[at], n
            code, at = code + 1, at + 1
        code <<= 1
    return symbol, length


def decode_scan(scan: np.ndarray, starts: np.ndarray, ends: np.ndarray, blocks: np.ndarray, kinds: list[tuple[int, int]], tables: dict) -> np.ndarray:
    """Coefficients (sum of blocks, 64) of intervals that lie at starts:ends of the stuffed bytes, without DC prediction undone.

    kinds: DC and AC table of each component; an interval's blocks go through the components in turn.
    """
    # Unstuffed bytes, padded so that a window of four bytes can be read at each place.
    keep = np.ones(len(scan), bool)
    keep[1:] = ~((scan[:-1] == 255) & (scan[1:] == 0))
    moved = np.cumsum(keep) - keep
    plain = np.concatenate([scan[keep], np.zeros(8, np.uint8)]).astype(np.uint32)
    window = (plain[:-3] << np.uint32(24)) | (plain[1:-2] << np.uint32(16)) | (plain[2:-1] << np.uint32(8)) | plain[3:]
    names = sorted({(0, d) for d, _ in kinds} | {(1, a) for _, a in kinds})
    found = [_lookup(*tables[n]) for n in names]
    symbols, lengths = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    base = np.array([[names.index((0, d)) << 16, names.index((1, a)) << 16] for d, a in kinds], np.int64)
    out = np.zeros((int(blocks.sum()), 64), np.int16)
    flat = out.reshape(-1)
    first = np.cumsum(blocks) - blocks
    lane_bit = 8 * moved[starts].astype(np.int64)
    lane_place = 64 * first  # where the next coefficient goes
    lane_end = 64 * (first + blocks)
    lane_first = 64 * first
    while len(lane_bit):
        for _ in range(16):
            k = lane_place & 63
            part = ((lane_place - lane_first) >> 6) % len(kinds)
            table = base[part, (k > 0).astype(np.int64)]
            peek = (window[lane_bit >> 3] >> (16 - (lane_bit & 7)).astype(np.uint32)).astype(np.int64) & 0xFFFF
            symbol, used = symbols[table + peek], lengths[table + peek]
            if not used.all():
                raise ValueError("a code is broken")
            lane_bit = lane_bit + used
            is_dc = k == 0
            size = np.where(is_dc, symbol, symbol & 15)
            run = np.where(is_dc, 0, symbol >> 4)
            peek = window[lane_bit >> 3].astype(np.int64) << (lane_bit & 7)
            bits = (peek & 0xFFFFFFFF) >> (32 - size)
            value = np.where(bits < (1 << size) >> 1, bits - (1 << size) + 1, bits)
            value[size == 0] = 0
            lane_bit = lane_bit + size
            ends_block = ~is_dc & (size == 0) & (run < 15)
            place = np.minimum(lane_place + run, lane_end - 1)
            flat[place[size > 0]] = value[size > 0]
            lane_place = np.where(ends_block, (lane_place | 63) + 1, lane_place + run + 1)
            open_lanes = lane_place < lane_end
            if not open_lanes.all():
                lane_bit, lane_place, lane_end, lane_first = (x[open_lanes] for x in (lane_bit, lane_place, lane_end, lane_first))
                if not len(lane_bit):
                    break
    return out


@dataclass
class Decoded:
    width: int
    height: int
    payload: bytes
    thumbnail: np.ndarray


def decode(files: list[bytes]) -> list[Decoded]:
    """Payload, dimensions and luminance thumbnail of each file; files of the same tables are stepped through together."""
    out: list[Decoded | None] = [None] * len(files)
    frames = [parse(f) for f in files]
    groups: dict[tuple, list[int]] = {}
    for i, f in enumerate(frames):
        groups.setdefault((tuple(c[1:] for c in f.components), tuple(f.sampling), tuple(sorted(f.tables.items()))), []).append(i)
    for own in groups.values():
        first = frames[own[0]]
        # The blocks of an MCU in order, by their components' tables.
        kinds = [c[1:] for c, (a, d) in zip(first.components, first.sampling, strict=True) for _ in range(a * d)]
        lanes = []  # file, its intervals' starts and ends, its MCUs
        for i in own:
            raw = np.frombuffer(files[i], np.uint8)[frames[i].scan :]
            mark = np.flatnonzero((raw[:-1] == 255) & (raw[1:] != 0))
            lanes.append((i, raw, np.append(0, mark[:-1] + 2), mark, frames[i].mcus[0] * frames[i].mcus[1]))
        queue, waiting = [], 0
        for lane in lanes:
            queue.append(lane)
            waiting += lane[4]
            if waiting >= AT_ONCE:
                _decode_group(queue, frames, kinds, out)
                queue, waiting = [], 0
        if queue:
            _decode_group(queue, frames, kinds, out)
    return out


def _undo(mine: np.ndarray, blocks: np.ndarray, sizes: list[int], parts: int) -> None:
    """DC coefficients from their differences: a component's blocks follow each other in the MCUs of an interval."""
    at = 0
    for size in sizes:
        places = (np.arange(0, len(mine), parts)[:, None] + np.arange(at, at + size)).ravel()
        lane = np.repeat(np.arange(len(blocks)), blocks // parts * size)
        total = np.cumsum(mine[places, 0].astype(np.int64))
        first = np.searchsorted(lane, np.arange(len(blocks)))
        mine[places, 0] = total - np.append(0, total)[first][lane]
        at += size


def _decode_group(lanes: list, frames: list[Frame], kinds: list, out: list) -> None:
    parts = len(kinds)
    sizes_of = [a * d for a, d in frames[lanes[0][0]].sampling]
    pieces, offset = [], 0
    for i, raw, starts, ends, mcus in lanes:
        step = frames[i].restart or mcus
        blocks = parts * np.minimum(step, mcus - step * np.arange(len(starts)))
        # A long file goes through in slices of its intervals.
        for at in range(0, len(starts), AT_ONCE):
            sl = slice(at, at + AT_ONCE)
            low, high = int(starts[sl][0]), int(ends[sl][-1])
            pieces.append((i, raw[low:high], starts[sl] - low, ends[sl] - low, blocks[sl]))
    done: dict[int, list[np.ndarray]] = {}
    batch, count = [], 0

    def run() -> None:
        nonlocal batch, count, offset
        if not batch:
            return
        sizes = np.array([len(p[1]) for p in batch])
        shift = np.cumsum(sizes) - sizes
        coefficients = decode_scan(
            np.concatenate([p[1] for p in batch]),
            np.concatenate([p[2] + s for p, s in zip(batch, shift, strict=True)]),
            np.concatenate([p[3] + s for p, s in zip(batch, shift, strict=True)]),
            np.concatenate([p[4] for p in batch]),
            kinds,
            frames[batch[0][0]].tables,
        )
        at = 0
        for p in batch:
            n = int(p[4].sum())
            mine = coefficients[at : at + n]
            at += n
            step = p[4][0] // parts
            if step > 1 or parts > len(sizes_of):  # DC is coded as the difference to the component's last one in the interval
                _undo(mine, p[4], sizes_of, parts)
            done.setdefault(p[0], []).append(mine)
        batch, count = [], 0

    for p in pieces:
        batch.append(p)
        count += len(p[2])
        if count >= AT_ONCE:
            run()
    run()
    for i, _, _, _, mcus in lanes:
        f = frames[i]
        blocks = np.concatenate(done[i])
        n = f.n_payload if f.n_payload is not None else blocks.size
        payload = (blocks.reshape(-1)[:n] + 128).astype(np.uint8).tobytes()
        (down, across), (a, d) = f.mcus, f.sampling[0]
        dc = blocks[:, 0].reshape(-1, parts)[:, : a * d].astype(np.float64) * f.quantisers[f.components[0][0]][0]
        # The luminance blocks of an MCU stand in rows; those beyond the image are dropped.
        dc = dc.reshape(down, across, d, a).swapaxes(1, 2).reshape(down * d, across * a)[: -(-f.height // 8), : -(-f.width // 8)]
        thumbnail = np.clip(dc / 8 + 128, 0, 255)
        out[i] = Decoded(f.width, f.height, payload, thumbnail)


def difference_hash(thumbnail: np.ndarray) -> str:
    """64 bits: of 8 x 9 nearest samples, whether each is brighter than its left neighbour."""
    down, across = thumbnail.shape
    small = thumbnail[np.ix_(np.arange(8) * down // 8, np.arange(9) * across // 9)]
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """Each text as a JPEG file, read back: dimensions, sizes, digests and the thumbnail's hash; with keep_media the file."""
    kind = docs.schema[id_col].dataType.simpleString()

    def each(batch: pa.RecordBatch):
        texts = utf8(batch.column(1))
        payloads = [t + b" " * (-len(t) % MCU if t else MCU) for t in texts]
        files = encode(payloads)
        found = decode(files)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        cols = {
            "doc_id": batch.column(0),
            "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
            "payload_bytes": pa.array([len(x.payload) for x in found], pa.int64()),
            "payload_sha256": pa.array([sha(x.payload) for x in found], pa.string()),
            "tail_crc32": pa.array([zlib.crc32(x.payload[-16:]) for x in found], pa.int64()),
            "media_bytes": pa.array([len(f) for f in files], pa.int64()),
            "media_sha256": pa.array([sha(f) for f in files], pa.string()),
            "feature": pa.array([f"{x.width}x{x.height}:{difference_hash(x.thumbnail)}" for x in found], pa.string()),
            "width": pa.array([x.width for x in found], pa.int32()),
            "height": pa.array([x.height for x in found], pa.int32()),
        }
        if keep_media:
            cols["media"] = pa.array(files, pa.binary())
        return pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    def small(batch: pa.RecordBatch):
        made = [each(part) for part in slices(batch, MCU * AT_ONCE)]
        table = pa.Table.from_batches(made).combine_chunks()
        return table.to_batches()[0] if made else None

    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int" + ", media binary" * keep_media
    return arrow_map(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), small, schema)
