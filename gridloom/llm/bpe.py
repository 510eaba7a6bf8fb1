"""Byte-level BPE encoding and decoding by a lazily determinised finite-state transducer.

The transducer reads the bytes of one match of the split pattern. The encoding of a prefix has one last token, and a token
t ends the encoding of a longer prefix if it is the whole prefix, or if the last token u of what stands before t is
compatible with t, that is if merging the bytes of u and t gives just [u, t]. So all that later bytes depend on is the
longest suffix of the input that begins some token, and the last tokens at the places inside that suffix. These make a state;
states and transitions are made when first met and kept (up to ``STATES``). A token is emitted once every last-token chain
that starts inside the suffix passes its end: the lookahead is bounded by the length of the longest token.

Decoding joins the tokens' bytes; ``Utf8Stream`` turns bytes that come in pieces into text with a state machine.

Defined cases: a null text is empty and has no tokens; an empty table gives no rows; repeated rows are encoded each; other
columns are not read. Ids outside the vocabulary raise KeyError.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import arrow_map, utf8

#: Kept states of the transducer before it starts anew, pieces of each of the two generations that are kept, and pairs of tokens.
STATES, PIECES, PAIRS = 250_000, 150_000, 100_000
#: Bits of a token in a kept transition.
_BITS = 24
#: Positions that wait for their chains to meet before settled tokens are emitted.
PENDING = 512
#: Unicode white space, which is what the split pattern's \s stands for.
_BLANK = r"\t-\r \x85\xa0  -     　"
#: A coarser split: each of its chunks is made of whole matches of the pattern.
_CHUNK = re.compile(f" ?[^{_BLANK}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+")


def ranks_from(path: str) -> dict[bytes, int]:
    """The vocabulary of a rank file: base64 of a token's bytes and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Transducer:
    """Encoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.size_of = {r: len(t) for t, r in ranks.items()}
        self.prefixes = {t[:i] for t in ranks for i in range(1, len(t) + 1)}
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        # Chunks are known to be whole matches of the public pattern only.
        self.chunks = _CHUNK.findall if pattern == public_tokenizers.PATTERN else lambda text: [text]
        self.pairs: dict[int, bool] = {}
        self.pieces = _Pieces(self)
        self._clear()

    def _clear(self) -> None:
        # State 0: nothing read; -1 stands for the last token of the empty prefix.
        self.keys: list[tuple[bytes, tuple[int, ...]]] = [(b"", (-1,))]
        self.index = {self.keys[0]: 0}
        self.moves: dict[int, int] = {}  # by 256 * state + byte: the next state and the last token there

    def merged(self, piece: bytes) -> list[int]:
        """Merge by rank, lowest first and leftmost among equals: the definition, used on pairs of tokens only."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            found = [(self.ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in self.ranks]
            if not found:
                break
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, before: int, token: int) -> bool:
        """Whether the token may follow ``before`` (-1: start the input)."""
        name = before << _BITS | token
        known = self.pairs.get(name)
        if known is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            want = [token] if before < 0 else [before, token]
            known = self.pairs[name] = self.merged(b"".join(self.bytes_of[t] for t in want)) == want
        return known

    def _step(self, state: int, byte: int) -> int:
        """The next state and the last token there, as one number; makes both where they are new."""
        suffix, last = self.keys[state]
        text = suffix + bytes([byte])
        for length in range(len(text), 0, -1):
            token = self.ranks.get(text[-length:])
            # last[j] belongs to the place j bytes after the suffix began.
            if token is not None and self.compatible(last[len(text) - length], token):
                break
        else:
            raise ValueError("the vocabulary lacks a byte")
        kept = text
        while kept not in self.prefixes:
            kept = kept[1:]
        # Last tokens count at places only from which some token could still begin.
        places = (*last, token)[len(text) - len(kept) :]
        key = (kept, tuple(t if kept[j:] in self.prefixes or j == len(kept) else -2 for j, t in enumerate(places)))
        target = self.index.get(key)
        if target is None:
            target = self.index[key] = len(self.keys)
            self.keys.append(key)
        self.moves[256 * state + byte] = out = target << _BITS | token
        return out

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one match of the pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.keys) > STATES:
            self._clear()
        out: list[int] = []
        ends: list[int] = []  # the last token at each place since what was emitted
        state, known, end, token = 0, self.moves.get, ends.append, (1 << _BITS) - 1
        for at in range(0, len(piece), PENDING):
            if at:
                self._emit(ends, out, len(self.keys[state][0]))
                if len(self.keys) > STATES:  # anew, from the state that is now
                    key = self.keys[state]
                    self._clear()
                    known, state = self.moves.get, self.index.setdefault(key, len(self.keys))
                    if state == len(self.keys):
                        self.keys.append(key)
            for byte in piece[at : at + PENDING]:
                step = known(256 * state + byte) or self._step(state, byte)
                state = step >> _BITS
                end(step & token)
        return out + self._chain(ends, len(ends))

    def _chain(self, ends: list[int], at: int) -> list[int]:
        """The tokens that lead to a place."""
        found, size = [], self.size_of
        while at > 0:
            token = ends[at - 1]
            found.append(token)
            at -= size[token]
        found.reverse()
        return found

    def _emit(self, ends: list[int], out: list[int], window: int) -> None:
        """Move tokens to out up to the last place that every chain from the last ``window`` places passes."""
        n, size = len(ends), self.size_of
        places = set(range(n - window, n + 1))
        while len(places) > 1:  # the farthest place steps back until all chains have met
            far = max(places)
            places.remove(far)
            places.add(far - size[ends[far - 1]])
            if min(places) <= 0:
                places = {0}
        meet = places.pop()
        out += self._chain(ends, meet)
        del ends[:meet]

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.pieces.__getitem__, self.chunks(text)))

    def ids(self, text: str) -> list[int]:
        return np.frombuffer(self.encode(text), "<u4").tolist()

    def decode(self, ids: bytes) -> bytes:
        """The bytes of little-endian unsigned 32-bit ids."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Pieces(dict):
    """Encodings of chunks that were met: PIECES of them, and as many of the generation before."""

    def __init__(self, owner: Transducer):
        self.owner, self.older = owner, {}

    def __missing__(self, chunk: str) -> bytes:
        out = self.older.get(chunk)
        if out is None:
            split, encode = self.owner.split, self.owner.encode_piece
            out = array("I", [i for piece in split(chunk) for i in encode(piece.encode())]).tobytes()
        if len(chunk) <= 64:
            if len(self) >= PIECES:
                self.older.clear()
                self.older.update(self)
                self.clear()
            self[chunk] = out
        return out


def _classes() -> bytes:
    """Classes of bytes for the automaton: continuation bytes in three ranges, leads by what may follow, and bytes that never occur."""
    out = bytearray(256)
    for low, high, kind in ((0x80, 0x90, 1), (0x90, 0xA0, 2), (0xA0, 0xC0, 3), (0xC0, 0xC2, 4), (0xC2, 0xE0, 5), (0xE0, 0xE1, 6), (0xE1, 0xF0, 7), (0xED, 0xEE, 8), (0xF0, 0xF1, 9), (0xF1, 0xF4, 10), (0xF4, 0xF5, 11), (0xF5, 0x100, 4)):
        out[low:high] = bytes([kind]) * (high - low)
    return bytes(out)


_CLASS = _classes()
#: States of the automaton: 0 between characters; 1, 2, 3: so many continuation bytes are missing; 4 to 7: the next one is bound, after
#: E0, ED, F0 and F4. By state the states that continuation bytes of the three ranges lead to; all else breaks the character.
_NEXT = {1: (0, 0, 0), 2: (1, 1, 1), 3: (2, 2, 2), 4: (None, None, 1), 5: (1, 1, None), 6: (None, 2, 2), 7: (2, None, None)}
#: States that leads open.
_OPENS = {5: 1, 6: 4, 7: 2, 8: 5, 9: 6, 10: 3, 11: 7}


class Utf8Stream:
    """Text of bytes that come in pieces, by a state machine over byte classes. Between pieces it keeps its state and the bytes of one
    unfinished character; what breaks a character becomes U+FFFD, once for each maximal part, as the library's decoder does.

    Runs between characters that are broken or cut are decoded at once: the automaton walks the ends of a piece, where a character may be
    open, and the middle is walked only if it is not valid as a whole.
    """

    def __init__(self):
        self.state, self.open = 0, b""

    def _walk(self, data: bytes, out: list[str]) -> None:
        """Each byte through the automaton."""
        state, held = self.state, bytearray(self.open)
        for byte in data:
            kind = _CLASS[byte]
            if state:
                then = _NEXT[state][kind - 1] if 1 <= kind <= 3 else None
                if then is not None:
                    held.append(byte)
                    state = then
                    if not state:
                        out.append(held.decode())
                        held.clear()
                    continue
                out.append("\ufffd")  # what was begun is broken; the byte starts anew
                held.clear()
                state = 0
            if kind == 0:
                out.append(chr(byte))
            elif kind in _OPENS:
                state = _OPENS[kind]
                held.append(byte)
            else:
                out.append("\ufffd")
        self.state, self.open = state, bytes(held)

    def feed(self, more: bytes) -> str:
        out: list[str] = []
        at = 0
        while self.state and at < len(more):  # finish the open character
            self._walk(more[at : at + 1], out)
            at += 1
        end = len(more)
        while end > at and len(more) - end < 4 and 1 <= _CLASS[more[end - 1]] <= 3:  # back to the last lead
            end -= 1
        if end > at and _CLASS[more[end - 1]] in _OPENS:
            end -= 1
        else:
            end = len(more)
        middle = more[at:end]
        try:
            out.append(middle.decode())
        except UnicodeDecodeError:
            self._walk(middle, out)
        self._walk(more[end:], out)
        return "".join(out)

    def finish(self) -> str:
        rest, self.state, self.open = "\ufffd" if self.state else "", 0, b""
        return rest


_LOADED: dict[tuple[str, str], Transducer] = {}


def loaded(path: str, pattern: str) -> Transducer:
    """The worker's transducer of that vocabulary; its tables serve all of its tasks."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Transducer(ranks_from(path), pattern)
    return _LOADED[path, pattern]


def tokenised(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the text's token ids as array<int>."""
    kind = docs.schema[id_col].dataType.simpleString()

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = loaded(path, pattern)
        ids = [np.frombuffer(coder.encode(t.decode()), "<u4").astype(np.int32) for t in utf8(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return arrow_map(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), each, f"doc_id {kind}, ids array<int>")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", piece: int = 4096) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, decoded_chars of each text: encoded, then decoded in pieces of ids."""
    kind = docs.schema[id_col].dataType.simpleString()

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = loaded(path, pattern)
        counts, ids_sha, decoded_sha, chars = [], [], [], []
        for text in utf8(batch.column(1)):
            ids = coder.encode(text.decode())
            stream, seen, total = Utf8Stream(), hashlib.sha256(), 0
            for at in range(0, len(ids), 4 * piece):
                raw = coder.decode(ids[at : at + 4 * piece])
                seen.update(raw)
                total += len(stream.feed(raw))
            counts.append(len(ids) // 4)
            ids_sha.append(hashlib.sha256(ids).hexdigest())
            decoded_sha.append(seen.hexdigest())
            chars.append(total + len(stream.finish()))
        out = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string()), pa.array(chars, pa.int64())]
        return pa.RecordBatch.from_arrays(out, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "decoded_chars"])

    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, decoded_chars long"
    return arrow_map(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), each, schema)
