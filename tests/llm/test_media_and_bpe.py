import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from gridloom.llm import bpe, media

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def payloads(seed=0):
    rng = random.Random(seed)
    some = [bytes(rng.choices(range(256), k=192 * rng.randint(1, 9))) for _ in range(20)]
    some += [bytes([128]) * 192, b"\xff" * 384, bytes([128] * 100 + [7] + [128] * 91), b" " * 192, bytes(rng.choices([128, 1], [50, 1], k=192 * 70))]
    return some


def test_jpeg_is_lossless():
    files = media.encode(payloads())
    assert [x.payload for x in media.decode(files)] == payloads()
    assert all(f[:2] == b"\xff\xd8" and f[-2:] == b"\xff\xd9" for f in files)
    assert files == [media.encode([p])[0] for p in payloads()]


def test_jpeg_size_and_thumbnail():
    payload = np.random.default_rng(0).integers(0, 256, 192 * 130, np.uint8)
    found = media.decode(media.encode([payload.tobytes()]))[0]
    assert (found.width, found.height) == (512, 24) and found.thumbnail.shape == (3, 64)
    luminance = payload.reshape(-1, 192)[:, 0].astype(float) - 128
    want = np.clip(np.append(luminance, np.zeros(62)).reshape(3, 64) / 8 + 128, 0, 255)
    assert np.array_equal(found.thumbnail, want)


def test_jpeg_with_other_restart_intervals():
    """Rewritten by hand: one interval, DC as differences, bits of one block after the other."""
    payload = bytes(random.Random(2).choices(range(256), k=192 * 3))
    values = np.frombuffer(payload, np.uint8).astype(int) - 128
    bits, last = "", [0, 0, 0]
    for k, block in enumerate(values.reshape(-1, 64)):
        diff, last[k % 3] = block[0] - last[k % 3], block[0]
        code = lambda t, s: format(int(t[2][s]), f"0{int(t[3][s])}b")
        extra = lambda v: "" if not v else format(v if v > 0 else v + (1 << abs(v).bit_length()) - 1, f"0{abs(v).bit_length()}b")
        bits += code(media._DC, abs(int(diff)).bit_length()) + extra(int(diff))
        run = 0
        for v in block[1:].tolist():
            if v == 0:
                run += 1
                continue
            bits += code(media._AC, 0xF0) * (run // 16) + code(media._AC, 16 * (run % 16) + abs(v).bit_length()) + extra(v)
            run = 0
        bits += code(media._AC, 0) if run else ""
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    head = media.header(3, len(payload)).replace(b"\xff\xdd\x00\x04\x00\x01", b"")
    assert media.decode([head + scan + b"\xff\xd9"])[0].payload == payload


def java_image(spark, rgb):
    jvm = spark._jvm
    height, width = rgb.shape[:2]
    image = jvm.java.awt.image.BufferedImage(width, height, 1 if rgb.ndim == 3 else 10)
    raster = image.getRaster()
    values = spark.sparkContext._gateway.new_array(jvm.int, rgb.size)
    for i, v in enumerate(rgb.ravel().tolist()):
        values[i] = v
    raster.setPixels(0, 0, width, height, values)
    out = jvm.java.io.ByteArrayOutputStream()
    assert jvm.javax.imageio.ImageIO.write(image, "jpg", out)
    return bytes(out.toByteArray())


@pytest.mark.parametrize("shape", [(37, 50, 3), (16, 16, 3), (40, 23)])
def test_files_of_another_encoder(spark, shape):
    """The JVM writes 4:2:0 for colours and one component for grey; the thumbnail is the mean luminance of each block."""
    rng = np.random.default_rng(1)
    y, x = np.mgrid[0 : shape[0], 0 : shape[1]]
    grey = (40 + 2 * x + 3 * y + rng.integers(0, 4, shape[:2])).clip(0, 255)
    rgb = np.repeat(grey[:, :, None], 3, 2) if len(shape) == 3 else grey
    raw = java_image(spark, rgb)
    found = media.decode([raw, raw])[1]
    assert (found.height, found.width) == shape[:2] and found.thumbnail.shape == (-(-shape[0] // 8), -(-shape[1] // 8))
    sampling = media.parse(raw).sampling
    assert sampling == ([(2, 2), (1, 1), (1, 1)] if len(shape) == 3 else [(1, 1)])
    for i in range(shape[0] // 8):
        for j in range(shape[1] // 8):
            assert abs(found.thumbnail[i, j] - grey[8 * i : 8 * i + 8, 8 * j : 8 * j + 8].mean()) < 4


def test_another_decoder_reads_our_files(spark):
    payload = bytes(random.Random(5).choices(range(118, 138), k=192 * 70))
    raw = media.encode([payload])[0]
    jvm = spark._jvm
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(raw))
    found = media.decode([raw])[0]
    assert (image.getWidth(), image.getHeight()) == (found.width, found.height)


def test_jpeg_rejects_what_it_cannot_read():
    with pytest.raises(ValueError):
        media.decode([b"GIF89a"])
    with pytest.raises(ValueError):
        media.decode([media.encode([b" " * 192])[0].replace(b"\xff\xc0", b"\xff\xc2")])


def test_media_columns(spark, edge_docs, no_docs):
    texts = sorted((r.text or "") for r in edge_docs.select("text").collect())
    got = sorted(media.media_columns(edge_docs, keep_media=True).collect(), key=lambda r: media.decode([r.media])[0].payload)
    want = []
    for t in texts:
        raw = t.encode()
        want.append((len(raw), raw + b" " * (-len(raw) % 192 if raw else 192)))
    for r, (n, payload) in zip(got, sorted(want, key=lambda x: x[1]), strict=True):
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (n, len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-16:]), len(r.media), hashlib.sha256(r.media).hexdigest())
    assert media.media_columns(no_docs).count() == 0


@pytest.fixture(scope="module")
def coders():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return bpe.Transducer(bpe.ranks_from(PATH), public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_like_the_library(coders):
    mine, theirs = coders
    rng = random.Random(1)
    letters = "abc  \n\t  é中👍'sS019　\x1c\x85-=*"
    texts = ["", " ", "\n\n  x", "x" * 3000, "ab" * 700, " " * 700, "=-" * 900, "''''s't", "​zero", "<|endoftext|>", "a\x00b"]
    texts += ["".join(rng.choices(letters, k=rng.randint(1, 80))) for _ in range(800)]
    texts += ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(0xA0, 0x2FFF), rng.randint(0x1F300, 0x1F6FF)])) for _ in range(40)) for _ in range(200)]
    for t in texts:
        assert mine.ids(t) == theirs.encode_ordinary(t), t
        assert mine.decode(mine.encode(t)) == t.encode()


def test_bounded_tables_give_the_same(coders, monkeypatch):
    monkeypatch.setattr(bpe, "STATES", 50)
    monkeypatch.setattr(bpe, "PIECES", 10)
    monkeypatch.setattr(bpe, "PENDING", 140)
    mine = bpe.Transducer(coders[0].ranks, public_tokenizers.PATTERN)
    text = "".join(random.Random(4).choices("abehlnorst", k=5000)) + " the quick brown fox " * 20
    assert mine.ids(text) == coders[1].encode_ordinary(text)


def test_stream_decodes_any_cut():
    rng = random.Random(8)
    texts = ["aé中👍 z".encode() + b"\xff\xe4\xb8" + "é".encode(), b"\xed\xa0\x80\xf4\x90\x80\x80\xc0\x80\xe0\x9f\xbf\xf0\x8f\xbf\xbf\xf8\x88"]
    texts += [bytes(rng.choices([0x41, 0x80, 0xA0, 0xC3, 0xE0, 0xE4, 0xED, 0xF0, 0xF4, 0xBF, 0x9F, 0xFF], k=30)) for _ in range(200)]
    for raw in texts:
        for cut in (1, 2, 3, 5, 30):
            stream = bpe.Utf8Stream()
            text = "".join(stream.feed(raw[i : i + cut]) for i in range(0, len(raw), cut)) + stream.finish()
            assert text == raw.decode("utf-8", "replace"), (raw, cut)


def test_other_patterns(coders):
    """A coarser split is used only where it is known to be made of whole matches."""
    words = r"\w+|[^\w\s]+|\s+"
    mine = bpe.Transducer(coders[0].ranks, words)
    theirs = tiktoken.Encoding("words", pat_str=words, mergeable_ranks=coders[0].ranks, special_tokens={})
    for text in ("it's  a-b\n\nc 12,5 é中", "  lead", "don't", "x\u00a0y"):
        assert mine.ids(text) == theirs.encode_ordinary(text)


def test_round_trip(spark, coders, edge_docs, no_docs):
    want = sorted((r.doc_id or 0, hashlib.sha256(np.array(coders[1].encode_ordinary(r.text or ""), "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in edge_docs.select("doc_id", "text").collect())
    got = bpe.round_trip(edge_docs, PATH, public_tokenizers.PATTERN).collect()
    assert sorted((r.doc_id or 0, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert bpe.round_trip(no_docs, PATH, public_tokenizers.PATTERN).count() == 0
    assert bpe.tokenised(edge_docs.where("doc_id = 7"), PATH, public_tokenizers.PATTERN).first().ids == coders[1].encode_ordinary("one")
