import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from marlstone.llm import flac


class Writer:
    """A plain bit writer for frames that the encoder itself never chooses."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> (n - 1 - i) & 1 for i in range(n)]

    def rice(self, r, k):
        u = 2 * r if r >= 0 else -2 * r - 1
        self.bits += [0] * (u >> k) + [1]
        self.put(u & (1 << k) - 1, k)

    def bytes(self):
        self.bits += [0] * (-len(self.bits) % 8)
        return np.packbits(np.array(self.bits, np.uint8)).tobytes()


def lpc_frame(x, number, coefs, precision, shift, wide, parts, ks):
    """An LPC frame; a parameter of None in ks is an escaped partition of 12 plain bits."""
    w, n, order = Writer(), len(x), len(coefs)
    for b in flac.frame_header(number, n):
        w.put(b, 8)
    w.put((32 + order - 1) << 1, 8)
    for v in x[:order]:
        w.put(v & 255, 8)
    w.put(precision - 1, 4)
    w.put(shift, 5)
    for c in coefs:
        w.put(c & (1 << precision) - 1, precision)
    w.put(wide, 2)
    w.put(parts, 4)
    size = n >> parts
    for p in range(1 << parts):
        k = ks[p]
        w.put((1 << (4 + wide)) - 1 if k is None else k, 4 + wide)
        if k is None:
            w.put(12, 5)
        for i in range(max(order, p * size), (p + 1) * size):
            r = x[i] - (sum(c * x[i - 1 - j] for j, c in enumerate(coefs)) >> shift)
            if k is None:
                w.put(r & 4095, 12)
            else:
                w.rice(r, k)
    body = w.bytes()
    crc = 0
    for b in body:
        crc = ((crc << 8) & 0xFFFF) ^ int(flac.CRC16[(crc >> 8) ^ b])
    return body + struct.pack(">H", crc)


def stream(frames, sizes, x, seek):
    info = struct.pack(">HH", 64, 64) + b"\0" * 6 + (8000 << 44 | 7 << 36 | len(x)).to_bytes(8, "big") + hashlib.md5(np.array(x, np.int8).tobytes()).digest()
    out = b"fLaC" + (b"\0" if seek else b"\x80") + len(info).to_bytes(3, "big") + info
    if seek:
        t = b"".join(struct.pack(">QQH", sum(sizes[:i]), sum(map(len, frames[:i])), sizes[i]) for i in range(len(frames)))
        out += b"\x83" + len(t).to_bytes(3, "big") + t
    return out + b"".join(frames)


@pytest.mark.parametrize("seek", [True, False])
def test_linear_prediction_partitions_and_escapes(seek):
    rng = random.Random(2)
    x = [int(90 * np.sin(i / 5)) + rng.randrange(-9, 9) for i in range(64 * 3)]
    frames = [
        lpc_frame(x[:64], 0, [7, -4], 5, 2, 0, 2, [3, 0, None, 4]),
        lpc_frame(x[64:128], 1, [3], 4, 1, 1, 0, [2]),
        lpc_frame(x[128:], 2, [6, -3, 1, -1, 2], 6, 2, 1, 1, [None, 1]),
    ]
    ((pcm, blocks),) = flac.decode([stream(frames, [64] * 3, x, seek)])
    assert pcm.tolist() == x and [b[0] for b in blocks] == [0, 64, 128] and [b[3] for b in blocks] == [33, 32, 36]


def test_round_trips_and_known_checksums():
    rng = np.random.default_rng(5)
    texts = [b"", b"a", b"x" * 63, b"y" * 64, b"z" * 65, "ünï¢ode ✓ ".encode() * 300, bytes(range(256)) * 20, rng.integers(0, 256, 9000, np.uint8).tobytes(), b"\0\xff" * 2000, b"The quick brown fox. " * 3000]
    payloads = [flac.payload(t) for t in texts]
    assert [len(p) for p in payloads[:5]] == [64, 64, 64, 64, 128]
    stored = flac.encode(payloads)
    assert stored == [flac.encode([p])[0] for p in payloads]
    kinds = set()
    for p, s, (pcm, blocks) in zip(payloads, stored, flac.decode(stored)):
        assert (pcm.view(np.uint8) ^ 128).tobytes() == p
        assert blocks[0][0] == 0 and sum(b[1] for b in blocks) == len(p)
        assert all(s[b[2] : b[2] + 2] == b"\xff\xf8" for b in blocks)
        kinds |= {b[3] for b in blocks}
    assert {flac.CONSTANT, flac.VERBATIM, flac.FIXED, flac.FIXED + 1} <= kinds
    assert flac.crc8(b"123456789") == 0xF4
    assert flac.crc16(np.frombuffer(b"123456789", np.uint8), np.array([0]), np.array([9]))[0] == 0xFEE8
    assert flac.coded_number(0x7F) == b"\x7f" and flac.coded_number(0x20AC) == "€".encode() and len(flac.coded_number(2**31)) == 7
    assert flac.parse_header(flac.frame_header(2**31 + 5, 300) + b"\0" * 8)[1:] == (2**31 + 5, 300)


def test_spaced_seek_points(monkeypatch):
    """Texts too long for a point per frame: the table keeps to its bound and the stream is read back all the same."""
    monkeypatch.setattr(flac, "MOST_POINTS", 3)
    texts = [b"some text, again and again. " * n for n in (1, 60, 500)]
    payloads = [flac.payload(t) for t in texts]
    stored = flac.encode(payloads)
    assert all(len(flac.read_metadata(s)[3]) <= 3 for s in stored)
    for p, (pcm, blocks) in zip(payloads, flac.decode(stored)):
        assert (pcm.view("uint8") ^ 128).tobytes() == p and [b[0] for b in blocks] == list(range(0, len(p), flac.BLOCK))


def test_damage_is_found():
    s = bytearray(flac.encode([flac.payload(b"some words " * 500)])[0])
    for at in (len(s) - 1, len(s) - 700, len(s) // 2):
        bad = bytearray(s)
        bad[at] ^= 4
        with pytest.raises(ValueError):
            flac.decode([bytes(bad)])


def test_rows(docs):
    long = "lorem ipsum " * 100000
    df = docs([(1, None), (2, ""), (3, "abc"), (3, "abc"), (None, "é"), (4, long)])
    got = {}
    for r in flac.digest(df).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert got[1][0].payload_sha256 == hashlib.sha256(b"\0" * 64).hexdigest() and got[1][0][1:] == got[2][0][1:] and got[1][0].n_bytes == 0
    assert got[3][0] == got[3][1] and got[None][0].n_bytes == 2
    p = flac.payload(long.encode())
    r = got[4][0]
    assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    stored = flac.media(df)
    assert {x.doc_id: (len(x.flac), hashlib.sha256(x.flac).hexdigest()) for x in stored.collect()}[4] == (r.media_bytes, r.media_sha256)
    blocks = sorted(flac.pcm_blocks(stored).where("doc_id = 4").collect(), key=lambda b: b.block)
    assert b"".join(bytes(b.pcm) for b in blocks) == (np.frombuffer(p, np.uint8) ^ 128).tobytes() and [b.sample_offset for b in blocks] == list(range(0, len(p), flac.BLOCK))
    assert flac.digest(docs([])).count() == 0 and flac.pcm_blocks(flac.media(docs([]))).count() == 0
