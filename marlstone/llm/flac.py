"""FLAC media columns: whole texts stored as 8-bit mono FLAC streams, read back by frames, and PCM blocks.

Writing: a payload byte b is the signed sample b - 128. Frames of 1024 samples take the cheapest of a constant, a
verbatim, or a fixed linear predictor of order 0 to 2 with Rice-coded residuals; each frame ends with its CRC-16 and
the stream starts with the MD5 of its samples and a seek table with one point (sample number, byte offset, samples)
per frame.

Reading: the seek table gives every frame's place, so the frames of many streams are decoded side by side: one NumPy
step reads the next Rice code of every frame at once. Frame headers (CRC-8), frames (CRC-16), linear predictors
(fixed orders 0 to 4 and quantised LPC), Rice partitions with either parameter size, escaped partitions, constants and
verbatim blocks are understood, and the samples' MD5 is compared. A stream without a seek table is read frame by frame.
Mono streams of 8 bits without wasted bits are the format's unit here; others raise ValueError, as does any checksum.

Work goes by groups of GROUP frames, so memory beyond a document's own stream does not grow with it. No shuffle.

Defined cases: null text is the empty text, whose payload is 64 zero bytes; repeated rows and null doc_ids keep their
rows; an empty table gives no rows; equal texts give equal streams and features.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, pick, slices

BLOCK, RATE, UNIT, GROUP = 1024, 8000, 64, 2048
CONSTANT, VERBATIM, FIXED, LPC = 0, 1, 8, 32
SEEK = np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])
#: Seek points that fit into a metadata block.
MOST_POINTS = (2**24 - 1) // SEEK.itemsize


def _crc_table(poly: int, bits: int) -> np.ndarray:
    top, mask, out = 1 << (bits - 1), (1 << bits) - 1, []
    for c in range(256):
        c <<= bits - 8
        for _ in range(8):
            c = ((c << 1) ^ poly if c & top else c << 1) & mask
        out.append(c)
    return np.array(out, np.uint32)


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
LEADING = np.array([16 - i.bit_length() for i in range(1 << 16)], np.int64)


def crc8(data: bytes) -> int:
    c = 0
    for x in data:
        c = int(CRC8[c ^ x])
    return c


def crc16(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-16 of many stretches of buf, one byte of each per step."""
    order = np.argsort(-lengths, kind="stable")
    at, left = starts[order].copy(), lengths[order]
    crc = np.zeros(len(at), np.uint32)
    alive = np.searchsorted(-left, -np.arange(1, (left[0] if len(left) else 0) + 1), side="right")
    for n in alive.tolist():
        c = crc[:n]
        crc[:n] = ((c << np.uint32(8)) & np.uint32(0xFFFF)) ^ CRC16[(c >> np.uint32(8)) ^ buf[at[:n]]]
        at[:n] += 1
    out = np.empty_like(crc)
    out[order] = crc
    return out


def coded_number(n: int) -> bytes:
    """The frame number, coded as UTF-8 codes a character."""
    if n < 0x80:
        return bytes([n])
    tail = []
    room = 6
    while n >= 1 << room:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        room -= 1
    return bytes([(0xFF << (room + 1)) & 0xFF | n, *reversed(tail)])


@lru_cache(4096)
def frame_header(number: int, n: int) -> bytes:
    code, extra = (10, b"") if n == BLOCK else (6, bytes([n - 1])) if n <= 256 else (7, struct.pack(">H", n - 1))
    head = bytes([0xFF, 0xF8, code << 4 | 4, 0b0000_0010]) + coded_number(number) + extra
    return head + bytes([crc8(head)])


def _frames(blocks: list[bytes], headers: list[bytes]) -> list[bytes]:
    """Whole frames for these blocks of payload bytes."""
    sizes = np.array([len(b) for b in blocks])
    n_frames, width = len(blocks), int(sizes.max())
    column = np.arange(width)
    inside = column < sizes[:, None]
    samples = np.zeros((n_frames, width), np.int16)
    samples[inside] = np.frombuffer(b"".join(blocks), np.uint8).astype(np.int16) - 128
    folded, params, costs = [], [], []
    r = samples
    for order in range(3):
        if order:
            r = np.diff(r, axis=1, prepend=np.int16(0))
        u = ((r << 1) ^ (r >> 15)).view(np.uint16)
        u = np.where(inside, u, 0)
        u[:, :order] = 0
        n = np.maximum(sizes - order, 0)
        mean = u.sum(axis=1, dtype=np.int64) / np.maximum(n, 1)
        k = np.clip(np.floor(np.log2(np.maximum(mean * 0.7, 1))).astype(np.int64), 0, 13)
        bits = [(u >> x.astype(np.uint16)[:, None]).sum(axis=1, dtype=np.int64) + n * (x + 1) for x in (k, k + 1)]
        folded.append(u)
        params.append(np.where(bits[1] < bits[0], k + 1, k))
        costs.append(np.where(sizes > order, np.minimum(*bits) + 8 * order + 10, 1 << 40))
    order = np.array(costs).argmin(axis=0)
    u, k, coded_bits = np.choose(order[:, None], folded), np.choose(order, params), np.choose(order, costs)
    constant = (samples.max(axis=1, initial=-128, where=inside) == samples.min(axis=1, initial=127, where=inside))
    raw = ~constant & (coded_bits >= 8 * sizes)
    rice = np.flatnonzero(~constant & ~raw)
    head = np.array([len(h) for h in headers])
    length = head + 1 + np.where(constant, 1, np.where(raw, sizes, (coded_bits + 7) // 8)) + 2
    at = np.cumsum(length) - length
    first = at + head + 1
    total = int(length.sum())
    words = np.zeros(total // 4 + 2)
    if len(rice):
        o, kk = order[rice], k[rice]
        coded = (inside & (column >= order[:, None]))[rice]
        ur = u[rice].astype(np.int64)
        size = np.where(coded, (ur >> kk[:, None]) + (kk + 1)[:, None], 0)
        last = (np.cumsum(size, axis=1) + ((first[rice] * 8) + 8 * o + 10 - 1)[:, None])[coded]
        low = ((ur & ((1 << kk) - 1)[:, None]) | (1 << kk)[:, None])[coded]
        # The Rice parameter (4 bits, after two fields of zeros) is one more code that ends right before the residuals.
        last, low = np.concatenate([last, first[rice] * 8 + 8 * o + 9]), np.concatenate([low, kk])
        low = low << (31 - (last & 31))
        word = last >> 5
        words += np.bincount(word, (low & 0xFFFFFFFF).astype(np.float64), len(words))
        words[:-1] += np.bincount(word, (low >> 32).astype(np.float64), len(words))[1:]
    packed = words.astype(">u4").view(np.uint8)
    unsigned = (samples & 255).astype(np.uint8)
    for i in np.flatnonzero(raw).tolist():
        packed[first[i] : first[i] + sizes[i]] = unsigned[i, : sizes[i]]
    for j in range(2):
        own = rice[order[rice] > j]
        packed[first[own] + j] = unsigned[own, j]
    packed[first[constant]] = unsigned[constant, 0]
    packed[at + head] = np.where(constant, CONSTANT, np.where(raw, VERBATIM, FIXED + order)) << 1
    joined = np.frombuffer(b"".join(headers), np.uint8)
    packed[np.repeat(at - (np.cumsum(head) - head), head) + np.arange(len(joined))] = joined
    crc = crc16(packed, at, length - 2)
    packed[at + length - 2], packed[at + length - 1] = crc >> 8, crc & 255
    whole = packed.tobytes()
    return [whole[a : a + n] for a, n in zip(at.tolist(), length.tolist(), strict=True)]


def encode(payloads: list[bytes]) -> list[bytes]:
    """One FLAC stream per payload (1 byte at least)."""
    frames: list[list[bytes]] = [[] for _ in payloads]
    todo = [(i, k) for i, p in enumerate(payloads) for k in range(-(-len(p) // BLOCK))]
    for at in range(0, len(todo), GROUP):
        part = todo[at : at + GROUP]
        blocks = [payloads[i][k * BLOCK : (k + 1) * BLOCK] for i, k in part]
        for (i, _), f in zip(part, _frames(blocks, [frame_header(k, len(b)) for (_, k), b in zip(part, blocks, strict=True)]), strict=True):
            frames[i].append(f)
    out = []
    for p, own in zip(payloads, frames, strict=True):
        lengths = [len(f) for f in own]
        step = -(-len(own) // MOST_POINTS)  # the table's length has three bytes: of very long texts every step-th frame has a point
        seek = np.zeros(-(-len(own) // step), SEEK)
        seek["sample"] = np.arange(0, len(own), step) * BLOCK
        seek["offset"] = (np.cumsum(lengths) - lengths)[::step]
        seek["n"] = [min(BLOCK, len(p) - k * BLOCK) for k in range(0, len(own), step)]
        pcm = np.frombuffer(p, np.uint8) ^ 128
        info = struct.pack(">HH", BLOCK, BLOCK) + min(lengths).to_bytes(3, "big") + max(lengths).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big") + hashlib.md5(pcm.tobytes()).digest()
        table = seek.tobytes()
        out.append(b"fLaC" + b"\0" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + b"".join(own))
    return out


@lru_cache(4096)
def parse_header(head: bytes) -> tuple[int, int, int]:
    """(header length, frame number, samples) from the first 16 bytes of a frame; ValueError if its CRC-8 is wrong."""
    if head[:2] != b"\xff\xf8":
        raise ValueError("no frame of fixed block size here")
    if head[3] & 0xF1 or head[3] >> 1 & 7 not in (0, 1):
        raise ValueError("only mono streams of 8 bits are read")
    at, number = 5, head[4]
    if number >= 0x80:
        more = 8 - (head[4] ^ 0xFF).bit_length() - 1
        number = head[4] & (1 << (6 - more)) - 1
        for x in head[5 : 5 + more]:
            number = number << 6 | x & 0x3F
        at += more
    code = head[2] >> 4
    if code == 6:
        n, at = head[at] + 1, at + 1
    elif code == 7:
        n, at = int.from_bytes(head[at : at + 2], "big") + 1, at + 2
    else:
        n = 192 if code == 1 else 576 << (code - 2) if code < 6 else 256 << (code - 8)
    at += {12: 1, 13: 2, 14: 2}.get(head[2] & 15, 0)
    if crc8(head[:at]) != head[at]:
        raise ValueError("a frame header's CRC-8 is wrong")
    return at + 1, number, n


class Bits:
    """Reads of up to 25 bits at many bit positions of one buffer at once."""

    def __init__(self, buf: np.ndarray):
        b = np.concatenate([buf, np.zeros(8, np.uint8)]).astype(np.uint32)
        self.words = b[:-3] << np.uint32(24) | b[1:-2] << np.uint32(16) | b[2:-1] << np.uint32(8) | b[3:]

    def top(self, at: np.ndarray) -> np.ndarray:
        return self.words[at >> 3] << (at & 7).astype(np.uint32)

    def read(self, at: np.ndarray, n) -> np.ndarray:
        return self.top(at).astype(np.int64) >> (32 - n)


def _signed(x: np.ndarray, bits) -> np.ndarray:
    return x - ((x >> (bits - 1) & 1) << bits)


def _residuals(bits: Bits, at: np.ndarray, sizes: np.ndarray, orders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Residuals (steps x frames, in the frames' order of size, largest first) and the bit after each frame's last one."""
    method, parts = bits.read(at, 2), bits.read(at + 2, 4)
    if (method > 1).any():
        raise ValueError("unknown residual coding")
    wide, span = 4 + method, sizes >> parts
    if ((span << parts) != sizes).any() or (span < orders).any():
        raise ValueError("partitions don't fit the block")
    at = at + 6
    steps = int(sizes.max())
    out = np.zeros((steps, len(sizes)), np.int64)
    k, raw = np.zeros(len(at), np.int64), np.full(len(at), -1)
    refresh = {0} | {int(x) for s, p in set(zip(span.tolist(), parts.tolist(), strict=True)) for x in range(0, s << p, s)} | {int(o) for o in np.unique(orders)}
    alive = np.searchsorted(-sizes, -np.arange(1, steps + 1), side="right").tolist()
    largest = int(orders.max())
    for i in range(steps):
        n = alive[i]
        if i in refresh:
            new = np.flatnonzero((np.arange(len(at)) < n) & (i >= orders) & ((i % span == 0) | (i == orders)))
            if len(new):
                k[new], at[new] = bits.read(at[new], wide[new]), at[new] + wide[new]
                escaped = k[new] == (1 << wide[new]) - 1
                raw[new] = -1
                if escaped.any():
                    e = new[escaped]
                    raw[e], k[e], at[e] = bits.read(at[e], 5), 0, at[e] + 5
        if i < largest or (raw >= 0).any():
            on = np.flatnonzero((i >= orders[:n]) & (raw[:n] < 0))
            plain = np.flatnonzero((i >= orders[:n]) & (raw[:n] > 0))
            if len(plain):
                out[i, plain] = _signed(bits.read(at[plain], raw[plain]), raw[plain])
                at[plain] += raw[plain]
            if len(on):
                p = at[on]
                out[i, on], at[on] = _codes(bits, p, k[on])
        else:
            out[i, :n], at[:n] = _codes(bits, at[:n], k[:n])
    return out, at


def _codes(bits: Bits, p: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The Rice code at each bit position, and the positions after them."""
    q = LEADING[bits.top(p) >> np.uint32(16)]
    if q.max(initial=0) >= 16:
        more = np.flatnonzero(q >= 16)
        while len(more):
            z = LEADING[bits.top(p[more] + q[more]) >> np.uint32(16)]
            q[more] += z
            more = more[z >= 16]
    p = p + q + 1
    u = q << k | bits.read(p, k)
    return u >> 1 ^ -(u & 1), p + k


def decode_frames(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray | None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Samples of each frame, its number, its subframe type and its length in bytes; checks both checksums.

    lengths None: unknown, so frames are only known to begin at starts.
    """
    whole = buf.tobytes()
    heads = [parse_header(whole[s : s + 16]) for s in starts.tolist()]
    head, number, sizes = (np.array(x, np.int64) for x in zip(*heads, strict=True))
    kind = buf[starts + head].astype(np.int64)
    if (kind & 0x81).any():
        raise ValueError("wasted bits or padding in a subframe")
    kind >>= 1
    body = (starts + head + 1) * 8
    if (((kind > 1) & (kind < FIXED)) | ((kind > FIXED + 4) & (kind < LPC))).any():
        raise ValueError("reserved subframe type")
    samples: list[np.ndarray] = [None] * len(starts)  # type: ignore[list-item]
    end = body + np.where(kind == CONSTANT, 8, 8 * sizes)
    for i in np.flatnonzero(kind < FIXED).tolist():
        b = int(body[i] >> 3)
        samples[i] = np.full(sizes[i], buf[b].astype(np.int8)) if kind[i] == CONSTANT else buf[b : b + int(sizes[i])].view(np.int8)
    coded = np.flatnonzero(kind >= FIXED)
    if len(coded):
        bits = Bits(buf)
        coded = coded[np.argsort(-sizes[coded], kind="stable")]
        order = np.where(kind[coded] >= LPC, kind[coded] - LPC + 1, kind[coded] - FIXED)
        first = body[coded]
        warm = np.zeros((int(order.max()), len(coded)), np.int64)
        for j in range(len(warm)):
            some = order > j
            warm[j, some] = _signed(bits.read(first[some] + 8 * j, 8), 8)
        at = first + 8 * order
        linear = kind[coded] >= LPC
        coefs, shift = {}, {}
        for c in np.flatnonzero(linear).tolist():
            one = at[c : c + 1]
            precision = int(bits.read(one, 4)[0]) + 1
            shift[c] = int(bits.read(one + 4, 5)[0])
            coefs[c] = [int(_signed(bits.read(one + 9 + precision * j, precision), precision)[0]) for j in range(int(order[c]))]
            at[c] += 9 + precision * int(order[c])
        rest, at = _residuals(bits, at, sizes[coded], order)
        rest[: len(warm)] += warm
        for o in range(1, 5):
            own = np.flatnonzero(~linear & (order == o))
            if len(own):
                rest[:, own] = _undo(rest[:, own], o)
        for c in coefs:
            x = rest[: int(sizes[coded[c]]), c].tolist()
            for i in range(int(order[c]), len(x)):
                x[i] += sum(a * b for a, b in zip(coefs[c], x[i - 1 :: -1], strict=False)) >> shift[c]
            rest[: len(x), c] = x
        flat = rest.astype(np.int8).T.copy()
        for c, i in enumerate(coded.tolist()):
            samples[i] = flat[c, : sizes[i]]
        end[coded] = at
    size = (end + 7) // 8 - starts + 2
    if lengths is not None and (size != lengths).any():
        raise ValueError("a frame doesn't end where the seek table has the next one")
    crc = crc16(buf, starts, size - 2)
    if (crc != (buf[starts + size - 2].astype(np.uint32) << np.uint32(8) | buf[starts + size - 1])).any():
        raise ValueError("a frame's CRC-16 is wrong")
    return samples, number, kind, size


def _undo(rest: np.ndarray, order: int) -> np.ndarray:
    """Samples from warm-up and residuals of a fixed predictor: repeated sums, each led by the warm-up's difference."""
    warm, d = rest[:order], rest[order:]
    for level in range(order - 1, -1, -1):
        d = np.cumsum(np.concatenate([np.diff(warm, n=level, axis=0)[-1:], d]), axis=0)[1:]
    return np.concatenate([warm, d])


def read_metadata(stream: bytes) -> tuple[int, bytes, int, np.ndarray]:
    """(samples, MD5, byte offset of the first frame, seek points)."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, total, md5, seek, last = 4, 0, b"", np.zeros(0, SEEK), False
    while not last:
        last, kind, n = stream[at] >> 7, stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        block = stream[at + 4 : at + 4 + n]
        if kind == 0:
            packed = int.from_bytes(block[10:18], "big")
            total, md5 = packed & (1 << 36) - 1, block[18:34]
            if packed >> 41 & 7 or (packed >> 36 & 31) != 7:
                raise ValueError("only mono streams of 8 bits are read")
        elif kind == 3:
            seek = np.frombuffer(block, SEEK)
        at += 4 + n
    return total, md5, at, seek


def decode(streams: list[bytes]) -> list[tuple[np.ndarray, list[tuple[int, int, int, int]]]]:
    """Each stream's samples (int8) and its blocks (sample offset, samples, byte offset, subframe type)."""
    info = [read_metadata(s) for s in streams]
    todo, whole = [], []
    for i, (s, (total, _, first, seek)) in enumerate(zip(streams, info, strict=True)):
        points = seek[seek["sample"] != 2**64 - 1]
        full = len(points) and int(points["n"].astype(np.int64).sum()) == total
        if full:
            at = (points["offset"].astype(np.int64) + first).tolist()
            todo += [(i, k, a, b) for k, (a, b) in enumerate(zip(at, [*at[1:], len(s)], strict=True))]
        else:
            whole.append(i)
    parts: list[list] = [[] for _ in streams]
    for g in range(0, len(todo), GROUP):
        group = todo[g : g + GROUP]
        buf = np.frombuffer(b"".join(streams[i][a:b] for i, _, a, b in group) + b"\0" * 16, np.uint8)
        lengths = np.array([b - a for _, _, a, b in group])
        samples, number, kind, _ = decode_frames(buf, np.cumsum(lengths) - lengths, lengths)
        for (i, k, a, _), x, n, t in zip(group, samples, number.tolist(), kind.tolist(), strict=True):
            if n != k:
                raise ValueError("frames out of order")
            parts[i].append((x, a, t))
    for i in whole:
        at, left = info[i][2], info[i][0]
        while left > 0:
            buf = np.frombuffer(streams[i][at : at + 64 * 1024 + 16] + b"\0" * 16, np.uint8)
            (x,), _, (t,), (n,) = decode_frames(buf, np.zeros(1, np.int64), None)
            parts[i].append((x, at, int(t)))
            at, left = at + int(n), left - len(x)
    out = []
    for own, (total, md5, _, _) in zip(parts, info, strict=True):
        pcm = np.concatenate([x for x, _, _ in own]) if own else np.zeros(0, np.int8)
        if len(pcm) != total or hashlib.md5(pcm.tobytes()).digest() != md5:
            raise ValueError("the samples' MD5 is wrong")
        sizes = [len(x) for x, _, _ in own]
        offsets = (np.cumsum(sizes) - sizes).tolist()
        out.append((pcm, [(o, n, a, t) for o, n, (_, a, t) in zip(offsets, sizes, own, strict=True)]))
    return out


def payload(text: bytes, unit: int = UNIT) -> bytes:
    return text + b"\0" * (max(unit, -(-len(text) // unit) * unit) - len(text))


def feature(pcm: np.ndarray, blocks: list[tuple[int, int, int, int]]) -> str:
    x = pcm.astype(np.int64)
    kinds = [t for _, _, _, t in blocks]
    return f"peak={int(np.abs(x).max())};sum={int(x.sum())};energy={int((x * x).sum())};steps={int(np.abs(np.diff(x)).sum())};blocks={len(blocks)};predicted={sum(t >= FIXED for t in kinds)}"


def media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, flac: the stored streams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=2 << 20):
            texts = as_bytes(b.column(1))
            yield pa.record_batch([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(encode([payload(t) for t in texts]), pa.binary())], names=["doc_id", "n_bytes", "flac"])

    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, flac binary")


def pcm_blocks(stored: DataFrame) -> DataFrame:
    """doc_id, block, sample_offset, n_samples, media_offset, pcm (signed 8-bit) of every frame of the stored streams; null streams give none."""
    schema = pa.schema([("doc_id", pa.int64()), ("block", pa.int64()), ("sample_offset", pa.int64()), ("n_samples", pa.int64()), ("media_offset", pa.int64()), ("pcm", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, column="flac", most=2 << 20):
            rows = [(d, k, o, n, a, pcm[o : o + n].tobytes()) for d, (pcm, blocks) in zip(b.column(0).to_pylist(), decode(b.column(1).to_pylist()), strict=True) for k, (o, n, a, _) in enumerate(blocks)]
            yield pa.record_batch([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    return pick(stored, "doc_id", "flac").where("flac is not null").mapInArrow(run, "doc_id long, block long, sample_offset long, n_samples long, media_offset long, pcm binary")


def digest(docs: DataFrame) -> DataFrame:
    """Store every text (`media`), read the stored streams back, and describe both."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, column="flac", most=2 << 20):
            rows, stored = [], b.column(2).to_pylist()
            for d, n, s, (pcm, blocks) in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), stored, decode(stored), strict=True):
                back = (pcm.view(np.uint8) ^ 128).tobytes()
                rows.append((d, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(s), hashlib.sha256(s).hexdigest(), feature(pcm, blocks)))
            yield pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(types)], names=names)

    return media(docs).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
