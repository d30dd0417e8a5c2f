"""Best-fit decreasing packing of tokenised documents into sequences of a fixed capacity.

Best-fit decreasing depends on the lengths alone, so pieces of one length are interchangeable: a histogram of at most
`capacity` lengths decides the packing, however many documents there are. The driver runs best-fit decreasing over
that histogram; a segment tree over remaining capacities finds the tightest open bin in O(log capacity), and equal
pieces that fall on equal bins are placed at once. This gives the very bins of the one-by-one algorithm. Each step
yields a rule "pieces of length L with ranks lo.. go to sequences s.., so many each, from this place on". A length
splits at most two ranges of bins and a bin holds at most 63 different lengths (1 + 2 + .. + 63 < 2048), which bounds
the rules by 4 * capacity * 63 whatever the input is: they are safe to send to every task.

Executors tokenise, rank their own pieces per length and, after a prefix sum over per-task counts, look the rules up.
No shuffle moves texts or ids, and no task gathers more than its own split.

Null text is the empty text (one end-of-document id); repeated rows and repeated or null doc_ids are packed row by
row; a document longer than the capacity is cut into full pieces and a last, shorter one; an empty table gives an
empty result.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, cut, keeps, lean, pick, slices

CAPACITY = 2048


#: Punctuation that may end a chunk and is part of no special token; after a letter it always starts a pre-token.
TAIL = ".,;:!?$%*&#"
#: Words whose lower case and composed form are letter by letter: they take the fast path.
PLAIN = re.compile("[a-zà-öø-þ]+")


def fast_words(table: dict) -> tuple:
    """A byte-pair encoder for lower-case Latin words with the same merges, and which of its ids end a word.

    The vocabulary marks a word's last symbol; here that letter is in upper case instead, which normalised words never
    have. The encoder merges by the joined symbols' rank instead of by listed pairs. Inside a word that is the same if
    every token is what its own string encodes to: merges inside a token's span don't depend on what stands around it,
    so such a span can only come from the listed pairs. Tokens that fail this test never occur and are left out.
    """
    import tiktoken

    # The vocabulary file writes printable bytes as themselves and the others as characters from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    pairs = {tuple(m if isinstance(m, list) else m.split(" ")): n for n, m in enumerate(table["merges"])}
    ids = [table["vocab"][a + b] for a, b in pairs]
    if ids != sorted(set(ids)):
        raise ValueError("ids aren't in order of merging")
    own = set(range(97, 123)) | {0xC3} | set(range(0xA0, 0xBF))
    ranks, ends = {}, []
    for token, i in table["vocab"].items():
        body = token.removesuffix("</w>")
        end = body != token
        raw = bytes(byte[c] for c in body if c in byte)
        if raw and len(raw) == len(body) and set(raw) <= own and not (end and raw[-1] == 0xC3) and _derives(body, end, pairs):
            ranks[raw[:-1] + bytes([raw[-1] - 32]) if end else raw] = i
            ends += [i] * end
    return tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={}), np.array(ends)


def _derives(body: str, end: bool, order: dict[tuple[str, str], int]) -> bool:
    """Do the listed merges, lowest first, turn this string into one token?"""
    parts = [*body[:-1], body[-1] + "</w>" * end]
    while len(parts) > 1:
        rank, at = min((order.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank == 1 << 60:
            return False
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return True


class ChunkEncoder:
    """Token ids of texts by way of their chunks between ASCII white space.

    The vocabulary's pattern never crosses white space and its normaliser works character by character, so a text's
    ids are its chunks' ids joined; chunks repeat, and a bounded table keeps their ids as little-endian bytes. A new
    chunk that is a Latin word and punctuation goes to fast_words, any other one to the tokenizer.
    """

    def __init__(self, path: str, most: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one thread, and one thread's memory, per worker
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.chunks, self.tails = Tokenizer.from_file(path), most, {}, {"": b""}
        with open(path, encoding="utf-8") as f:
            self.words, ends = fast_words(json.load(f)["model"])
        self.is_end = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.is_end[ends] = True

    def _slow(self, chunks: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _learn(self, fresh: list[bytes]) -> None:
        words, stems, tails, odd = [], [], [], []
        for c in fresh:
            whole = c.decode()
            stem = whole.rstrip(TAIL)
            low = stem.lower()
            if PLAIN.fullmatch(low) and len(low) == len(stem):
                words.append(c)
                stems.append(low[:-1] + low[-1].upper())
                tails.append(whole[len(stem) :])
            else:
                odd.append(c)
        new = list(set(tails).difference(self.tails))
        self.tails.update(zip(new, self._slow(new), strict=True))
        if words:
            ids = np.array(self.words.encode_ordinary(" ".join(stems)), "<u4")
            raw, at = ids.tobytes(), 0
            for c, tail, to in zip(words, tails, (4 * np.flatnonzero(self.is_end[ids]) + 4).tolist(), strict=True):
                self.chunks[c] = raw[at:to] + self.tails[tail]
                at = to
        for at in range(0, len(odd), 5_000):
            some = odd[at : at + 5_000]
            self.chunks.update(zip(some, self._slow([c.decode() for c in some]), strict=True))
        if len(self.tails) > 20_000:
            self.tails = {"": b""}

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        parts = [t.split() for t in texts]
        words = set().union(*parts)
        if len(self.chunks) > self.most:
            self.chunks.clear()
        self._learn(list(words.difference(self.chunks)))
        look = self.chunks.__getitem__
        for p in parts:
            yield b"".join(map(look, p))


@lru_cache(1)
def encoder(path: str) -> ChunkEncoder:
    """One per Python worker, whatever the number of its tasks."""
    return ChunkEncoder(path)


keeps("packing", encoder.cache_clear)


class OpenBins:
    """Segment tree over remaining capacities: does any bin with this much room exist?"""

    def __init__(self, capacity: int):
        self.n = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.n)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def push(self, room: int, first: int, count: int) -> None:
        if count:
            self.ranges[room].append((first, count))
            self._set(room, 1)

    def pop(self, room: int) -> tuple[int, int]:
        out = self.ranges[room].pop()
        if not self.ranges[room]:
            self._set(room, 0)
        return out

    def _set(self, room: int, there: int) -> None:
        i = room + self.n
        self.tree[i] = there
        while i > 1:
            i >>= 1
            self.tree[i] = self.tree[2 * i] | self.tree[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest room >= least with an open bin."""
        i = least + self.n
        if self.tree[i]:
            return least
        while i > 1:
            if not i & 1 and self.tree[i + 1]:
                i += 1
                while i < self.n:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.n
            i >>= 1
        return None


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Rules (length, lo, hi, first sequence, pieces per sequence, offset) in order of (length, lo), and the sequences used."""
    bins, rules, used = OpenBins(capacity), [], 0
    for length in sorted(counts, reverse=True):
        left, lo = counts[length], 0
        while left:
            room = bins.tightest(length)
            if room is None:
                new = -(-left // (capacity // length))
                bins.push(capacity, used, new)
                used, room = used + new, capacity
            first, count = bins.pop(room)
            each = room // length
            full = min(count, left // each)
            if not full:
                full, each = 1, left
            rules.append((length, lo, lo + full * each, first, each, capacity - room))
            bins.push(room, first + full, count - full)
            if room - each * length:
                bins.push(room - each * length, first, full)
            lo, left = lo + full * each, left - full * each
    return np.array(sorted(rules), np.int64).reshape(-1, 6), used


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row per piece; part and place rank the pieces of one length inside a task."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("place", pa.int64())])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, seen, part = encoder(tokenizer), [0] * (capacity + 1), TaskContext.get().partitionId()
        for batch in slices(batches, most=1 << 20):
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), coder.encode(as_bytes(batch.column(1))), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    n = len(own) // 4
                    rows.append((doc, k, at // 4, n, zlib.crc32(own), part, seen[n]))
                    seen[n] += 1
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run, "packing"), PIECES)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with its sequence_id and offset."""
    own = cut(pieces(docs, tokenizer, capacity))
    per_task = own.groupBy("length", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per_task = cut(per_task.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0))))
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row per length: at most `capacity`
    rules, _ = best_fit(counts, capacity)
    stride = max(counts.values(), default=0) + 1  # (length, rank) as one sorted number; lengths * pieces stay far below 2**63
    keys = rules[:, 0] * stride + rules[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            rule = rules[np.searchsorted(keys, length * stride + rank, side="right") - 1]
            step = rank - rule[:, 1]
            yield pa.record_batch([*(b.column(i) for i in range(5)), pa.array(rule[:, 3] + step // rule[:, 4]), pa.array(rule[:, 5] + length * (step % rule[:, 4]))], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = own.join(per_task.drop("n"), ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("place") + F.col("base")).alias("rank"))
    return ranked.mapInArrow(lean(place, "packing"), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
