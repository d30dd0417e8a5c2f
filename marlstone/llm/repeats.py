"""Removal of repeated byte strings: ranks of doubled lengths at anchors, instead of prefix doubling over all positions.

Literal prefix doubling sorts a rank pair of every position at every round, which does not fit the disk limit (README).
What is kept of it: ranks of doubled lengths, and Spark's sorts of rank pairs at growing lengths; what differs: ranks
need no global numbering, and only anchors are sorted first, then what shares an anchor, then single starts.

A position's rank at length L names the L bytes that start there. Doubling names 2L bytes by the pair (rank at p, rank
at p + L); lengths between powers overlap the two halves. Positions whose rank is unique at some length are unique at
every greater one and leave; the threshold (100 bytes) ends the doubling. Ranks are 64-bit fingerprints of the pair
instead of dense numbers from a global sort: equal strings get equal ranks wherever they are, so the rounds up to 24
bytes need no shuffle, and Spark sorts (rank, position) pairs only where equal ranks must meet:

1. At 24 bytes, of every window of 77 positions only the one with the smallest rank is sorted (its anchor; a 100-byte
   string always holds one whole window, so equal strings have equal anchors at equal places; one position in 39 is
   an anchor). All string starts of an anchor with a unique rank are unique.
2. At an anchor's whole context, the bytes of all 100-byte strings that it stands for (100 to 176 of them): all starts
   of a context that has occurred before are repeats. If all contexts of an anchor are equal, the first one is new.
3. Contexts that share an anchor but differ: their bytes are sorted by anchor, and inside each anchor's group the rank
   pairs at 64 bytes, offset 36 (100 bytes), of all their starts; all but the first of each are repeats. An anchor
   with more than GROUP contexts is not taken by one task: its starts are sorted one by one, by their rank pairs.

Before each shuffle a task keeps the first occurrence of what it has itself seen and resolves the others on the spot,
so a passage in a third of all documents arrives once per task. An anchor with many different contexts in a task (a
line that many documents share) is dealt by context, with one marker row for the tasks where it is rare.

Results are exact up to collisions of 128-bit (contexts, strings) fingerprint pairs. Texts are shuffled once, by
document; step 3 and the final cut read the same exchange. Documents are cut into pieces of 256 k starts, so ranks need bounded memory.

Defined cases: null text is empty; strings never cross documents; a null doc_id comes last in the order; rows that
repeat a doc_id are put one after another by text hash, so the second of two equal rows is removed; empty tables give
no rows; texts under 100 bytes are kept as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, cut, lean, slices

LENGTH, ANCHOR = 100, 24
WINDOW = LENGTH - ANCHOR + 1
#: String starts per piece of text; different contexts of one anchor in a task before it is dealt by context; rows a
#: task combines at once; different contexts of one anchor before its starts are dealt one by one.
PIECE, MANY, COMBINE, GROUP = 1 << 18, 16, 1 << 21, 512
ROW, MARKER, KNOWN, REPEAT = 0, 1, 2, 3
DONE, BY_CONTEXT, BY_START = 0, 1, 2
LAST = 2**63 - 1
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= B
    h ^= h >> np.uint64(29)
    return h


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The rank of a pair of ranks."""
    return _mix(a * A + b)


def rank8(buf: np.ndarray) -> np.ndarray:
    """Ranks of the 8 bytes from each position of buf, which ends with 8 spare bytes."""
    return _mix(np.ndarray((len(buf) - 8,), "<u8", buf, strides=(1,)) * A)


def rank24(buf: np.ndarray) -> np.ndarray:
    """Ranks of 24 bytes, two rounds of doubling on; the tail of the array is not meaningful."""
    r = rank8(buf)
    r = pair(r[:-8], r[8:])
    return pair(r[:-8], r[8:])


def rank64(r24: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Ranks of 64 bytes at some positions: 24 + 24 (48), then 48 + 48 overlapping."""
    r48 = lambda x: pair(r24[x], r24[x + 24])
    return pair(r48(at), r48(at + 16))


def pieces(texts: list[bytes], length: int = LENGTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, first byte, starts, text offset, text number) arrays of pieces of texts, joined to about PIECE bytes at a time."""
    todo, size = [], 0
    for i, t in enumerate(texts):
        for a in range(0, len(t) - length + 1, PIECE):
            n = min(PIECE, len(t) - length + 1 - a)
            todo.append((t[a : a + n + length - 1], n, a, i))
            size += n + length
            if size >= PIECE:
                yield _joined(todo)
                todo, size = [], 0
    if todo:
        yield _joined(todo)


def _joined(todo: list) -> tuple:
    sizes = np.array([len(t) for t, _, _, _ in todo])
    buf = np.frombuffer(b"".join(t for t, _, _, _ in todo) + b"\0" * 128, np.uint8)
    return (buf, np.cumsum(sizes) - sizes, *(np.array([x[j] for x in todo]) for j in (1, 2, 3)))


def anchors(buf: np.ndarray, first: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each anchor: rank, context rank, place of its first start in buf, number of starts, and the piece it is in."""
    r = rank24(buf)
    place = np.uint64((1 << 22) - 1)
    v = (r & ~place) | np.arange(len(r), dtype=np.uint64)
    step = 1
    while 2 * step <= WINDOW:
        v = np.minimum(v[:-step], v[step:])
        step *= 2
    v = np.minimum(v[: len(v) - (WINDOW - step)], v[WINDOW - step :])
    valid = np.zeros(len(v) + 1, np.int8)
    np.add.at(valid, first, 1)
    np.add.at(valid, np.minimum(first + starts, len(v)), -1)
    at = np.flatnonzero(np.cumsum(valid[:-1], dtype=np.int8))
    x = (v[at] & place).astype(np.int64)
    new = np.flatnonzero(np.diff(x, prepend=-1))
    x, begin = x[new], at[new]
    n = np.diff(np.append(new, len(at)))
    size = n + LENGTH - 1
    context = pair(pair(rank64(r, begin), rank64(r, begin + (size - 64) // 2)), rank64(r, begin + size - 64) ^ _mix((size << 8 | x - begin).astype(np.uint64)))
    return r[x].view(np.int64), context.view(np.int64), begin, n, np.searchsorted(first, begin, side="right") - 1


def _first_seen(names: tuple[np.ndarray, ...], doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Row numbers in order of (names, doc, start)."""
    if len(doc) > 1 and not ((doc[1:] > doc[:-1]) | ((doc[1:] == doc[:-1]) & (start[1:] >= start[:-1]))).all():
        order = np.lexsort((start, doc))
    else:
        order = np.arange(len(doc))
    for name in reversed(names):
        order = order[np.argsort(name[order], kind="stable")]
    return order


def _runs(doc: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Adjoining stretches of starts joined."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], (start + n)[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > end[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc))[: len(first)] - 1
    return doc[first], start[first], end[last] - start[first]


def _combined(key, context, doc, start, n) -> Iterator[pa.RecordBatch]:
    """What a task sends of the anchors it has seen: first contexts, markers, and repeats that are already certain."""
    order = _first_seen((key, context), doc, start)
    key, context, doc, start, n = (x[order] for x in (key, context, doc, start, n))
    old = np.zeros(len(key), bool)
    old[1:] = (key[1:] == key[:-1]) & (context[1:] == context[:-1])
    out = [[], [], [], []]

    def send(k, c, d, s, m, flag):
        for col, x in zip(out, (k, c, d, (s << 9) | (m << 2) | flag), strict=True):
            col.append(x)

    d, s, m = _runs(doc[old], start[old], n[old])
    for col, x in zip(out, (_mix(d.astype(np.uint64)).view(np.int64) ^ s, m, d, (s << 9) | REPEAT), strict=True):
        col.append(x)
    key, context, doc, start, n = (x[~old] for x in (key, context, doc, start, n))
    first = np.flatnonzero(np.diff(key, prepend=key[:1] - 1)) if len(key) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(first, len(key)))
    common = np.repeat(sizes > MANY, sizes)
    send(key[~common], context[~common], doc[~common], start[~common], n[~common], ROW)
    dealt = pair(key[common].view(np.uint64), context[common].view(np.uint64)).view(np.int64)
    send(dealt, context[common], doc[common], start[common], n[common], KNOWN)
    mark = first[sizes > MANY]
    send(key[mark], context[mark], doc[mark], start[mark], n[mark], MARKER)
    cols = [np.concatenate(x) for x in out]
    for at in range(0, len(cols[0]), 1 << 16):
        yield pa.record_batch([pa.array(c[at : at + (1 << 16)]) for c in cols], names=["key", "context", "doc", "at"])


def _anchor_rows(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in slices(batches):
            ids = b.column(0).to_numpy()
            for buf, first, starts, offset, text in pieces(as_bytes(b.column(1))):
                key, context, begin, n, piece = anchors(buf, first, starts)
                held.append((key, context, ids[text[piece]], begin - first[piece] + offset[piece], n))
                size += len(key)
            if size >= COMBINE:
                yield from _combined(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, size = [], 0
        if size:
            yield from _combined(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return docs.mapInArrow(lean(run), "key long, context long, doc long, at long")


def _sorted_groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[list[np.ndarray]]:
    """Columns of sorted batches, cut so that rows equal in the first n_keys columns stay together."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [c.to_numpy() for c in b.columns]
        change = np.zeros(len(cols[0]), bool)
        for i in range(n_keys):
            change[1:] |= cols[i][1:] != cols[i][:-1]
            if held:
                change[0] |= cols[i][0] != held[-1][i][-1]
        if not change.any():
            held.append(cols)
            continue
        to = int(np.flatnonzero(change)[-1])
        held.append([c[:to] for c in cols])
        yield [np.concatenate(x) for x in zip(*held, strict=True)]
        held = [[c[to:] for c in cols]]
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _ranked_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (key, context, doc, at) to stretches of starts: repeats (DONE), or to be ranked on, and how."""
    for key, context, doc, at in _sorted_groups(batches, 1):
        flag, n, start = at & 3, at >> 2 & 127, at >> 9
        sure = flag == REPEAT
        n = np.where(sure, context, n)
        new_key = np.ones(len(key), bool)
        new_key[1:] = key[1:] != key[:-1]
        new_context = new_key.copy()
        new_context[1:] |= context[1:] != context[:-1]
        group = np.cumsum(new_key) - 1
        contexts = np.bincount(group, new_context)
        common = (np.bincount(group, (flag == MARKER) | (flag == KNOWN)) > 0) | (contexts > GROUP)  # alike for all rows of an anchor
        probe = new_context & ((contexts > 1) | common)[group] & ((flag == ROW) | (flag == KNOWN))
        some = (~new_context & (flag != MARKER)) | sure | probe
        how = np.where(probe & ~sure, np.where(common[group], BY_START, BY_CONTEXT), DONE).astype(np.int32)
        if some.any():
            yield pa.record_batch([pa.array(x[some]) for x in (doc, start, n, how)], names=["doc", "start", "n", "how"])


def _to_rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, rest, text, stretches) to rows to sort: contexts (key: the anchor's rank; n starts; their bytes) and
    single starts (key, second: the rank pair; n = 0), of which a task sends the first of each and repeats (n = -length)."""
    names = ["key", "second", "doc", "start", "n", "bytes"]
    held: list[tuple] = []

    def starts() -> Iterator[pa.RecordBatch]:
        r1, r2, doc, start = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((start, doc, r2, r1))
        r1, r2, doc, start = r1[order].view(np.int64), r2[order].view(np.int64), doc[order], start[order]
        old = np.zeros(len(r1), bool)
        old[1:] = (r1[1:] == r1[:-1]) & (r2[1:] == r2[:-1])
        d, s, n = _runs(doc[old], start[old], np.ones(int(old.sum()), np.int64))
        cols = [np.concatenate(x) for x in ((r1[~old], _mix(d.astype(np.uint64) + A).view(np.int64) ^ s), (r2[~old], s), (doc[~old], d), (start[~old], s), (np.zeros(int((~old).sum()), np.int64), -n))]
        for at in range(0, len(cols[0]), 1 << 16):
            part = [pa.array(c[at : at + (1 << 16)]) for c in cols]
            yield pa.record_batch([*part, pa.nulls(len(part[0]), pa.binary())], names=names)
        held.clear()

    for b in slices(batches):
        out: list[tuple] = []
        for doc, text, spans in zip(b.column(0).to_pylist(), as_bytes(b.column(2)), b.column(3), strict=True):
            own = spans.values
            order = np.argsort(own.field(0).to_numpy(), kind="stable")
            start, n, how = (own.field(i).to_numpy()[order] for i in range(3))
            for piece in np.unique(start // PIECE).tolist():
                base = piece * PIECE
                r = rank24(np.frombuffer(text[base : base + PIECE + 2 * LENGTH] + b"\0" * 128, np.uint8))
                here = start // PIECE == piece
                for s, m in zip(start[here & (how == BY_CONTEXT)].tolist(), n[here & (how == BY_CONTEXT)].tolist(), strict=True):
                    # The anchor has the smallest rank of the positions that all the stretch's windows share.
                    out.append((int(r[s - base + m - 1 : s - base + WINDOW].min().view(np.int64)), 0, doc, s, m, text[s : s + m + LENGTH - 1]))
                s, m = start[here & (how == BY_START)], n[here & (how == BY_START)]
                if len(s):
                    at = np.repeat(s - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
                    held.append((rank64(r, at - base), rank64(r, at - base + LENGTH - 64), np.full(len(at), doc), at))
        if out:
            yield pa.record_batch([pa.array([x[i] for x in out], pa.binary() if i == 5 else pa.int64()) for i in range(6)], names=names)
        if sum(len(h[0]) for h in held) >= COMBINE:
            yield from starts()
    if held:
        yield from starts()


def _starts(contexts: list[bytes], doc: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rank pairs at 64 bytes, offset 36, of all string starts of some contexts, their documents, starts and row numbers."""
    sizes = np.array([len(x) for x in contexts])
    first = np.cumsum(sizes) - sizes
    r = rank24(np.frombuffer(b"".join(contexts) + b"\0" * 128, np.uint8))
    row = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at = first[row] + step
    return rank64(r, at), rank64(r, at + LENGTH - 64), doc[row], start[row] + step, row


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _to_rank in order of (key, second, doc, start) to stretches of repeated starts."""

    def stretches(doc, start, n=None) -> pa.RecordBatch:
        return pa.record_batch([pa.array(x) for x in _runs(doc, start, np.ones(len(doc), np.int64) if n is None else n)], names=["doc", "start", "n"])

    def rank(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        key, second, doc, start, n = (whole.column(i).to_numpy() for i in range(5))
        yield stretches(doc[n < 0], start[n < 0], -n[n < 0])
        i = np.flatnonzero(n == 0)
        if len(i):
            old = np.zeros(len(i), bool)
            old[1:] = (key[i[1:]] == key[i[:-1]]) & (second[i[1:]] == second[i[:-1]])
            yield stretches(doc[i[old]], start[i[old]])
        i = np.flatnonzero(n > 0)
        if len(i):
            r1, r2, d, s, row = _starts(whole.column(5).take(pa.array(i)).to_pylist(), doc[i], start[i], n[i])
            r1 ^= _mix(key[i].view(np.uint64)[row] * A)  # keeps groups apart
            order = np.lexsort((s, d, r2, r1))
            r1, r2, d, s = r1[order], r2[order], d[order], s[order]
            old = np.zeros(len(r1), bool)
            old[1:] = (r1[1:] == r1[:-1]) & (r2[1:] == r2[:-1])
            yield stretches(d[old], s[old])

    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column(0).to_numpy()
        to = int(np.searchsorted(key, key[-1]))
        if to or held and held[-1].column(0)[-1].as_py() != key[0]:
            if to:
                held.append(b.slice(0, to))
            yield from rank(held)
            held = []
        held.append(b.slice(to))
    if held:
        yield from rank(held)


def _numbered(docs: DataFrame, rest: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """doc (unique, in the order of doc_id), rest (a struct of the columns to keep), text."""
    own = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest"), F.col("`text`"))
    if own.groupBy("doc_id").count().where("count > 1").isEmpty():
        return own.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), "rest", "text")
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    return cut(own.repartitionByRange(*order).sortWithinPartitions(*order).select(F.monotonically_increasing_id().alias("doc"), "rest", "text"))


def repeated_starts(numbered: DataFrame) -> DataFrame:
    """(doc, spans): stretches (start, n) of string starts that have occurred before, for documents that have any."""
    order = ("key", "context", "doc", "at")
    found = cut(_anchor_rows(numbered.select("doc", "text")).repartition("key").sortWithinPartitions(*order).mapInArrow(lean(_ranked_contexts), "doc long, start long, n long, how int"))
    lists = found.where(f"how <> {DONE}").groupBy("doc").agg(F.collect_list(F.struct("start", "n", "how")).alias("spans"))
    probes = numbered.join(lists, "doc").select("doc", "rest", "text", "spans")
    to_rank = probes.mapInArrow(lean(_to_rank), "key long, second long, doc long, start long, n long, bytes binary")
    order = ("key", "second", "doc", "start")
    ranked = to_rank.repartition("key").sortWithinPartitions(*order).mapInArrow(lean(_ranked), "doc long, start long, n long")
    every = found.where(f"how = {DONE}").select("doc", "start", "n").union(ranked)
    return every.groupBy("doc").agg(F.collect_list(F.struct("start", "n")).alias("spans"))


def _cut_spans(size: int, spans: pa.StructArray) -> list[tuple[int, int]]:
    """Maximal removed runs (from, to) of a text of this size."""
    start, n = (spans.field(i).to_numpy() for i in (0, 1))
    order = np.argsort(start, kind="stable")
    start, end = start[order], (start + n)[order] + LENGTH - 1
    reach = np.maximum.accumulate(end)
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return list(zip(start[first].tolist(), reach[np.append(first[1:], len(start)) - 1].tolist(), strict=True))


def _kept(text: bytes, spans) -> tuple[bytes, list[tuple[int, int]]]:
    if not spans.is_valid:
        return text, []
    gone, parts, at = _cut_spans(len(text), spans.values), [], 0
    for a, b in gone:
        parts.append(text[at:a])
        at = b
    return b"".join([*parts, text[at:]]), gone


def _with_spans(docs: DataFrame, rest: tuple[str, ...]) -> DataFrame:
    numbered = _numbered(docs, rest)
    return numbered.join(repeated_starts(numbered), "doc", "left").select("rest", "text", "spans")


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, text, kept (the remaining bytes), spans (array of removed runs) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
        for b in slices(batches):
            rows = [_kept(t, s) for t, s in zip(as_bytes(b.column(1)), b.column(2), strict=True)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array([r[0] for r in rows], pa.binary()), pa.array([[{"from": x, "to": y} for x, y in r[1]] for r in rows], kind)], names=["doc_id", "text", "kept", "spans"])

    joined = _with_spans(docs, ("doc_id",)).select(F.col("rest.doc_id").cast("long").alias("doc_id"), "text", "spans")
    return joined.mapInArrow(lean(run), "doc_id long, text string, kept binary, spans array<struct<from: long, to: long>>")


def without_repeats(docs: DataFrame) -> DataFrame:
    """Every row with its own columns, its text without the repeats (characters cut in two go with them) and, if there is
    such a column, n_chars counted anew; texts without a repeat are untouched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts, spans = b.column(1), b.column(2)
            new = [_kept(t, s)[0].decode(errors="ignore") if s.is_valid else None for t, s in zip(as_bytes(texts), spans, strict=True)]
            text = pa.array([o if n is None else n for o, n in zip(texts.to_pylist(), new, strict=True)], pa.string())
            size = pa.array([None if n is None else len(n) for n in new], pa.int64())
            yield pa.record_batch([b.column(0), text, size], names=["rest", "text", "n"])

    names = tuple(docs.columns)
    rest = tuple(c for c in names if c != "text")
    joined = _with_spans(docs, rest)
    out = joined.mapInArrow(lean(run), T.StructType([joined.schema["rest"], T.StructField("text", T.StringType()), T.StructField("n", T.LongType())]))
    own = {c: F.col("rest").getField(c) for c in rest} | {"text": F.col("text")}
    if "n_chars" in own:
        own["n_chars"] = F.coalesce(F.col("n").cast(docs.schema["n_chars"].dataType), own["n_chars"])
    return out.select(*[own[c].alias(c) for c in names])


def digest(docs: DataFrame) -> DataFrame:
    joined = _with_spans(docs, ("doc_id",)).select(F.col("rest.doc_id").cast("long").alias("doc_id"), "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = as_bytes(b.column(1))
            rows = [_kept(t, s) for t, s in zip(texts, b.column(2), strict=True)]
            yield pa.record_batch([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(t) - len(k) for t, (k, _) in zip(texts, rows, strict=True)], pa.int64()), pa.array([len(g) for _, g in rows], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k, _ in rows], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.mapInArrow(lean(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
