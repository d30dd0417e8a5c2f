"""SimHash near-duplicate classes by a byte-position inverted index with count filtering.

A fingerprint is eight positional bytes. Two fingerprints at `within` = 4 or fewer differing bits agree in at least
8 - 4 = 4 positions, so counting shared positional bytes and keeping pairs with 4 or more loses no link. Tallying one
posting list per single byte would meet a 256th of all pairs; instead the index is keyed by three positions at once.
Twenty triples of the eight positions (Turan's system for 8 points) are such that any four positions contain one of
them, so every pair that passes the count filter meets in at least one list, and a list is 2**-24 of the data. Inside
a list the shared positional bytes are tallied, pairs below the guaranteed minimum go, and the rest are verified bit
by bit; a union-find keeps one edge per member at most, so no pairs are written out.

Exact copies share a fingerprint and enter the index once. A list longer than `list_limit` (near copies by the ten
thousand) is never compared in one task: two words at distance 4 or less have a common word at distance 2 or less from
both, so its members are dealt by all words within 2 flips of the 40 bits they don't share, and each such word links
its members to the smallest one: linear, exact and pre-aggregated.

Defined cases: null text, or text without words, has fingerprint zero and is linked like any other. A null doc_id never
names a component unless all of its members are null. Repeated rows each keep a row. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LAST, as_bytes, cut, kept_rows, lean, pick, slices
from .components import components

WORDS, SEED, WITHIN, LIST_LIMIT = 4, 42, 4, 16384


def triples() -> list[tuple[int, int, int]]:
    """Three groups of positions in a ring: triples inside a group, or two of a group with one of the next."""
    rings = [(0, 1, 2), (3, 4, 5), (6, 7)]
    out = [t for g in rings for t in combinations(g, 3)]
    for g, after in zip(rings, rings[1:] + rings[:1], strict=True):
        out += [(*pair, x) for pair in combinations(g, 2) for x in after]
    return out


TRIPLES = triples()


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The signed 64-bit fingerprint of one text."""
    import xxhash

    parts = text.lower().split()  # bytes: lowers A-Z only, splits at space and U+0009 to U+000D only
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return int(np.uint64(xxhash.xxh64_intdigest(joined, SEED)).astype(np.int64))
    starts = [0, *accumulate(len(p) + 1 for p in parts)]
    h, view = xxhash.xxh64_intdigest, memoryview(joined)
    hashes = np.array([h(view[s : e - 1], SEED) for s, e in zip(starts, starts[words:], strict=False)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, a hash of the text, and the fingerprint of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.record_batch([b.column(0), b.column(2), pa.array([fingerprint(t, words) for t in as_bytes(b.column(1))], pa.int64())], names=["doc_id", "text_hash", "fp"])

    own = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash"))
    return own.mapInArrow(lean(run), "doc_id long, text_hash long, fp long")


def local_links(key: np.ndarray, fp: np.ndarray, within: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, smallest member of its part) for rows in order of (key, fp), lists being runs of one key."""
    root, changed = np.arange(len(key)), False
    rows = np.arange(len(key) - 1)
    step = 1
    while len(rows := rows[(rows + step < len(key))]) and len(rows := rows[key[rows] == key[rows + step]]):
        differ = fp[rows] ^ fp[rows + step]
        shared = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)  # the tally of shared positional bytes
        passed = np.flatnonzero(shared >= 8 - within)
        near = rows[passed[np.bitwise_count(differ[passed].view(np.uint64)) <= within]]
        near = near[root[near] != root[near + step]]
        for i in near.tolist():
            a, b = i, i + step
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            root[max(a, b)] = min(a, b)
            changed = True
        while len(near) and (root[root] != root).any():
            root = root[root]
        step += 1
    moved = np.flatnonzero(root != np.arange(len(key))) if changed else np.zeros(0, np.int64)
    return fp[moved], fp[root[moved]]


def links(distinct: DataFrame, within: int = WITHIN, list_limit: int = LIST_LIMIT) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (fp) that connect exactly what lies within `within` <= 4 bits."""
    if not 0 <= within <= 4:
        raise ValueError("the index of triples covers 4 differing bits at most")
    byte = lambda p: F.shiftright("fp", 8 * p).bitwiseAND(F.lit(255))
    keys = [F.lit(n << 24) + F.shiftleft(byte(a), 16) + F.shiftleft(byte(b), 8) + byte(c) for n, (a, b, c) in enumerate(TRIPLES)]
    index = distinct.select(F.explode(F.array(*keys)).alias("key"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a, b, key=None):
            n = len(a)
            return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()) if key is None else pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()) if key is None else pa.array(np.full(n, key), pa.int64())], names=["a", "b", "key"])

        key, fp, long = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for batch in batches:
            key, fp = np.concatenate([key, batch.column(0).to_numpy()]), np.concatenate([fp, batch.column(1).to_numpy()])
            if long is not None:
                n = int(np.searchsorted(key, long, side="right"))
                yield out(fp[:n], None, long)
                key, fp = key[n:], fp[n:]
            if not len(key):
                continue
            long, n = None, int(np.searchsorted(key, key[-1]))
            yield out(*local_links(key[:n], fp[:n], within))
            key, fp = key[n:], fp[n:]
            if len(key) > list_limit:
                long = int(key[0])
                yield out(fp, None, long)
                key, fp = key[:0], fp[:0]
        yield out(*local_links(key, fp, within))

    found = cut(index.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(lean(run), "a long, b long, key long"))
    edges, crowded = found.where("key is null").select("a", "b"), found.where("key is not null").select("key", F.col("a").alias("fp"))
    if not crowded.isEmpty():
        edges = edges.union(_by_midpoints(crowded, (within + 1) // 2))
    return edges


def _by_midpoints(crowded: DataFrame, radius: int) -> DataFrame:
    spark = crowded.sparkSession
    flips = []
    for n, triple in enumerate(TRIPLES):
        free = [b for p in range(8) if p not in triple for b in range(8 * p, 8 * p + 8)]
        for k in range(radius + 1):
            flips += [(n, int(np.array(sum(1 << b for b in c), np.uint64).astype(np.int64))) for c in combinations(free, k)]
    masks = F.broadcast(spark.createDataFrame(flips, "triple long, mask long"))  # 20 * 821 rows at most
    dealt = crowded.withColumn("triple", F.shiftright("key", 24)).join(masks, "triple").select("key", "fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("mid"))
    least = dealt.groupBy("key", "mid").agg(F.min("fp").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    return dealt.join(least, ["key", "mid"]).where("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b")).distinct()


def classes(docs: DataFrame, words: int = WORDS, within: int = WITHIN, list_limit: int = LIST_LIMIT) -> DataFrame:
    """doc_id, text_hash, fp, component_id and the component's root fingerprint for every row."""
    own = cut(fingerprints(docs, words))
    reps = cut(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(reps.select("fp"), within, list_limit)).withColumnRenamed("node", "fp")
    joined = reps.join(roots, "fp")
    named = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = joined.join(named, "root").select("fp", "root", "component_id")
    every = reps.join(linked, "fp", "left").select(F.bitwise_not("fp").alias("key"), F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "least").alias("component_id"))
    # By a key that neither side is dealt by: both sides get an exchange, and the adaptive join can split a fingerprint of many copies.
    return own.withColumn("key", F.bitwise_not("fp")).join(every, "key").select("doc_id", "text_hash", "fp", "component_id", "root")


def digest(docs: DataFrame) -> DataFrame:
    return classes(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, **how) -> DataFrame:
    """The documents with one row left of each component: the smallest doc_id (null last; then by text hash); of rows
    that are equal in id and text one stays."""
    least = F.min(F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("id"), F.col("text_hash").alias("hash"))).alias("m")
    return kept_rows(docs, classes(docs, **how).groupBy("root").agg(least).select("m.id", "m.hash"))
