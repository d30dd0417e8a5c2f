"""Near-duplicate removal by similarity, the pipeline's stage: one document of each group stays.

Two texts are linked if the sets of their distinct five-word shingles (ASCII lower case; fewer words: the whole
sequence) have a Jaccard similarity of 0.8 or more, compared shingle by shingle (up to collisions of 64-bit hashes).
Groups are what links connect. A node is a distinct set, so copies enter once.

1. Candidates. Op3's index (positional bytes, count filter, bits verified) links fingerprints of 4 or fewer differing
   bits; measured on 6151 pairs that is 7 % of those at similarity 0.80 to 0.85 and 49 % above 0.9, so a second index adds
   bands: BANDS keys of ROWS MinHash values each. A pair at 0.8 shares no key with probability (1 - 0.8 ** 5) ** 32,
   3 in a million, and less above. In a list a pair goes only if its sketches differ in more than DIFFER of 160 values,
   which a pair at 0.8 does with a probability below one in a million. What stays is a forest, one row per member of
   a list at most; its trees are no result, they only say which sets have to meet. A list above LIST members is
   linked as a whole instead: its tree may be larger than it must be, the result is the same.
2. Against a tree's centre, the member whose fingerprint is nearest to the majority of each bit: one comparison each.
3. All pairs of what is left with the tree, except pairs that are connected already, in cells of at most 2 * CELL
   bytes of shingles: no task has a whole tree, and a tree that hangs together by its centre is never dealt at all.

Only links that the comparison confirms join documents. No list, tree or number of partners is cut.

Defined cases: texts without words (null among them) are one group. The row that stays has the smallest doc_id, null
last, then the smallest text hash; of rows that are equal in id and text one stays. An empty table gives no rows.
Columns of any other name are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import as_bytes, cut, keeps, kept_rows, lean, row_id, slices, stored, text_hash
from .components import components

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS, DIFFER, LIST, CELL = 32, 5, 52, 16384, 1 << 20
VALUES = BANDS * ROWS
#: Words whose hashes a worker remembers.
WORDS_KEPT = 1 << 17

_rng = np.random.default_rng(20)
_PLACE = _rng.integers(1, 2**64, SHINGLE + 1, np.uint64) | np.uint64(1)
_TIMES, _PLUS = _rng.integers(1, 2**32, VALUES, np.uint32) | np.uint32(1), _rng.integers(0, 2**32, VALUES, np.uint32)
_BAND = _rng.integers(1, 2**64, (BANDS, ROWS), np.uint64) | np.uint64(1)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= WORDS_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_hashes = _WordHashes()
keeps("similar", _hashes.clear)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes) -> np.ndarray:
    """The hashes of the distinct shingles of one text, in order; none without words."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, parts), np.uint64, len(parts))
    n = max(1, len(h) - SHINGLE + 1)
    sums = np.full(n, min(len(h), SHINGLE), np.uint64) * _PLACE[SHINGLE]
    for k in range(min(len(h), SHINGLE)):
        sums += h[k : k + n] * _PLACE[k]
    return np.unique(_mixed(sums))


def min_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """VALUES minima for each of the sets, none of them empty."""
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), VALUES), np.uint32)
    for i in range(VALUES):
        out[:, i] = np.minimum.reduceat(x * _TIMES[i] + _PLUS[i], starts)
    return out


def band_keys(minima: np.ndarray) -> np.ndarray:
    return _mixed((minima.reshape(-1, BANDS, ROWS) * _BAND).sum(axis=2, dtype=np.uint64))


def sketches(minima: np.ndarray) -> np.ndarray:
    """Two bits of each minimum, as two planes."""
    planes = [np.packbits((minima >> np.uint32(b) & np.uint32(1)).astype(np.uint8), axis=1) for b in (0, 1)]
    return np.concatenate(planes, axis=1)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(row_id().alias("id"), text_hash().alias("hash"), F.col("`text`").alias("text"))


def nodes(docs: DataFrame) -> DataFrame:
    """One row per distinct set: node (its hash), id and hash of the row that stands for it, n, fp, keys, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in slices(batches):
            texts = as_bytes(b.column(2))
            sets = [shingles(t) for t in texts]
            node = np.array([xxhash.xxh64_intdigest(s) for s in sets], np.uint64).view(np.int64)
            # Different sets of fewer than four shingles are less than 0.8 alike.
            some = [i for i, s in enumerate(sets) if len(s) >= 4]
            keys, sketch = [b""] * len(sets), [b""] * len(sets)
            if some:
                minima = min_hashes([sets[i] for i in some])
                for i, k, s in zip(some, band_keys(minima), sketches(minima), strict=True):
                    keys[i], sketch[i] = k.tobytes(), s.tobytes()
            fp = [simhash.fingerprint(t) for t in texts]
            yield pa.record_batch(
                [pa.array(node), b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(fp, pa.int64()), pa.array(keys, pa.binary()), pa.array(sketch, pa.binary())],
                names=["node", "id", "hash", "n", "fp", "keys", "sketch"],
            )

    found = _keyed(docs).select("id", "hash", "text").mapInArrow(lean(run, "similar"), "node long, id long, hash long, n long, fp long, keys binary, sketch binary")
    least = F.min(F.struct("id", "hash", "n", "fp", "keys", "sketch")).alias("m")
    return found.groupBy("node").agg(least).select("node", "m.*")


def _whole(batches: Iterator[pa.RecordBatch], keys: int, most: int | None = None) -> Iterator[pa.Table]:
    """Rows in order of their first columns, as tables that hold every run of equal keys as a whole; a run above `most`
    rows comes in part: its first rows, more than `most`, alone, the others in front of later tables."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = tuple(batch.column(c)[-1] for c in range(keys))
        same = np.ones(batch.num_rows, bool)
        for c in range(keys):
            own = batch.column(c).to_numpy()
            same &= own == own[-1]
        n = batch.num_rows - int(same.sum())
        if held and (n or tuple(held[-1].column(c)[-1] for c in range(keys)) != last):
            yield pa.Table.from_batches([*held, batch.slice(0, n)])
            held = []
        elif n:
            yield pa.Table.from_batches([batch.slice(0, n)])
        held.append(batch.slice(n))
        if most and sum(b.num_rows for b in held) > most:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def _find(root: np.ndarray, i: int) -> int:
    while root[i] != i:
        i = root[i]
    return i


def _join(root: np.ndarray, i: int, j: int) -> bool:
    p, q = _find(root, i), _find(root, j)
    root[max(p, q)] = min(p, q)
    return p != q


def _settle(root: np.ndarray) -> np.ndarray:
    while (up := root[root] != root).any():
        root = np.where(up, root[root], root)
    return root


def forest(key: np.ndarray, node: np.ndarray, size: np.ndarray, sketch: np.ndarray, mille: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect, in every list (run of one key), all pairs whose sizes and sketches allow mille / 1000."""
    first = np.concatenate([[True], key[1:] != key[:-1]])
    start = np.flatnonzero(first)
    length = np.diff(np.append(start, len(key)))
    home = np.repeat(np.arange(len(start)), length)
    long = length[home] > LIST
    a, b = [node[long]], [node[start[home[long]]]]
    root = np.arange(len(key))
    rows = np.flatnonzero(~long)
    step = 1
    while len(rows := rows[rows + step < len(key)]) and len(rows := rows[home[rows] == home[rows + step]]):
        for at in range(0, len(rows), 1 << 18):
            i = rows[at : at + (1 << 18)]
            i = i[root[i] != root[i + step]]
            i = i[1000 * np.minimum(size[i], size[i + step]) >= mille * np.maximum(size[i], size[i + step])]
            differ = sketch[i] ^ sketch[i + step]
            half = differ.shape[1] // 2
            i = i[np.bitwise_count(differ[:, :half] | differ[:, half:]).sum(axis=1, dtype=np.int64) <= DIFFER]
            for x in i.tolist():
                if _join(root, x, x + step):
                    a.append(node[x : x + 1])
                    b.append(node[x + step : x + step + 1])
        root = _settle(root)
        if step & (step - 1) == 0:  # lists that are one tree by now are done
            open_ = np.zeros(len(start), bool)
            open_[home[root != start[home]]] = True
            rows = rows[open_[home[rows]]]
        step += 1
    return np.concatenate(a), np.concatenate(b)


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def candidates(found: DataFrame, mille: int) -> DataFrame:
    """Edges (a, b) between nodes; what they connect has to be compared."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keys = np.frombuffer(b"".join(b.column(2).to_pylist()), np.int64)
                each = lambda c: pa.compute.take(b.column(c), pa.array(np.repeat(np.arange(b.num_rows), BANDS)))
                yield pa.record_batch([pa.array(keys), each(0), each(1), each(3)], names=["key", "node", "n", "sketch"])

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        long = first = None  # the list that has come in part, and its first node
        for x in _whole(batches, 1, LIST):
            key, node = x.column("key").to_numpy(), x.column("node").to_numpy()
            if long is not None and key[0] == long:
                n = int(np.searchsorted(key, long, side="right"))
                yield _edges(node[:n], np.full(n, first))
                x, key, node = x.slice(n), key[n:], node[n:]
            same = key[1:] == key[:-1]
            at = np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
            if len(at):
                sketch = np.frombuffer(b"".join(x.column("sketch").take(pa.array(at)).to_pylist()), np.uint8).reshape(len(at), -1)
                yield _edges(*forest(key[at], node[at], x.column("n").to_numpy()[at], sketch, mille))
            if len(key) > LIST and key[0] == key[-1]:  # alone, so perhaps not all of it
                long, first = key[0], node[0]

    rows = found.where("length(keys) > 0").select("node", "n", "keys", "sketch").mapInArrow(lean(index, "similar"), "key long, node long, n long, sketch binary")
    banded = rows.repartition("key").sortWithinPartitions("key").mapInArrow(lean(lists, "similar"), "a long, b long")
    by_fp = found.groupBy("fp").agg(F.min("node").alias("m"))
    same = found.select("node", "fp").join(by_fp, "fp").where("node <> m").select(F.col("node").alias("a"), F.col("m").alias("b"))
    near = simhash.links(by_fp.select("fp"))
    near = near.join(by_fp.select(F.col("fp").alias("a"), F.col("m").alias("x")), "a").join(by_fp.select(F.col("fp").alias("b"), F.col("m").alias("y")), "b")
    return banded.union(same).union(near.select(F.col("x").alias("a"), F.col("y").alias("b")))


def alike(a: np.ndarray, b: np.ndarray, mille: int) -> bool:
    """Have two sets a Jaccard similarity of mille / 1000 or more? Sets without shingles are alike."""
    if 1000 * min(len(a), len(b)) < mille * max(len(a), len(b)):
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 1000 * shared >= mille * (len(a) + len(b) - shared)


def _centres(members: DataFrame) -> DataFrame:
    """tree, centre: the member whose fingerprint is nearest to the majority of each bit."""
    ones = [F.sum(F.shiftright("fp", b).bitwiseAND(F.lit(1))).alias(f"bit{b}") for b in range(64)]
    bits = members.groupBy("tree").agg(F.count("*").alias("size"), *ones)
    most = F.lit(0).cast("long")
    for b in range(64):
        most = most.bitwiseOR(F.when(2 * F.col(f"bit{b}") > F.col("size"), F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")))
    far = F.bit_count(F.col("fp").bitwiseXOR(F.col("most")))
    # By a key that neither side nor the aggregation is dealt by, so that the adaptive join can split a large tree.
    key = F.bitwise_not("tree").alias("key")
    return members.select("*", key).join(bits.select(key, most.alias("most")), "key").groupBy("tree").agg(F.min(F.struct(far.alias("far"), "node")).alias("m")).select("tree", F.col("m.node").alias("centre"))


def cell_links(queries: list[np.ndarray], query_node: np.ndarray, query_part: np.ndarray, sets: list[np.ndarray], node: np.ndarray, part: np.ndarray, mille: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of similarity mille / 1000 and more between queries and sets, as many as connect them; part: what is connected already."""
    names, place = np.unique(np.concatenate([part, query_part]), return_inverse=True)
    own, of_query = place[: len(part)], place[len(part) :]
    root, size = np.arange(len(names)), np.array([len(s) for s in sets])
    words, at = np.unique(np.concatenate(sets), return_inverse=True)
    offset, mark, a, b = np.concatenate([[0], np.cumsum(size)[:-1]]), np.zeros(len(words) + 1, bool), [], []
    for q, x, p in zip(queries, query_node.tolist(), of_query.tolist(), strict=True):
        root = _settle(root)
        open_ = (root[own] != root[p]) & (1000 * np.minimum(size, len(q)) >= mille * np.maximum(size, len(q)))
        if not open_.any():
            continue
        hit = np.searchsorted(words, q)
        hit = hit[words[np.minimum(hit, len(words) - 1)] == q]
        mark[hit] = True
        shared = np.add.reduceat(mark[at], np.minimum(offset, len(at) - 1), dtype=np.int64)
        mark[hit] = False
        for j in np.flatnonzero(open_ & (1000 * shared >= mille * (size + len(q) - shared))).tolist():
            if _join(root, p, int(own[j])):
                a.append(x)
                b.append(node[j])
    return np.array(a, np.int64), np.array(b, np.int64)


def links(docs: DataFrame, found: DataFrame, least: float = SIMILAR) -> DataFrame:
    """Edges (a, b) between nodes that connect exactly those of a similarity of `least` (three decimals count) or more."""
    mille = round(1000 * least)
    trees = components(candidates(found, mille)).select("node", F.col("root").alias("tree"))
    members = cut(found.select("node", "id", "hash", "n", "fp").join(trees, "node"))
    texts = _keyed(docs).join(members.join(_centres(members), "tree").select("id", "hash", "node", "tree", "n", "centre"), ["id", "hash"])
    once = texts.withColumn("place", F.row_number().over(Window.partitionBy("id", "hash").orderBy("id"))).where("place = 1")  # repeated rows
    whole = stored(once.select("tree", "node", "n", "centre", "text"), "members")
    centre = whole.where("node = centre").select("tree", F.col("text").alias("other"))

    def against_centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, of_centre = None, np.zeros(0, np.uint64)
        for b in slices(batches):
            same = []
            for t, o in zip(as_bytes(b.column(3)), as_bytes(b.column(4)), strict=True):
                if o != last:
                    last, of_centre = o, shingles(o)
                same.append(alike(shingles(t), of_centre, mille))
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(same, pa.bool_())], names=["tree", "node", "centre", "same"])

    star = cut(whole.where("node <> centre").join(centre, "tree").select("tree", "node", "centre", "text", "other").mapInArrow(lean(against_centre, "similar"), "tree long, node long, centre long, same boolean"))
    out = star.where("same").select(F.col("node").alias("a"), F.col("centre").alias("b"))
    if star.where("not same").isEmpty():
        return out
    own = whole.select("tree", "node", "n", "text").join(star.select("node", "centre", "same"), "node", "left")
    own = own.select("tree", "node", "n", "text", (~F.coalesce("same", F.lit(True))).alias("open"), F.when(F.col("same"), F.col("centre")).otherwise(F.col("node")).alias("part"))
    cells = lambda c: F.ceil(F.sum(c) * 8 / CELL).cast("long")
    dealt = whole.select("tree", "node", "n").join(star.where("not same").select("node", F.lit(1).alias("open")), "node", "left").groupBy("tree").agg(cells(F.col("n") * F.col("open")).alias("xs"), cells("n").alias("ys"))
    own = own.join(dealt.where("xs > 0"), "tree").withColumn("x", F.pmod(F.xxhash64("node"), F.col("xs"))).withColumn("y", F.pmod(F.xxhash64("node", F.lit(1)), F.col("ys")))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    cols = ["tree", "x", "y", "role", "node", "part", "text"]
    rows = own.drop("x").withColumn("x", every("xs")).withColumn("role", F.lit(0)).select(*cols).union(own.where("open").drop("y").withColumn("y", every("ys")).withColumn("role", F.lit(1)).select(*cols))

    def in_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole(batches, 3):
            tree, x, y, role, node, part = (t.column(c).to_numpy() for c in range(6))
            start = np.flatnonzero(np.concatenate([[True], (tree[1:] != tree[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
            for s, e in zip(start.tolist(), [*start[1:].tolist(), len(tree)], strict=True):
                is_query = role[s:e] == 1
                if is_query.any() and not is_query.all():
                    sets = [shingles(v) for v in as_bytes(t.column(6).slice(s, e - s).combine_chunks())]
                    some = lambda f: [v for v, q in zip(sets, is_query, strict=True) if q == f]  # noqa: B023, E731
                    yield _edges(*cell_links(some(True), node[s:e][is_query], part[s:e][is_query], some(False), node[s:e][~is_query], part[s:e][~is_query], mille))

    return out.union(rows.repartition("tree", "x", "y").sortWithinPartitions("tree", "x", "y", "role").mapInArrow(lean(in_cells, "similar"), "a long, b long"))


def one_of_each(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """The documents with one row left of each group."""
    found = cut(nodes(docs))
    groups = components(links(docs, found, least))
    stay = found.select("node", "id", "hash").join(groups, "node", "left").groupBy(F.coalesce("root", "node").alias("group")).agg(F.min(F.struct("id", "hash")).alias("m"))
    return kept_rows(docs, stay.select("m.id", "m.hash"))
