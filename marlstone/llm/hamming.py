"""Exact top-k search of binary codes by incremental multi-index hashing.

A vector's code holds the sign of each of its 64 dimensions. A code is S segments of W bits, W being 8, 16 or 32 by the
number of codes (about its binary logarithm); the index lists codes by (segment, value). In round r every open query
probes, in each segment, the values that differ from its own in exactly r bits, and every code met is verified by its
full distance. After round r each code within S * (r + 1) - 1 bits has been met in some segment (if all S differed in
r + 1 bits or more, the sum would be larger), so a query whose k-th verified distance is at most that is closed; others
go on. Round W meets every code.

Codes enter once, with the k + 1 smallest ids that have them, so a vector shared by a third of all rows is one code;
that loses nothing, as ties go to the smaller id and a query leaves out its own id only. Index and probes meet in one
exchange by (segment, value); a list above LIST_BLOCK codes is dealt in blocks by a hash of the code, and its probes go
to each block, so no task holds a whole long list. In a task, probes meet a list block by block and only each query's
best k of the task go on, none farther than its k-th distance so far. Nothing is broadcast or collected but counts.

Defined cases: a null vector, or one with a null, a NaN or another number of dimensions, is neither indexed nor
searched for; the value 0 counts as not positive; repeated rows and null ids: ids are taken once, null ids are left
out; fewer than k other ids give fewer rows; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, pick

BITS, K, EVERY = 64, 10, 20
#: Codes of a list in one task.
LIST_BLOCK = 1 << 17
#: Distances computed at once in a task.
BLOCK = 1 << 20


def codes(vectors: DataFrame, bits: int = BITS) -> DataFrame:
    """vec_id, code of every usable vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                flat = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, bits)
                yield pa.record_batch([b.column(0), pa.array(np.packbits(flat > 0, axis=1, bitorder="little").view(np.int64).ravel())], names=["vec_id", "code"])

    own = pick(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    usable = own.where(f"vec_id is not null and size(embedding) = {bits} and not exists(embedding, x -> x is null or isnan(x))")
    return usable.mapInArrow(run, "vec_id long, code long")


def _nearest(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows in order of (list, block, kind): a block's codes, then the queries that probe it (with their k-th distance so far)."""
    best: list[tuple[np.ndarray, ...]] = []
    size, listed, held = 0, None, []

    def reduced(parts):
        query, code, far, least = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((code, query))  # a code may be met in several segments
        query, code, far, least = (x[order] for x in (query, code, far, least))
        new = np.ones(len(query), bool)
        new[1:] = (query[1:] != query[:-1]) | (code[1:] != code[:-1])
        query, code, far, least = (x[new] for x in (query, code, far, least))
        order = np.lexsort((least, far, query))
        query, code, far, least = (x[order] for x in (query, code, far, least))
        first = np.searchsorted(query, query)
        some = np.arange(len(query)) - first < k
        return query[some], code[some], far[some], least[some]

    for b in batches:
        key, block, kind, code, extra = (c.to_numpy() for c in b.columns)
        bounds = np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1]) | (kind[1:] != kind[:-1])) + 1
        for a, z in zip([0, *bounds.tolist()], [*bounds.tolist(), len(key)], strict=True):
            if a == z:
                continue
            if kind[a] == 0:
                if listed != (key[a], block[a]):
                    listed, held = (key[a], block[a]), []
                held.append((code[a:z], extra[a:z]))
                continue
            if listed != (key[a], block[a]):
                continue  # nobody has this value
            if len(held) > 1:
                held = [tuple(np.concatenate(x) for x in zip(*held, strict=True))]
            codes_, least = held[0]
            for c in range(0, len(codes_), BLOCK):
                own = codes_[c : c + BLOCK]
                step = max(1, BLOCK // len(own))
                for q in range(a, z, step):
                    query, bound = code[q : min(z, q + step)], extra[q : min(z, q + step)]
                    far = np.bitwise_count((query[:, None] ^ own[None, :]).view(np.uint64))
                    i, j = np.nonzero(far <= bound[:, None])
                    if len(i):
                        best.append((query[i], own[j], far[i, j].astype(np.int64), least[c + j]))
                        size += len(i)
            if size > 4 * BLOCK:
                best = [reduced(best)]
                size = len(best[0][0])
    if best:
        yield pa.record_batch([pa.array(x) for x in reduced(best)], names=["query", "code", "distance", "least"])


def width(n: int) -> int:
    """The segment width for n codes."""
    return next(w for w in (8, 16, 32) if w == 32 or n <= 1 << (3 * w // 2))


def search(vectors: DataFrame, k: int = K, every: int = EVERY, segment: int | None = None, list_block: int = LIST_BLOCK) -> DataFrame:
    """query_id, rank, neighbour_id, distance: the k nearest other ids of every row whose id is divisible by `every`."""
    ids = cut(codes(vectors).distinct())
    place = F.row_number().over(Window.partitionBy("code").orderBy("vec_id"))
    kept = cut(ids.withColumn("place", place).where(F.col("place") <= k + 1))  # each task keeps k + 1 per code before the shuffle
    index = kept.where("place = 1").select("code", F.col("vec_id").alias("least"))
    segment = segment or width(index.count())
    segments = BITS // segment
    lists = _segments(index, [0], segment).select("list", F.lit(0).alias("kind"), "code", F.col("least").alias("extra"))
    long = cut(lists.groupBy("list").count().where(F.col("count") > list_block).select("list", F.ceil(F.col("count") / list_block).cast("long").alias("blocks")))
    split = not long.isEmpty()
    blocks, cols = F.coalesce("blocks", F.lit(1).cast("long")), ["list", "block", "kind", "code", "extra"]
    if split:
        lists = lists.join(long, "list", "left").withColumn("block", F.pmod(F.xxhash64("code"), blocks)).select(*cols)
    else:
        lists = lists.withColumn("block", F.lit(0).cast("long")).select(*cols)
    queries = ids.where(F.col("vec_id") % every == 0)
    state = cut(queries.select(F.col("code").alias("query")).distinct().withColumn("bound", F.lit(BITS).cast("long")))
    found = None
    for r in range(segment + 1):
        masks = [sum(1 << b for b in c) for c in combinations(range(segment), r)]
        probes = _segments(state.select(F.col("query").alias("code"), "bound"), masks, segment).select("list", F.lit(1).alias("kind"), "code", F.col("bound").alias("extra"))
        if split:
            probes = probes.join(long, "list", "left").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))).select(*cols)
        else:
            probes = probes.withColumn("block", F.lit(0).cast("long")).select(*cols)
        met = lists.union(probes).repartition("list", "block").sortWithinPartitions("list", "block", "kind", "code").mapInArrow(lambda batches: _nearest(batches, k + 1), "query long, code long, distance long, least long")
        if found is not None:
            met = met.union(found)
        nearest = Window.partitionBy("query").orderBy("distance", "least")
        found = cut(met.distinct().withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= k + 1).drop("n"))
        # The (k + 1)-th distance over ids, the query's own id among them, bounds the k-th over others.
        over = found.join(kept.groupBy("code").agg(F.count("*").alias("ids")), "code")
        running = F.sum("ids").over(nearest.rowsBetween(Window.unboundedPreceding, 0))
        bounds = over.withColumn("running", running).where(F.col("running") >= k + 1).groupBy("query").agg(F.min("distance").alias("bound"))
        state = cut(state.select("query").join(bounds, "query", "left").select("query", F.coalesce("bound", F.lit(BITS).cast("long")).alias("bound")).where(F.col("bound") > segments * (r + 1) - 1))
        if state.isEmpty():
            break
    near = found.join(kept.select("code", F.col("vec_id").alias("neighbour_id")), "code").select("query", "neighbour_id", "distance")
    rank = Window.partitionBy("query").orderBy("distance", "neighbour_id")
    near = near.withColumn("n", F.row_number().over(rank)).where(F.col("n") <= k + 1)
    answers = near.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("n", "neighbour_id", "distance"))).alias("near"))  # k + 1 at most
    own = queries.select(F.col("vec_id").alias("query_id"), F.col("code").alias("query")).join(answers, "query")
    others = F.slice(F.filter("near", lambda x: x["neighbour_id"] != F.col("query_id")), 1, k)
    return own.select("query_id", F.posexplode(others).alias("at", "x")).select("query_id", (F.col("at") + 1).cast("long").alias("rank"), F.col("x.neighbour_id").alias("neighbour_id"), F.col("x.distance").alias("distance"))


def _segments(rows: DataFrame, masks: list[int], segment: int) -> DataFrame:
    """Every row once per segment and mask, with the list (segment, value ^ mask) that it belongs to or probes."""
    value = lambda s: F.shiftrightunsigned("code", s * segment).bitwiseAND(F.lit((1 << segment) - 1).cast("long"))
    lists = [F.lit(s << segment).cast("long") + value(s) for s in range(BITS // segment)]
    flips = F.array(*[F.lit(m).cast("long") for m in masks])
    each = rows.select("*", F.explode(F.array(*lists)).alias("own"))
    return each.select("*", F.explode(flips).alias("flip")).withColumn("list", F.col("own").bitwiseXOR(F.col("flip")))


SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) = 64
), d AS (
  SELECT q.vec_id AS query_id, b.vec_id AS neighbour_id,
    len(list_filter(range(1, 65), lambda i: (q.embedding[i] > 0) <> (b.embedding[i] > 0)))::BIGINT AS distance
  FROM v q JOIN v b ON q.vec_id % 20 = 0 AND q.vec_id <> b.vec_id
), r AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS rank FROM d
)
SELECT query_id, rank, neighbour_id, distance FROM r WHERE rank <= 10
"""
