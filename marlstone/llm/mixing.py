"""Mixing sources to target weights by systematic sampling [native].

Sizes are word counts. Targets share the whole corpus size by source weight; a target stops at `most` times its
source's size and the excess is shared again by weight, which is water filling: with the sources in order of
cap / weight, the level is (total - caps before) / (weights from here on) at the first source whose cap reaches it.

Inside a source every document expects r = target / source_size copies. With the documents in order of size (then
doc_id), the prefix sum of expected copies up to rank i is i * r; one offset u in [0, 1) per source, a fixed hash of
the source's name and the seed, is added and a document is emitted once per integer between its two prefix sums:
floor(i * r + u) - floor((i - 1) * r + u). In order of size the words taken stay within about twice the largest
document of the target, and no document exceeds ceil(r) <= `most` copies.

The ranks come from one range shuffle of ids and sizes over (source, size, doc_id), so a source with a third of all rows is spread over
as many tasks as its rows need: a row's place inside its partition plus the counts of earlier partitions. Nothing but
one row per source is ever in one task.

Null text has size 0; null source is a source of its own, last in order; null doc_id sorts first; repeated rows are
sampled one by one; an empty table gives an empty result; a corpus without words takes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, free_names, pick, row_id

#: Weights by the source's place in code point order, repeating.
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """(source, size) rows to one row per source: source, source_size, target."""
    by_place = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("place"), F.lit(len(weights))) + 1).cast("int"))
    per = (
        sized.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("place", F.row_number().over(by_place) - 1)
        .withColumn("weight", weight.cast("long"))
        .withColumn("cap", F.col("source_size") * most)
    )
    ratio = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before, onward, whole = ratio.rowsBetween(Window.unboundedPreceding, -1), ratio.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(onward)
    levelled = per.withColumn("level", level).withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    # The level of the first source that is not capped holds for all later ones too.
    common = F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), F.col("place"), F.col("level")))).over(whole)["level"]
    return levelled.withColumn("common", common).select(
        "source", "source_size",
        F.when(F.col("common").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("common") * F.col("weight"))).alias("target"),
    )


def offset(source: Column, seed: int) -> Column:
    """One fixed pseudo-random number in [0, 1) per source."""
    named = F.concat(F.lit(f"{seed}|"), F.coalesce(F.concat(F.lit("="), source), F.lit("")))
    return F.conv(F.substring(F.md5(named), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, seed: int = 7, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per input row: kept (a struct of the `keep` columns), source, size, source_size, target, copies."""
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), F.col("`doc_id`"), F.col("`source`"), word_count(F.col("`text`")).alias("size"))
    base = cut(base)
    known = targets(base, weights, most)
    order = [F.col("source").asc_nulls_last(), F.col("size"), F.col("doc_id")]
    at = F.monotonically_increasing_id()
    ranged = cut(base.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", at))
    ranged = ranged.withColumn("part", F.shiftright("at", 33)).withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
    runs = ranged.groupBy("part", "key").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    known = known.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))).drop("source")
    rank = F.col("at") - F.col("first") + F.col("base") + 1
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    u = offset(F.col("source"), seed)
    emitted = F.floor(F.col("rank") * F.col("rate") + F.col("u")) - F.floor((F.col("rank") - 1) * F.col("rate") + F.col("u"))
    joined = ranged.join(runs, ["part", "key"]).join(known, "key").withColumn("rank", rank).withColumn("rate", rate).withColumn("u", u)
    return joined.select("kept", "source", "size", "source_size", "target", emitted.cast("long").alias("copies"))


def digest(docs: DataFrame) -> DataFrame:
    out = copies(pick(docs, "doc_id", "text", "source"))
    return out.select("kept.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every input row as often as it is taken, with its own columns.

    Ranks are found without the texts; these move once, in the join by id and a hash of id, source and text. Rows that
    are equal in all three share their copies evenly.
    """
    own_id, own_hash, n_copies, n_rows, place, own = free_names(docs, "id", "hash", "copies", "rows", "place", "own")
    keyed = docs.select("*", row_id().alias(own_id), F.xxhash64(F.col("`doc_id`"), F.col("`source`"), F.col("`text`")).alias(own_hash))
    taken = copies(keyed, keep=(own_id, own_hash), **how)
    key = [F.col("kept").getField(c).alias(c) for c in (own_id, own_hash)]
    taken = taken.groupBy(*key).agg(F.sum("copies").alias(n_copies), F.count("*").alias(n_rows)).where(F.col(n_copies) > 0)
    numbered = F.row_number().over(Window.partitionBy(own_id, own_hash).orderBy(own_id))
    joined = keyed.join(taken, [own_id, own_hash]).withColumn(place, numbered)
    share = F.floor(F.col(n_copies) / F.col(n_rows)) + F.when(F.col(place) <= F.col(n_copies) % F.col(n_rows), 1).otherwise(0)
    out = joined.withColumn(own, share.cast("int")).where(F.col(own) > 0)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(own))).alias(place)).drop(place)


SQL = r"""
WITH d AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), p AS (
  SELECT source, SUM(size)::BIGINT AS source_size, ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source
), w AS (
  SELECT *, (CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::BIGINT AS weight, source_size * 3 AS cap FROM p
), l AS (
  SELECT *, ((SUM(source_size) OVER ())::BIGINT - COALESCE(SUM(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
    / (SUM(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level FROM w
), c AS (
  SELECT *, (SELECT arg_min(level, (cap / weight, place)) FROM l WHERE level * weight <= cap) AS common FROM l
), t AS (
  SELECT source, source_size, CASE WHEN common IS NULL THEN cap::DOUBLE ELSE LEAST(cap::DOUBLE, common * weight) END AS target FROM c
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    ROW_NUMBER() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) AS rank,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
    ('0x' || substr(md5('7|' || COALESCE('=' || d.source, '')), 1, 8))::UBIGINT / 4294967296.0 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (floor(rank * rate + u) - floor((rank - 1) * rate + u))::BIGINT * size AS taken FROM r
"""
