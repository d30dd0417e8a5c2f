"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round is two aggregations and two joins over the edges; a hub's neighbours are pre-aggregated by the minimum and
the joins are ordinary sort-merge joins, so a hub of any size is split and nothing is sent to the driver. Every round
is written to the shared folder, and the one before it is removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, remove


def components(edges: DataFrame) -> DataFrame:
    """Edges (a long, b long) to (node, root): root is the smallest node of the component; nodes without edges are absent."""
    now, at = _anew(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    state = _state(now)
    while state[0]:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = _with_least(both, least).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _with_least(large, least)
        small = small.select("a", F.col("m").alias("b")).union(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        last, (now, at) = at, _anew(small.distinct())
        remove(edges.sparkSession, last)
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())


def _anew(edges: DataFrame) -> tuple[DataFrame, str]:
    """The edges written and read again, and where: a checkpoint keeps the size estimate of its plan, joins multiply estimates, and
    carried from round to round their digits grow until planning does not end (seen from the fifth round on)."""
    path = fresh_path(edges.sparkSession, "edges")
    edges.write.parquet(path)
    return edges.sparkSession.read.schema("a long, b long").parquet(path), path


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Edges with their node's minimum m; joined by a key that neither side is dealt by, so that both sides get an
    exchange and the adaptive join can split a hub's edges."""
    return edges.withColumn("key", F.bitwise_not("a")).join(least.select(F.bitwise_not("a").alias("key"), "m").hint("merge"), "key")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
