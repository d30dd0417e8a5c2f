"""One place for the session settings that the engine's semantics rest on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC calendar days, ANSI errors instead of silent nulls, run-time re-planning with skew splitting.
SEMANTICS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def local_session(cores: int | str = "*", memory: str = "4g", partitions: int = 8) -> SparkSession:
    """A session for one machine; on a cluster, pass your own session to every function instead."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("marlstone")
    conf = SEMANTICS | {"spark.sql.shuffle.partitions": str(partitions), "spark.ui.enabled": "false", "spark.driver.memory": memory}
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
