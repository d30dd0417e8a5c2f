"""Shared helpers: checkpoints in the cluster's shared folder, and Arrow column access."""

from __future__ import annotations

import ctypes
import itertools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of the word contracts: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that setting is unset on a local master (tests)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named and sc.getCheckpointDir() is None and not re.fullmatch(r"local(\[[^-]*\])?", sc.master):
        raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="marlstone-"))
        fs, own = _at(spark, sc.getCheckpointDir())  # Spark's own folder in it, of this application alone
        fs.deleteOnExit(own)
    return named or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise df once in the shared folder and cut its lineage there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's part of the shared folder; that part goes when the driver ends."""
    folder = f"{shared_folder(spark).rstrip('/')}/marlstone-{spark.sparkContext.applicationId}"
    fs, path = _at(spark, folder)
    fs.deleteOnExit(path)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    fs, at = _at(spark, path)
    fs.delete(at, True)


def _at(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder, for what is read several times and holds texts."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names like these that df has no column of (letter case does not tell columns apart)."""
    taken = {c.lower() for c in df.columns}
    return [next(x for i in itertools.count() if (x := f"__{n}{i or ''}") not in taken) for n in names]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pick(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns never reach an operator's own names."""
    return docs.select(*[F.col(f"`{n}`") for n in names])


#: The place of a null id in the order of ids.
LAST = 2**63 - 1


def row_id() -> Column:
    return F.coalesce(F.col("`doc_id`").cast("long"), F.lit(LAST))


def text_hash() -> Column:
    return F.xxhash64(F.col("`text`"))


def kept_rows(docs: DataFrame, stay: DataFrame) -> DataFrame:
    """The rows of docs with these ids (null as LAST) and text hashes, one of each. Texts move once, in this join."""
    own_id, own_hash, place = free_names(docs, "id", "hash", "place")
    keyed = docs.select("*", row_id().alias(own_id), text_hash().alias(own_hash))
    numbered = keyed.join(stay.select(F.col("id").alias(own_id), F.col("hash").alias(own_hash)), [own_id, own_hash])
    numbered = numbered.withColumn(place, F.row_number().over(Window.partitionBy(own_id, own_hash).orderBy(own_id)))
    return numbered.where(F.col(place) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


def drawn_texts(rows: DataFrame, ids: DataFrame, most_bytes: int, group: str) -> DataFrame:
    """group, text of the rows whose doc_id was drawn: of each group as many whole texts as fit into most_bytes, the
    shorter ones first where not all do; rows that are equal in id, group and text are one."""
    own = rows.join(F.broadcast(ids), "doc_id").select(group, "doc_id", "text").where("text is not null").distinct()
    shorter = Window.partitionBy(group).orderBy(F.octet_length("text"), "doc_id", "text").rowsBetween(Window.unboundedPreceding, 0)
    return own.withColumn("__bytes", F.sum(F.octet_length("text")).over(shorter)).where(F.col("__bytes") <= most_bytes).select(group, "text")


#: How to drop what a module keeps in a Python worker between tasks, by the module's name.
_kept: dict[str, Callable[[], object]] = {}


def keeps(module: str, drop: Callable[[], object]) -> None:
    _kept[module] = drop


def give_back(but: str = "") -> None:
    """Drop what modules other than `but` keep in this process, and return its free memory to the system: a worker outlives
    its task, and so would the largest heap that any stage has needed."""
    for module, drop in _kept.items():
        if module != but:
            drop()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
        trim(0)


def lean(run: Callable[[Iterator], Iterator], but: str = "") -> Callable[[Iterator], Iterator]:
    """The same function for mapInArrow, in a worker that gives back memory before and after."""

    def task(batches: Iterator) -> Iterator:
        give_back(but)
        yield from run(batches)
        give_back(but)

    return task


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 << 20, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with about `most` bytes of the column and at most `rows` rows, one row at least: bounds a worker's memory."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        n = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(n), 0
        while at < len(n):
            start = int(ends[at - 1]) if at else 0
            to = min(at + rows, max(at + 1, int(np.searchsorted(ends, start + most, side="right"))))
            yield batch.slice(at, to - at)
            at = to
