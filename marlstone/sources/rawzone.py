"""The raw zone: immutable text snapshots with a manifest each.

<root>/<source>/<dataset>/retrieved_date=YYYY-MM-DD/<snapshot id>.csv and .manifest.json beside it. All access goes by
Spark's file system layer, so the root may be a local folder or any store that Spark reads. A payload is what one fetch
hands to the driver, as one file: rows are taken one by one and written in blocks, so it is never held as a whole.
Executors hash payloads, all at once; one above WHOLE bytes, which a row of Spark can't hold, is hashed in blocks where
the run is driven. A payload without line breaks inside its cells is read by many tasks.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import asdict, dataclass, field
from itertools import chain
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..settings import Run, stable_hash, utc_now

MANIFEST = ".manifest.json"
#: Arrival order of a row: the snapshot's place in the run, then the row's place in its file.
ORDER = "_ord"
PLACE_BITS = 50
#: Bytes written or hashed at a time; the size from which a payload is no single value.
CHUNK, WHOLE = 1 << 20, 1 << 30


def arrival(place: int = 0) -> Column:
    """The order of rows taken directly after one scan, as one number (fewer than 2**17 file splits, 2**13 snapshots)."""
    return F.lit(place << PLACE_BITS).cast("long") + F.monotonically_increasing_id()


class ChecksumError(ValueError):
    """A payload differs from what its manifest says."""


class Files:
    """The few file operations the raw zone needs, through Hadoop's file system."""

    def __init__(self, spark: SparkSession, root: str):
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._jvm = jvm

    def exists(self, path: str) -> bool:
        return self.fs.exists(self._path(path))

    def glob(self, pattern: str) -> list[str]:
        found = self.fs.globStatus(self._path(pattern))
        return sorted(s.getPath().toString() for s in found) if found else []

    def read(self, path: str) -> bytes:
        stream = self.fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def size(self, path: str) -> int:
        return self.fs.getFileStatus(self._path(path)).getLen()

    def sha256(self, path: str) -> str:
        """In blocks, for files of any size."""
        digest = self._jvm.java.security.MessageDigest.getInstance("SHA-256")
        stream = self._jvm.java.security.DigestInputStream(self.fs.open(self._path(path)), digest)
        try:
            self._jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, self._jvm.org.apache.commons.io.output.NullOutputStream.INSTANCE, CHUNK)
        finally:
            stream.close()
        return bytes(b & 255 for b in digest.digest()).hex()

    def write_new(self, path: str, pieces: Iterable[bytes]) -> None:
        """Create the file from pieces; FileExistsError if it is there already."""
        if self.exists(path):
            raise FileExistsError(f"refusing to overwrite {path}")
        stream, held = self.fs.create(self._path(path), False), bytearray()
        try:
            for piece in pieces:
                held += piece
                if len(held) >= CHUNK:
                    stream.write(held)
                    held = bytearray()
            stream.write(held)
        finally:
            stream.close()

    def move_new(self, path: str, to: str) -> None:
        """Rename; FileExistsError, and the file goes, if there is one of that name."""
        if self.exists(to):
            self.fs.delete(self._path(path), False)
            raise FileExistsError(f"refusing to overwrite {to}")
        if not self.fs.rename(self._path(path), self._path(to)):
            raise OSError(f"{path} can't be renamed to {to}")


@dataclass(frozen=True)
class Snapshot:
    snapshot_id: str
    source: str
    dataset: str
    payload_file: str
    retrieved_at: str
    row_count: int
    columns: tuple[str, ...]
    column_dtypes: dict[str, str]
    checksum_sha256: str
    params: dict[str, Any] = field(default_factory=dict)
    run_id: str | None = None
    pipeline_version: str | None = None
    mode: str | None = None
    synthetic: bool = False
    replayed_from: str | None = None
    notes: str = ""
    line_breaks: bool = True  # may cells hold any? Manifests that don't say are read as if so
    folder: str = ""

    @property
    def path(self) -> str:
        return f"{self.folder}/{self.payload_file}"

    def manifest(self) -> dict[str, Any]:
        return {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(self).items() if k != "folder"}

    @classmethod
    def parse(cls, text: str, folder: str) -> Snapshot:
        known = {k: v for k, v in json.loads(text).items() if k in cls.__dataclass_fields__}
        return cls(**known | {"columns": tuple(known["columns"]), "folder": folder})


class RawZone:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, str(root).rstrip("/"), Files(spark, str(root))

    # Writing

    def write(self, source: str, dataset: str, columns: Sequence[str], rows: Iterable[Sequence[Any]], run: Run, *, params: dict[str, Any] | None = None, column_dtypes: dict[str, str] | None = None, synthetic: bool = False, replayed_from: str | None = None, notes: str = "", retrieved_at: dt.datetime | None = None) -> Snapshot:
        """Store a fetched payload as text, once: a snapshot is never written over. Rows may be any iterable."""
        stamp, params = retrieved_at or utc_now(), dict(params or {})
        folder = f"{self.root}/{source}/{dataset}/retrieved_date={stamp:%Y-%m-%d}"
        digest, n, breaks = hashlib.sha256(), 0, False

        def lines() -> Iterable[bytes]:
            nonlocal n, breaks
            for i, row in enumerate(chain([columns], rows)):
                line = (",".join(map(_quoted, row if not i else [_cell(x) for x in row])) + "\n").encode()
                breaks |= line.count(b"\n") > 1 or b"\r" in line
                n = i
                digest.update(line)
                yield line

        spool = f"{folder}/.{uuid.uuid4().hex}"  # the name of the snapshot tells its number of rows
        self.files.write_new(spool, lines())
        name = f"{source}-{dataset}-{stamp:%Y%m%dT%H%M%SZ}-{stable_hash({'params': params, 'rows': n, 'run': run.run_id})[:8]}"
        snapshot = Snapshot(
            name, source, dataset, f"{name}.csv", stamp.isoformat(), n, tuple(columns), dict(column_dtypes or dict.fromkeys(columns, "string")), digest.hexdigest(),
            params, run.run_id, run.version, run.mode, synthetic, replayed_from, notes, breaks, folder,
        )
        self.files.move_new(spool, snapshot.path)
        self.files.write_new(f"{folder}/{name}{MANIFEST}", [(json.dumps(snapshot.manifest(), indent=2, ensure_ascii=False) + "\n").encode()])
        return snapshot

    # Reading

    def list_snapshots(self, source: str | None = None, dataset: str | None = None) -> list[Snapshot]:
        """Snapshots in order of path."""
        paths = self.files.glob(f"{self.root}/{source or '*'}/{dataset or '*'}/retrieved_date=*/*{MANIFEST}")
        return [Snapshot.parse(self.files.read(p).decode(), p.rpartition("/")[0]) for p in paths]

    def latest(self, source: str, dataset: str) -> Snapshot | None:
        return max(self.list_snapshots(source, dataset), key=lambda s: (dt.datetime.fromisoformat(s.retrieved_at), s.snapshot_id), default=None)

    def verify(self, snapshots: list[Snapshot]) -> list[Snapshot]:
        """Those whose payload isn't what was written; executors hash all payloads at once."""
        small = [s for s in snapshots if self.files.size(s.path) <= WHOLE]
        got = {s.payload_file: self.files.sha256(s.path) for s in snapshots if s not in small}
        if small:
            hashed = self.spark.read.format("binaryFile").load([s.path for s in small]).select("path", F.sha2("content", 256).alias("sha"))
            got |= {r.path.rpartition("/")[2]: r.sha for r in hashed.collect()}  # one row per snapshot
        return [s for s in snapshots if got.get(s.payload_file) != s.checksum_sha256]

    def header(self, snapshot: Snapshot) -> list[str]:
        """The payload's own column labels, repeated ones included."""
        first = self.spark.read.text(snapshot.path).limit(1).collect()
        return _split(first[0].value) if first else []

    def read(self, snapshot: Snapshot, place: int = 0) -> DataFrame:
        """All columns as text ("" stays ""), and the arrival order of each row."""
        labels = self.header(snapshot)
        names = [n if labels.index(n) == i else f"{n}.{labels[:i].count(n)}" for i, n in enumerate(labels)]
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        df = self.spark.read.schema(schema).csv(snapshot.path, header=True, escape='"', multiLine=snapshot.line_breaks, enforceSchema=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        # The files are read one by one, so the row number inside this scan is the order of delivery.
        return df.select(*[F.coalesce(F.col(f"`{n}`"), F.lit("")).alias(n) for n in names], arrival(place).alias(ORDER))


def _cell(x: Any) -> str:
    return "" if x is None or x != x else str(x)


def _quoted(x: str) -> str:
    return '"' + x.replace('"', '""') + '"' if any(c in x for c in ',"\n\r') else x


def _split(line: str) -> list[str]:
    import csv

    return next(csv.reader([line.rstrip("\r")]), [])
