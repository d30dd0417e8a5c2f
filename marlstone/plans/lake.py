"""The warehouse: Parquet tables under one root, each source a partition that a load replaces as a whole.

Tables are registered as temporary views, so `spark.sql` reads them by name. Loading is idempotent: dynamic partition
overwrite replaces the sources that are in the frame and leaves the others alone; the commit is Spark's (staged files
are moved in at the end), and rows that break NOT NULL are refused before anything is written.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..contracts import CONTRACTS, DATASET_METADATA, VALIDATION_RESULTS, get_contract, validation_struct
from ..operators.dedup import keep_first
from ..settings import Run
from ..sources.rawzone import ORDER, Files
from .findings import Checked, log_table


class ContractViolation(ValueError):
    """Rows that a table doesn't take."""


class Lake:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, str(root).rstrip("/")
        self.ensure()

    def __enter__(self) -> Lake:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        for name in self.tables():
            self.spark.catalog.dropTempView(name)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    @staticmethod
    def _struct(name: str) -> T.StructType:
        if name == VALIDATION_RESULTS.name:
            return validation_struct()
        return DATASET_METADATA.to_struct() if name == DATASET_METADATA.name else get_contract(name).to_struct()

    def tables(self) -> list[str]:
        return sorted([*CONTRACTS, DATASET_METADATA.name, VALIDATION_RESULTS.name])

    def exists(self) -> bool:
        return Files(self.spark, self.root).exists(self.path(DATASET_METADATA.name))

    def ensure(self) -> None:
        """Create what is missing, empty and with its contract's schema, and register the views."""
        files = Files(self.spark, self.root)
        for name in self.tables():
            if not files.exists(self.path(name)):
                self._writer(self.spark.createDataFrame([], self._struct(name)), name).mode("ignore").save(self.path(name))
            self.table(name).createOrReplaceTempView(name)

    def _writer(self, df: DataFrame, name: str):
        w = df.write.format("parquet")
        return w.partitionBy("source").option("partitionOverwriteMode", "dynamic") if name in CONTRACTS else w

    def table(self, name: str) -> DataFrame:
        """Schema from the contract: nothing is inferred, and partitions by source are pruned."""
        struct = self._struct(name)
        return self.spark.read.schema(struct).parquet(self.path(name)).select(*struct.names)

    def load_dataset(self, name: str, df: DataFrame, run: Run, schema_version: str | None = None) -> int:
        """Replace the frame's sources by its rows (first row per key); the rows written."""
        contract = get_contract(name)
        order = [ORDER] if ORDER in df.columns else [F.monotonically_increasing_id()]
        extra = [ORDER] if ORDER in df.columns else []
        projected = df.select(*[F.col(f.name).cast(t.dataType).alias(f.name) for f, t in zip(contract.fields, contract.to_struct(), strict=True)], *extra)
        rows = keep_first(projected, list(contract.primary_key), order).select(*contract.column_names).persist()
        try:
            broken = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in contract.non_nullable_columns])
            found = rows.groupBy("source").agg(F.count("*").alias("n"), F.count_if(broken).alias("broken"), F.min("date").alias("first"), F.max("date").alias("last")).collect()
            if bad := sum(r.broken for r in found):
                raise ContractViolation(f"{bad} rows of {name} have nulls where none are allowed; nothing was written")
            if not found:
                return 0
            self._writer(rows, name).mode("overwrite").save(self.path(name))
        finally:
            rows.unpersist()
        first, last = min(r["first"] for r in found), max(r["last"] for r in found)
        log = [(name, r.source, schema_version or contract.version, run.run_id, run.started_at, r.n, first, last, run.fingerprint) for r in found]
        self.spark.createDataFrame(log, DATASET_METADATA.to_struct()).coalesce(1).write.mode("append").parquet(self.path(DATASET_METADATA.name))
        self.ensure()
        return sum(r.n for r in found)

    def persist_validation(self, checked: Checked | list[Checked]) -> int:
        """Append all findings to the check log; their number."""
        several = [checked] if isinstance(checked, Checked) else list(checked)
        n = sum(len(c.found) for c in several)
        if n:
            log_table(self.spark, several).coalesce(1).write.mode("append").parquet(self.path(VALIDATION_RESULTS.name))
            self.ensure()
        return n

    def quarantine(self, name: str, source: str, run: Run, df: DataFrame) -> str:
        """Keep rejected rows as CSV for inspection; they are never loaded."""
        path = f"{self.root}/quarantine/{name}__{source}__{run.run_id}"
        df.drop(ORDER).write.mode("errorifexists").option("header", True).csv(path)
        return path

    def query(self, sql: str, params: list | dict | None = None) -> DataFrame:
        """Any SQL over the tables; ? takes a list, :name a dict."""
        return self.spark.sql(sql, args=params) if params else self.spark.sql(sql)

    def row_count(self, name: str) -> int:
        return self.table(name).count()
