"""Cutting lineage of iterative jobs on storage that outlives an executor."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Collection, Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    if context.applicationId not in _folders:
        _folders[context.applicationId] = tempfile.mkdtemp(prefix="corpusloom-")
    return _folders[context.applicationId]


_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Within, a query's shuffle files go as it ends, not once the driver happens to collect its garbage."""
    before = spark.conf.get(_RELEASE, None)
    spark.conf.set(_RELEASE, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_RELEASE)
        else:
            spark.conf.set(_RELEASE, before)


def write_columns(df: DataFrame, path: str) -> None:
    """Ids are random digits, which zstd packs to about half of what the default codec does."""
    with _shuffles_released(df.sparkSession):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder and forget how it was made.

    Rows are written as compressed columns, a fraction of the size of a checkpoint of plain rows. Those that columns cannot hold
    (repeated names, untyped nulls, no column at all) are checkpointed as they are.
    """
    spark, schema = df.sparkSession, df.schema
    names = {name.lower() for name in schema.names}
    if names and len(names) == len(schema.names) and "void" not in schema.simpleString():
        path = f"{shared_folder(spark)}/corpusloom-{spark.sparkContext.applicationId}/kept/{uuid.uuid4().hex}"
        write_columns(df, path)
        return spark.read.schema(schema).parquet(path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """``df``, marked to be broadcast if it was counted to hold ``rows`` rows at most; beyond them a join shuffles it."""
    kept = checkpointed(df)
    return F.broadcast(kept) if kept.count() <= rows else kept


class LazyTables(Mapping):
    """Tables whose plans are built when first asked for."""

    def __init__(self, builders: dict[str, Callable[[], DataFrame]]):
        self.builders, self._built = builders, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self.builders[name]()
        return self._built[name]

    def __contains__(self, name: object) -> bool:
        return name in self.builders

    def __iter__(self) -> Iterator[str]:
        return iter(self.builders)

    def __len__(self) -> int:
        return len(self.builders)


class StoredTables(LazyTables):
    """Derived tables, each written once per application when first asked for, then read back.

    Later queries scan columnar files with pruning and pushdown instead of deriving rows again. Tables named in ``derived`` are
    larger than what they are told by, and are derived with the columns that a query reads.
    """

    _written: dict[tuple[str, str, str], str] = {}

    def __init__(self, spark: SparkSession, label: str, builders: dict[str, Callable[[], DataFrame]], derived: Collection[str] = ()):
        super().__init__(builders)
        self.spark, self.label, self.derived = spark, label, derived

    def __getitem__(self, name: str) -> DataFrame:
        if name in self.derived:
            return super().__getitem__(name)
        key = (self.spark.sparkContext.applicationId, self.label, name)
        if key not in self._written:
            digest = hashlib.sha256(self.label.encode()).hexdigest()[:16]
            path = f"{shared_folder(self.spark)}/corpusloom-{key[0]}/{digest}/{name}"
            write_columns(self.builders[name](), path)
            self._written[key] = path
        return self.spark.read.parquet(self._written[key])
