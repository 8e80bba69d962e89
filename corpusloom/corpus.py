"""A corpus state: named DataFrames with fixed layouts plus a few constants."""

from __future__ import annotations

from collections import ChainMap
from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.durable import checkpointed
from corpusloom.functions.text import ReferenceProfile
from corpusloom.schema import BRANCH_TABLES, CORPUS_TABLES, Table


@dataclass(frozen=True)
class Head:
    corpus_id: str
    snapshot_uuid: str | None
    sequence: int


@dataclass(frozen=True)
class Corpus:
    spark: SparkSession
    tables: Mapping[str, DataFrame]
    namespace: str
    corpus_id: str
    profile: ReferenceProfile = field(default_factory=ReferenceProfile)
    head: Head | None = None

    layout = CORPUS_TABLES

    def __getitem__(self, name: str) -> DataFrame:
        if name in self.tables:
            return self.tables[name]
        return self.spark.createDataFrame([], self.layout[name].schema)

    def with_tables(self, **tables: DataFrame) -> Corpus:
        return replace(self, tables=ChainMap(tables, self.tables))

    def settled(self) -> Corpus:
        """The same state with every table checkpointed, so that further batches start from short plans."""
        return replace(self, tables={name: checkpointed(df) for name, df in self.tables.items()})

    def spec(self, name: str) -> Table:
        return self.layout[name]


@dataclass(frozen=True)
class Branch(Corpus):
    """A workspace whose immutable rows can be united with those of other workspaces."""

    workspace_uuid: str = ""
    replica_uuid: str = ""
    sources: tuple[Branch, ...] = ()  # the branches that a composition unites, in their order

    layout = BRANCH_TABLES

    def with_tables(self, **tables: DataFrame) -> Branch:
        return replace(super().with_tables(**tables), sources=())


def shaped(df: DataFrame, table: Table) -> DataFrame:
    """Exactly the table's columns, in order and type; a missing column is null."""
    present = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in table.schema.fields
    ])
