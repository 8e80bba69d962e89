"""Positions of rows within groups of any size."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from corpusloom.llm.common import stored


def numbered(rows: DataFrame, key: str, order: Sequence[Column], folder: str, name: str, out: str) -> DataFrame:
    """A stored table of ``rows`` with ``out``, the position from 0 among the rows of one ``key`` along ``order``.

    Rows are dealt by ranges of (key, order), so that a hot key lies over many tasks; a task counts as it reads, and only the
    keys that begin in one task and go on in another, at most two a task, have their counts moved on. The table is written
    before its counts are used, so a task that runs again can't find other ranges. Nulls come first.
    """
    import pyarrow as pa

    schema = StructType([*rows.schema.fields, StructField("_task", LongType()), StructField(out, LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, last, n, started = TaskContext.get().partitionId(), None, 0, False
        for batch in batches:
            at = []
            for value in batch.column(key).to_pylist():
                n = n + 1 if started and value == last else 0
                last, started = value, True
                at.append(n)
            arrays = [*batch.columns, pa.array([task] * len(at), pa.int64()), pa.array(at, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "_task", out])

    by = [F.col(key).asc_nulls_first(), *order]
    table = stored(rows.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(count, schema), folder, name)
    pieces = table.groupBy(F.col(key).alias("_key"), F.col("_task").alias("_of")).agg((F.max(out) + 1).alias("_n"))
    several = pieces.groupBy(F.col("_key").alias("_several")).agg(F.count(F.lit(1)).alias("_tasks")).where("_tasks > 1")
    pieces = pieces.join(several, F.col("_key").eqNullSafe(F.col("_several")), "left_semi")
    before = W.partitionBy("_key").orderBy("_of").rowsBetween(W.unboundedPreceding, -1)
    shifts = pieces.select("_key", "_of", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    joined = table.join(F.broadcast(shifts), table[key].eqNullSafe(F.col("_key")) & (F.col("_task") == F.col("_of")), "left")
    return joined.withColumn(out, F.col(out) + F.coalesce("_shift", F.lit(0))).drop("_key", "_of", "_shift", "_task")
