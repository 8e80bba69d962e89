"""Operation logs: one JSON request per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.functions import ids
from corpusloom.schema import flat_schema

ARGUMENTS = ("pointer STRING, title STRING, description STRING, graph_key STRING, pointer_prefix STRING, "
             "expected_revision_uuid STRING, target_revision_uuid STRING, reason STRING, notation STRING, read STRING, "
             "subject_pointer STRING, predicate_pointer STRING, object_pointer STRING, tag_pointer STRING, scope STRING, tracking_note STRING")
REQUEST = (StructType().add("request_id", "string").add("tool", "string").add("arguments", flat_schema(ARGUMENTS))
           .add("change_set_id", "string").add("ts", "timestamp").add("_corrupt", "string"))


def hashed_requests(df: DataFrame) -> DataFrame:
    """Adds ``input_hash`` over the canonical JSON of the arguments that were given."""
    # Field order inside the struct is made alphabetical; absent arguments leave no trace.
    names = sorted(f.name for f in REQUEST["arguments"].dataType.fields)
    canonical = F.to_json(F.struct(*[F.col(f"arguments.{n}").alias(n) for n in names]))
    return df.withColumn("input_hash", ids.input_hash(F.col("tool"), canonical, F.col("change_set_id")))


def is_bad() -> Column:
    """Whether a parsed line holds no request."""
    return F.col("_corrupt").isNotNull() | F.col("request_id").isNull() | F.col("tool").isNull()


def split_bad(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.where(~is_bad()), df.where(is_bad())


def read_oplog(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(requests, rejects)`` of a log folder."""
    # Parsed from text, because a JSON scan may not select the corrupt-record column alone.
    lines = spark.read.text(path).select(F.from_json("value", REQUEST, {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"), "value").select("r.*", "value")
    good, bad = split_bad(lines.withColumn("_corrupt", F.coalesce("_corrupt", F.when(F.col("tool").isNull(), F.col("value")))))
    return hashed_requests(good.drop("_corrupt", "value")), bad.select(F.col("value").alias("line"))


def as_operations(requests: DataFrame) -> DataFrame:
    """Requests as rows for the change operators."""
    return requests.select("index", F.col("tool").alias("operation"), "arguments.*", F.col("request_id").alias("request_uuid"))
