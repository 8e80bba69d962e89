"""Incremental ingest of an operation log as a Structured Streaming query."""

from __future__ import annotations

import hashlib
import uuid
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.corpus import Corpus, shaped
from corpusloom.functions.durable import checkpointed
from corpusloom.functions.ordered import grouped_rank
from corpusloom.operators.changes import SUPPORTED, Changes, dedupe_requests, ledger_rows, next_head, plan_changes
from corpusloom.schema import CORPUS_TABLES
from corpusloom.sources.oplog import REQUEST, as_operations, hashed_requests, is_bad
from corpusloom.sources.snapshots import _latest, commit_changes, read_corpus


def oplog_stream(spark: SparkSession, path: str) -> DataFrame:
    """Every line of a log folder as it comes: its request, and the ``line`` itself where it holds none.

    Requests without a time take that of their file. However late a request is, it is passed on: resends are known by the
    ledger, not by their time.
    """
    lines = spark.readStream.format("text").load(path)
    parsed = lines.select(F.from_json("value", REQUEST, {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"), "value",
                          F.col("_metadata.file_modification_time").alias("modified")).select("r.*", "value", "modified")
    timed = hashed_requests(parsed.withColumn("ts", F.coalesce("ts", "modified")))
    return timed.withColumn("line", F.when(is_bad(), F.col("value"))).drop("value", "modified", "_corrupt")


def ingest_oplog(stream: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Applies each micro-batch of ``stream`` to the corpus at ``root`` as one commit.

    Replays are dropped; conflicting reuses and lines that hold no request are set aside. Each request is judged, and only
    sound ones are applied. A batch that was committed before a failure is recognised by its number and skipped.
    """
    spark = stream.sparkSession

    def apply(batch: DataFrame, number: int) -> None:
        apply_batch(read_corpus(spark, root), batch, root, f"{checkpoint}#{number}")

    return (stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
                  .trigger(availableNow=True).start())


def apply_batch(c: Corpus, batch: DataFrame, root: str, batch_key: str) -> Corpus:
    """One commit from a batch of requests; refused requests go to the ``refused`` folder with reasons."""
    request = str(uuid.uuid5(uuid.UUID(c.corpus_id), f"batch:{batch_key}"))
    if not c["semantic_snapshots"].where(F.col("request_uuid") == request).isEmpty():
        return c
    batch = checkpointed(batch)
    if "line" in batch.columns:
        corrupt = batch.where("line IS NOT NULL").select("request_id", F.lit("corrupt_line").alias("code"), F.col("line").alias("detail"))
        batch = batch.where("line IS NULL").drop("line")
    else:
        corrupt = batch.limit(0).select("request_id", F.lit("").alias("code"), F.lit("").alias("detail"))
    judged = dedupe_requests(batch.select("request_id", "tool", "input_hash"), c["operation_ledger"])
    first_arrival = F.row_number().over(W.partitionBy("request_id").orderBy("ts"))
    fresh = batch.join(judged.where("disposition = 'new'").select("request_id"), "request_id", "left_semi").withColumn("_k", first_arrival).where("_k = 1").drop("_k")
    ordered = grouped_rank(fresh.withColumn("_all", F.lit(1)), ["_all"], [F.col("ts"), F.col("request_id")], F.date_trunc("minute", "ts"), "index").drop("_all")
    conflicts = judged.where("disposition = 'conflict'").select("request_id", F.lit("request_reused").alias("code"), F.lit(None).cast("string").alias("detail"))
    at = batch.agg(F.max("ts").alias("t")).first()["t"]
    stamp = _stamp(c, at) if at is not None else None
    sound, refused, changes = _sound(c, ordered, stamp)
    reasons = corrupt.unionByName(conflicts).unionByName(refused)
    if not reasons.isEmpty():
        reasons.write.mode("overwrite").parquet(f"{root}/refused/{request}")
    if sound.isEmpty():
        return c
    digest = hashlib.sha256(batch_key.encode()).hexdigest()
    head, transition = next_head(c, c.head, request, "batch.apply", digest, {"batch": batch_key})
    listed = sound.select("index", F.col("request_id").alias("request_uuid"), F.col("tool").alias("tool_name"), "input_hash",
                          F.col("change_set_id").alias("change_set_uuid"), F.lit(stamp).alias("at"))
    first = (_latest(c.spark, root) or {}).get("requests", 0)
    books = ledger_rows(c, listed, first)
    own = {"output_snapshot_uuid": F.lit(head.snapshot_uuid), "input_snapshot_uuid": F.lit(c.head.snapshot_uuid), "transition_digest": F.lit(transition)}
    ledger = books.ledger.withColumns(own)
    receipts = books.receipts.withColumn("output_snapshot_uuid", F.lit(head.snapshot_uuid))
    snapshot = c.spark.range(1).select(
        F.lit(head.snapshot_uuid).alias("snapshot_uuid"), F.lit(c.head.snapshot_uuid).alias("parent_snapshot_uuid"), F.lit(c.corpus_id).alias("corpus_id"),
        F.lit(head.sequence).alias("database_sequence"), F.lit(transition).alias("transition_digest"), F.lit(request).alias("request_uuid"),
        F.lit("batch.apply").alias("tool_name"), F.lit(stamp).alias("created_at"))
    extra = {"operation_ledger": ledger, "change_set_receipts": receipts, "semantic_snapshots": shaped(snapshot, CORPUS_TABLES["semantic_snapshots"])}
    return commit_changes(c, changes, root, head, extra, {"requests": first + sound.count()})


def _stamp(c: Corpus, at: datetime) -> str:
    """The batch's time in whole seconds, later than that of every commit before it, also if its requests are late."""
    last = c["semantic_snapshots"].agg(F.max(F.substring("created_at", 1, 19))).first()[0]
    moment = at.replace(microsecond=0)
    if last is not None:
        moment = max(moment, datetime.fromisoformat(last) + timedelta(seconds=1))
    return f"{moment:%Y-%m-%d %H:%M:%S}"


def _sound(c: Corpus, requests: DataFrame, stamp: str) -> tuple[DataFrame, DataFrame, Changes]:
    """Requests that pass, refusals, and the plan. Refusing one can unsettle a later one that built on it, so repeat."""
    requests = checkpointed(requests)
    known = requests.where(F.col("tool").isin(*SUPPORTED)).select("tool").distinct()
    kinds = {r["tool"] for r in known.collect()}  # at most the supported names
    refused = None
    while True:
        plan = plan_changes(c, as_operations(requests), stamp, kinds)
        bad = checkpointed(plan.rejections.join(requests.select("index", "request_id"), "index").select("request_id", "code", "detail"))
        if bad.isEmpty():
            return requests, refused if refused is not None else bad, plan
        refused = bad if refused is None else refused.unionByName(bad)
        requests = checkpointed(requests.join(bad.select("request_id").distinct(), "request_id", "left_anti"))
