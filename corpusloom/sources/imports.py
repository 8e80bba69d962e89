"""Import of first-generation node tables, in which a node had one text and no history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.corpus import Corpus, shaped
from corpusloom.functions import ids
from corpusloom.operators.references import build_reference_index, validate_links
from corpusloom.operators.views import current_nodes
from corpusloom.schema import CORPUS_TABLES


def import_v1(spark: SparkSession, tables: dict[str, DataFrame], namespace: str, corpus_id: str) -> tuple[Corpus, DataFrame]:
    """``(corpus, mismatches)`` from ``nodes``, ``graphs``, ``graph_membership`` and optional tables.

    Node ids are derived again from the pointers; nodes whose stored id differs are the mismatches,
    and an import with any must not be used. The node's time becomes that of its first revision.
    """
    missing = {"nodes", "graphs", "graph_membership"} - set(tables)
    if missing:
        raise ValueError(f"missing tables: {sorted(missing)}")
    nodes = tables["nodes"].withColumn("lifecycle_state", F.lit("promoted"))
    if "staging_nodes" in tables:
        nodes = nodes.unionByName(tables["staging_nodes"].withColumn("lifecycle_state", F.lit("staged")))
    nodes = nodes.withColumn("expected", ids.uuid5_col(namespace, "pointer"))
    mismatches = nodes.where(F.col("uuid") != F.col("expected")).select("pointer", F.col("uuid").alias("stored"), "expected")
    first = ids.derived_uuid_col(namespace, "revision", F.col("uuid"), F.col("data_one"), ids.content_hash("title", "description"), F.lit(""))
    nodes = nodes.withColumn("revision_uuid", first)
    built = {
        "node_identity": nodes.select("uuid", "pointer", F.lit("pgx:").alias("sigil"), F.col("data_one").alias("created_at"),
                                      "lifecycle_state", F.col("revision_uuid").alias("current_revision_uuid")),
        "node_revision": nodes.select("revision_uuid", F.col("uuid").alias("node_uuid"), "title", "description", F.col("data_one").alias("created_at"),
                                      ids.content_hash("title", "description").alias("content_hash"), F.lit("import").alias("reason")),
        "graphs": tables["graphs"], "graph_membership": tables["graph_membership"],
    }
    for name in ("predicate_registry", "tag_registry"):
        if name in tables:
            built[name] = tables[name]
    if "triples" in tables:
        keys = [F.col(k) for k in ("subject_uuid", "predicate_uuid", "object_uuid")]
        built["triples"] = tables["triples"].withColumn("triple_uuid", ids.derived_uuid_col(namespace, "triple", *keys)).withColumnRenamed("data_one", "created_at")
    if "node_tags" in tables:
        keys = [F.col(k) for k in ("subject_uuid", "tag_uuid")]
        built["node_tags"] = tables["node_tags"].withColumn("assignment_uuid", ids.derived_uuid_col(namespace, "tag-assignment", *keys)).withColumnRenamed("data_one", "created_at")
    c = Corpus(spark, {n: shaped(df, CORPUS_TABLES[n]) for n, df in built.items()}, namespace, corpus_id)
    if "staging_queue" in tables:
        staged = current_nodes(c).where("lifecycle_state = 'staged'")
        blocked = validate_links(staged, c).where("severity = 'error'").select(F.col("source_node_uuid").alias("node_uuid"), F.lit(True).alias("_bad")).distinct()
        queue = tables["staging_queue"].join(blocked, "node_uuid", "left").withColumn("status", F.when(F.col("_bad"), "blocked").otherwise("pending"))
        c = c.with_tables(staging_queue=shaped(queue, CORPUS_TABLES["staging_queue"]))
    return c.with_tables(reference_occurrences=build_reference_index(c)), mismatches
