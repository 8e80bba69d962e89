import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from corpusloom.corpus import Corpus, Head, shaped  # noqa: E402
from corpusloom.functions import ids  # noqa: E402
from corpusloom.schema import CORPUS_TABLES  # noqa: E402
from corpusloom.session import local_session  # noqa: E402

NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
CORPUS_ID = "3f2504e0-4f89-41d3-9a0c-0305e82c3301"


@pytest.fixture(scope="session")
def spark():
    return local_session(shuffle_partitions=4)


@pytest.fixture(scope="session")
def make_corpus(spark):
    """A corpus from (pointer, title, description[, lifecycle]) rows and (key, prefix, declaration) graphs."""
    from pyspark.sql import functions as F

    def build(rows, graphs=(("examples", "E", "E0"),), predicates=(), tags=()):
        declared = [(d, f"object: {k}", f"Namespace {p}.", "promoted") for k, p, d in graphs]
        full = declared + [(*r, "promoted")[:4] for r in rows]
        nodes = spark.createDataFrame([(i, *r) for i, r in enumerate(full)], "i BIGINT, pointer STRING, title STRING, description STRING, lifecycle_state STRING")
        nodes = nodes.withColumn("uuid", ids.uuid5_col(NAMESPACE, "pointer")).withColumn(
            "created_at", ids.ns_time(F.lit("1999-01-01").cast("timestamp"), F.col("i")))
        nodes = nodes.withColumn("current_revision_uuid", ids.derived_uuid_col(NAMESPACE, "revision", "uuid"))
        g = spark.createDataFrame([(k, p, d) for k, p, d in graphs], "graph_key STRING, pointer_prefix STRING, decl STRING").select(
            ids.uuid5_col(NAMESPACE, "decl").alias("graph_uuid"), "graph_key", "pointer_prefix", F.lit("").alias("description"))
        owner = F.lit(None).cast("string")
        for k, p, d in sorted(graphs, key=lambda x: len(x[1])):
            owner = F.when(F.col("pointer").startswith(p), F.lit(d)).otherwise(owner)
        members = nodes.where("lifecycle_state = 'promoted'").withColumn("decl", owner).where("decl IS NOT NULL").select(
            ids.uuid5_col(NAMESPACE, "decl").alias("graph_uuid"), F.col("uuid").alias("node_uuid"), F.col("i").alias("ordinal"))
        queue = nodes.where("lifecycle_state = 'staged'").select(F.col("uuid").alias("node_uuid"), F.lit("examples").alias("intended_graph_key"),
                                                                  F.lit("").alias("tracking_note"), F.lit("pending").alias("status"))
        registry = lambda names, column: spark.createDataFrame([(n,) for n in names], "p STRING").select(ids.uuid5_col(NAMESPACE, "p").alias(column))
        built = {
            "node_identity": nodes.withColumn("sigil", F.lit("pgx:")),
            "node_revision": nodes.withColumn("revision_uuid", F.col("current_revision_uuid")).withColumn("node_uuid", F.col("uuid"))
                                  .withColumn("content_hash", ids.content_hash("title", "description")).withColumn("reason", F.lit("")),
            "graphs": g, "graph_membership": members, "staging_queue": queue,
            "predicate_registry": registry(predicates, "predicate_uuid"), "tag_registry": registry(tags, "tag_uuid"),
        }
        tables = {n: shaped(df, CORPUS_TABLES[n]) for n, df in built.items()}
        return Corpus(spark, tables, NAMESPACE, CORPUS_ID, head=Head(CORPUS_ID, "00000000-0000-0000-0000-000000000001", 0)).settled()
    return build
