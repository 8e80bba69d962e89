"""Registered queries of file sources, branch sources, embeddings of notation, new tags and branch objects, and terms over time."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import ids, text
from corpusloom.functions.durable import shared_folder
from corpusloom.operators import changes, filetree, viewalgebra, views
from corpusloom.plans import bindings as b
from corpusloom.plans.registry import query
from corpusloom.plans.sqltwins import with_ctes
from corpusloom.sources import files, snapshots


# ---- files ------------------------------------------------------------------------
def _document_files(spark: SparkSession, sf: str) -> str:
    """Every document as a file of its own below a new folder: Markdown by language, texts without a language as hidden data files."""
    root = re.sub(r"^file:/+", "/", f"{shared_folder(spark).rstrip('/')}/corpusloom-files-{uuid.uuid4().hex}")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for path, body in zip(batch["path"], batch["body"], strict=True):
                system.create_dir(f"{base}/{path.rpartition('/')[0]}", recursive=True)
                with system.open_output_stream(f"{base}/{path}") as out:
                    out.write(bytes(body))
            yield batch[["path"]]

    short = F.col("n_chars") < 100
    path = F.when(short, b._text(F.col("lang"), "/.cache/D", F.col("doc_id"), ".bin")).otherwise(b._text(F.col("lang"), "/a b/D", F.col("doc_id"), ".md"))
    rows = b.table(spark, sf, "documents").select(path.alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("body"))
    rows.mapInPandas(write, "path STRING").write.format("noop").mode("overwrite").save()
    return root


_PATH = "CASE WHEN n_chars < 100 THEN lang||'/.cache/D'||doc_id||'.bin' ELSE lang||'/a b/D'||doc_id||'.md' END"


@query("s6_markdown", f"SELECT {_PATH} AS path, text FROM documents WHERE n_chars >= 100")
def markdown(spark: SparkSession, sf: str) -> DataFrame:
    """A folder of notes read back, each as one text with its path."""
    return files.read_markdown(spark, _document_files(spark, sf))


@query("s7_inventory", f"SELECT {_PATH} AS path, sha256(text) AS sha256, strlen(text) AS size_bytes FROM documents")
def inventory(spark: SparkSession, sf: str) -> DataFrame:
    """All files of a folder, hidden ones too, with their digests and sizes."""
    return files.file_inventory(spark, _document_files(spark, sf))


@query("c4_many_needles", with_ctes("node", """SELECT DISTINCT 'unlinked.referenced' AS code, needle AS key, path AS detail FROM (
      SELECT path, hit[1:i] AS needle FROM (SELECT path, hit, unnest(range(2, len(hit) + 1)) AS i FROM (
        SELECT pointer AS path, unnest(regexp_extract_all(description, '[OC][0-9]+')) AS hit FROM node)))
    WHERE needle != path AND (needle IN (SELECT 'O'||o_orderkey FROM orders) OR needle IN (SELECT 'C'||c_custkey FROM customer))"""))
def many_needles(spark: SparkSession, sf: str) -> DataFrame:
    """Every text that mentions the name of an order or a customer, sought all at once."""
    c = b.corpus(spark, sf)
    texts = views.current_nodes(c).where("NOT pointer RLIKE '^U[0-9]'").select(F.col("pointer").alias("path"), F.col("description").alias("text"))
    names = b.table(spark, sf, "orders").select(b.pointer("O", "o_orderkey").alias("resource")).union(b.table(spark, sf, "customer").select(b.pointer("C", "c_custkey")))
    return filetree.check_unlinked_many(texts, names).select("code", "key", "detail")


@query("s8_read_branches", with_ctes("slice", """SELECT label AS branch, 'Order '||o_orderkey AS title, 'price '||round(o_totalprice*100)::BIGINT AS description FROM slice
    UNION ALL SELECT label, 'Order '||o_orderkey, 'price '||round(o_totalprice*100)::BIGINT||' seen '||label FROM slice WHERE o_orderpriority = '1-URGENT'"""))
def branch_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Three branches written to storage and read back side by side: the revisions of each."""
    root = f"{shared_folder(spark).rstrip('/')}/corpusloom-branches-{uuid.uuid4().hex}"
    for label in b.BRANCH_RULES:
        branch = b.branch(spark, sf, label)
        snapshots.write_corpus(branch, f"{root}/{label}", branch.head)
    return snapshots.read_branches(spark, {label: f"{root}/{label}" for label in b.BRANCH_RULES})["node_revisions"].select("branch", "title", "description")


# ---- writes -----------------------------------------------------------------------
@query("t6_embed_traversals", with_ctes("decl", """SELECT 'C'||c_custkey AS pointer, CASE WHEN c_acctbal < 0 THEN 'unlawful_notation' WHEN c_mktsegment = 'BUILDING' THEN 'stale_write' ELSE 'done' END AS outcome,
    CASE WHEN c_acctbal >= 0 AND c_mktsegment != 'BUILDING' THEN 'Customer in ['||n_name||'](N'||c_nationkey||'). Segment '||c_mktsegment||'.'||chr(10)||chr(10)||'### Traversal expression'||chr(10)||chr(10)||
      '```pgx-traversal'||chr(10)||'[(C'||c_custkey||'):(PRN001):(N'||c_nationkey||')]'||chr(10)||'```'||CASE WHEN c_mktsegment = 'MACHINERY' THEN chr(10)||chr(10)||'Read: at home in '||n_name ELSE '' END END AS description
    FROM customer JOIN nation ON c_nationkey = n_nationkey"""))
def embedded(spark: SparkSession, sf: str) -> DataFrame:
    """An expression put into each customer's text; debtors' lack a bracket, builders' expect another revision."""
    c = b.corpus(spark, sf)
    rows = b.table(spark, sf, "customer").join(b.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    known = c["node_identity"].select("pointer", "current_revision_uuid")
    ops = rows.withColumn("pointer", b.pointer("C", "c_custkey")).join(known, "pointer").select(
        F.col("c_custkey").alias("index"), "pointer",
        b._text(" ( ", b.pointer("C", "c_custkey"), "):(PRN001): (", b.pointer("N", "c_nationkey"), F.when(F.col("c_acctbal") < 0, "").otherwise(")")).alias("notation"),
        F.when(F.col("c_mktsegment") == "MACHINERY", b._text("at home in ", F.col("n_name"))).alias("read"),
        F.when(F.col("c_mktsegment") == "BUILDING", "another").otherwise(F.col("current_revision_uuid")).alias("expected_revision_uuid"))
    plan = changes.embed_traversals(c, ops)
    codes = plan.rejections.groupBy("index").agg(F.max("code").alias("code"))
    texts = plan.appended["node_revision"].select("revision_uuid", "description")
    done = plan.results.join(texts, "revision_uuid", "left").join(codes, "index", "left")
    outcome = F.coalesce("code", "outcome")
    return done.select("pointer", outcome.alias("outcome"), F.when(outcome == "done", F.col("description")).alias("description"))


@query("w9_create_tags", """SELECT 'TGN1'||lpad(n_nationkey::VARCHAR, 3, '0') AS pointer, 'tag: '||n_name AS title, NULL::VARCHAR AS code FROM nation
    UNION ALL SELECT 'X'||r_regionkey, NULL, 'outside_namespace' FROM region""")
def new_tags(spark: SparkSession, sf: str) -> DataFrame:
    """A tag for every nation; those for regions lie outside the tags' namespace."""
    nation, region = b.table(spark, sf, "nation"), b.table(spark, sf, "region")
    ops = nation.select(F.col("n_nationkey").cast("long").alias("index"), b._text("TGN1", F.lpad(F.col("n_nationkey").cast("string"), 3, "0")).alias("pointer"),
                        b._text("tag: ", F.col("n_name")).alias("title"), b._text("Marks ", F.col("n_name")).alias("description")).unionByName(
        region.select((F.col("r_regionkey") + 1000).cast("long").alias("index"), b.pointer("X", "r_regionkey").alias("pointer"),
                      b._text("tag: ", F.col("r_name")).alias("title"), F.lit("-").alias("description")))
    plan = changes.create_tags(b.corpus(spark, sf), ops)
    refused = plan.rejections.join(ops.select("index", "pointer"), "index").select("pointer", F.lit(None).cast("string").alias("title"), "code")
    named = plan.appended["node_identity"].select(F.col("uuid").alias("tag_uuid"), "pointer").join(
        plan.appended["node_revision"].select(F.col("node_uuid").alias("tag_uuid"), "title"), "tag_uuid")
    made = plan.appended["tag_registry"].join(named, "tag_uuid").select("pointer", "title", F.lit(None).cast("string").alias("code"))
    return refused.unionByName(made.join(refused.select("pointer"), "pointer", "left_anti"))


_PART_KIND = "CASE WHEN p_size = 1 THEN 'graph' WHEN p_size = 2 THEN 'tree' ELSE 'node' END"


@query("w14_create_objects", f"""SELECT CASE WHEN p_size = 3 THEN '' ELSE 'P'||p_partkey END AS alias, {_PART_KIND} AS object_kind, p_name AS title,
    CASE WHEN p_size = 2 THEN 'object_kind' WHEN p_size = 3 THEN 'empty_alias' END AS code FROM part""")
def new_objects(spark: SparkSession, sf: str) -> DataFrame:
    """Every part as an object of a branch, some of an unknown kind and some without an alias."""
    plan, _ = _part_objects(spark, sf)
    kinds = plan.appended["semantic_objects"].select("object_uuid", "object_kind")
    titles = plan.appended["node_revisions"].select(F.col("node_uuid").alias("object_uuid"), "title")
    aliases = plan.appended["object_alias_assertions"].select("object_uuid", F.col("alias_text").alias("alias"))
    rows = plan.results.select("index", "object_uuid").join(kinds, "object_uuid").join(titles, "object_uuid").join(aliases, "object_uuid")
    return rows.join(plan.rejections.select("index", "code"), "index", "left").select("alias", "object_kind", "title", "code")


def _part_objects(spark: SparkSession, sf: str):
    east = b.branch(spark, sf, "east")
    kind = F.when(F.col("p_size") == 1, "graph").when(F.col("p_size") == 2, "tree").otherwise("node")
    ops = b.table(spark, sf, "part").select(F.col("p_partkey").alias("index"), F.when(F.col("p_size") == 3, "").otherwise(b.pointer("P", "p_partkey")).alias("alias"),
                                            F.col("p_name").alias("title"), F.col("p_brand").alias("description"), kind.alias("object_kind"), "p_size")
    return changes.create_objects(east, ops.drop("p_size")), ops


@query("w14_memberships", """SELECT p_partkey, CASE WHEN p_size = 4 OR p_size = 5 THEN 'graph_or_object_missing' END AS code, p_brand AS order_key
    FROM part WHERE EXISTS (SELECT 1 FROM part WHERE p_size = 1)""")
def new_memberships(spark: SparkSession, sf: str) -> DataFrame:
    """Every part put into the first graph among the parts; some name an object that is no graph, some are not there."""
    plan, ops = _part_objects(spark, sf)
    east = b.branch(spark, sf, "east")
    objects = east["semantic_objects"].unionByName(plan.appended["semantic_objects"])
    of = plan.results.select("index", "object_uuid")
    graph = ops.where("object_kind = 'graph'").join(of, "index").agg(F.min_by("object_uuid", "index").alias("g"))
    rows = ops.join(of, "index").join(graph, F.col("g").isNotNull()).select(
        "index", F.when(F.col("p_size") == 4, F.col("object_uuid")).otherwise(F.col("g")).alias("graph_uuid"),
        F.when(F.col("p_size") == 5, F.lit("gone")).otherwise(F.col("object_uuid")).alias("object_uuid"), F.col("description").alias("order_key"))
    added = changes.add_memberships(east.with_tables(semantic_objects=objects), rows)
    placed = added.results.select("index", "membership_uuid").join(added.appended["graph_membership_assertions"].select("membership_uuid", "order_key"), "membership_uuid")
    return placed.join(added.rejections.select("index", "code"), "index", "left").select(F.col("index").alias("p_partkey"), "code", "order_key")


# ---- terms over time --------------------------------------------------------------
_AWAY = 6 * 3600
_SAID = r"""SELECT term, ts, count(*) AS members, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY term ORDER BY ts) AS away FROM (
    SELECT unnest(list_distinct(list_append(regexp_extract_all(lower(props), '[\p{L}\p{N}]+'), event_type))) AS term, ts FROM events) GROUP BY term, ts"""
_STRETCHES = f"""SELECT term, min(ts) AS started_at, max(ts) AS ended_at, sum(members)::BIGINT AS members, max(away) AS away FROM (
    SELECT *, sum(CASE WHEN away IS NULL OR away > {_AWAY * 1_000_000} THEN 1 ELSE 0 END) OVER (PARTITION BY term ORDER BY ts) AS island FROM ({_SAID})) GROUP BY term, island"""
_MOMENT_SQL = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"


def _stretches(spark: SparkSession, sf: str) -> DataFrame:
    events = b.table(spark, sf, "events").select("event_type", F.col("ts").alias("moment"), text.words(F.col("props")).alias("words"))
    terms = F.array_distinct(F.array_append("words", F.col("event_type")))
    return viewalgebra.sessions(events.select(F.explode(terms).alias("term"), "moment"), _AWAY)


def _moment(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name)


@query("m17_islands", f"SELECT term, {_MOMENT_SQL.format('started_at')} AS started_at, {_MOMENT_SQL.format('ended_at')} AS ended_at, members FROM ({_STRETCHES})")
def islands(spark: SparkSession, sf: str) -> DataFrame:
    """The stretches in which each word of the events keeps coming back within six hours."""
    return _stretches(spark, sf).select("term", _moment("started_at"), _moment("ended_at"), "members")


@query("m17_sessions", f"""SELECT term, {_MOMENT_SQL.format('min(started_at)')} AS first_at, {_MOMENT_SQL.format('max(ended_at)')} AS last_at, count(*) AS islands,
    max(away)::BIGINT AS longest_gap_us, sum(members)::BIGINT AS members FROM ({_STRETCHES}) GROUP BY term""")
def terms_over_time(spark: SparkSession, sf: str) -> DataFrame:
    """First and last time, number of stretches and longest gap of each word of the events."""
    rows = viewalgebra.recurrence_over_time(_stretches(spark, sf))
    return rows.select("term", _moment("first_at"), _moment("last_at"), "islands", F.round(F.col("longest_gap") * 1e6).cast("long").alias("longest_gap_us"), "members")
