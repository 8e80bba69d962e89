"""Stands the benchmark tables up as a corpus.

Pointers are a letter prefix plus the table key; texts, links, triples, revisions, requests,
branches and views are derived from columns, so everything grows with the tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.corpus import Branch, Corpus, Head, shaped
from corpusloom.functions import ids
from corpusloom.functions.durable import LazyTables, StoredTables
from corpusloom.functions.ordered import grouped_previous, grouped_rank
from corpusloom.operators.references import build_reference_index
from corpusloom.operators.search import BlockIndex, SearchIndex, build_blocks, count_terms, dealt_by_node, documents, occurrences, searchable, summed_blocks
from corpusloom.schema import BRANCH_TABLES, CORPUS_TABLES

NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"  # the public URL namespace
CORPUS_ID = "3f2504e0-4f89-41d3-9a0c-0305e82c3301"

# graph_key, pointer_prefix, declaration pointer
GRAPHS = [
    ("regions", "RG", "RG.decl"), ("nations", "N", "N.decl"), ("customers", "C", "C.decl"),
    ("customers-one", "C1", "C1.decl"), ("suppliers", "S", "S.decl"), ("parts", "P", "P.decl"),
    ("orders", "O", "O.decl"), ("documents", "D", "D.decl"), ("users", "U", "U.decl"),
    ("predicates", "PRN", "PRN000"), ("tags", "TGN", "TGN000"), ("sentinels", "SNT", "SNT000"),
]
PREDICATES = [("PRN001", "in"), ("PRN002", "placed_by"), ("PRN003", "contains"), ("PRN004", "supplied_by")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pointer(prefix: str, key: str | Column) -> Column:
    return F.concat(F.lit(prefix), (F.col(key) if isinstance(key, str) else key).cast("string"))


def _at(day: str, key: Column | str) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return ids.ns_time(F.lit(day).cast("timestamp"), key.cast("long"))


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def order_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with link prose and a notation block; some links and notations are broken on purpose."""
    orders = table(spark, sf, "orders")
    customer = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name")
    joined = (orders.join(customer, orders.o_custkey == customer.c_custkey)
                    .join(nation, F.col("c_nationkey") == F.col("n_nationkey")))
    priority, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    target = F.when(priority == "5-LOW", pointer("CX", "o_custkey")).otherwise(pointer("C", "o_custkey"))
    marked = (priority == "4-NOT SPECIFIED") & (status == "F")
    anchor = F.when(marked, _text(F.col("c_name"), " ⟦pgx:", pointer("C", "o_custkey"), "⟧")).otherwise(F.col("c_name"))
    closing = F.when((priority == "1-URGENT") & (status == "F"), "]").otherwise(")]")
    notation = _text("[((", pointer("O", "o_orderkey"), "):(PRN002):(", pointer("C", "o_custkey"), ")):(PRN001):(",
                     pointer("N", "c_nationkey"), closing)
    prose = _text("Placed by [", anchor, "](", target, ") in [", F.col("n_name"), "](", pointer("N", "c_nationkey"), ").")
    description = _text(prose, "\n\n### Traversal expression\n\n```pgx-traversal\n", notation, "\n```")
    return joined.select(
        "o_orderkey", "o_custkey", "c_nationkey", "o_orderstatus", "o_orderpriority", "o_orderdate", "o_totalprice",
        pointer("O", "o_orderkey").alias("pointer"), _text("Order ", F.col("o_orderkey")).alias("title"),
        description.alias("description"), notation.alias("notation"),
        F.when(status == "P", "staged").otherwise("promoted").alias("lifecycle_state"))


def node_texts(spark: SparkSession, sf: str) -> DataFrame:
    """All single-revision nodes: kind, graph_key, pointer, title, description, created_at, lifecycle_state, ordinal."""
    region = table(spark, sf, "region")
    nation = table(spark, sf, "nation")
    nations = nation.select("n_nationkey", "n_name")

    def rows(df: DataFrame, kind: str, graph: str | Column, pointer_: Column, title: Column, description: Column,
             created: Column, key: Column, lifecycle: Column | None = None) -> DataFrame:
        graph_col = F.lit(graph) if isinstance(graph, str) else graph
        return df.select(
            F.lit(kind).alias("kind"), graph_col.alias("graph_key"), pointer_.alias("pointer"), title.alias("title"),
            description.alias("description"), created.alias("created_at"),
            (lifecycle if lifecycle is not None else F.lit("promoted")).alias("lifecycle_state"),
            (key.cast("long") + 1).alias("ordinal"))

    declared = spark.createDataFrame([(i, k, p, d) for i, (k, p, d) in enumerate(GRAPHS)],
                                     "i BIGINT, graph_key STRING, prefix STRING, decl STRING")
    predicates = spark.createDataFrame([(i, p, n) for i, (p, n) in enumerate(PREDICATES)],
                                       "i BIGINT, pointer STRING, name STRING")
    region_link = _text("Nation of [", F.col("r_name"), "](", pointer("RG", "n_regionkey"), ").")
    parts = [
        rows(declared, "graph", F.col("graph_key"), F.col("decl"), _text("object: ", F.col("graph_key")),
             _text("Namespace ", F.col("prefix"), "."), _at("1991-01-01", "i"), F.lit(-1)),
        rows(predicates, "predicate", "predicates", F.col("pointer"), _text("predicate: ", F.col("name")),
             _text("Relation ", F.col("name"), "."), _at("1991-01-02", "i"), F.col("i")),
        rows(region, "region", "regions", pointer("RG", "r_regionkey"), F.col("r_name"), _text("Region ", F.col("r_name"), "."),
             _at("1992-01-01", "r_regionkey"), F.col("r_regionkey")),
        rows(nation.join(region, nation.n_regionkey == region.r_regionkey), "nation", "nations",
             pointer("N", "n_nationkey"), F.col("n_name"), region_link, _at("1992-01-02", "n_nationkey"), F.col("n_nationkey")),
        rows(table(spark, sf, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")), "customer",
             F.when(F.col("c_custkey").cast("string").startswith("1"), "customers-one").otherwise("customers"),
             pointer("C", "c_custkey"), F.col("c_name"),
             _text("Customer in [", F.col("n_name"), "](", pointer("N", "c_nationkey"), "). Segment ", F.col("c_mktsegment"), "."),
             _at("1992-01-03", "c_custkey"), F.col("c_custkey")),
        rows(table(spark, sf, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")), "supplier", "suppliers",
             pointer("S", "s_suppkey"), F.col("s_name"),
             _text("Supplier in [", F.col("n_name"), "](", pointer("N", "s_nationkey"), ")."),
             _at("1992-01-04", "s_suppkey"), F.col("s_suppkey")),
        rows(table(spark, sf, "part"), "part", "parts", pointer("P", "p_partkey"), F.col("p_name"), part_text(),
             _at("1992-01-05", "p_partkey"), F.col("p_partkey")),
        rows(order_texts(spark, sf), "order", "orders", F.col("pointer"), F.col("title"), F.col("description"),
             ids.ns_time(F.col("o_orderdate"), F.col("o_orderkey")), F.col("o_orderkey"), F.col("lifecycle_state")),
        rows(table(spark, sf, "documents"), "document", "documents", pointer("D", "doc_id"), _text("Document ", F.col("doc_id")),
             F.col("text"), _at("1992-01-06", "doc_id"), F.col("doc_id")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def part_text() -> Column:
    """Part descriptions cite suppliers in the legacy citation style, some of it protected."""
    return _text("Supplied as **", F.col("p_name"), "** (*S", F.col("p_size"), "*), see (*S", F.col("p_size") + 60,
                 "*). Kept as written: `(*S0*)` and {{{**x** (*S1*)}}}.")


def user_revisions(spark: SparkSession, sf: str) -> DataFrame:
    """Every event is a revision of its user's node, chained in time order."""
    events = table(spark, sf, "events")
    # Chains are found by numbers; ids are told by them afterwards.
    rows = events.select("user_id", "event_id", "ts", "event_type", "value", "props")
    chained = grouped_previous(rows, ["user_id"], [F.col("ts"), F.col("event_id")], F.date_trunc("hour", "ts"), F.struct("event_id"), "_before")
    before = ids.derived_uuid_col(NAMESPACE, "event-revision", F.col("_before.event_id"))
    return chained.select(
        "user_id", "event_id", "ts", "event_type", "value", _event_node().alias("node_uuid"), _event_revision().alias("revision_uuid"),
        F.col("event_type").alias("title"), _text("value=", F.col("value"), " props=", F.col("props")).alias("description"),
        _text(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), "000Z").alias("created_at"),
        F.when(F.col("_before").isNotNull(), before).alias("previous_revision_uuid"))


def _event_node() -> Column:
    return ids.uuid5_col(NAMESPACE, pointer("U", "user_id"))


def _event_revision() -> Column:
    return ids.derived_uuid_col(NAMESPACE, "event-revision", F.col("event_id"))


def last_revisions(spark: SparkSession, sf: str) -> DataFrame:
    """The last of each user's revisions, found without the chain of all of them."""
    events = table(spark, sf, "events").where("user_id IS NOT NULL AND ts IS NOT NULL")
    last = events.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
    return last.select("user_id", _event_node().alias("node_uuid"), _event_revision().alias("current_revision_uuid"))


def triple_rows(spark: SparkSession, sf: str) -> DataFrame:
    """subject, predicate and object pointers with a unique time."""
    nation, customer = table(spark, sf, "nation"), table(spark, sf, "customer")
    supplier, orders, lineitem = table(spark, sf, "supplier"), table(spark, sf, "orders"), table(spark, sf, "lineitem")

    def rows(df: DataFrame, subject: Column, predicate: str, obj: Column, created: Column) -> DataFrame:
        return df.select(subject.alias("subject_pointer"), F.lit(predicate).alias("predicate_pointer"),
                         obj.alias("object_pointer"), created.alias("created_at"))

    def pair_time(day: str, first: str, second: str) -> Column:
        start = F.timestamp_seconds(F.unix_timestamp(F.lit(day).cast("timestamp")) + F.col(first))
        return ids.ns_time(start, F.col(second))

    contains = lineitem.select("l_orderkey", "l_partkey").distinct()
    supplied = lineitem.select("l_partkey", "l_suppkey").distinct()
    parts = [
        rows(nation, pointer("N", "n_nationkey"), "PRN001", pointer("RG", "n_regionkey"), _at("1993-01-01", "n_nationkey")),
        rows(customer, pointer("C", "c_custkey"), "PRN001", pointer("N", "c_nationkey"), _at("1993-01-02", "c_custkey")),
        rows(supplier, pointer("S", "s_suppkey"), "PRN001", pointer("N", "s_nationkey"), _at("1993-01-03", "s_suppkey")),
        rows(orders, pointer("O", "o_orderkey"), "PRN002", pointer("C", "o_custkey"), _at("1993-01-04", "o_orderkey")),
        rows(contains, pointer("O", "l_orderkey"), "PRN003", pointer("P", "l_partkey"),
             pair_time("1994-01-01", "l_orderkey", "l_partkey")),
        rows(supplied, pointer("P", "l_partkey"), "PRN004", pointer("S", "l_suppkey"),
             pair_time("2004-01-01", "l_partkey", "l_suppkey")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def corpus(spark: SparkSession, sf: str) -> Corpus:
    """The whole benchmark corpus; each table is derived and stored when first read."""
    derived = {name: (lambda name=name: _derived(spark, sf)[name]) for name in _LOADED}
    derived["reference_occurrences"] = lambda: build_reference_index(corpus(spark, sf))
    derived["search_occurrences"] = lambda: occurrences(indexed_nodes(corpus(spark, sf)))
    derived["search_postings"] = lambda: count_terms(occurrences(dealt_by_node(indexed_nodes(corpus(spark, sf)), node_count(corpus(spark, sf)))))
    derived["search_blocks"] = lambda: summed_blocks(corpus(spark, sf).tables["search_block_postings"])
    derived["search_block_postings"] = lambda: _blocks(corpus(spark, sf)).postings.repartitionByRange("term", "block").sortWithinPartitions("term", "block")
    derived["search_docs"] = lambda: documents(indexed_nodes(corpus(spark, sf)))
    return Corpus(spark, StoredTables(spark, sf, derived, _UNSTORED), NAMESPACE, CORPUS_ID)


def indexed_nodes(c: Corpus) -> DataFrame:
    """What the search index covers: all promoted nodes."""
    return searchable(c)


def node_count(c: Corpus) -> int:
    """How many nodes there are, promoted or not."""
    return c["node_identity"].count()


def search_index(c: Corpus) -> SearchIndex:
    """The stored index."""
    return SearchIndex(*[c.tables[f"search_{part}"] for part in ("postings", "occurrences", "docs")])


def _blocks(c: Corpus) -> BlockIndex:
    return build_blocks(search_index(c))


def block_index(c: Corpus) -> BlockIndex:
    """The stored index of blocks."""
    return BlockIndex(*[c.tables[f"search_{part}"] for part in ("block_postings", "blocks", "docs")])


_plans: dict[tuple[str, str], dict[str, DataFrame]] = {}


def _derived(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _plans:
        _plans[key] = derive(spark, sf)
    return _plans[key]


# Four ids for each pair of numbers: most queries read few of them, and on disk they are several times the tables that they come from.
_UNSTORED = ("triples",)
_LOADED = ("node_identity", "node_revision", "graphs", "graph_membership", "staging_queue", "predicate_registry", "triples",
           "node_tags", "tag_registry", "sentinel_guidance", "operation_ledger", "semantic_snapshots", "change_sets",
           "change_set_receipts", "corpus_workstreams")


def derive(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Unstored plans of all corpus tables."""
    texts = node_texts(spark, sf).withColumn("uuid", ids.uuid5_col(NAMESPACE, F.col("pointer")))
    first_revision = ids.derived_uuid_col(
        NAMESPACE, "revision", F.col("uuid"), F.col("created_at"),
        ids.content_hash("title", "description"), F.lit(""))
    nodes = texts.withColumn("revision_uuid", first_revision)
    chained = user_revisions(spark, sf)
    users = last_revisions(spark, sf)
    identity = nodes.select("uuid", "pointer", F.lit("pgx:").alias("sigil"), "created_at", "lifecycle_state",
                            F.col("revision_uuid").alias("current_revision_uuid")).unionByName(
        users.select(F.col("node_uuid").alias("uuid"), pointer("U", "user_id").alias("pointer"), F.lit("pgx:").alias("sigil"),
                     _at("1992-01-07", "user_id").alias("created_at"), F.lit("promoted").alias("lifecycle_state"),
                     "current_revision_uuid"))
    revision = nodes.select("revision_uuid", F.col("uuid").alias("node_uuid"), "title", "description", "created_at",
                            F.lit(None).cast("string").alias("previous_revision_uuid")).unionByName(
        chained.select("revision_uuid", "node_uuid", "title", "description", "created_at", "previous_revision_uuid"))
    revision = revision.withColumn("content_hash", ids.content_hash("title", "description")).withColumn("reason", F.lit("load"))
    graphs = spark.createDataFrame(GRAPHS, "graph_key STRING, pointer_prefix STRING, decl STRING").select(
        ids.uuid5_col(NAMESPACE, "decl").alias("graph_uuid"), "graph_key", "pointer_prefix",
        _text("Namespace ", F.col("pointer_prefix"), ".").alias("description"))
    keys = graphs.select("graph_uuid", "graph_key")
    member = nodes.where("lifecycle_state = 'promoted'").join(keys, "graph_key").select(
        "graph_uuid", F.col("uuid").alias("node_uuid"), "ordinal").unionByName(
        users.select(F.lit("users").alias("graph_key"), "node_uuid", (F.col("user_id") + 1).alias("ordinal"))
             .join(keys, "graph_key").select("graph_uuid", "node_uuid", "ordinal"))
    queue = nodes.where("lifecycle_state = 'staged'").select(
        F.col("uuid").alias("node_uuid"), F.col("graph_key").alias("intended_graph_key"), F.lit("").alias("tracking_note"),
        F.when(F.col("description").contains("(CX"), "blocked").otherwise("pending").alias("status"))
    predicates = spark.createDataFrame(PREDICATES, "pointer STRING, name STRING").select(
        ids.uuid5_col(NAMESPACE, "pointer").alias("predicate_uuid"))
    triple = triple_rows(spark, sf).select(
        ids.uuid5_col(NAMESPACE, "subject_pointer").alias("subject_uuid"),
        ids.uuid5_col(NAMESPACE, "predicate_pointer").alias("predicate_uuid"),
        ids.uuid5_col(NAMESPACE, "object_pointer").alias("object_uuid"), "created_at")
    triple = triple.withColumn("triple_uuid", ids.derived_uuid_col(
        NAMESPACE, "triple", F.col("subject_uuid"), F.col("predicate_uuid"), F.col("object_uuid")))
    labels = table(spark, sf, "labels")
    tag_of = labels.where("quality = 1").select("doc_id", F.lit("D0").alias("tag")).unionByName(
        labels.where("toxic = 1").select("doc_id", F.lit("D1").alias("tag")))
    tags = tag_of.select(
        ids.uuid5_col(NAMESPACE, pointer("D", "doc_id")).alias("subject_uuid"), ids.uuid5_col(NAMESPACE, "tag").alias("tag_uuid"),
        F.when(F.col("tag") == "D0", _at("1995-01-01", "doc_id")).otherwise(_at("1995-01-02", "doc_id")).alias("created_at"))
    tags = tags.withColumn("assignment_uuid", ids.derived_uuid_col(NAMESPACE, "tag-assignment", F.col("subject_uuid"), F.col("tag_uuid")))
    sentinels = table(spark, sf, "documents").where("lang = 'de'").select(
        ids.uuid5_col(NAMESPACE, pointer("D", "doc_id")).alias("node_uuid"), F.col("source").alias("scope"),
        (F.col("n_chars") > 500).alias("active"), _at("1996-01-01", "doc_id").alias("created_at"))
    built = {
        "node_identity": identity, "node_revision": revision, "graphs": graphs, "graph_membership": member,
        "staging_queue": queue, "predicate_registry": predicates, "triples": triple, "node_tags": tags,
        "tag_registry": tags.select("tag_uuid").distinct(), "sentinel_guidance": sentinels,
    }
    shaped_tables = {name: shaped(df, CORPUS_TABLES[name]) for name, df in built.items()}
    return {**shaped_tables, **request_tables(spark, sf)}


def request_log(spark: SparkSession, sf: str) -> DataFrame:
    """Events as requests. Purchases arrive twice unchanged; errors arrive again with another value."""
    events = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    resent = events.where(F.col("event_type").isin("purchase", "error")).withColumn(
        "value", F.when(F.col("event_type") == "error", F.col("value") + 1).otherwise(F.col("value")))
    arrivals = events.withColumn("arrival", F.lit(1)).unionByName(resent.withColumn("arrival", F.lit(2)))
    return arrivals.select(
        F.col("event_id").cast("string").alias("request_id"), F.col("event_type").alias("tool"), "ts", "user_id", "arrival",
        F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), "event_type",
                           F.round(F.col("value") * 100).cast("long").cast("string"), "props"), 256).alias("input_hash"))


def request_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Ledger, snapshot chain, change sets, receipts and workstreams told by the event log.

    Each event commits one operation; each user's work is one change set, complete once it ends in a sign-up.
    """
    events = table(spark, sf, "events")
    moment = _text(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), "000Z")
    request = ids.derived_uuid_col(CORPUS_ID, "request", F.col("event_id"))
    snapshot = ids.derived_uuid_col(CORPUS_ID, "state", F.col("event_id"))
    change_set = ids.derived_uuid_col(CORPUS_ID, "change-set", F.col("user_id"))
    rows = events.select(
        "event_id", "user_id", "event_type", "ts", request.alias("request_uuid"), snapshot.alias("snapshot_uuid"),
        change_set.alias("change_set_uuid"), moment.alias("at"), (F.col("event_id") + 1).alias("database_sequence"),
        F.sha2(F.col("props"), 256).alias("input_hash"))
    ledger = rows.select("request_uuid", F.col("event_type").alias("tool_name"), "input_hash", F.lit("committed").alias("status"),
                         F.lit("{}").alias("result_json"), F.col("at").alias("started_at"), F.col("at").alias("committed_at"),
                         "database_sequence", F.col("snapshot_uuid").alias("output_snapshot_uuid"), "change_set_uuid")
    parent = F.when(F.col("event_id") > 0, ids.derived_uuid_col(CORPUS_ID, "state", F.col("event_id") - 1))
    snapshots = rows.select("snapshot_uuid", parent.alias("parent_snapshot_uuid"), F.lit(CORPUS_ID).alias("corpus_id"),
                            "database_sequence", F.sha2(F.col("input_hash"), 256).alias("transition_digest"), "request_uuid",
                            F.col("event_type").alias("tool_name"), F.col("at").alias("created_at"))
    sets = rows.groupBy("user_id", "change_set_uuid").agg(
        F.min_by("snapshot_uuid", "event_id").alias("base_snapshot_uuid"), F.min("at").alias("created_at"),
        (F.max_by("event_type", "event_id") == "signup").alias("done"), F.max("at").alias("last_at"))
    sets = sets.select("change_set_uuid", _text("Work of user ", F.col("user_id")).alias("title"), F.lit("track events").alias("intent"),
                       F.when(F.col("done"), "completed").otherwise("open").alias("status"), "base_snapshot_uuid", "created_at",
                       F.when(F.col("done"), F.col("last_at")).alias("resolved_at"), F.lit("").alias("resolution"))
    receipts = grouped_rank(rows, ["change_set_uuid"], [F.col("database_sequence")], F.floor(F.col("event_id") / 100_000), "ordinal")
    receipts = receipts.select("change_set_uuid", "ordinal", "request_uuid", F.col("event_type").alias("tool_name"),
                               "database_sequence", F.col("snapshot_uuid").alias("output_snapshot_uuid"))
    streams = rows.groupBy("user_id").agg(F.min("snapshot_uuid").alias("base_snapshot_id"), F.min("at").alias("created_at"),
                                          F.count(F.lit(1)).alias("mutation_count"))
    streams = streams.select(ids.derived_uuid_col(CORPUS_ID, "workstream", F.col("user_id")).alias("workstream_id"),
                             F.lit(CORPUS_ID).alias("corpus_id"), "base_snapshot_id", "created_at",
                             F.lit("r1").alias("package_release_id"), "mutation_count")
    built = {"operation_ledger": ledger, "semantic_snapshots": snapshots, "change_sets": sets,
             "change_set_receipts": receipts, "corpus_workstreams": streams}
    return {name: shaped(df, CORPUS_TABLES[name]) for name, df in built.items()}


# ---- branches ---------------------------------------------------------------------
BRANCH_RULES = {
    # label: which orders the branch holds
    "east": "o_orderstatus IN ('F', 'O')",
    "west": "o_orderstatus IN ('O', 'P')",
    "south": "o_orderpriority IN ('1-URGENT', '2-HIGH')",
}


_branches: dict[tuple[str, str, str, bool], Branch] = {}


def branch(spark: SparkSession, sf: str, label: str, tampered: bool = False) -> Branch:
    key = (spark.sparkContext.applicationId, sf, label, tampered)
    if key not in _branches:
        _branches[key] = _derive_branch(spark, sf, label, tampered)
    return _branches[key]


def _derive_branch(spark: SparkSession, sf: str, label: str, tampered: bool) -> Branch:
    """Orders of one slice as branch objects.

    Objects, aliases and first revisions are shared between slices. Urgent orders get a further
    revision per branch, hence several frontiers after composition, and each branch aliases its
    customer numbers to its own first order. ``tampered`` branches changed shared rows in place.
    """
    rows = table(spark, sf, "orders").where(BRANCH_RULES[label])
    operation = ids.derived_uuid_col(NAMESPACE, "order-operation", F.col("o_orderkey"))
    price = F.round(F.col("o_totalprice") * 100).cast("long")
    if tampered:
        price = F.when((F.col("o_orderpriority") == "3-MEDIUM") & (F.col("o_orderstatus") == "O"), price + 1).otherwise(price)
    origin = ids.uuid5_col(NAMESPACE, F.lit("replica:origin"))
    local = ids.uuid5_col(NAMESPACE, F.lit(f"replica:{label}"))
    at = ids.ns_time(F.col("o_orderdate"), F.col("o_orderkey"))
    base = rows.select("o_orderkey", "o_custkey", "o_orderpriority", operation.alias("operation_uuid"), at.alias("created_at"),
                       _text("Order ", F.col("o_orderkey")).alias("title"), _text("price ", price).alias("description"))
    base = (base.withColumn("object_uuid", ids.uuid5_of(F.col("operation_uuid"), F.lit("object:node")))
                .withColumn("revision_uuid", ids.uuid5_of(F.col("operation_uuid"), F.lit("revision"))))
    urgent = base.where("o_orderpriority = '1-URGENT'").select(
        "object_uuid", "created_at", "title", F.col("revision_uuid").alias("parent_revision_uuid"),
        ids.derived_uuid_col(NAMESPACE, f"revise-{label}", F.col("o_orderkey")).alias("operation_uuid"),
        _text(F.col("description"), f" seen {label}").alias("description"))
    urgent = urgent.withColumn("revision_uuid", ids.uuid5_of(F.col("operation_uuid"), F.lit("revision")))
    # A customer's first order is found by numbers, which sum up map-side without sorting; its ids are told by its key.
    first = rows.groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"), F.min_by("o_orderdate", "o_orderkey").alias("o_orderdate"))
    first = first.select("o_custkey", F.when(F.col("o_orderkey").isNotNull(), operation).alias("operation_uuid"), at.alias("created_at"))
    first = first.withColumn("object_uuid", ids.uuid5_of(F.col("operation_uuid"), F.lit("object:node")))
    aliases = base.select(ids.uuid5_of(F.col("operation_uuid"), F.lit("alias")).alias("assertion_uuid"), origin.alias("scope_replica_uuid"),
                          pointer("O", "o_orderkey").alias("alias_text"), "object_uuid", "operation_uuid", "created_at").unionByName(
        first.select(ids.derived_uuid_col(NAMESPACE, f"alias-{label}", F.col("o_custkey")).alias("assertion_uuid"),
                     local.alias("scope_replica_uuid"), pointer("CUST", "o_custkey").alias("alias_text"),
                     "object_uuid", "operation_uuid", "created_at"))
    operations = base.select("operation_uuid", origin.alias("origin_replica_uuid"), F.lit("object.create").alias("operation_kind"),
                             F.sha2(F.col("title"), 256).alias("payload_hash"), F.lit("{}").alias("payload_json"), "created_at").unionByName(
        urgent.select("operation_uuid", local.alias("origin_replica_uuid"), F.lit("object.revise").alias("operation_kind"),
                      F.sha2(F.col("description"), 256).alias("payload_hash"), F.lit("{}").alias("payload_json"), "created_at"))
    graph = ids.uuid5_col(NAMESPACE, F.lit("branch-graph"))
    revisions = base.select("revision_uuid", "object_uuid", "title", "description", "operation_uuid", "created_at").unionByName(
        urgent.select("revision_uuid", "object_uuid", "title", "description", "operation_uuid", "created_at"))
    replica_uuid, head_uuid, workspace_uuid = _label_ids(label)
    built = {
        "replicas": spark.createDataFrame([("origin", "1992-01-01T00:00:00.000000000Z"), (label, "1992-01-01T00:00:00.000000001Z")],
                                          "label STRING, created_at STRING").select(
            ids.uuid5_col(NAMESPACE, F.concat(F.lit("replica:"), "label")).alias("replica_uuid"), "label", "created_at"),
        "semantic_operations": operations,
        "semantic_objects": base.select("object_uuid", F.lit("node").alias("object_kind"),
                                        F.col("operation_uuid").alias("creation_operation_uuid"), "created_at"),
        "object_alias_assertions": aliases,
        "node_revisions": revisions.select("revision_uuid", F.col("object_uuid").alias("node_uuid"), "title", "description",
                                           ids.object_content_hash("title", "description").alias("content_hash"),
                                           "operation_uuid", "created_at"),
        "revision_parents": urgent.select("revision_uuid", "parent_revision_uuid", F.lit(0).alias("ordinal")),
        "graph_membership_assertions": base.select(
            ids.uuid5_of(F.col("operation_uuid"), F.lit("membership")).alias("membership_uuid"), graph.alias("graph_uuid"),
            "object_uuid", F.col("o_orderpriority").alias("order_key"), "operation_uuid", "created_at"),
        "corpus_components": spark.createDataFrame([(CORPUS_ID, CORPUS_ID)], BRANCH_TABLES["corpus_components"].schema),
    }
    builders = {name: (lambda name=name, df=df: shaped(df, BRANCH_TABLES[name])) for name, df in built.items()}
    # An order tells its rows in every table; stored, they would take many times the space of the orders, so they are derived when read.
    return Branch(spark, LazyTables(builders), NAMESPACE, CORPUS_ID, head=Head(CORPUS_ID, head_uuid, 1),
                  workspace_uuid=workspace_uuid, replica_uuid=replica_uuid)


def _label_ids(label: str) -> tuple[str, str, str]:
    space = uuid.UUID(NAMESPACE)
    return tuple(str(uuid.uuid5(space, f"{kind}:{label}")) for kind in ("replica", "head", "workspace"))


# ---- views ------------------------------------------------------------------------
def document_views(spark: SparkSession, sf: str) -> DataFrame:
    """Declared views over documents: one row per (view, member)."""
    docs = table(spark, sf, "documents")
    labels = table(spark, sf, "labels")
    member = pointer("D", "doc_id")
    parts = [
        docs.select(_text("lang:", F.col("lang")).alias("view"), member.alias("member")),
        docs.select(_text("source:", F.col("source")).alias("view"), member.alias("member")),
        docs.where("n_chars > 2000").select(F.lit("long").alias("view"), member.alias("member")),
        docs.where(F.col("text").contains(" the ")).select(F.lit("word:the").alias("view"), member.alias("member")),
        labels.where("quality = 1").select(F.lit("quality").alias("view"), member.alias("member")),
        labels.where("toxic = 1").select(F.lit("toxic").alias("view"), member.alias("member")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns as members with their conversation as container."""
    rows = table(spark, sf, "conversations")
    return rows.select(_text(F.col("conv_id"), ".", F.col("turn")).alias("member"), F.col("conv_id").alias("container"),
                       "turn", "role", "text")
