"""Registered queries of bulk changes, branches, quality checks and file-tree checks."""

from __future__ import annotations

import uuid
from collections import ChainMap
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.corpus import Corpus, Head, shaped
from corpusloom.functions import ids
from corpusloom.functions.durable import LazyTables, checkpointed, shared_folder
from corpusloom.functions.ordered import grouped_rank
from corpusloom.operators import branches, changes, filetree, fingerprints, quality, views
from corpusloom.plans import bindings as b
from corpusloom.plans.registry import query
from corpusloom.plans.sqltwins import node_id, uuid5, with_ctes
from corpusloom.schema import COMPOSED_TABLES
from corpusloom.sources import imports, oplog, snapshots
from corpusloom.streaming import ingest


# ---- bulk changes -----------------------------------------------------------------
_VALUE = "'value='||{}||' props='||{}"


def _without_orders(spark: SparkSession, sf: str) -> Corpus:
    """The corpus before any order arrived."""
    c = b.corpus(spark, sf)
    keep = c["node_identity"].where("NOT pointer RLIKE '^O[0-9]'")
    members = c["graph_membership"].join(keep.select(F.col("uuid").alias("node_uuid")), "node_uuid", "left_semi")
    return c.with_tables(node_identity=keep, graph_membership=members)


def _order_ops(spark: SparkSession, sf: str, operation: str) -> DataFrame:
    rows = b.order_texts(spark, sf)
    return rows.select(F.col("o_orderkey").alias("index"), F.lit(operation).alias("operation"), "pointer", "title", "description", F.lit("orders").alias("graph_key"))


@query("w2_preflight_create", with_ctes("link otext", """SELECT DISTINCT substr(src, 2)::BIGINT AS "index", code, target AS detail FROM link WHERE code IS NOT NULL AND src LIKE 'O%'
    UNION SELECT o_orderkey, 'legacy_visible_pointer_marker', 'C'||o_custkey FROM otext WHERE marked"""))
def preflight_create(spark: SparkSession, sf: str) -> DataFrame:
    """What speaks against creating all orders in one batch."""
    return changes.create_nodes(_without_orders(spark, sf), _order_ops(spark, sf, "node.create")).rejections


@query("w3_create_nodes", with_ctes("otext", f"""SELECT 'O'||o_orderkey AS pointer, {node_id("('O'||o_orderkey)")} AS uuid, row_number() OVER (ORDER BY o_orderkey) AS ordinal
    FROM otext WHERE NOT marked AND target NOT LIKE 'CX%'"""))
def created(spark: SparkSession, sf: str) -> DataFrame:
    """Creation of every order whose links are sound: identities with their place in the graph."""
    ops = _order_ops(spark, sf, "node.create").where("NOT description LIKE '%(CX%' AND NOT description LIKE '%⟦pgx:%'")
    plan = changes.create_nodes(_without_orders(spark, sf), ops)
    placed = plan.appended["graph_membership"].select(F.col("node_uuid").alias("uuid"), "ordinal")
    return plan.appended["node_identity"].select("pointer", "uuid").join(placed, "uuid")


@query("w4_revise_nodes", with_ctes("node", """SELECT pointer, title, old_title, outcome FROM (
    SELECT 'D'||doc_id AS pointer, CASE WHEN quality=1 THEN 'Good document '||doc_id ELSE 'Document '||doc_id END AS title, 'Document '||doc_id AS old_title,
      CASE WHEN quality=1 THEN 'done' ELSE 'unchanged' END AS outcome FROM labels)"""))
def revised(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents retitled against the revision they are expected to have; unlabelled quality keeps the title."""
    c = b.corpus(spark, sf)
    labels = b.table(spark, sf, "labels").withColumn("pointer", b.pointer("D", "doc_id"))
    ops = labels.join(c["node_identity"].select("pointer", "current_revision_uuid"), "pointer").select(
        F.col("doc_id").alias("index"), "pointer", F.when(F.col("quality") == 1, b._text("Good document ", F.col("doc_id"))).alias("title"),
        F.col("current_revision_uuid").alias("expected_revision_uuid"))
    plan = changes.revise_nodes(c, ops)
    new = plan.appended["node_revision"].select("revision_uuid", F.col("title").alias("_t"))
    rows = plan.results.join(new, "revision_uuid", "left")
    old = b._text("Document ", F.substring("pointer", 2, 20))
    return rows.select("pointer", F.coalesce("_t", old).alias("title"), old.alias("old_title"), "outcome")


@query("w4_stale_writes", """SELECT doc_id AS "index", 'stale_write' AS code, 'D'||doc_id AS detail FROM labels WHERE toxic=1""")
def stale(spark: SparkSession, sf: str) -> DataFrame:
    c = b.corpus(spark, sf)
    labels = b.table(spark, sf, "labels").withColumn("pointer", b.pointer("D", "doc_id")).join(c["node_identity"].select("pointer", "current_revision_uuid"), "pointer")
    expected = F.when(F.col("toxic") == 1, "an older one").otherwise(F.col("current_revision_uuid"))
    ops = labels.select(F.col("doc_id").alias("index"), F.lit("node.update").alias("operation"), "pointer", F.lit("New title").alias("title"), expected.alias("expected_revision_uuid"))
    return changes.preflight(c, ops)


@query("w4_revision_chain", with_ctes("urev", f"""SELECT event_id, CASE WHEN prev IS NOT NULL THEN {uuid5(b.NAMESPACE, "('event-revision:'||prev)")} END AS previous_revision_uuid
    FROM (SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)"""))
def chained(spark: SparkSession, sf: str) -> DataFrame:
    return b.user_revisions(spark, sf).select("event_id", "previous_revision_uuid")


@query("w1_apply_batch", with_ctes("cur", """SELECT pointer, CASE WHEN kind = 'customer' THEN title||' of '||c_mktsegment ELSE title END AS title, description, lifecycle AS lifecycle_state
    FROM cur LEFT JOIN customer ON kind = 'customer' AND pointer = 'C'||c_custkey"""))
def applied(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus written to storage, every customer renamed by one committed batch, and all nodes read again."""
    c = b.corpus(spark, sf)
    names = ("node_identity", "node_revision", "graphs", "graph_membership", "staging_queue", "reference_occurrences")
    start = Corpus(spark, {n: c[n] for n in names}, b.NAMESPACE, b.CORPUS_ID, head=Head(b.CORPUS_ID, str(uuid.uuid5(uuid.UUID(b.NAMESPACE), "start")), 0))
    root = f"{shared_folder(spark)}/corpusloom-w1-{uuid.uuid4().hex}"
    start = snapshots.write_corpus(start, root, start.head)
    ops = b.table(spark, sf, "customer").select(F.col("c_custkey").alias("index"), F.lit("node.update").alias("operation"), b.pointer("C", "c_custkey").alias("pointer"),
                                                b._text(F.col("c_name"), " of ", F.col("c_mktsegment")).alias("title"))
    plan = changes.plan_changes(start, ops, kinds={"node.update"})
    head, _ = changes.next_head(start, start.head, "w1", "batch.apply", "customers", {})
    after = snapshots.commit_changes(start, plan, root, head)
    return views.current_nodes(after).select("pointer", "title", "description", "lifecycle_state")


def _log(spark: SparkSession, sf: str) -> str:
    """Events as a log of updates in two folders' worth of lines: errors are broken lines, purchases are sent twice."""
    folder = f"{shared_folder(spark)}/corpusloom-log-{uuid.uuid4().hex}"
    events = b.table(spark, sf, "events")
    request = F.to_json(F.struct(F.col("event_id").cast("string").alias("request_id"), F.lit("node.update").alias("tool"),
                                 F.struct(b.pointer("U", "user_id").alias("pointer"), F.col("event_type").alias("title")).alias("arguments"),
                                 F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts")))
    line = F.when(F.col("event_type") == "error", b._text("broken ", F.col("event_id"))).otherwise(request)
    lines = events.select(line.alias("value")).unionByName(events.where("event_type = 'purchase'").select(request.alias("value")))
    lines.write.text(folder)
    return folder


@query("s4_read_oplog", """SELECT event_id::VARCHAR AS request_id, sha256('{"arguments":{"pointer":"U'||user_id||'","title":"'||event_type||'"},"change_set_id":null,"tool":"node.update"}') AS input_hash,
    NULL::VARCHAR AS line FROM (SELECT * FROM events WHERE event_type != 'error' UNION ALL SELECT * FROM events WHERE event_type = 'purchase')
    UNION ALL SELECT NULL, NULL, 'broken '||event_id FROM events WHERE event_type = 'error'""")
def read_log(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of a log: requests with the hash of their input, and lines that hold none."""
    requests, rejects = oplog.read_oplog(spark, _log(spark, sf))
    return requests.select("request_id", "input_hash", F.lit(None).cast("string").alias("line")).unionByName(
        rejects.select(F.lit(None).cast("string").alias("request_id"), F.lit(None).cast("string").alias("input_hash"), "line"))


@query("x1_ingest", """SELECT event_id::VARCHAR AS request_id, row_number() OVER (ORDER BY ts, event_id::VARCHAR) AS database_sequence, NULL::VARCHAR AS code, NULL::VARCHAR AS detail FROM events WHERE event_type != 'error'
    UNION ALL SELECT NULL, NULL, 'corrupt_line', 'broken '||event_id FROM events WHERE event_type = 'error'""")
def ingested(spark: SparkSession, sf: str) -> DataFrame:
    """A log streamed into a stored corpus of users: its ledger, and what was refused."""
    c = b.corpus(spark, sf)
    users = c["node_identity"].where("pointer RLIKE '^U'")
    nodes = users.select(F.col("uuid").alias("node_uuid"))
    tables = {"node_identity": users, "node_revision": c["node_revision"].join(nodes, "node_uuid", "left_semi").select(*c.spec("node_revision").names),
              "graphs": c["graphs"].where("graph_key = 'users'"), "graph_membership": c["graph_membership"].join(nodes, "node_uuid", "left_semi").select(*c.spec("graph_membership").names)}
    head = Head(b.CORPUS_ID, str(uuid.uuid5(uuid.UUID(b.NAMESPACE), "start")), 0)
    root = f"{shared_folder(spark)}/corpusloom-x1-{uuid.uuid4().hex}"
    snapshots.write_corpus(Corpus(spark, tables, b.NAMESPACE, b.CORPUS_ID, head=head), root, head)
    stream = ingest.oplog_stream(spark, _log(spark, sf))
    ingest.ingest_oplog(stream, root, f"{root}/progress").awaitTermination()
    ledger = snapshots.read_corpus(spark, root)["operation_ledger"].select(
        F.col("request_uuid").alias("request_id"), "database_sequence", F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("detail"))
    refused = spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/refused")
    return ledger.unionByName(refused.select("request_id", F.lit(None).cast("long").alias("database_sequence"), "code", "detail"))


def _updates_of(spark: SparkSession, sf: str, node: Column) -> DataFrame:
    c = b.corpus(spark, sf)
    events = b.table(spark, sf, "events")
    numbered = grouped_rank(events.withColumn("_all", F.lit(1)), ["_all"], [F.col("ts"), F.col("event_id")], F.date_trunc("hour", "ts"), "index")
    numbered = checkpointed(numbered.select("index", "event_id", "event_type", node.alias("pointer"),
                                            b._text("value=", F.col("value"), " props=", F.col("props")).alias("description")))
    plan = changes.plan_changes(c, numbered.withColumn("operation", F.lit("node.update")).withColumnRenamed("event_type", "title"), kinds={"node.update"})
    new = plan.appended["node_revision"].select("revision_uuid", "previous_revision_uuid")
    titles = plan.appended["node_revision"].select("revision_uuid", "title").unionByName(c["node_revision"].select("revision_uuid", "title"))
    before = new.join(titles.select(F.col("revision_uuid").alias("previous_revision_uuid"), F.col("title").alias("replaced_title")), "previous_revision_uuid")
    rows = plan.results.select("index", "outcome", "revision_uuid").join(numbered.select("index", "event_id", F.col("event_type").alias("title")), "index")
    done = rows.where("outcome = 'done'").join(before, "revision_uuid").select("event_id", "outcome", "title", "replaced_title")
    return done.unionByName(rows.where("outcome != 'done'").select("event_id", "outcome", "title", F.lit(None).cast("string").alias("replaced_title")))


@query("w4_many_revisions", f"""SELECT event_id, CASE WHEN event_type = p_type AND {_VALUE.format('value', 'props')} = p_text THEN 'unchanged' ELSE 'done' END AS outcome, event_type AS title,
    CASE WHEN event_type = p_type AND {_VALUE.format('value', 'props')} = p_text THEN NULL ELSE p_type END AS replaced_title
    FROM (SELECT *, coalesce(lag(event_type) OVER w, last_value(event_type) OVER v) AS p_type, coalesce(lag({_VALUE.format('value', 'props')}) OVER w, last_value({_VALUE.format('value', 'props')}) OVER v) AS p_text
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), v AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))""")
def many_revisions(spark: SparkSession, sf: str) -> DataFrame:
    """Every event once more as an update of its user, all in one batch: outcomes, and the title that each new revision replaces."""
    return _updates_of(spark, sf, b.pointer("U", "user_id"))


@query("w4_one_node", f"""SELECT event_id, CASE WHEN event_type = p_type AND {_VALUE.format('value', 'props')} = p_text THEN 'unchanged' ELSE 'done' END AS outcome, event_type AS title,
    CASE WHEN event_type = p_type AND {_VALUE.format('value', 'props')} = p_text THEN NULL ELSE p_type END AS replaced_title
    FROM (SELECT *, lag(event_type, 1, (SELECT c_name FROM customer WHERE c_custkey = 0)) OVER w AS p_type, lag({_VALUE.format('value', 'props')}, 1, '') OVER w AS p_text
      FROM events WINDOW w AS (ORDER BY ts, event_id))""")
def one_node(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as an update of one and the same node, all in one batch, streamed through its chain of revisions."""
    return _updates_of(spark, sf, F.lit("C0"))


@query("w5_revert_nodes", with_ctes("urev", "SELECT pointer, title FROM urev WHERE nth=1"))
def reverted(spark: SparkSession, sf: str) -> DataFrame:
    """Every user set back to the first revision: the titles after the batch."""
    c = b.corpus(spark, sf)
    first = c["node_revision"].where("previous_revision_uuid IS NULL").select(F.col("node_uuid").alias("uuid"), F.col("revision_uuid").alias("target_revision_uuid"))
    users = c["node_identity"].where("pointer RLIKE '^U[0-9]'").select("uuid", "pointer")
    ops = users.join(first, "uuid").select(F.substring("pointer", 2, 20).cast("long").alias("index"), "pointer", "target_revision_uuid")
    plan = changes.revert_nodes(c, ops)
    new = plan.appended["node_revision"].select("node_uuid", "title").join(users.withColumnRenamed("uuid", "node_uuid"), "node_uuid")
    same = plan.results.where("outcome = 'unchanged'").join(c["node_revision"].select("revision_uuid", "title"), "revision_uuid")
    return new.select("pointer", "title").unionByName(same.select("pointer", "title"))


@query("w6_stage_nodes", with_ctes("otext", """SELECT 'O'||o_orderkey AS pointer, CASE WHEN marked OR target LIKE 'CX%' THEN 'blocked' ELSE 'pending' END AS status,
    (CASE WHEN marked THEN 2 WHEN target LIKE 'CX%' THEN 1 ELSE 0 END)::BIGINT AS issues FROM otext"""))
def staged(spark: SparkSession, sf: str) -> DataFrame:
    """All orders staged: their status and how many issues stand against each."""
    plan = changes.stage_nodes(_without_orders(spark, sf), _order_ops(spark, sf, "node.stage"))
    issues = plan.appended["staging_issues"].groupBy("node_uuid").agg(F.count(F.lit(1)).alias("issues"))
    queue = plan.appended["staging_queue"].join(plan.appended["node_identity"].select(F.col("uuid").alias("node_uuid"), "pointer"), "node_uuid")
    return queue.join(issues, "node_uuid", "left").select("pointer", "status", F.coalesce("issues", F.lit(0)).alias("issues"))


@query("w7_promote_nodes", with_ctes("otext", """SELECT o_orderkey AS "index", 'unresolved_pointer' AS code, target AS detail FROM otext WHERE o_orderstatus='P' AND target LIKE 'CX%'
    UNION ALL SELECT o_orderkey, 'not_staged', 'O'||o_orderkey FROM otext WHERE o_orderstatus!='P'"""))
def promoted(spark: SparkSession, sf: str) -> DataFrame:
    """Why all orders cannot be promoted at once: some are not staged, some have unresolved links."""
    ops = b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("index"), b.pointer("O", "o_orderkey").alias("pointer"))
    return changes.promote_nodes(b.corpus(spark, sf), ops).rejections


@query("w8_add_triples", """SELECT subject_pointer, object_pointer FROM (SELECT DISTINCT 'S'||l_suppkey AS subject_pointer, 'P'||l_partkey AS object_pointer FROM lineitem)""")
def triples(spark: SparkSession, sf: str) -> DataFrame:
    """Every line asserts that its supplier offers its part; repeats and facts already stored add nothing."""
    c = b.corpus(spark, sf)
    lines = b.table(spark, sf, "lineitem")
    offered = lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("index"), b.pointer("S", "l_suppkey").alias("subject_pointer"),
                           F.lit("PRN004").alias("predicate_pointer"), b.pointer("P", "l_partkey").alias("object_pointer"))
    known = lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber") + 5_000_000_000).alias("index"), b.pointer("P", "l_partkey").alias("subject_pointer"),
                         F.lit("PRN004").alias("predicate_pointer"), b.pointer("S", "l_suppkey").alias("object_pointer"))
    added = changes.add_triples(c, offered.unionByName(known)).appended["triples"]
    names = c["node_identity"].select("uuid", "pointer")
    return (added.join(names.select(F.col("uuid").alias("subject_uuid"), F.col("pointer").alias("subject_pointer")), "subject_uuid")
                 .join(names.select(F.col("uuid").alias("object_uuid"), F.col("pointer").alias("object_pointer")), "object_uuid")
                 .select("subject_pointer", "object_pointer"))


@query("w9_assign_tags", "SELECT 'D'||doc_id AS pointer, 'D1' AS tag FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic=1)")
def tagged(spark: SparkSession, sf: str) -> DataFrame:
    """Every document tagged; those that carry the tag already are left alone."""
    c = b.corpus(spark, sf)
    ops = b.table(spark, sf, "documents").select(F.col("doc_id").alias("index"), b.pointer("D", "doc_id").alias("subject_pointer"), F.lit("D1").alias("tag_pointer"))
    added = changes.assign_tags(c, ops).appended["node_tags"]
    names = c["node_identity"].select(F.col("uuid").alias("subject_uuid"), "pointer")
    return added.join(names, "subject_uuid").select("pointer", F.lit("D1").alias("tag"))


@query("w10_create_graphs", """SELECT 'brand-'||p_brand AS graph_key, 'BR'||replace(p_brand, 'Brand#', '')||'.' AS pointer_prefix FROM part GROUP BY p_brand""")
def graphs(spark: SparkSession, sf: str) -> DataFrame:
    """One namespace per part brand, with its declaration node."""
    number = F.replace("p_brand", F.lit("Brand#"), F.lit(""))
    ops = b.table(spark, sf, "part").select("p_brand").distinct().select(
        number.cast("long").alias("index"), b._text("BR", number, ".decl").alias("pointer"), b._text("object: ", F.col("p_brand")).alias("title"),
        b._text("Parts of ", F.col("p_brand"), ".").alias("description"), b._text("brand-", F.col("p_brand")).alias("graph_key"), b._text("BR", number, ".").alias("pointer_prefix"))
    plan = changes.create_graphs(b.corpus(spark, sf), ops)
    declared = plan.appended["graph_membership"].where("ordinal = 0").select("graph_uuid")
    return plan.appended["graphs"].join(declared, "graph_uuid", "left_semi").select("graph_key", "pointer_prefix")


@query("w11_create_sentinels", "SELECT 'SNT1'||lpad(item_id::VARCHAR, 6, '0') AS pointer, 'benchmark' AS scope FROM benchmark")
def guidance(spark: SparkSession, sf: str) -> DataFrame:
    """Every benchmark text becomes advice."""
    rows = b.table(spark, sf, "benchmark")
    ops = rows.select(F.col("item_id").alias("index"), b._text("SNT1", F.lpad(F.col("item_id").cast("string"), 6, "0")).alias("pointer"),
                      b._text("Advice ", F.col("item_id")).alias("title"), F.replace("text", F.lit("\r"), F.lit("")).alias("description"), F.lit("benchmark").alias("scope"))
    plan = changes.create_sentinels(b.corpus(spark, sf), ops)
    made = plan.appended["node_identity"].select(F.col("uuid").alias("node_uuid"), "pointer")
    return plan.appended["sentinel_guidance"].where("active").join(made, "node_uuid").select("pointer", "scope")


_HASH = "sha256(user_id||'|'||event_type||'|'||round(value*100)::BIGINT||'|'||props)"


@query("w12_dedupe_requests", with_ctes("req", f"""SELECT request_id, copies, CASE WHEN variants > 1 OR (past IS NOT NULL AND past != h) THEN 'conflict' WHEN past IS NOT NULL THEN 'replay' ELSE 'new' END AS disposition
    FROM (SELECT request_id, count(*) AS copies, count(DISTINCT {_HASH}) AS variants, min({_HASH}) AS h FROM req GROUP BY request_id)
    LEFT JOIN (SELECT event_id::VARCHAR AS request_id, {_HASH} AS past FROM events WHERE event_type IN ('view', 'error')) USING (request_id)"""))
def deduped(spark: SparkSession, sf: str) -> DataFrame:
    """The resent log against a ledger that holds all views and errors."""
    log = b.request_log(spark, sf)
    ledger = log.where("arrival = 1 AND tool IN ('view', 'error')").select(F.col("request_id").alias("request_uuid"), "input_hash")
    return changes.dedupe_requests(log, ledger).select("request_id", "copies", "disposition")


@query("w13_ledger_rows", """SELECT event_id, row_number() OVER (ORDER BY event_id) + 7 AS database_sequence, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS ordinal FROM events""")
def ledger(spark: SparkSession, sf: str) -> DataFrame:
    """All events booked as requests of one change set per user."""
    c = Corpus(spark, {}, b.NAMESPACE, b.CORPUS_ID)
    rows = b.table(spark, sf, "events").select(
        F.col("event_id").alias("index"), F.col("event_id").cast("string").alias("request_uuid"), F.col("event_type").alias("tool_name"),
        F.sha2("props", 256).alias("input_hash"), F.col("user_id").cast("string").alias("change_set_uuid"), F.col("ts").cast("string").alias("at"))
    books = changes.ledger_rows(c, rows, 7)
    both = books.ledger.select("request_uuid", "database_sequence").join(books.receipts.select("request_uuid", "ordinal"), "request_uuid")
    return both.select(F.col("request_uuid").cast("long").alias("event_id"), "database_sequence", "ordinal")


@query("w14_branch_revisions", """SELECT (SELECT count(*) FROM orders WHERE o_orderstatus IN ('F','O')) AS revisions, 0::BIGINT AS accepted_strangers,
    (SELECT count(*) FROM orders WHERE o_orderstatus IN ('F','O') AND o_orderpriority='2-HIGH') AS rejected""")
def branch_revisions(spark: SparkSession, sf: str) -> DataFrame:
    """Every object of a branch revised; for high priorities the parent named is one of another object."""
    east = b.branch(spark, sf, "east")
    rows = b.table(spark, sf, "orders").where(b.BRANCH_RULES["east"])
    operation = ids.derived_uuid_col(b.NAMESPACE, "order-operation", F.col("o_orderkey"))
    own, high = ids.uuid5_of(operation, F.lit("revision")), F.col("o_orderpriority") == "2-HIGH"
    ops = rows.select(F.col("o_orderkey").alias("index"), ids.uuid5_of(operation, F.lit("object:node")).alias("object_uuid"),
                      F.when(high, ids.uuid5_of(ids.derived_uuid_col(b.NAMESPACE, "order-operation", F.col("o_orderkey") + 1_000_000_000), F.lit("revision"))).otherwise(own).alias("parent_revision_uuid"),
                      F.lit("Later").alias("title"), F.lit("text").alias("description"))
    plan = changes.revise_objects(east, ops)
    bad = plan.rejections.select("index").distinct()
    wrong = plan.results.join(bad, "index", "left_anti").join(rows.where(high).select(F.col("o_orderkey").alias("index")), "index", "left_semi")
    return plan.results.agg(F.count(F.lit(1)).alias("revisions")).select(
        "revisions", wrong.agg(F.count(F.lit(1))).scalar().alias("accepted_strangers"), bad.agg(F.count(F.lit(1))).scalar().alias("rejected"))


@query("s5_import_v1", f"SELECT 'D'||doc_id AS pointer, {node_id(chr(40) + chr(39) + 'D' + chr(39) + '||doc_id)')} AS uuid, 'promoted' AS lifecycle_state FROM documents")
def imported(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as first-generation nodes."""
    docs = b.table(spark, sf, "documents")
    nodes = docs.select(F.lit("pgx:").alias("sigil"), b.pointer("D", "doc_id").alias("pointer"), b._text("Document ", F.col("doc_id")).alias("title"),
                        F.col("text").alias("description"), b._at("1992-01-06", "doc_id").alias("data_one")).withColumn("uuid", ids.uuid5_col(b.NAMESPACE, "pointer"))
    graph = spark.createDataFrame([("documents", "D", "")], "graph_key STRING, pointer_prefix STRING, description STRING").withColumn("graph_uuid", ids.uuid5_col(b.NAMESPACE, F.lit("D0")))
    members = nodes.select(graph.select("graph_uuid").scalar().alias("graph_uuid"), F.col("uuid").alias("node_uuid"), F.substring("pointer", 2, 20).cast("long").alias("ordinal"))
    c, _ = imports.import_v1(spark, {"nodes": nodes, "graphs": graph, "graph_membership": members}, b.NAMESPACE, b.CORPUS_ID)
    return c["node_identity"].select("pointer", "uuid", "lifecycle_state")


# ---- branches ---------------------------------------------------------------------
def _branches(spark: SparkSession, sf: str, tampered: str | None = None) -> list:
    return [b.branch(spark, sf, label, label == tampered) for label in b.BRANCH_RULES]


_OP = "00000000-0000-4000-8000-000000000001"
_AT = "2000-01-01T00:00:00.000000000Z"


def _composed(spark: SparkSession, sf: str):
    return branches.compose(_branches(spark, sf), _OP, _AT)[0]


@query("b1_compose", with_ctes("slice", """SELECT table_name, n::BIGINT AS n FROM (SELECT 'semantic_objects' AS table_name, count(DISTINCT o_orderkey) AS n FROM slice
    UNION ALL SELECT 'node_revisions', count(DISTINCT o_orderkey) + count(*) FILTER (o_orderpriority='1-URGENT') FROM slice
    UNION ALL SELECT 'semantic_operations', count(DISTINCT o_orderkey) + count(*) FILTER (o_orderpriority='1-URGENT') + 1 FROM slice
    UNION ALL SELECT 'revision_parents', count(*) FILTER (o_orderpriority='1-URGENT') FROM slice
    UNION ALL SELECT 'graph_membership_assertions', count(DISTINCT o_orderkey) FROM slice
    UNION ALL SELECT 'replicas', 2 + count(DISTINCT label) FROM slice UNION ALL SELECT 'semantic_snapshots', 1
    UNION ALL SELECT 'snapshot_parents', count(DISTINCT label) FROM slice
    UNION ALL SELECT 'object_alias_assertions', (SELECT count(DISTINCT o_orderkey) FROM slice) + (SELECT count(*) FROM (SELECT DISTINCT label, o_custkey FROM slice)))"""))
def composed(spark: SparkSession, sf: str) -> DataFrame:
    """Row counts of all tables of three overlapping branches united; the branches list no snapshots, so the composition's is the only one."""
    c = _composed(spark, sf)
    return reduce(DataFrame.unionByName, [c[name].agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n")) for name in COMPOSED_TABLES])


@query("b1_composed_texts", with_ctes("slice", f"""SELECT 'Order '||o_orderkey AS title, 'price '||round(o_totalprice * 100)::BIGINT||seen AS description,
    strftime(o_orderdate,'%Y-%m-%dT%H:%M:%S.')||lpad(o_orderkey::VARCHAR,9,'0')||'Z' AS created_at, o_orderpriority = '1-URGENT' AND seen != '' AS revised
    FROM (SELECT DISTINCT o_orderkey, o_totalprice, o_orderdate, o_orderpriority, '' AS seen FROM slice
      UNION ALL SELECT o_orderkey, o_totalprice, o_orderdate, o_orderpriority, ' seen '||label FROM slice WHERE o_orderpriority = '1-URGENT')"""))
def composed_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The texts of all revisions of the united branches, and which of them revise another."""
    c = _composed(spark, sf)
    children = c["revision_parents"].select("revision_uuid", F.lit(True).alias("_child")).distinct()
    rows = c["node_revisions"].join(children, "revision_uuid", "left")
    return rows.select("title", "description", "created_at", F.coalesce("_child", F.lit(False)).alias("revised"))


@query("b1_collisions", """SELECT 'node_revisions' AS table_name, count(*) AS collisions FROM orders WHERE o_orderpriority='3-MEDIUM' AND o_orderstatus='O' HAVING count(*) > 0""")
def collided(spark: SparkSession, sf: str) -> DataFrame:
    """Composition with a branch that rewrote shared rows in place."""
    return branches.collisions_by_table(_branches(spark, sf, tampered="west"))


@query("b2_composition_record")
def record(spark: SparkSession, sf: str) -> DataFrame:
    c = _composed(spark, sf)
    return c["composition_records"].join(c["composition_inputs"], "composition_uuid").select("composition_uuid", "output_snapshot_uuid", "source_count", "source_workspace_uuid", "source_snapshot_uuid")


@query("b3_alias_conflicts", with_ctes("slice", """SELECT 'CUST'||o_custkey AS alias, count(DISTINCT k) AS object_count FROM (SELECT label, o_custkey, min(o_orderkey) AS k FROM slice GROUP BY ALL)
    GROUP BY o_custkey HAVING count(DISTINCT k) > 1"""))
def alias_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return branches.alias_conflicts(_composed(spark, sf)).select("alias", "object_count").distinct()


@query("b4_frontier_conflicts", with_ctes("slice", "SELECT 'Order '||o_orderkey AS title, count(*) AS frontier_count FROM slice WHERE o_orderpriority='1-URGENT' GROUP BY o_orderkey HAVING count(*) > 1"))
def frontier_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    c = _composed(spark, sf)
    return branches.frontier_conflicts(c).join(c["node_revisions"].select("revision_uuid", "title"), "revision_uuid").select("title", "frontier_count").distinct()


@query("b5_objects", with_ctes("slice", """SELECT title, aliases, frontier FROM (SELECT o_orderkey, 'Order '||o_orderkey AS title, CASE WHEN bool_or(o_orderpriority='1-URGENT') THEN count(*) ELSE 1 END AS frontier FROM slice GROUP BY o_orderkey)
    JOIN (SELECT o_orderkey, 1 + coalesce(n, 0) AS aliases FROM (SELECT DISTINCT o_orderkey FROM slice) LEFT JOIN
      (SELECT k AS o_orderkey, count(*) AS n FROM (SELECT label, o_custkey, min(o_orderkey) AS k FROM slice GROUP BY ALL) GROUP BY k) USING (o_orderkey)) USING (o_orderkey)"""))
def listed(spark: SparkSession, sf: str) -> DataFrame:
    rows = branches.objects(_composed(spark, sf))
    return rows.select(F.col("revision_frontier")[0]["title"].alias("title"), F.size("aliases").cast("long").alias("aliases"), F.size("revision_frontier").cast("long").alias("frontier"))


@query("b6_resolve_alias", with_ctes("slice", """SELECT 'CUST'||o_custkey AS alias, scope, CASE WHEN n IS NULL THEN 'unknown' WHEN n > 1 THEN 'ambiguous' ELSE 'resolved' END AS status FROM (
    SELECT c.c_custkey AS o_custkey, 'any' AS scope, a.n FROM customer c LEFT JOIN (SELECT o_custkey, count(DISTINCT k) AS n FROM (SELECT label, o_custkey, min(o_orderkey) AS k FROM slice GROUP BY ALL) GROUP BY 1) a ON a.o_custkey=c.c_custkey
    UNION ALL SELECT c.c_custkey, 'south', s.n FROM customer c LEFT JOIN (SELECT o_custkey, 1 AS n FROM slice WHERE label='south' GROUP BY 1) s ON s.o_custkey=c.c_custkey)"""))
def alias_objects(spark: SparkSession, sf: str) -> DataFrame:
    customers = b.table(spark, sf, "customer").select(b.pointer("CUST", "c_custkey").alias("alias"))
    south = b._label_ids("south")[0]
    asked = customers.withColumn("scope", F.lit("any")).unionByName(customers.withColumn("scope", F.lit("south")))
    asked = asked.withColumn("scope_replica_uuid", F.when(F.col("scope") == "south", F.lit(south)))
    return branches.resolve_alias(_composed(spark, sf), asked).select("alias", "scope", "status")


@query("b7_verify_state", "SELECT * FROM (VALUES ('sound', true), ('lost rows', false), ('changed rows', false), ('reordered', true)) t(state, matches)")
def verified(spark: SparkSession, sf: str) -> DataFrame:
    """The composition against its stored fingerprint: as it is, with rows lost or changed since, and with rows moved."""
    sound = _composed(spark, sf)
    revisions = sound["node_revisions"]
    states = {"sound": sound, "lost rows": sound.with_tables(node_revisions=revisions.where("NOT title LIKE '%7'")),
              "changed rows": sound.with_tables(node_revisions=revisions.withColumn("title", F.when(F.col("title").endswith("7"), "changed").otherwise(F.col("title")))),
              "reordered": sound.with_tables(node_revisions=revisions.repartition(3, "title"))}
    out = [branches.verify_state(c).select(F.lit(name).alias("state"), "matches") for name, c in states.items()]
    return reduce(DataFrame.unionByName, out)


@query("b8_compare", """SELECT 'O'||o_orderkey AS pointer, CASE WHEN o_orderstatus='P' THEN 'left_only' ELSE 'changed' END AS difference FROM orders WHERE o_orderstatus='P' OR o_orderpriority='2-HIGH'
    UNION ALL SELECT 'X'||s_suppkey, 'right_only' FROM supplier""")
def compared(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus against one that lost staged orders, changed high-priority ones and gained nodes."""
    c = b.corpus(spark, sf)
    texts = b.order_texts(spark, sf).where("o_orderpriority = '2-HIGH'").select(ids.uuid5_col(b.NAMESPACE, "pointer").alias("node_uuid"))
    touched = c["node_revision"].join(texts.withColumn("_hit", F.lit(True)), "node_uuid", "left").withColumn("content_hash", F.when(F.col("_hit"), "other").otherwise(F.col("content_hash"))).drop("_hit")
    extra = b.table(spark, sf, "supplier").select(b.pointer("X", "s_suppkey").alias("pointer"))
    new_ids = extra.select(ids.uuid5_col(b.NAMESPACE, "pointer").alias("uuid"), "pointer", F.lit("pgx:").alias("sigil"), F.lit("t").alias("created_at"), F.lit("promoted").alias("lifecycle_state"),
                           F.col("pointer").alias("current_revision_uuid"))
    new_rev = extra.select(F.col("pointer").alias("revision_uuid"), ids.uuid5_col(b.NAMESPACE, "pointer").alias("node_uuid"), F.lit("t").alias("title"), F.lit("d").alias("description"), F.lit("t").alias("created_at"),
                           F.lit(None).cast("string").alias("previous_revision_uuid"), F.lit("h").alias("content_hash"), F.lit(None).cast("string").alias("request_uuid"), F.lit("").alias("reason"))
    other = c.with_tables(node_identity=c["node_identity"].where("lifecycle_state != 'staged'").unionByName(new_ids), node_revision=touched.select(*c.spec("node_revision").names).unionByName(new_rev))
    return branches.compare(c, other)


_BUILDING = "FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P' AND c_mktsegment = 'BUILDING' AND c_nationkey"


@query("b8_bucketed_compare", with_ctes("ident", f"""SELECT pointer, difference, (SELECT count(DISTINCT substr(md5(pointer),1,3)) FROM d) AS buckets_read,
      (SELECT count(DISTINCT substr(md5(pointer),1,3)) FROM ident) AS buckets FROM d""",
    {"d": f"""SELECT 'O'||o_orderkey AS pointer, 'changed' AS difference {_BUILDING} = 3
      UNION ALL SELECT 'O'||o_orderkey, 'left_only' {_BUILDING} = 4 UNION ALL SELECT 'X'||r_regionkey, 'right_only' FROM region"""}))
def compared_by_digest(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus against one some commits later, whose digest tree has followed those commits."""
    c = b.corpus(spark, sf)
    customer = b.table(spark, sf, "customer").where("c_mktsegment = 'BUILDING' AND c_nationkey IN (3, 4)").select("c_custkey", "c_nationkey")
    hit = b.table(spark, sf, "orders").where("o_orderstatus = 'P'").join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        ids.uuid5_col(b.NAMESPACE, b.pointer("O", "o_orderkey")).alias("uuid"), (F.col("c_nationkey") == 3).alias("changed"))
    extra = b.table(spark, sf, "region").select(b.pointer("X", "r_regionkey").alias("pointer"))
    new_id = extra.select(ids.uuid5_col(b.NAMESPACE, "pointer").alias("uuid"), "pointer", F.lit("pgx:").alias("sigil"), F.lit("t").alias("created_at"), F.lit("promoted").alias("lifecycle_state"),
                          F.col("pointer").alias("current_revision_uuid"))
    new_rev = shaped(extra.select(F.col("pointer").alias("revision_uuid"), ids.uuid5_col(b.NAMESPACE, "pointer").alias("node_uuid"), F.lit("t").alias("title"), F.lit("d").alias("description"),
                                  F.lit("t").alias("created_at"), F.lit("h").alias("content_hash")), c.spec("node_revision"))
    changed = hit.where("changed").select(F.col("uuid").alias("node_uuid"), F.lit(True).alias("_hit"))
    revised = c["node_revision"].join(changed, "node_uuid", "left").withColumn("content_hash", F.when(F.col("_hit"), "other").otherwise(F.col("content_hash")))
    other = c.with_tables(node_identity=c["node_identity"].join(hit.where("NOT changed"), "uuid", "left_anti").select(*new_id.columns).unionByName(new_id),
                          node_revision=revised.select(*c.spec("node_revision").names).unionByName(new_rev))
    touched = lambda corpus, nodes: views.current_nodes(corpus).join(nodes, "uuid", "left_semi").select("pointer", "content_hash")
    tree = fingerprints.digest_tree(views.current_nodes(c))
    later = fingerprints.advanced(tree, touched(c, hit), touched(other, hit.where("changed").select("uuid").unionByName(new_id.select("uuid"))))
    rows, read = branches.compare_by_digest(c, other, tree, later)
    return rows.withColumn("buckets_read", read.agg(F.count(F.lit(1)).alias("n")).scalar()).withColumn("buckets", tree.agg(F.count(F.lit(1)).alias("n")).scalar())


@query("b9_lineage", """SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')||'000Z' AS created_at, n AS mutation_count FROM (SELECT min(ts) AS ts, count(*) AS n FROM events GROUP BY user_id)""")
def lineage(spark: SparkSession, sf: str) -> DataFrame:
    return branches.lineage(b.corpus(spark, sf)).select("created_at", "mutation_count")


_BASES = f"(SELECT min({uuid5(b.CORPUS_ID, chr(40) + chr(39) + 'state:' + chr(39) + '||event_id)')}) AS b, count(*) AS n FROM events GROUP BY user_id)"


@query("b9_common_base", f"SELECT max(b) AS common_base_snapshot_id FROM {_BASES} WHERE n < (SELECT avg(n) FROM {_BASES})")
def base(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus and another in which the busier workstreams were begun anew elsewhere."""
    c = b.corpus(spark, sf)
    streams = c["corpus_workstreams"]
    busy = F.col("mutation_count") >= streams.select(F.avg("mutation_count")).scalar()
    elsewhere = ids.derived_uuid_col(b.CORPUS_ID, "elsewhere", "workstream_id")
    return branches.common_base(c, c.with_tables(corpus_workstreams=streams.withColumn("base_snapshot_id", F.when(busy, elsewhere).otherwise(F.col("base_snapshot_id")))))


@query("b10_classify_handoffs", """SELECT user_id::VARCHAR AS handoff_id, CASE WHEN n < 50 THEN 'nonmatching' WHEN k='error' THEN 'unverified' WHEN k='view' THEN 'machinery_mismatch' WHEN last=e0 THEN 'exact' ELSE 'unexpected_descendant' END AS classification
    FROM (SELECT user_id, count(*) AS n, min(event_id) AS e0, max(event_id) AS last, arg_max(event_type, event_id) AS k FROM events GROUP BY user_id)""")
def handoffs(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's work handed off at its start and found again at its end."""
    events = b.table(spark, sf, "events")
    state = lambda col: ids.derived_uuid_col(b.CORPUS_ID, "state", F.col(col))
    users = events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("e0"), F.max("event_id").alias("last"), F.max_by("event_type", "event_id").alias("k"))
    key = F.col("user_id").cast("string").alias("handoff_id")
    receipts = users.select(key, F.when(F.col("k") == "view", "r0").otherwise("r1").alias("release_id"), F.lit(b.CORPUS_ID).alias("corpus_id"), state("e0").alias("snapshot_uuid"),
                            (F.col("e0") + 1).alias("database_sequence"), F.lit("s").alias("sha256"))
    candidates = users.select(key, (F.col("n") >= 50).alias("present"), (F.col("k") != "error").alias("readable"), F.lit(b.CORPUS_ID).alias("corpus_id"), state("last").alias("snapshot_uuid"),
                              (F.col("last") + 1).alias("database_sequence"), F.lit("s").alias("sha256"))
    history = events.select(F.col("user_id").cast("string").alias("handoff_id"), state("event_id").alias("snapshot_uuid"))
    return branches.classify_handoffs(receipts, candidates, history, "r1").select("handoff_id", "classification")


@query("b11_merge_laws", """SELECT law, holds OR NOT EXISTS (SELECT 1 FROM orders WHERE o_orderstatus IN ('F','O') AND o_orderpriority = '2-HIGH') AS holds
    FROM (VALUES ('idempotent', false), ('commutative', true), ('associative_left', true), ('associative_right', true)) t(law, holds)""")
def laws(spark: SparkSession, sf: str) -> DataFrame:
    """The laws for three branches, of which the first holds aliases of pressing orders twice under one key."""
    east, *others = [b.branch(spark, sf, label) for label in b.BRANCH_RULES]
    rows = east["object_alias_assertions"]
    pressing = b.table(spark, sf, "orders").where("o_orderpriority = '2-HIGH'").select(b.pointer("O", "o_orderkey").alias("alias_text"))
    again = rows.join(pressing, "alias_text", "left_semi").withColumn("created_at", F.lit("later"))
    doubled = east.with_tables(object_alias_assertions=rows.unionByName(again.select(*rows.columns)))
    return branches.merge_laws([doubled, *others])


# ---- quality ----------------------------------------------------------------------
def damaged(spark: SparkSession, sf: str) -> Corpus:
    """The corpus with faults planted by data: see each check's SQL twin for which rows."""
    c = b.corpus(spark, sf)

    def marked(name: str, rule: str, prefix: str, key: str, flag: str) -> DataFrame:
        return b.table(spark, sf, name).where(rule).select(b.pointer(prefix, key).alias("pointer"), F.lit(True).alias(flag))

    def building() -> DataFrame:
        return marked("customer", "c_mktsegment = 'BUILDING'", "C", "c_custkey", "_building")

    def identity() -> DataFrame:
        poor, small = marked("supplier", "s_acctbal < 0", "S", "s_suppkey", "_poor"), marked("part", "p_size = 1", "P", "p_partkey", "_small")
        rows = c["node_identity"].join(poor, "pointer", "left").join(small, "pointer", "left").join(building(), "pointer", "left")
        nation = F.col("pointer").rlike("^N[0-9]")
        other = ids.uuid5_col(b.NAMESPACE, F.concat(F.lit("wrong:"), "pointer"))
        rows = rows.withColumn("uuid", F.when(F.col("_poor"), other).otherwise(F.col("uuid")))
        rows = rows.withColumn("created_at", F.when(nation, F.substring("created_at", 1, 19)).otherwise(F.col("created_at")))
        rows = rows.withColumn("current_revision_uuid", F.when(F.col("_small"), F.lit("gone")).otherwise(F.col("current_revision_uuid")))
        rows = rows.withColumn("lifecycle_state", F.when(F.col("_building"), "retired").otherwise(F.col("lifecycle_state")))
        return rows.select(*c.spec("node_identity").names)

    def members() -> DataFrame:
        german = b.table(spark, sf, "documents").where("lang = 'de'").select(ids.uuid5_col(b.NAMESPACE, b.pointer("D", "doc_id")).alias("node_uuid"))
        urgent = b.table(spark, sf, "orders").where("o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'").select(
            ids.uuid5_col(b.NAMESPACE, F.lit("O.decl")).alias("graph_uuid"), ids.uuid5_col(b.NAMESPACE, b.pointer("O", "o_orderkey")).alias("node_uuid"), (F.col("o_orderkey") + 1).alias("ordinal"))
        general, special = ids.uuid5_col(b.NAMESPACE, F.lit("C.decl")), ids.uuid5_col(b.NAMESPACE, F.lit("C1.decl"))
        moved = building().select(ids.uuid5_col(b.NAMESPACE, "pointer").alias("node_uuid"), F.lit(True).alias("_moved"))
        rows = c["graph_membership"].join(german, "node_uuid", "left_anti").join(moved, "node_uuid", "left")
        return rows.withColumn("graph_uuid", F.when(F.col("_moved") & (F.col("graph_uuid") == special), general).otherwise(F.col("graph_uuid"))).select("graph_uuid", "node_uuid", "ordinal").unionByName(urgent)

    def revision() -> DataFrame:
        return c["node_revision"].withColumn("content_hash", F.when(F.col("title") == "signup", "0").otherwise(F.col("content_hash")))

    def receipts() -> DataFrame:
        errors = F.col("tool_name") == "error"
        return c["change_set_receipts"].withColumn("database_sequence", F.when(errors, F.col("database_sequence") + 1).otherwise(F.col("database_sequence")))

    def tags() -> DataFrame:
        twice = b.table(spark, sf, "labels").where("toxic = 1").select(ids.uuid5_col(b.NAMESPACE, b.pointer("D", "doc_id")).alias("subject_uuid"))
        return c["node_tags"].unionByName(c["node_tags"].join(twice, "subject_uuid", "left_semi").select(*c.spec("node_tags").names))

    # A check derives and stores the tables that it reads, no others.
    changed = LazyTables({"node_identity": identity, "graph_membership": members, "node_revision": revision, "change_set_receipts": receipts, "node_tags": tags})
    return replace(c, tables=ChainMap(changed, c.tables))


def _findings(df: DataFrame) -> DataFrame:
    return df.select("code", "key")


@query("q1_uuid", "SELECT 'uuid_determinism' AS code, 'S'||s_suppkey AS key FROM supplier WHERE s_acctbal < 0")
def q1(spark: SparkSession, sf: str) -> DataFrame:
    return _findings(quality.check_uuid(damaged(spark, sf)))


@query("q2_timestamps", "SELECT 'identity_timestamp' AS code, 'N'||n_nationkey AS key FROM nation")
def q2(spark: SparkSession, sf: str) -> DataFrame:
    return _findings(quality.check_timestamps(damaged(spark, sf)))


@query("q3_current_revision", "SELECT 'current_revision' AS code, 'P'||p_partkey AS key FROM part WHERE p_size=1 UNION ALL SELECT 'current_revision', 'S'||s_suppkey FROM supplier WHERE s_acctbal < 0")
def q3(spark: SparkSession, sf: str) -> DataFrame:
    return _findings(quality.check_current_revision(damaged(spark, sf)))


@query("q4_content_hash", f"SELECT 'revision_hash' AS code, {uuid5(b.NAMESPACE, chr(40) + chr(39) + 'event-revision:' + chr(39) + '||event_id)')} AS key FROM events WHERE event_type='signup'")
def q4(spark: SparkSession, sf: str) -> DataFrame:
    return _findings(quality.check_content_hash(damaged(spark, sf)))


@query("q5_cycles", "SELECT 'revision_cycle' AS code, 'U'||user_id AS key FROM events GROUP BY user_id HAVING arg_max(event_type, ts)='purchase'")
def q5(spark: SparkSession, sf: str) -> DataFrame:
    """Users whose last act was a purchase get their first revision tied to their last."""
    c = b.corpus(spark, sf)
    last = c["node_identity"].select(F.col("uuid").alias("node_uuid"), "current_revision_uuid").join(
        c["node_revision"].where("title = 'purchase'").select(F.col("revision_uuid").alias("current_revision_uuid")), "current_revision_uuid")
    rows = c["node_revision"].join(last, "node_uuid", "left").withColumn("previous_revision_uuid", F.coalesce("previous_revision_uuid", "current_revision_uuid"))
    return _findings(quality.check_cycles(c.with_tables(node_revision=rows.select(*c.spec("node_revision").names))))


@query("q6_lifecycle_membership", """SELECT 'promoted_without_graph' AS code, 'D'||doc_id AS key FROM documents WHERE lang='de'
    UNION ALL SELECT 'promoted_without_graph', 'S'||s_suppkey FROM supplier WHERE s_acctbal < 0
    UNION ALL SELECT 'staged_in_graph', 'O'||o_orderkey FROM orders WHERE o_orderstatus='P' AND o_orderpriority='1-URGENT'""")
def q6(spark: SparkSession, sf: str) -> DataFrame:
    return _findings(quality.check_lifecycle_membership(damaged(spark, sf)))


@query("q7_namespace", "SELECT 'graph_namespace' AS code, 'C'||c_custkey AS key FROM customer WHERE c_mktsegment='BUILDING' AND c_custkey::VARCHAR LIKE '1%'")
def q7(spark: SparkSession, sf: str) -> DataFrame:
    return _findings(quality.check_membership_namespace(damaged(spark, sf)))


@query("q8_links", with_ctes("link otext", """SELECT 'promoted_reference_contract' AS code, src AS key FROM link WHERE code IS NOT NULL AND lifecycle='promoted'
    UNION ALL SELECT 'promoted_reference_contract', 'O'||o_orderkey FROM otext WHERE marked"""))
def q8(spark: SparkSession, sf: str) -> DataFrame:
    return _findings(quality.check_links(b.corpus(spark, sf)))


@query("q9_reference_index", with_ctes("occ", "SELECT 'reference_index_mismatch' AS code, src AS key FROM occ WHERE src LIKE 'S%'"))
def q9(spark: SparkSession, sf: str) -> DataFrame:
    """A stored index that lost its suppliers."""
    c = b.corpus(spark, sf)
    lost = c["node_identity"].where("pointer RLIKE '^S[0-9]'").select(F.col("uuid").alias("source_node_uuid"))
    return _findings(quality.check_reference_index(c.with_tables(reference_occurrences=c["reference_occurrences"].join(lost, "source_node_uuid", "left_anti"))))


@query("q10_roundtrip", r"SELECT 'pgx_roundtrip' AS code, 'D'||doc_id AS key FROM documents WHERE lang = 'es' OR regexp_matches(text, '^\s|\s$')")
def q10(spark: SparkSession, sf: str) -> DataFrame:
    """Spanish documents are padded with blanks, which the line format does not keep."""
    c = b.corpus(spark, sf)
    spanish = b.table(spark, sf, "documents").where("lang = 'es'").select(ids.uuid5_col(b.NAMESPACE, b.pointer("D", "doc_id")).alias("node_uuid"), F.lit(" ").alias("_pad"))
    padded = c["node_revision"].join(spanish, "node_uuid", "left").withColumn("description", F.concat(F.coalesce("_pad", F.lit("")), "description"))
    return _findings(quality.check_roundtrip(c.with_tables(node_revision=padded.select(*c.spec("node_revision").names))))


@query("q11_search_count", with_ctes("ident", """SELECT 'fts_count' AS code, n||'/'||(n + 1 + (SELECT count(DISTINCT user_id) FROM events)) AS detail FROM (SELECT count(*) AS n FROM ident WHERE lifecycle='promoted' AND pointer NOT LIKE 'U%')
    UNION ALL SELECT 'fts_count', NULL WHERE false"""))
def q11(spark: SparkSession, sf: str) -> DataFrame:
    """An index without the users and the node that declares their namespace."""
    c = b.corpus(spark, sf)
    docs = b.search_index(c).docs.where("NOT pointer LIKE 'U%'")
    return quality.check_search_count(c, docs).select("code", "detail")


@query("q12_receipts", f"SELECT 'change_set_receipts' AS code, {uuid5(b.CORPUS_ID, chr(40) + chr(39) + 'request:' + chr(39) + '||event_id)')} AS key FROM events WHERE event_type='error'")
def q12(spark: SparkSession, sf: str) -> DataFrame:
    return _findings(quality.check_receipts(damaged(spark, sf)))


_POOR = f"(SELECT {node_id("('S'||s_suppkey)")} AS u FROM supplier WHERE s_acctbal < 0)"


@query("q13_foreign_keys", f"""SELECT 'foreign_key' AS code, k||u AS key FROM {_POOR}, (SELECT unnest(['graph_membership.node_uuid=', 'node_revision.node_uuid=', 'triples.subject_uuid=', 'reference_occurrences.source_node_uuid=']) AS k)
    UNION ALL SELECT 'foreign_key', 'triples.object_uuid='||u FROM (SELECT DISTINCT {node_id("('S'||l_suppkey)")} AS u FROM lineitem JOIN supplier ON l_suppkey=s_suppkey WHERE s_acctbal < 0)
    UNION ALL SELECT 'foreign_key', 'reference_occurrences.profile_key=pgx-default' WHERE EXISTS (SELECT * FROM nation)""")
def q13(spark: SparkSession, sf: str) -> DataFrame:
    """Every reference of every table. The benchmark stores no link profiles, so the one profile in use is an orphan."""
    return _findings(quality.check_foreign_keys(damaged(spark, sf)))


_TWICE = f"""SELECT {node_id("('D'||doc_id)")} AS d, {node_id("tag")} AS t, day||'T00:00:00.'||lpad(doc_id::VARCHAR, 9, '0')||'Z' AS moment
    FROM (SELECT doc_id, 'D1' AS tag, '1995-01-02' AS day FROM labels WHERE toxic=1 UNION ALL SELECT doc_id, 'D0', '1995-01-01' FROM labels WHERE toxic=1 AND quality=1)"""


@query("q14_unique", f"""SELECT 'unique' AS code, unnest(['node_tags(subject_uuid,tag_uuid)='||d||'|'||t, 'node_tags(created_at)='||moment, 'node_tags(assignment_uuid)='||{uuid5(b.NAMESPACE, "('tag-assignment:'||d||'|'||t)")}]) AS key FROM ({_TWICE})
    UNION ALL SELECT 'unique', 'node_identity(current_revision_uuid)=gone' FROM (SELECT count(*) AS n FROM part WHERE p_size=1) WHERE n > 1
    UNION ALL SELECT 'unique', 'node_identity(created_at)=1992-01-02T00:00:00' FROM (SELECT count(*) AS n FROM nation) WHERE n > 1""")
def q14(spark: SparkSession, sf: str) -> DataFrame:
    """Every key of every table."""
    return _findings(quality.check_unique(damaged(spark, sf)))


@query("q15_rules", f"""SELECT 'check_rule' AS code, 'node_identity='||{node_id("('C'||c_custkey)")} AS key FROM customer WHERE c_mktsegment='BUILDING'""")
def q15(spark: SparkSession, sf: str) -> DataFrame:
    return _findings(quality.check_rules(damaged(spark, sf)))


@query("q16_append_only", f"""SELECT 'row_changed' AS code, 'node_revision='||{uuid5(b.NAMESPACE, chr(40) + chr(39) + 'event-revision:' + chr(39) + '||event_id)')} AS key FROM events WHERE event_type='signup'
    UNION ALL SELECT 'row_removed', 'node_identity='||{node_id("('S'||s_suppkey)")} FROM supplier WHERE s_acctbal < 0
    UNION ALL SELECT 'row_changed', 'node_identity='||{node_id("('N'||n_nationkey)")} FROM nation
    UNION ALL SELECT 'row_changed', 'change_set_receipts='||{uuid5(b.CORPUS_ID, "('change-set:'||user_id)")}||'|'||o FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS o FROM events) WHERE event_type='error'""")
def q16(spark: SparkSession, sf: str) -> DataFrame:
    return _findings(quality.check_append_only(b.corpus(spark, sf), damaged(spark, sf)))


@query("q17_transitions", "SELECT 'lifecycle_transition' AS code, 'C'||c_custkey AS key FROM customer WHERE c_mktsegment='BUILDING'")
def q17(spark: SparkSession, sf: str) -> DataFrame:
    return _findings(quality.check_transitions(b.corpus(spark, sf), damaged(spark, sf)))


@query("q18_registries", """SELECT 'registry_lifecycle' AS code, 'O'||o_orderkey AS key FROM orders WHERE o_orderstatus='P' AND o_orderpriority='1-URGENT'
    UNION ALL SELECT 'registry_lifecycle', 'C'||c_custkey FROM customer WHERE c_mktsegment='BUILDING'""")
def q18(spark: SparkSession, sf: str) -> DataFrame:
    return _findings(quality.check_registries(damaged(spark, sf)))


@query("q0_validate")
def everything(spark: SparkSession, sf: str) -> DataFrame:
    """All checks on the damaged corpus, counted by code."""
    c = damaged(spark, sf)
    return quality.summary(quality.validate(c, b.search_index(c).docs))


# ---- file trees -------------------------------------------------------------------
def _inventory(spark: SparkSession, sf: str) -> DataFrame:
    docs = b.table(spark, sf, "documents")
    return docs.select(b._text(F.col("source"), "/", F.col("doc_id"), ".md").alias("path"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size_bytes"), "lang", "doc_id")


@query("c1_manifest", """SELECT CASE lang WHEN 'de' THEN 'manifest.unlisted_files' ELSE 'manifest.mismatch' END AS code, source||'/'||doc_id||'.md' AS key FROM documents WHERE lang IN ('de','es')
    UNION ALL SELECT 'manifest.missing_files', 'benchmark/'||item_id||'.md' FROM benchmark UNION ALL SELECT 'manifest.duplicate', source||'/'||doc_id||'.md' FROM documents WHERE lang='fr'
    UNION ALL SELECT 'manifest.file_count', 'file_count'""")
def manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files. The manifest lacks German ones, has other hashes for Spanish ones, lists French ones twice."""
    files = _inventory(spark, sf)
    listed = files.where("lang != 'de'").withColumn("sha256", F.when(F.col("lang") == "es", "0").otherwise(F.col("sha256")))
    listed = listed.unionByName(listed.where("lang = 'fr'")).select("path", "sha256", "size_bytes")
    gone = b.table(spark, sf, "benchmark").select(b._text("benchmark/", F.col("item_id"), ".md").alias("path"), F.lit("0").alias("sha256"), F.lit(0).cast("long").alias("size_bytes"))
    return filetree.check_manifest(files.select("path", "sha256", "size_bytes"), listed.unionByName(gone), file_count=-1).select("code", "key")


@query("c2_transient_and_missing", """SELECT 'tree.transient' AS code, 'cache/'||doc_id||'.pyc' AS key FROM documents WHERE lang='de' UNION ALL SELECT 'projection.missing_files', 'src0/'||doc_id||'.md' FROM documents WHERE source != 'src0'""")
def tree(spark: SparkSession, sf: str) -> DataFrame:
    files = _inventory(spark, sf)
    left_over = files.where("lang = 'de'").withColumn("path", b._text("cache/", F.col("doc_id"), ".pyc"))
    expected = files.select(F.col("doc_id").cast("string").alias("name"))
    return filetree.check_cleanliness(files.unionByName(left_over)).unionByName(filetree.check_projection(files, expected, "src0", ".md")).select("code", "key")


@query("c3_wikilinks", r"""SELECT n.path AS key, l.target AS detail FROM (SELECT page_id||'.md' AS path, unnest(regexp_extract_all(html, 'href="/([^"#|\[\]]+)"', 1)) AS raw FROM pages) n,
    LATERAL (SELECT trim(n.raw) AS target) l WHERE l.target NOT IN (SELECT page_id::VARCHAR FROM pages)""")
def wikilinks(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as notes whose anchors are wikilinks."""
    pages = b.table(spark, sf, "pages")
    hrefs = F.regexp_extract_all("html", F.lit(r'href="/([^"#|\[\]]+)"'), F.lit(1))
    notes = pages.select(b._text(F.col("page_id"), ".md").alias("path"), F.array_join(F.transform(hrefs, lambda h: F.concat(F.lit("[["), h, F.lit("#top|shown]]"))), " ").alias("text"))
    return filetree.check_wikilinks(notes).select("key", "detail")


@query("c4_unlinked", "SELECT 'the' AS key, 'D'||doc_id AS detail FROM documents WHERE contains(text, 'the') UNION ALL SELECT 'a/sch', 'D'||doc_id FROM documents WHERE contains(text, 'sch')")
def unlinked(spark: SparkSession, sf: str) -> DataFrame:
    texts = b.table(spark, sf, "documents").select(b.pointer("D", "doc_id").alias("path"), "text")
    return filetree.check_unlinked(texts, ["the", "a/sch"]).select("key", "detail")


@query("c5_bundles", """SELECT source AS key, unnest(CASE source WHEN 'src1' THEN ['resource_content_mismatch'] WHEN 'src2' THEN ['content_digest_mismatch','resource_identity_mismatch']
    WHEN 'src3' THEN ['unsupported_format'] ELSE []::VARCHAR[] END) AS code FROM (SELECT DISTINCT source FROM documents)""")
def bundles(spark: SparkSession, sf: str) -> DataFrame:
    """Each source as a stored bundle; three of them are spoiled in different ways."""
    files = _inventory(spark, sf).select(F.split_part("path", F.lit("/"), F.lit(1)).alias("bundle"), "path", "sha256", F.col("size_bytes").alias("byte_size"))
    listing = filetree.listing_digests(files).withColumnRenamed("digest", "content_digest")
    listing = listing.withColumn("resource_uuid", ids.uuid5_col(ids.BUNDLE_NAMESPACE, F.concat(F.lit("folder:"), "content_digest")))
    spoiled = F.col("bundle") == "src2"
    manifests = listing.select("bundle", F.when(F.col("bundle") == "src3", "v0").otherwise("v1").alias("format"), F.lit("v1").alias("supported_format"), F.lit("folder").alias("source_kind"),
                               F.when(spoiled, "0").otherwise(F.col("content_digest")).alias("content_digest"), F.when(spoiled, "0").otherwise(F.col("resource_uuid")).alias("resource_uuid"))
    actual = files.withColumn("sha256", F.when(F.col("bundle") == "src1", "0").otherwise(F.col("sha256")))
    return filetree.check_bundles(actual, files, manifests).select("key", "code")
