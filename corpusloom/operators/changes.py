"""Bulk append-only changes: a table of operations becomes deltas and rejections.

Operations act in ``index`` order and see what earlier ones did. Nothing is written here: a change
set with any rejection must not be applied, and :mod:`corpusloom.sources.snapshots` commits the rest.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Collection
from dataclasses import dataclass, replace
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.corpus import Branch, Corpus, Head, shaped
from corpusloom.functions import ids, text
from corpusloom.functions.durable import broadcast_if_small, checkpointed
from corpusloom.functions.ordered import grouped_rank
from corpusloom.operators.folding import folded
from corpusloom.operators.graph import assign_ordinals, check_namespace
from corpusloom.operators.references import bare_profile, build_reference_index, checked_links, extract_links, plan_bare, rewrite_legacy, validate_links
from corpusloom.operators.traversal import canonical_notation, check_traversals, tokenise, traversal_index
from corpusloom.operators.views import current_nodes
from corpusloom.schema import BRANCH_TABLES, CORPUS_TABLES, flat_schema

OPERATION = flat_schema(
    "index BIGINT, operation STRING, pointer STRING, title STRING, description STRING, graph_key STRING, "
    "pointer_prefix STRING, expected_revision_uuid STRING, target_revision_uuid STRING, reason STRING, notation STRING, "
    "read STRING, subject_pointer STRING, predicate_pointer STRING, object_pointer STRING, tag_pointer STRING, "
    "scope STRING, tracking_note STRING, request_uuid STRING")

CREATING = ("node.create", "node.stage", "tag.create", "graph.create", "sentinel.create")
TEXT_CHANGING = ("node.update", "traversal.embed")
SUPPORTED = (*CREATING, *TEXT_CHANGING, "node.revert", "node.promote", "triple.add", "tag.assign")
# Revisions of one node form a hash chain, so one node's operations are taken one after another: up to so many within the row,
# more of them streamed in order with the node's state carried along. A node may have any number of them.
CHUNK = 500
# Stored tables that only some operations need; a batch without any of them does not ask for the table, which may be large or not yet derived.
NEEDED_BY = {
    "triples": {"triple.add"}, "predicate_registry": {"triple.add"}, "node_tags": {"tag.assign"}, "tag_registry": {"tag.assign"},
    "graph_membership": {*CREATING, "node.promote"}, "node_revision": {*CREATING, *TEXT_CHANGING, "node.revert", "node.promote"},
    "staging_queue": {*CREATING, *TEXT_CHANGING, "node.revert", "node.promote"}}
ISSUE_SPREAD = 50_000
ORDINAL_BUCKET = 100_000


def operations(df: DataFrame) -> DataFrame:
    """``df`` with every operation column present."""
    present = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name) for f in OPERATION.fields])


@dataclass(frozen=True)
class Changes:
    """Rows to append, rows replacing others by key, keys to remove, and reasons to refuse."""

    appended: dict[str, DataFrame]
    replaced: dict[str, DataFrame]
    removed: dict[str, DataFrame]
    rejections: DataFrame
    results: DataFrame

    def settled(self, names: Collection[str]) -> Changes:
        """The same changes, those of the named tables written once: as much as the batch changes, not the tables that it changes."""
        kept = lambda rows: {name: checkpointed(df) if name in names else df for name, df in rows.items()}
        return replace(self, appended=kept(self.appended), replaced=kept(self.replaced), removed=kept(self.removed))

    def applied_to(self, c: Corpus) -> Corpus:
        tables = {}
        for name in {*self.appended, *self.replaced, *self.removed}:
            rows, key = c[name], list(c.spec(name).key)
            for gone in (self.removed.get(name), self.replaced.get(name)):
                if gone is not None:
                    on = key if set(key) <= set(gone.columns) else gone.columns
                    rows = rows.join(gone.select(*on), on, "left_anti")
            rows = rows.select(*c.spec(name).names)
            for more in (self.replaced.get(name), self.appended.get(name)):
                if more is not None:
                    rows = rows.unionByName(more)
            tables[name] = rows
        return c.with_tables(**tables)


def _rejected(df: DataFrame, code: str | Column, detail: Column) -> DataFrame:
    code = F.lit(code) if isinstance(code, str) else code
    return df.select(F.col("index"), code.alias("code"), detail.cast("string").alias("detail"))


def _nothing(c: Corpus, schema: StructType) -> DataFrame:
    """An empty table that the optimizer knows to be empty, so that it removes what is joined to it."""
    return c.spark.createDataFrame([], schema).limit(0)


def _asked_for(c: Corpus, kinds: set[str]) -> Corpus:
    """The corpus with tables that operations of these kinds do not need left empty."""
    empty = {name: _nothing(c, c.spec(name).schema) for name, users in NEEDED_BY.items() if not kinds & users}
    return c.with_tables(**empty) if empty else c


def _limited_to(known: DataFrame, *asked: DataFrame) -> DataFrame:
    """The rows of ``known`` for the pointers of ``asked(pointer)``: with a small batch the corpus's pointers are not dealt out at all."""
    wanted = reduce(DataFrame.unionByName, asked).where("pointer IS NOT NULL").distinct()
    return known.join(broadcast_if_small(wanted), "pointer", "left_semi")


def _default_graph(ops: DataFrame) -> DataFrame:
    graph = (F.when(F.col("operation") == "tag.create", "tags").when(F.col("operation") == "sentinel.create", "sentinels")
              .otherwise(F.col("graph_key")))
    return ops.withColumn("graph_key", graph)


def _as_updates(c: Corpus, ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reverts turned into updates carrying the old revision's text, and the reverts that name no revision of the node."""
    revision = c["node_revision"].select(F.col("revision_uuid").alias("target_revision_uuid"), F.col("node_uuid").alias("_node"),
                                         F.col("title").alias("_title"), F.col("description").alias("_description"))
    reverts = ops.where("operation = 'node.revert'").withColumn("_uuid", ids.uuid5_col(c.namespace, F.col("pointer")))
    found = reverts.join(revision, "target_revision_uuid", "left")
    good = F.col("_node").eqNullSafe(F.col("_uuid"))
    turned = found.where(good).withColumn("operation", F.lit("node.update")).withColumn("title", F.col("_title")).withColumn(
        "description", F.col("_description")).withColumn("reason", F.coalesce("reason", F.lit("revert"))).select(*OPERATION.names)
    missing = _rejected(found.where(~good), "revision_not_found", F.col("target_revision_uuid"))
    return ops.where("operation != 'node.revert'").unionByName(turned), missing


_STATE = ("title", "description", "revision_uuid", "lifecycle_state")


def _histories(c: Corpus, ops: DataFrame, at: str) -> DataFrame:
    """Every text-bearing operation with its outcome: code, new revision, and the text before and after."""
    kinds = [*CREATING, "node.update", "traversal.embed"]
    texts = ops.where(F.col("operation").isin(*kinds))
    fields = ["index", "operation", "title", "description", "expected_revision_uuid", "reason", "notation", "read", "graph_key",
              "pointer_prefix", "scope", "tracking_note", "request_uuid"]
    texts = checkpointed(texts.select("pointer", *fields))
    # Identities are pruned to the batch's nodes before any text of the corpus is read.
    touched = broadcast_if_small(_limited_to(c["node_identity"], texts.select("pointer")))
    state = current_nodes(c.with_tables(node_identity=touched)).select("pointer", *_STATE)
    outcome = ("struct<index:bigint,operation:string,code:string,title:string,description:string,revision_uuid:string,"
               "previous_revision_uuid:string,created_at:string,lifecycle_state:string,reason:string,graph_key:string,"
               "pointer_prefix:string,scope:string,tracking_note:string,request_uuid:string>")
    default = F.create_map(*[F.lit(x) for pair in {
        "node.create": "node creation", "node.stage": "staged node creation", "tag.create": "tag creation",
        "graph.create": "graph creation", "sentinel.create": "create advisory sentinel", "node.update": "node update",
        "traversal.embed": "embed lawful traversal expression"}.items() for x in pair])
    reason_of = lambda operation, reason: F.coalesce(F.when(reason != "", reason), F.element_at(default, operation))
    start = F.struct(*[F.col(f).alias(f) for f in _STATE], F.array().cast(f"array<{outcome}>").alias("out"))
    node, base = F.col("uuid"), F.lit(at).cast("timestamp")

    def step(acc: Column, op: Column) -> Column:
        creates = op["operation"].isin(*CREATING)
        exists = acc["revision_uuid"].isNotNull()
        stale = op["expected_revision_uuid"].isNotNull() & (op["expected_revision_uuid"] != acc["revision_uuid"])
        appended = F.concat(F.rtrim(F.regexp_replace(acc["description"], r"\s+$", "")),
                            F.when(F.trim(acc["description"]) == "", "").otherwise("\n\n"), text.embedded_block(op["notation"], op["read"]))
        title = F.when(op["operation"] == "traversal.embed", acc["title"]).otherwise(F.coalesce(op["title"], acc["title"]))
        description = F.when(op["operation"] == "traversal.embed", appended).otherwise(F.coalesce(op["description"], acc["description"]))
        same = ~creates & (title == acc["title"]) & (description == acc["description"])
        code = (F.when(creates & exists, "pointer_exists").when(~creates & ~exists, "node_not_found")
                 .when(~creates & stale, "stale_write").when(same, "unchanged"))
        moment = ids.ns_time(base, op["index"])
        previous = F.when(creates, F.lit(None).cast("string")).otherwise(acc["revision_uuid"])
        revision = ids.derived_uuid_col(c.namespace, "revision", node, moment, ids.content_hash(title, description), previous)
        lifecycle = F.when(creates, F.when(op["operation"] == "node.stage", "staged").otherwise("promoted")).otherwise(acc["lifecycle_state"])
        moved = code.isNull()
        reason = reason_of(op["operation"], op["reason"])
        row = F.struct(
            op["index"].alias("index"), op["operation"].alias("operation"), code.alias("code"), title.alias("title"),
            description.alias("description"), F.when(moved, revision).otherwise(acc["revision_uuid"]).alias("revision_uuid"),
            previous.alias("previous_revision_uuid"), moment.alias("created_at"), lifecycle.alias("lifecycle_state"), reason.alias("reason"),
            op["graph_key"].alias("graph_key"), op["pointer_prefix"].alias("pointer_prefix"), op["scope"].alias("scope"),
            op["tracking_note"].alias("tracking_note"), op["request_uuid"].alias("request_uuid"))
        return F.struct(
            F.when(moved, title).otherwise(acc["title"]).alias("title"),
            F.when(moved, description).otherwise(acc["description"]).alias("description"),
            F.when(moved, revision).otherwise(acc["revision_uuid"]).alias("revision_uuid"),
            F.when(moved, lifecycle).otherwise(acc["lifecycle_state"]).alias("lifecycle_state"),
            F.array_append(acc["out"], row.cast(outcome)).alias("out"))

    sizes = texts.groupBy("pointer").agg(F.count(F.lit(1)).alias("n"))
    several = (sizes.agg(F.max("n")).first()[0] or 0) > CHUNK
    crowded = checkpointed(sizes.where(F.col("n") > CHUNK).select("pointer")) if several else None
    within = texts.join(crowded, "pointer", "left_anti") if several else texts
    stacked = within.groupBy("pointer").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("ops"))
    before = stacked.join(state, "pointer", "left").withColumn("uuid", ids.uuid5_col(c.namespace, F.col("pointer")))
    rows = before.select("uuid", "pointer", F.explode(F.aggregate("ops", start, step)["out"]).alias("o")).select("uuid", "pointer", "o.*")
    if not several:
        return rows
    creates = F.col("operation").isin(*CREATING)
    streamed = texts.join(crowded, "pointer", "left_semi").withColumns({
        "uuid": ids.uuid5_col(c.namespace, F.col("pointer")), "created_at": ids.ns_time(base, F.col("index")), "creates": creates,
        "block": text.embedded_block(F.col("notation"), F.col("read")), "reason": reason_of(F.col("operation"), F.col("reason"))})
    known = state.join(crowded, "pointer", "left_semi")
    return rows.unionByName(folded(streamed, known, c.namespace, rows.drop("uuid", "pointer").schema))


def _known_from(c: Corpus, history: DataFrame) -> DataFrame:
    """``(pointer, uuid, since)``: from which index on a pointer exists; -1 for the snapshot."""
    created = history.where(F.col("operation").isin(*CREATING) & F.col("code").isNull()).select("pointer", "uuid", F.col("index").alias("since"))
    return c["node_identity"].select("pointer", "uuid", F.lit(-1).cast("long").alias("since")).unionByName(created)


def _link_findings(c: Corpus, new: DataFrame, links: DataFrame, history: DataFrame, known: DataFrame) -> DataFrame:
    """Link errors of every new text, judged against what existed at its index; ``links`` are those of the ``new`` texts."""
    # Resolve against the corpus as it stands at the end, then void targets created later.
    end = c.with_tables(node_identity=known.select("uuid", "pointer"))
    errors = validate_links(new, end, links=checked_links(new, end, links=links)).where("severity = 'error'")
    at = history.select(F.col("revision_uuid").alias("source_revision_uuid"), "index", F.col("uuid").alias("node_uuid"), "lifecycle_state")
    found = errors.select("source_revision_uuid", "code", "target_pointer", "link_index").join(at, "source_revision_uuid")
    sound = links.where("code IS NULL").select("source_revision_uuid", "target_pointer", "link_index")
    early = sound.join(at, "source_revision_uuid").join(
        known.select(F.col("pointer").alias("target_pointer"), "since"), "target_pointer").where(F.col("since") > F.col("index"))
    return found.unionByName(early.select("source_revision_uuid", F.lit("unresolved_pointer").alias("code"), "target_pointer",
                                          "link_index", "index", "node_uuid", "lifecycle_state"))


def next_moment(head: Head | None) -> str:
    """The time of the batch that follows a head: each head has a second of its own."""
    return f"{datetime(2000, 1, 1) + timedelta(seconds=head.sequence if head else 0):%Y-%m-%d %H:%M:%S}"


def plan_changes(c: Corpus, ops: DataFrame, at: str | None = None, kinds: set[str] | None = None) -> Changes:
    """Deltas and rejections of a batch. ``at`` dates it, by default a second after the batch before it; the index
    supplies distinct nanoseconds, so a batch of fewer than a thousand million operations ends before the next begins.

    ``kinds`` names the operations the batch may hold, if known; steps no such operation needs are
    then planned over empty tables, which the optimizer removes.
    """
    at = at or next_moment(c.head)
    ops = _default_graph(operations(ops))
    none = _nothing(c, OPERATION)
    kinds = kinds or set(SUPPORTED)
    c = _asked_for(c, kinds)
    of = lambda *names: ops.where(F.col("operation").isin(*names)) if kinds & set(names) else none
    ops, missing_targets = _as_updates(c, ops) if "node.revert" in kinds else (ops, _rejected(none, "", F.lit("")))
    known_ops = ops.where(F.col("operation").isin(*CREATING, "node.update", "traversal.embed", "triple.add", "tag.assign", "node.promote"))
    unsupported = _rejected(ops.join(known_ops.select("index"), "index", "left_anti"), "unsupported_operation", F.col("operation"))
    embeds = check_traversals(tokenise(of("traversal.embed").withColumn("uuid", F.col("pointer"))))
    if "traversal.embed" in kinds:
        canon = canonical_notation(embeds).select("index", F.when(F.col("lawful"), F.col("canonical")).alias("canonical"))
        known_ops = known_ops.join(canon, "index", "left").withColumn("notation", F.coalesce("canonical", "notation")).drop("canonical")
    known_ops = ops = checkpointed(known_ops)

    writes = bool(kinds & {*CREATING, *TEXT_CHANGING, "node.revert"})
    history = _histories(c, known_ops if writes else none, at)
    history = checkpointed(history) if writes else _nothing(c, history.schema)
    known = _known_from(c, history)
    rejections = [missing_targets, unsupported,
                  _rejected(embeds.where("NOT lawful"), "unlawful_notation", F.concat_ws("@", "reason", "offset")),
                  _rejected(history.where("code IS NOT NULL AND code != 'unchanged'"), F.col("code"), F.col("pointer"))]

    # Creations: grammar, text rules, namespace.
    created = history.where(F.col("operation").isin(*CREATING) & F.col("code").isNull())
    rules = CORPUS_TABLES["node_revision"].rules
    rejections += [
        _rejected(created.where(~F.col("pointer").rlike(rf"^(?:{c.profile.pointer_pattern})$")), "pointer_grammar", F.col("pointer")),
        _rejected(history.where("code IS NULL").where(f"NOT ({rules['title']}) OR title IS NULL"), "invalid_title", F.col("pointer")),
        _rejected(history.where("code IS NULL").where(f"NOT ({rules['description']}) OR description IS NULL"), "invalid_description", F.col("pointer"))]
    new_graphs = created.where("operation = 'graph.create'")
    taken = c["graphs"].select("graph_key", "pointer_prefix")
    clash = new_graphs.join(taken.select("graph_key").distinct(), "graph_key", "left_semi").select("index", "graph_key").unionByName(
        new_graphs.join(taken.select("pointer_prefix").distinct(), "pointer_prefix", "left_semi").select("index", "graph_key"))
    rejections.append(_rejected(clash.distinct(), "graph_exists", F.col("graph_key")))
    graph_rows = new_graphs.select(F.col("uuid").alias("graph_uuid"), "graph_key", "pointer_prefix", "description")
    graphs = c["graphs"].select("graph_uuid", "graph_key", "pointer_prefix", "description").unionByName(graph_rows)

    promotions, promote_rejections = _promotions(c, of("node.promote"), "node.promote" in kinds)
    rejections += promote_rejections
    placed = created.where("graph_key IS NOT NULL OR operation != 'node.stage'").select("index", "pointer", "graph_key", "uuid", "operation").unionByName(
        promotions.select("index", "pointer", "graph_key", "uuid", F.lit("node.promote").alias("operation")))
    judged = check_namespace(placed, graphs)
    rejections.append(_rejected(judged.where("namespace_error IS NOT NULL"), F.col("namespace_error"), F.col("pointer")))
    joining = judged.where("operation != 'node.stage'").select(
        F.col("resolved_graph_uuid").alias("graph_uuid"), F.col("uuid").alias("node_uuid"), "index")
    membership = assign_ordinals(joining.where("graph_uuid IS NOT NULL"), c["graph_membership"], F.col("index"),
                                 F.floor(F.col("index") / ORDINAL_BUCKET))

    # Links: promoted texts must be sound, staged texts collect issues.
    new = history.where("code IS NULL").select(F.col("revision_uuid").alias("uuid"), "revision_uuid", "description")
    links = extract_links(new, c.profile)
    links = checkpointed(links) if writes else _nothing(c, links.schema)
    # Of all pointers only those that new texts cite are looked up.
    cited = _limited_to(known, links.select(F.col("target_pointer").alias("pointer"))) if writes else known
    findings = _link_findings(c, new, links, history, cited)
    findings = checkpointed(findings) if writes else _nothing(c, findings.schema)
    strict = findings.where("lifecycle_state = 'promoted'")
    rejections.append(_rejected(strict, F.col("code"), F.col("target_pointer")))

    # Embedded pointers must exist by then.
    used = traversal_index(embeds.select("uuid", F.col("index").alias("block"), "tokens", "lawful")).select(F.col("block").alias("index"), "pointer").distinct()
    used = checkpointed(used) if "traversal.embed" in kinds else used
    first_known = (_limited_to(known, used.select("pointer")) if "traversal.embed" in kinds else known).groupBy("pointer").agg(F.min("since").alias("since"))
    unknown = used.join(first_known, "pointer", "left").where("since IS NULL OR since > index")
    rejections.append(_rejected(unknown, "node_not_found", F.col("pointer")))

    def named_by(kind: str, *columns: str) -> DataFrame:
        asked = of(kind)
        return _limited_to(known, *[asked.select(F.col(x).alias("pointer")) for x in columns]) if kind in kinds else known.limit(0)

    triples, triple_rejections, triple_results = _triples(c, of("triple.add"), named_by("triple.add", "subject_pointer", "predicate_pointer", "object_pointer"), at)
    tags, tag_rejections = _tag_assignments(c, of("tag.assign"), named_by("tag.assign", "subject_pointer", "tag_pointer"), history, at)
    rejections += [*triple_rejections, *tag_rejections]

    moved = history.where("code IS NULL")
    latest = moved.groupBy("uuid").agg(F.max_by(F.struct("revision_uuid", "description", "lifecycle_state"), "index").alias("n"))
    identities = created.select("uuid", "pointer", F.lit("pgx:").alias("sigil"), "created_at").join(
        latest.select("uuid", F.col("n.lifecycle_state").alias("lifecycle_state"), F.col("n.revision_uuid").alias("current_revision_uuid")), "uuid")
    old = c["node_identity"].join(latest, "uuid").join(created.select("uuid").distinct(), "uuid", "left_anti").select(
        "uuid", "pointer", "sigil", "created_at", "lifecycle_state", F.col("n.revision_uuid").alias("current_revision_uuid"))
    lifted = c["node_identity"].join(promotions.select("uuid"), "uuid", "left_semi")
    lifted = lifted.join(latest.select("uuid", F.col("n.revision_uuid").alias("_r")), "uuid", "left").select(
        "uuid", "pointer", "sigil", "created_at", F.lit("promoted").alias("lifecycle_state"), F.coalesce("_r", "current_revision_uuid").alias("current_revision_uuid"))
    replaced_identity = old.join(promotions.select("uuid"), "uuid", "left_anti").unionByName(lifted)

    staged_now = latest.where("n.lifecycle_state = 'staged'").select("uuid", F.col("n.revision_uuid").alias("source_revision_uuid"))
    open_issues = findings.where("lifecycle_state = 'staged'").join(staged_now, "source_revision_uuid", "left_semi")
    blocked = open_issues.select(F.col("node_uuid")).distinct().withColumn("_blocked", F.lit(True))
    status = F.when(F.col("_blocked"), "blocked").otherwise("pending")
    queue = created.where("operation = 'node.stage'").select(
        F.col("uuid").alias("node_uuid"), F.col("graph_key").alias("intended_graph_key"), F.coalesce("tracking_note", F.lit("")).alias("tracking_note")
    ).join(blocked, "node_uuid", "left").withColumn("status", status)
    requeued = c["staging_queue"].drop("status").join(staged_now.select(F.col("uuid").alias("node_uuid")), "node_uuid", "left_semi").join(
        blocked, "node_uuid", "left").withColumn("status", status)
    issue_time = ids.ns_time(F.lit(at).cast("timestamp"), F.col("index") * ISSUE_SPREAD + F.col("link_index") + 1)
    issues = open_issues.withColumn("created_at", issue_time).select(
        ids.derived_uuid_col(c.namespace, "staging-issue", F.col("node_uuid"), F.col("source_revision_uuid"), F.col("link_index"), F.col("created_at"), F.col("code")).alias("issue_uuid"),
        "node_uuid", F.col("code").alias("issue_code"), ids.canonical_json(code=F.col("code"), pointer=F.col("target_pointer")).alias("details_json"),
        "created_at")
    rewritten = staged_now.select(F.col("uuid").alias("node_uuid"))
    settled = c["staging_issues"].join(promotions.select(F.col("uuid").alias("node_uuid")), "node_uuid", "left_semi").withColumn(
        "resolved_at", F.coalesce("resolved_at", F.lit(at)))

    end = c.with_tables(node_identity=cited.select("uuid", "pointer"))
    final_texts = latest.select("uuid", F.col("n.revision_uuid").alias("revision_uuid"), F.col("n.description").alias("description"))
    occurrences = build_reference_index(end, final_texts).withColumn("created_at", F.lit(at))

    appended = {
        "node_identity": identities,
        "node_revision": moved.select("revision_uuid", F.col("uuid").alias("node_uuid"), "title", "description", "created_at",
                                      "previous_revision_uuid", ids.content_hash("title", "description").alias("content_hash"), "request_uuid", "reason"),
        "graphs": graph_rows, "graph_membership": membership, "staging_queue": queue, "staging_issues": issues,
        "triples": triples, "node_tags": tags, "reference_occurrences": occurrences,
        "tag_registry": created.where("operation = 'tag.create'").select(F.col("uuid").alias("tag_uuid")),
        "sentinel_guidance": created.where("operation = 'sentinel.create'").select(
            F.col("uuid").alias("node_uuid"), F.coalesce("scope", F.lit("corpus")).alias("scope"), F.lit(True).alias("active"), "created_at"),
        "audit_event": _audit(c, known_ops, history, at),
    }
    replaced = {"node_identity": replaced_identity, "staging_queue": requeued, "staging_issues": settled}
    removed = {"staging_queue": promotions.select(F.col("uuid").alias("node_uuid")),
               "staging_issues": rewritten, "reference_occurrences": latest.select(F.col("uuid").alias("source_node_uuid"))}
    all_rejections = rejections[0]
    for more in rejections[1:]:
        all_rejections = all_rejections.unionByName(more)
    results = history.select("index", "operation", "pointer", "uuid", "revision_uuid", F.coalesce("code", F.lit("done")).alias("outcome"))
    results = results.unionByName(triple_results)
    shaped_rows = lambda d: {n: shaped(df, CORPUS_TABLES[n]) for n, df in d.items()}
    return Changes(shaped_rows(appended), shaped_rows(replaced), removed, all_rejections.distinct(), results)


def _promotions(c: Corpus, ops: DataFrame, asked: bool = True) -> tuple[DataFrame, list[DataFrame]]:
    """The nodes that may be promoted, and rejections. Unless promotions are ``asked`` for, ``ops`` has no rows, and nothing is materialised."""
    kept = checkpointed if asked else lambda df: df
    wanted = ops.select("index", "pointer", "graph_key")
    # Whether a node may be promoted is told without its text; only the texts of those that may are joined.
    revisions = c["node_revision"].select(ids.packed("revision_uuid").alias("_r"))
    nodes = c["node_identity"].withColumn("_r", ids.packed("current_revision_uuid")).join(revisions, "_r", "left_semi").select(
        "pointer", ids.packed("uuid").alias("_u"), "_r", "lifecycle_state")
    queue = c["staging_queue"].select(ids.packed("node_uuid").alias("_u"), "intended_graph_key")
    rows = wanted.join(nodes, "pointer", "left").join(queue, "_u", "left")
    rows = rows.withColumn("graph_key", F.coalesce("graph_key", "intended_graph_key"))
    code = (F.when(F.col("_u").isNull(), "node_not_found").when(F.col("lifecycle_state") != "staged", "not_staged")
             .when(F.col("graph_key").isNull(), "graph_required"))
    # Judged once: of those refused only the reason stays, of the others what their promotion needs.
    rows = rows.withColumn("code", code)
    stays = lambda name: F.when(F.col("code").isNull(), F.col(name)).alias(name)
    rows = kept(rows.select("index", "pointer", "code", stays("graph_key"), stays("_u"), stays("_r")))
    good = rows.where("code IS NULL")
    texts = kept(good.join(c["node_revision"].select(ids.packed("revision_uuid").alias("_r"), "description"), "_r").select(
        "index", "pointer", "graph_key", ids.spelled("_u").alias("uuid"), ids.spelled("_r").alias("revision_uuid"), "description"))
    errors = validate_links(texts.select("uuid", "revision_uuid", "description"), c).where("severity = 'error'")
    broken = errors.select(F.col("source_node_uuid").alias("uuid"), F.col("code").alias("link_code"), "target_pointer").join(texts.select("uuid", "index"), "uuid")
    return texts.select("index", "pointer", "uuid", "graph_key"), [
        _rejected(rows.where("code IS NOT NULL"), F.col("code"), F.col("pointer")),
        _rejected(broken, F.col("link_code"), F.col("target_pointer"))]


def _triples(c: Corpus, ops: DataFrame, known: DataFrame, at: str) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    rows = ops.select("index", "operation", "request_uuid", "subject_pointer", "predicate_pointer", "object_pointer")
    since = known.groupBy("pointer").agg(F.min_by("uuid", "since").alias("uuid"), F.min("since").alias("since"))
    rejections = []
    for role in ("subject", "predicate", "object"):
        named = since.select(F.col("pointer").alias(f"{role}_pointer"), F.col("uuid").alias(f"{role}_uuid"), F.col("since").alias(f"{role}_since"))
        if role == "predicate":  # a batch names few, each of them often
            named = broadcast_if_small(ops.select("predicate_pointer").distinct().join(named, "predicate_pointer"))
        rows = rows.join(named, f"{role}_pointer", "left")
        late = F.col(f"{role}_since").isNull() | (F.col(f"{role}_since") > F.col("index"))
        rejections.append(_rejected(rows.where(late), "node_not_found", F.col(f"{role}_pointer")))
    unregistered = rows.where("predicate_uuid IS NOT NULL").join(c["predicate_registry"], "predicate_uuid", "left_anti")
    rejections.append(_rejected(unregistered, "predicate_not_registered", F.col("predicate_pointer")))
    whole = rows.where("subject_uuid IS NOT NULL AND predicate_uuid IS NOT NULL AND object_uuid IS NOT NULL")
    keys = ["subject_uuid", "predicate_uuid", "object_uuid"]
    stored = c["triples"].select(*keys, F.col("triple_uuid").alias("_stored"))
    first = whole.groupBy(*keys).agg(F.min(F.struct("index", "request_uuid")).alias("f")).join(stored.drop("_stored"), keys, "left_anti")
    uuid_ = ids.derived_uuid_col(c.namespace, "triple", *[F.col(k) for k in keys])
    added = first.select(uuid_.alias("triple_uuid"), *keys, ids.ns_time(F.lit(at).cast("timestamp"), F.col("f.index")).alias("created_at"),
                         F.col("f.request_uuid").alias("request_uuid"), F.col("f.index").alias("index"))
    new_at = added.select(*keys, F.col("index").alias("_new"))
    results = whole.join(new_at, keys, "left").select(
        "index", "operation", F.col("subject_pointer").alias("pointer"), uuid_.alias("uuid"), F.lit(None).cast("string").alias("revision_uuid"),
        F.when(F.col("_new").eqNullSafe(F.col("index")), "done").otherwise("already_present").alias("outcome"))
    return added.drop("index"), rejections, results


def _tag_assignments(c: Corpus, ops: DataFrame, known: DataFrame, history: DataFrame, at: str) -> tuple[DataFrame, list[DataFrame]]:
    rows = ops.select("index", "request_uuid", "subject_pointer", "tag_pointer")
    since = known.groupBy("pointer").agg(F.min_by("uuid", "since").alias("uuid"), F.min("since").alias("since"))
    rejections = []
    for role in ("subject", "tag"):
        named = since.select(F.col("pointer").alias(f"{role}_pointer"), F.col("uuid").alias(f"{role}_uuid"), F.col("since").alias(f"{role}_since"))
        rows = rows.join(named, f"{role}_pointer", "left")
        late = F.col(f"{role}_since").isNull() | (F.col(f"{role}_since") > F.col("index"))
        rejections.append(_rejected(rows.where(late), "node_not_found", F.col(f"{role}_pointer")))
    registered = c["tag_registry"].unionByName(history.where("operation = 'tag.create' AND code IS NULL").select(F.col("uuid").alias("tag_uuid")))
    rejections.append(_rejected(rows.where("tag_uuid IS NOT NULL").join(registered, "tag_uuid", "left_anti"), "tag_not_registered", F.col("tag_pointer")))
    keys = ["subject_uuid", "tag_uuid"]
    first = rows.where("subject_uuid IS NOT NULL AND tag_uuid IS NOT NULL").groupBy(*keys).agg(F.min(F.struct("index", "request_uuid")).alias("f"))
    added = first.join(c["node_tags"].select(*keys), keys, "left_anti")
    return added.select(ids.derived_uuid_col(c.namespace, "tag-assignment", F.col("subject_uuid"), F.col("tag_uuid")).alias("assignment_uuid"),
                        *keys, ids.ns_time(F.lit(at).cast("timestamp"), F.col("f.index")).alias("created_at"), F.col("f.request_uuid").alias("request_uuid")), rejections


def _audit(c: Corpus, ops: DataFrame, history: DataFrame, at: str) -> DataFrame:
    done = history.where("code IS NULL").select("index", "uuid", "previous_revision_uuid", "revision_uuid", "reason")
    rows = ops.select("index", "operation", "request_uuid").join(done, "index", "left")
    moment = ids.ns_time(F.lit(at).cast("timestamp"), F.col("index"))
    rows = rows.withColumn("created_at", moment)
    return rows.select(
        ids.derived_uuid_col(c.namespace, "audit", F.col("request_uuid"), F.col("operation"), F.col("uuid"), F.col("created_at")).alias("event_uuid"),
        "request_uuid", F.col("operation").alias("operation_type"), F.col("uuid").alias("node_uuid"), "previous_revision_uuid",
        F.col("revision_uuid").alias("new_revision_uuid"), ids.canonical_json(reason=F.coalesce("reason", F.lit(""))).alias("details_json"), "created_at")


# ---- single-kind batches ----------------------------------------------------------
def _of_kind(c: Corpus, df: DataFrame, operation: str, at: str) -> Changes:
    return plan_changes(c, df.withColumn("operation", F.lit(operation)), at, {operation})


def create_nodes(c: Corpus, df: DataFrame, at: str | None = None) -> Changes:
    return _of_kind(c, df, "node.create", at)


def revise_nodes(c: Corpus, df: DataFrame, at: str | None = None) -> Changes:
    return _of_kind(c, df, "node.update", at)


def revert_nodes(c: Corpus, df: DataFrame, at: str | None = None) -> Changes:
    return _of_kind(c, df, "node.revert", at)


def stage_nodes(c: Corpus, df: DataFrame, at: str | None = None) -> Changes:
    return _of_kind(c, df, "node.stage", at)


def promote_nodes(c: Corpus, df: DataFrame, at: str | None = None) -> Changes:
    return _of_kind(c, df, "node.promote", at)


def embed_traversals(c: Corpus, df: DataFrame, at: str | None = None) -> Changes:
    return _of_kind(c, df, "traversal.embed", at)


def add_triples(c: Corpus, df: DataFrame, at: str | None = None) -> Changes:
    return _of_kind(c, df, "triple.add", at)


def create_tags(c: Corpus, df: DataFrame, at: str | None = None) -> Changes:
    return _of_kind(c, df, "tag.create", at)


def assign_tags(c: Corpus, df: DataFrame, at: str | None = None) -> Changes:
    return _of_kind(c, df, "tag.assign", at)


def create_graphs(c: Corpus, df: DataFrame, at: str | None = None) -> Changes:
    return _of_kind(c, df, "graph.create", at)


def create_sentinels(c: Corpus, df: DataFrame, at: str | None = None) -> Changes:
    return _of_kind(c, df, "sentinel.create", at)


def _rewritten(c: Corpus, texts: DataFrame, at: str | None, reason: str) -> Changes:
    """A revision for every node of ``texts(pointer, description)``."""
    numbered = grouped_rank(texts.select("pointer", "description").withColumn("_all", F.lit(1)).withColumn("_key", F.sha1(F.col("pointer").cast("binary"))),
                            ["_all"], [F.col("_key"), F.col("pointer")], F.substring("_key", 1, 3), "index")
    ops = numbered.select("index", "pointer", "description", F.lit(reason).alias("reason"))
    return _of_kind(c, ops, "node.update", at)


def migrate_legacy(c: Corpus, at: str | None = None, include_staged: bool = True) -> Changes:
    """Legacy citations turned into links, one revision per changed node; a second run changes nothing."""
    return _rewritten(c, rewrite_legacy(c, include_staged), at, "legacy citations rewritten")


def migrate_bare(c: Corpus, at: str | None = None, include_staged: bool = True) -> Changes:
    """Links respelled as bare pointers, one revision per changed node, judged by the bare profile.

    Any link error, in a text as it is or as it would become, is a rejection, so such a corpus is left as it is.
    """
    texts, errors = plan_bare(c, include_staged)
    plan = _rewritten(replace(c, profile=bare_profile(c.profile)), texts, at, "links respelled as bare pointers")
    found = errors.select(F.lit(None).cast("long").alias("index"), "code", F.col("target_pointer").alias("detail"))
    return replace(plan, rejections=plan.rejections.unionByName(found).distinct())


def preflight(c: Corpus, ops: DataFrame, at: str | None = None) -> DataFrame:
    """Rejections a batch would meet; writes nothing."""
    return plan_changes(c, ops, at).rejections


# ---- requests ---------------------------------------------------------------------
def dedupe_requests(oplog: DataFrame, ledger: DataFrame) -> DataFrame:
    """One row per request id of ``oplog(request_id, tool, input_hash)`` with its ``disposition``.

    ``conflict`` when one id came with different inputs, now or earlier; ``replay`` when the ledger
    already holds this very input; ``new`` otherwise. ``copies`` counts arrivals.
    """
    arrivals = oplog.groupBy("request_id").agg(
        F.min("input_hash").alias("input_hash"), F.max("input_hash").alias("_other"), F.count(F.lit(1)).alias("copies"))
    past = ledger.select(F.col("request_uuid").alias("request_id"), F.col("input_hash").alias("_past"))
    joined = arrivals.join(past, "request_id", "left")
    conflict = (F.col("input_hash") != F.col("_other")) | (F.col("_past") != F.col("input_hash"))
    disposition = F.when(F.coalesce(conflict, F.lit(False)), "conflict").when(F.col("_past").isNotNull(), "replay").otherwise("new")
    return joined.select("request_id", F.when(disposition != "conflict", F.col("input_hash")).alias("input_hash"), "copies", disposition.alias("disposition"))


@dataclass(frozen=True)
class LedgerRows:
    ledger: DataFrame
    receipts: DataFrame


def ledger_rows(c: Corpus, requests: DataFrame, sequence: int, bucket: Column | None = None) -> LedgerRows:
    """Ledger and receipt rows of ``requests(index, request_uuid, tool_name, input_hash, change_set_uuid, at)``.

    Sequence numbers follow ``sequence`` along the index; receipts continue each change set's count.
    """
    bucket = bucket if bucket is not None else F.floor(F.col("index") / ORDINAL_BUCKET)
    numbered = grouped_rank(requests.withColumn("_all", F.lit(1)), ["_all"], [F.col("index")], bucket, "_nth").drop("_all")
    numbered = numbered.withColumn("database_sequence", F.lit(sequence) + F.col("_nth"))
    ledger = numbered.select("request_uuid", "tool_name", "input_hash", F.lit("committed").alias("status"), F.col("at").alias("started_at"),
                             F.col("at").alias("committed_at"), "database_sequence", "change_set_uuid")
    attached = numbered.where("change_set_uuid IS NOT NULL")
    past = c["change_set_receipts"].groupBy("change_set_uuid").agg(F.max("ordinal").alias("_last"))
    ranked = grouped_rank(attached, ["change_set_uuid"], [F.col("database_sequence")], bucket, "_in_set")
    receipts = ranked.join(past, "change_set_uuid", "left").withColumn("ordinal", F.coalesce("_last", F.lit(0)) + F.col("_in_set"))
    return LedgerRows(shaped(ledger, CORPUS_TABLES["operation_ledger"]), shaped(receipts, CORPUS_TABLES["change_set_receipts"]))


def next_head(c: Corpus, head: Head, request_uuid: str, tool_name: str, batch_hash: str, result: dict) -> tuple[Head, str]:
    """The head after one transition, and the transition digest."""
    sequence = head.sequence + 1
    body = {"parent_snapshot_uuid": head.snapshot_uuid, "request_uuid": request_uuid, "tool_name": tool_name,
            "input_hash": batch_hash, "database_sequence": sequence, "result": result}
    digest = hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    name = f"snapshot:{head.snapshot_uuid}:{sequence}:{digest}:{request_uuid}"
    return Head(head.corpus_id, str(uuid.uuid5(uuid.UUID(head.corpus_id), name)), sequence), digest


# ---- branch workspaces ------------------------------------------------------------
def _operation_rows(b: Branch, df: DataFrame, kind: str, payload: Column, at: str) -> DataFrame:
    rows = df.withColumn("payload_json", payload).withColumn("created_at", ids.ns_time(F.lit(at).cast("timestamp"), F.col("index")))
    return rows.withColumn("operation_uuid", ids.derived_uuid_col(b.namespace, kind, F.lit(b.replica_uuid), F.col("index"), F.col("created_at"), F.sha2("payload_json", 256)))


def _operations_table(b: Branch, rows: DataFrame, kind: str) -> DataFrame:
    return rows.select("operation_uuid", F.lit(b.replica_uuid).alias("origin_replica_uuid"), F.lit(kind).alias("operation_kind"),
                       F.sha2("payload_json", 256).alias("payload_hash"), "payload_json", "created_at")


def _branch_changes(appended: dict[str, DataFrame], rejections: DataFrame, results: DataFrame) -> Changes:
    return Changes({n: shaped(df, BRANCH_TABLES[n]) for n, df in appended.items()}, {}, {}, rejections, results)


def create_objects(b: Branch, df: DataFrame, at: str = "2000-01-01 00:00:00") -> Changes:
    """Objects from ``df(index, alias, title, description, object_kind)``; ids derive from each operation's id."""
    payload = ids.canonical_json(alias=F.col("alias"), title=F.col("title"), description=F.col("description"), object_kind=F.col("object_kind"))
    rows = _operation_rows(b, df, "object.create", payload, at)
    operation = F.col("operation_uuid")
    rows = rows.withColumn("object_uuid", ids.uuid5_of(operation, F.concat(F.lit("object:"), "object_kind"))).withColumn(
        "assertion_uuid", ids.uuid5_of(operation, F.lit("alias"))).withColumn("revision_uuid", ids.uuid5_of(operation, F.lit("revision")))
    bad = rows.withColumn("code", F.when(~F.col("object_kind").isin("node", "graph"), "object_kind").when(
        F.coalesce(F.length("alias"), F.lit(0)) == 0, "empty_alias")).where("code IS NOT NULL")
    appended = {
        "semantic_operations": _operations_table(b, rows, "object.create"),
        "semantic_objects": rows.select("object_uuid", "object_kind", F.col("operation_uuid").alias("creation_operation_uuid"), "created_at"),
        "object_alias_assertions": rows.select("assertion_uuid", F.lit(b.replica_uuid).alias("scope_replica_uuid"), F.col("alias").alias("alias_text"),
                                               "object_uuid", "operation_uuid", "created_at"),
        "node_revisions": _branch_revisions(rows)}
    return _branch_changes(appended, _rejected(bad, F.col("code"), F.col("alias")), rows.select("index", "object_uuid", "revision_uuid"))


def _branch_revisions(rows: DataFrame) -> DataFrame:
    return rows.select("revision_uuid", F.col("object_uuid").alias("node_uuid"), "title", "description",
                       ids.object_content_hash("title", "description").alias("content_hash"), "operation_uuid", "created_at")


def revise_objects(b: Branch, df: DataFrame, at: str = "2000-01-01 00:00:00") -> Changes:
    """Revisions from ``df(index, object_uuid, parent_revision_uuid, title, description)``."""
    payload = ids.canonical_json(**{k: F.col(k) for k in ("object_uuid", "parent_revision_uuid", "title", "description")})
    rows = _operation_rows(b, df, "object.revise", payload, at).withColumn("revision_uuid", ids.uuid5_of(F.col("operation_uuid"), F.lit("revision")))
    owner = b["node_revisions"].select(F.col("revision_uuid").alias("parent_revision_uuid"), F.col("node_uuid").alias("_owner"))
    checked = rows.join(owner, "parent_revision_uuid", "left")
    bad = checked.where(~F.col("_owner").eqNullSafe(F.col("object_uuid")))
    appended = {"semantic_operations": _operations_table(b, rows, "object.revise"), "node_revisions": _branch_revisions(rows),
                "revision_parents": rows.select("revision_uuid", "parent_revision_uuid", F.lit(0).alias("ordinal"))}
    return _branch_changes(appended, _rejected(bad, "parent_not_of_object", F.col("object_uuid")), rows.select("index", "object_uuid", "revision_uuid"))


def add_memberships(b: Branch, df: DataFrame, at: str = "2000-01-01 00:00:00") -> Changes:
    """Memberships from ``df(index, graph_uuid, object_uuid, order_key)``; the graph must be a graph and both must exist."""
    payload = ids.canonical_json(**{k: F.col(k) for k in ("graph_uuid", "object_uuid", "order_key")})
    rows = _operation_rows(b, df, "graph.membership.add", payload, at).withColumn("membership_uuid", ids.uuid5_of(F.col("operation_uuid"), F.lit("membership")))
    graph = b["semantic_objects"].where("object_kind = 'graph'").select(F.col("object_uuid").alias("graph_uuid"), F.lit(True).alias("_graph"))
    known = b["semantic_objects"].select("object_uuid", F.lit(True).alias("_object"))
    bad = rows.join(graph, "graph_uuid", "left").join(known, "object_uuid", "left").where("_graph IS NULL OR _object IS NULL")
    appended = {"semantic_operations": _operations_table(b, rows, "graph.membership.add"),
                "graph_membership_assertions": rows.select("membership_uuid", "graph_uuid", "object_uuid", "order_key", "operation_uuid", "created_at")}
    return _branch_changes(appended, _rejected(bad, "graph_or_object_missing", F.col("object_uuid")), rows.select("index", "object_uuid", "membership_uuid"))
