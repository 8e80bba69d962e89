"""Table layouts of a corpus and of a branchable workspace, with their integrity rules.

Integrity is data here: quality checks are generated from these declarations.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

_TYPES = {"STRING": StringType(), "BIGINT": LongType(), "INT": IntegerType(), "BOOLEAN": BooleanType(), "TIMESTAMP": TimestampType()}


def flat_schema(columns: str) -> StructType:
    """Struct of ``name TYPE, ...`` with plain types; needs no session."""
    pairs = [column.split() for column in columns.split(",")]
    return StructType([StructField(name, _TYPES[kind]) for name, kind in pairs])


@dataclass(frozen=True)
class Table:
    columns: str
    key: tuple[str, ...]
    unique: tuple[tuple[str, ...], ...] = ()
    refs: dict[str, tuple[str, str]] = field(default_factory=dict)
    rules: dict[str, str] = field(default_factory=dict)
    append_only: bool = False

    @property
    def schema(self) -> StructType:
        return flat_schema(self.columns)

    @property
    def names(self) -> list[str]:
        return self.schema.fieldNames()


def _one_of(column: str, *values: str) -> str:
    return f"{column} IN ({', '.join(repr(v) for v in values)})"


def _one_line(column: str) -> str:
    return f"length({column}) > 0 AND instr({column}, '\\n') = 0 AND instr({column}, '\\r') = 0"


NODE = ("node_identity", "uuid")
REVISION = ("node_revision", "revision_uuid")
SNAPSHOT = ("semantic_snapshots", "snapshot_uuid")

CORPUS_TABLES: dict[str, Table] = {
    "metadata": Table("key STRING, value STRING", ("key",)),
    "node_identity": Table(
        "uuid STRING, pointer STRING, sigil STRING, created_at STRING, lifecycle_state STRING, current_revision_uuid STRING",
        ("uuid",), (("pointer",), ("created_at",), ("current_revision_uuid",)),
        rules={"pointer": _one_line("pointer"), "sigil": "sigil = 'pgx:'",
               "lifecycle_state": _one_of("lifecycle_state", "staged", "promoted", "deprecated")}),
    "node_revision": Table(
        "revision_uuid STRING, node_uuid STRING, title STRING, description STRING, created_at STRING, "
        "previous_revision_uuid STRING, content_hash STRING, request_uuid STRING, reason STRING",
        ("revision_uuid",), (("created_at",),), {"node_uuid": NODE, "previous_revision_uuid": REVISION},
        {"title": _one_line("title"), "description": "length(description) > 0 AND instr(description, '\\r') = 0"},
        append_only=True),
    "graphs": Table(
        "graph_uuid STRING, graph_key STRING, pointer_prefix STRING, description STRING",
        ("graph_uuid",), (("graph_key",), ("pointer_prefix",)), {"graph_uuid": NODE}),
    "graph_membership": Table(
        "graph_uuid STRING, node_uuid STRING, ordinal BIGINT",
        ("graph_uuid", "node_uuid"), (("node_uuid",), ("graph_uuid", "ordinal")),
        {"graph_uuid": ("graphs", "graph_uuid"), "node_uuid": NODE}, {"ordinal": "ordinal >= 0"}),
    "staging_queue": Table(
        "node_uuid STRING, intended_graph_key STRING, tracking_note STRING, status STRING",
        ("node_uuid",), refs={"node_uuid": NODE, "intended_graph_key": ("graphs", "graph_key")},
        rules={"status": _one_of("status", "pending", "blocked", "review")}),
    "staging_issues": Table(
        "issue_uuid STRING, node_uuid STRING, issue_code STRING, details_json STRING, created_at STRING, resolved_at STRING",
        ("issue_uuid",), (("created_at",),), {"node_uuid": NODE}),
    "predicate_registry": Table("predicate_uuid STRING", ("predicate_uuid",), refs={"predicate_uuid": NODE}),
    "triples": Table(
        "triple_uuid STRING, subject_uuid STRING, predicate_uuid STRING, object_uuid STRING, created_at STRING, request_uuid STRING",
        ("triple_uuid",), (("created_at",), ("subject_uuid", "predicate_uuid", "object_uuid")),
        {"subject_uuid": NODE, "predicate_uuid": ("predicate_registry", "predicate_uuid"), "object_uuid": NODE}),
    "tag_registry": Table("tag_uuid STRING", ("tag_uuid",), refs={"tag_uuid": NODE}),
    "node_tags": Table(
        "assignment_uuid STRING, subject_uuid STRING, tag_uuid STRING, created_at STRING, request_uuid STRING",
        ("assignment_uuid",), (("created_at",), ("subject_uuid", "tag_uuid")),
        {"subject_uuid": NODE, "tag_uuid": ("tag_registry", "tag_uuid")}),
    "reference_profiles": Table(
        "profile_key STRING, namespace_prefix STRING, pointer_pattern STRING, visible_open STRING, visible_close STRING, "
        "uri_template STRING, require_target BOOLEAN, resolver_status STRING, created_at STRING",
        ("profile_key",), (("namespace_prefix",), ("created_at",)),
        rules={"resolver_status": _one_of("resolver_status", "resolved", "unresolved")}),
    "reference_occurrences": Table(
        "occurrence_uuid STRING, source_node_uuid STRING, source_revision_uuid STRING, ordinal INT, profile_key STRING, "
        "target_pointer STRING, target_uuid STRING, anchor_text STRING, visible_identifier STRING, canonical_uri STRING, "
        "char_start INT, char_end INT, token_path STRING, occurrence_fingerprint STRING, created_at STRING",
        ("occurrence_uuid",),
        (("created_at",), ("source_revision_uuid", "ordinal"), ("source_revision_uuid", "occurrence_fingerprint")),
        {"source_node_uuid": NODE, "source_revision_uuid": REVISION, "target_uuid": NODE,
         "profile_key": ("reference_profiles", "profile_key")},
        {"ordinal": "ordinal >= 0", "span": "char_start >= 0 AND char_end > char_start"}),
    "operation_ledger": Table(
        "request_uuid STRING, tool_name STRING, input_hash STRING, status STRING, result_json STRING, started_at STRING, "
        "committed_at STRING, database_sequence BIGINT, input_snapshot_uuid STRING, output_snapshot_uuid STRING, "
        "transition_digest STRING, change_set_uuid STRING",
        ("request_uuid",), (("started_at",),), {"change_set_uuid": ("change_sets", "change_set_uuid")},
        {"status": _one_of("status", "started", "committed")}),
    "audit_event": Table(
        "event_uuid STRING, request_uuid STRING, operation_type STRING, node_uuid STRING, previous_revision_uuid STRING, "
        "new_revision_uuid STRING, details_json STRING, created_at STRING",
        ("event_uuid",), (("created_at",),),
        {"node_uuid": NODE, "previous_revision_uuid": REVISION, "new_revision_uuid": REVISION}),
    "corpus_workstreams": Table(
        "workstream_id STRING, corpus_id STRING, base_snapshot_id STRING, created_at STRING, package_release_id STRING, "
        "mutation_count BIGINT", ("workstream_id",), (("created_at",),), rules={"mutation_count": "mutation_count >= 0"}),
    "materializations": Table(
        "materialization_id STRING, corpus_id STRING, snapshot_id STRING, workstream_id STRING, kind STRING, "
        "created_at STRING, details_json STRING", ("materialization_id",), (("created_at",),),
        rules={"kind": _one_of("kind", "database", "pgx", "markdown")}),
    "sentinel_guidance": Table(
        "node_uuid STRING, scope STRING, active BOOLEAN, created_at STRING",
        ("node_uuid",), (("created_at",),), {"node_uuid": NODE}),
    "semantic_snapshots": Table(
        "snapshot_uuid STRING, parent_snapshot_uuid STRING, corpus_id STRING, database_sequence BIGINT, "
        "transition_digest STRING, request_uuid STRING, tool_name STRING, created_at STRING",
        ("snapshot_uuid",), (("created_at",), ("corpus_id", "database_sequence")),
        {"parent_snapshot_uuid": SNAPSHOT}, {"database_sequence": "database_sequence >= 0"}, append_only=True),
    "change_sets": Table(
        "change_set_uuid STRING, title STRING, intent STRING, status STRING, base_snapshot_uuid STRING, created_at STRING, "
        "resolved_at STRING, resolution STRING",
        ("change_set_uuid",), (("created_at",),), {"base_snapshot_uuid": SNAPSHOT},
        {"status": _one_of("status", "open", "completed", "abandoned", "superseded")}),
    "change_set_receipts": Table(
        "change_set_uuid STRING, ordinal BIGINT, request_uuid STRING, tool_name STRING, database_sequence BIGINT, "
        "output_snapshot_uuid STRING",
        ("change_set_uuid", "ordinal"), (("request_uuid",),),
        {"change_set_uuid": ("change_sets", "change_set_uuid"), "request_uuid": ("operation_ledger", "request_uuid"),
         "output_snapshot_uuid": SNAPSHOT},
        {"ordinal": "ordinal >= 1", "database_sequence": "database_sequence >= 1"}, append_only=True),
}

_OPERATION = ("semantic_operations", "operation_uuid")
_OBJECT = ("semantic_objects", "object_uuid")
_REPLICA = ("replicas", "replica_uuid")
_NODE_REVISION = ("node_revisions", "revision_uuid")

BRANCH_TABLES: dict[str, Table] = {
    "corpus_components": Table(
        "composite_corpus_uuid STRING, component_corpus_uuid STRING", ("composite_corpus_uuid", "component_corpus_uuid")),
    "replicas": Table("replica_uuid STRING, label STRING, created_at STRING, forked_from_snapshot_uuid STRING",
                      ("replica_uuid",), append_only=True),
    "semantic_operations": Table(
        "operation_uuid STRING, origin_replica_uuid STRING, operation_kind STRING, payload_hash STRING, payload_json STRING, "
        "created_at STRING", ("operation_uuid",), refs={"origin_replica_uuid": _REPLICA}, append_only=True),
    "semantic_objects": Table(
        "object_uuid STRING, object_kind STRING, creation_operation_uuid STRING, created_at STRING",
        ("object_uuid",), refs={"creation_operation_uuid": _OPERATION},
        rules={"object_kind": _one_of("object_kind", "node", "graph")}, append_only=True),
    "object_alias_assertions": Table(
        "assertion_uuid STRING, scope_replica_uuid STRING, alias_text STRING, object_uuid STRING, operation_uuid STRING, "
        "created_at STRING", ("assertion_uuid",),
        refs={"scope_replica_uuid": _REPLICA, "object_uuid": _OBJECT, "operation_uuid": _OPERATION},
        rules={"alias_text": "length(alias_text) > 0"}, append_only=True),
    "node_revisions": Table(
        "revision_uuid STRING, node_uuid STRING, title STRING, description STRING, content_hash STRING, "
        "operation_uuid STRING, created_at STRING", ("revision_uuid",),
        refs={"node_uuid": _OBJECT, "operation_uuid": _OPERATION}, append_only=True),
    "revision_parents": Table(
        "revision_uuid STRING, parent_revision_uuid STRING, ordinal INT",
        ("revision_uuid", "parent_revision_uuid"), (("revision_uuid", "ordinal"),),
        {"revision_uuid": _NODE_REVISION, "parent_revision_uuid": _NODE_REVISION}, {"ordinal": "ordinal >= 0"},
        append_only=True),
    "graph_membership_assertions": Table(
        "membership_uuid STRING, graph_uuid STRING, object_uuid STRING, order_key STRING, operation_uuid STRING, "
        "created_at STRING", ("membership_uuid",),
        refs={"graph_uuid": _OBJECT, "object_uuid": _OBJECT, "operation_uuid": _OPERATION}, append_only=True),
    "semantic_snapshots": Table(
        "snapshot_uuid STRING, corpus_uuid STRING, operation_uuid STRING, state_fingerprint STRING, created_at STRING",
        ("snapshot_uuid",), (("operation_uuid",),), {"operation_uuid": _OPERATION}, append_only=True),
    "snapshot_parents": Table(
        "snapshot_uuid STRING, parent_snapshot_uuid STRING, ordinal INT",
        ("snapshot_uuid", "parent_snapshot_uuid"), (("snapshot_uuid", "ordinal"),),
        {"snapshot_uuid": SNAPSHOT, "parent_snapshot_uuid": SNAPSHOT}, {"ordinal": "ordinal >= 0"}, append_only=True),
    "composition_records": Table(
        "composition_uuid STRING, operation_uuid STRING, output_snapshot_uuid STRING, source_count INT, plan_digest STRING, "
        "created_at STRING", ("composition_uuid",), (("operation_uuid",), ("output_snapshot_uuid",)),
        {"operation_uuid": _OPERATION, "output_snapshot_uuid": SNAPSHOT}, {"source_count": "source_count >= 1"}),
    "composition_inputs": Table(
        "composition_uuid STRING, source_workspace_uuid STRING, source_corpus_uuid STRING, source_snapshot_uuid STRING, "
        "source_sha256 STRING", ("composition_uuid", "source_workspace_uuid", "source_snapshot_uuid"),
        refs={"composition_uuid": ("composition_records", "composition_uuid"), "source_snapshot_uuid": SNAPSHOT}),
    "local_requests": Table(
        "replica_uuid STRING, request_uuid STRING, input_hash STRING, operation_uuid STRING, result_json STRING",
        ("replica_uuid", "request_uuid"), refs={"replica_uuid": _REPLICA, "operation_uuid": _OPERATION}),
}

# Immutable rows that composition unites, and the subset whose content identifies a state.
COMPOSED_TABLES = ("replicas", "semantic_operations", "semantic_objects", "object_alias_assertions", "node_revisions",
                   "revision_parents", "graph_membership_assertions", "semantic_snapshots", "snapshot_parents")
STATE_TABLES = ("semantic_objects", "object_alias_assertions", "node_revisions", "revision_parents",
                "graph_membership_assertions")
