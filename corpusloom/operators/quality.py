"""Corpus quality as one findings table: (code, severity, key, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.corpus import Corpus
from corpusloom.functions import ids
from corpusloom.functions.text import node_line
from corpusloom.operators.fingerprints import row_digest
from corpusloom.operators.graph import assign_graph, revision_chains
from corpusloom.operators.references import build_reference_index, validate_links
from corpusloom.operators.views import current_nodes
from corpusloom.sources.nodetext import parse_lines


def _found(df: DataFrame, code: str | Column, key: Column | str, detail: Column | str | None = None, severity: str = "error") -> DataFrame:
    code = F.lit(code) if isinstance(code, str) else code
    key = F.col(key) if isinstance(key, str) else key
    detail = F.lit(None) if detail is None else (F.col(detail) if isinstance(detail, str) else detail)
    return df.select(code.alias("code"), F.lit(severity).alias("severity"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def check_uuid(c: Corpus) -> DataFrame:
    return _found(c["node_identity"].where(F.col("uuid") != ids.uuid5_col(c.namespace, "pointer")), "uuid_determinism", "pointer", "uuid")


def check_timestamps(c: Corpus) -> DataFrame:
    bad = lambda df: df.where(~F.coalesce(F.col("created_at").rlike(ids.NS_TIME_PATTERN), F.lit(False)))
    return _all([_found(bad(c["node_identity"]), "identity_timestamp", "pointer", "created_at"),
                 _found(bad(c["node_revision"]), "revision_timestamp", "revision_uuid", "created_at")])


def check_current_revision(c: Corpus) -> DataFrame:
    owner = c["node_revision"].select("revision_uuid", "node_uuid")
    rows = c["node_identity"].join(owner, F.col("current_revision_uuid") == F.col("revision_uuid"), "left")
    return _found(rows.where(~F.col("node_uuid").eqNullSafe(F.col("uuid"))), "current_revision", "pointer", "current_revision_uuid")


def check_content_hash(c: Corpus) -> DataFrame:
    return _found(c["node_revision"].where(F.col("content_hash") != ids.content_hash("title", "description")), "revision_hash", "revision_uuid")


def check_cycles(c: Corpus) -> DataFrame:
    cyclic = revision_chains(c["node_revision"]).where("cycle").select(F.col("revision_uuid").alias("current_revision_uuid"))
    return _found(c["node_identity"].join(cyclic, "current_revision_uuid", "left_semi"), "revision_cycle", "pointer")


def check_lifecycle_membership(c: Corpus) -> DataFrame:
    member = c["graph_membership"].select(F.col("node_uuid").alias("uuid"))
    outside = c["node_identity"].where("lifecycle_state = 'promoted'").join(member, "uuid", "left_anti")
    inside = c["node_identity"].where("lifecycle_state = 'staged'").join(member, "uuid", "left_semi")
    return _all([_found(outside, "promoted_without_graph", "pointer"), _found(inside, "staged_in_graph", "pointer")])


def check_membership_namespace(c: Corpus) -> DataFrame:
    graphs = c["graphs"].select("graph_uuid", "graph_key", "pointer_prefix")
    rows = (c["graph_membership"].join(c["node_identity"].select(F.col("uuid").alias("node_uuid"), "pointer"), "node_uuid")
            .join(graphs.select("graph_uuid", "graph_key"), "graph_uuid"))
    owned = assign_graph(rows, graphs)
    wrong = owned.where(~F.col("resolved_graph_uuid").eqNullSafe(F.col("graph_uuid")))
    return _found(wrong, "graph_namespace", "pointer", F.concat_ws("->", F.col("graph_key"), F.coalesce("resolved_graph_key", F.lit("none"))))


def check_links(c: Corpus) -> DataFrame:
    nodes = current_nodes(c).where("lifecycle_state = 'promoted'")
    errors = validate_links(nodes, c).where("severity = 'error'").join(nodes.select(F.col("uuid").alias("source_node_uuid"), "pointer"), "source_node_uuid")
    return _found(errors, "promoted_reference_contract", "pointer", "code")


# What a stored occurrence must share with the derived one.
_COMPARED = ("target_pointer", "anchor_text", "canonical_uri", "char_start", "char_end", "occurrence_fingerprint")


def check_reference_index(c: Corpus, derived: DataFrame | None = None) -> DataFrame:
    derived = derived if derived is not None else build_reference_index(c)
    nodes = current_nodes(c).select("pointer", F.col("revision_uuid").alias("source_revision_uuid"))
    keys = ["source_revision_uuid", "ordinal"]
    digest = row_digest(*_COMPARED)
    stored = c["reference_occurrences"].join(nodes, "source_revision_uuid", "left_semi").select(*keys, digest.alias("stored"))
    rows = stored.join(derived.select(*keys, digest.alias("derived")), keys, "full").where(~F.col("stored").eqNullSafe(F.col("derived")))
    kind = F.when(F.col("stored").isNull(), "missing").when(F.col("derived").isNull(), "surplus").otherwise("different")
    return _found(rows.join(nodes, "source_revision_uuid"), "reference_index_mismatch", "pointer", F.concat_ws(":", F.col("ordinal").cast("string"), kind))


def check_roundtrip(c: Corpus) -> DataFrame:
    nodes = current_nodes(c).select("pointer", "title", "description", "data_one")
    lines = nodes.withColumn("line", node_line(*[F.col(x) for x in ("pointer", "title", "description", "data_one")]))
    read = parse_lines(lines.withColumnRenamed("pointer", "given"), "line")
    same = (F.col("parsed.pointer").eqNullSafe(F.col("given")) & F.col("parsed.title").eqNullSafe(F.col("title"))
            & F.col("parsed.description").eqNullSafe(F.col("description")) & F.col("parsed.data_one").eqNullSafe(F.col("data_one")))
    return _found(read.where(~same), "pgx_roundtrip", "given")


def check_search_count(c: Corpus, docs: DataFrame) -> DataFrame:
    expected = c["node_identity"].where("lifecycle_state = 'promoted'").agg(F.count(F.lit(1)).alias("n")).scalar()
    rows = docs.agg(F.count(F.lit(1)).alias("actual")).withColumn("expected", expected).where(F.col("actual") != F.col("expected"))
    return _found(rows, "fts_count", F.lit("search_index"), F.concat_ws("/", F.col("actual").cast("string"), F.col("expected").cast("string")))


def check_receipts(c: Corpus) -> DataFrame:
    ledger = c["operation_ledger"].select("request_uuid", F.lit(True).alias("_known"), F.col("change_set_uuid").alias("_set"), F.col("database_sequence").alias("_seq"))
    rows = c["change_set_receipts"].join(ledger, "request_uuid", "left")
    wrong = rows.where(F.col("_known").isNull() | ~F.col("_set").eqNullSafe(F.col("change_set_uuid")) | ~F.col("_seq").eqNullSafe(F.col("database_sequence")))
    return _found(wrong, "change_set_receipts", "request_uuid")


# ---- generated from the layout ----------------------------------------------------
def check_foreign_keys(c: Corpus, tables: list[str] | None = None) -> DataFrame:
    parts = []
    for name in tables or list(c.layout):
        for column, (target, key) in c.spec(name).refs.items():
            # References are counted by value before they meet the keys, so that a value that many rows share is dealt once a task. An anti
            # join would be taken before the count by the optimizer.
            rows = c[name].where(F.col(column).isNotNull()).groupBy(ids.packed(column).alias("_k")).agg(F.count(F.lit(1)).alias("n"))
            keys = c[target].select(ids.packed(key).alias("_k"), F.lit(True).alias("_known"))
            orphans = rows.join(keys, "_k", "left").where("_known IS NULL").select(ids.spelled("_k").alias("_v"), "n")
            parts.append(_found(orphans, "foreign_key", F.concat(F.lit(f"{name}.{column}="), F.col("_v")), "n"))
    return _all(parts)


def check_unique(c: Corpus, tables: list[str] | None = None) -> DataFrame:
    parts = []
    for name in tables or list(c.layout):
        for columns in (c.spec(name).key, *c.spec(name).unique):
            present = reduce(lambda a, b: a & b, [F.col(x).isNotNull() for x in columns])
            repeated = c[name].where(present).groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
            key = F.concat(F.lit(f"{name}({','.join(columns)})="), F.concat_ws("|", *[F.col(x).cast("string") for x in columns]))
            parts.append(_found(repeated, "unique", key, "n"))
    return _all(parts)


def check_rules(c: Corpus, tables: list[str] | None = None) -> DataFrame:
    """Rows breaking a column rule or missing a key; each table is read once."""
    parts = []
    for name in tables or list(c.layout):
        spec = c.spec(name)
        broken = [F.when(~F.coalesce(F.expr(rule), F.lit(True)), label) for label, rule in spec.rules.items()]
        broken += [F.when(F.col(k).isNull(), f"{k} is null") for k in spec.key]
        rows = c[name].withColumn("_b", F.explode(F.filter(F.array(*broken), lambda x: x.isNotNull())))
        parts.append(_found(rows, "check_rule", F.concat(F.lit(f"{name}="), F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in spec.key])), "_b"))
    return _all(parts)


# ---- between two states -----------------------------------------------------------
def check_append_only(old: Corpus, new: Corpus) -> DataFrame:
    parts = []
    frozen = {name: spec.names for name, spec in old.layout.items() if spec.append_only}
    frozen["node_identity"] = ["uuid", "pointer", "sigil", "created_at"]
    frozen["change_sets"] = ["change_set_uuid"]
    for name, columns in frozen.items():
        key = list(old.spec(name).key)
        before = old[name].select(*key, row_digest(*columns).alias("_old"))
        after = new[name].select(*key, row_digest(*columns).alias("_new"))
        rows = before.join(after, key, "left").where(~F.col("_old").eqNullSafe(F.col("_new")))
        code = F.when(F.col("_new").isNull(), "row_removed").otherwise("row_changed")
        parts.append(_found(rows, code, F.concat(F.lit(f"{name}="), F.concat_ws("|", *[F.col(k).cast("string") for k in key]))))
    return _all(parts)


# The lifecycle moves that are allowed.
ALLOWED_MOVES = ("staged>promoted", "staged>deprecated", "promoted>deprecated")


def check_transitions(old: Corpus, new: Corpus) -> DataFrame:
    before = old["node_identity"].select("uuid", F.col("lifecycle_state").alias("_from"))
    rows = new["node_identity"].join(before, "uuid").where(F.col("_from") != F.col("lifecycle_state"))
    move = F.concat_ws(">", "_from", "lifecycle_state")
    return _found(rows.where(~move.isin(*ALLOWED_MOVES)), "lifecycle_transition", "pointer", move)


def check_registries(c: Corpus) -> DataFrame:
    """Registries and graphs hold promoted nodes only, the staging queue staged ones only."""
    state = c["node_identity"].select(F.col("uuid").alias("_u"), "pointer", "lifecycle_state")
    parts = []
    for name, column, wanted in (("graph_membership", "node_uuid", "promoted"), ("predicate_registry", "predicate_uuid", "promoted"),
                                 ("tag_registry", "tag_uuid", "promoted"), ("staging_queue", "node_uuid", "staged")):
        rows = c[name].join(state, F.col(column) == F.col("_u")).where(F.col("lifecycle_state") != wanted)
        parts.append(_found(rows, "registry_lifecycle", "pointer", F.concat(F.lit(f"{name}:"), F.col("lifecycle_state"))))
    return _all(parts)


def validate(c: Corpus, search_docs: DataFrame | None = None, full: bool = True) -> DataFrame:
    """All checks on one state."""
    parts = [check_uuid(c), check_timestamps(c), check_current_revision(c), check_content_hash(c), check_cycles(c),
             check_lifecycle_membership(c), check_membership_namespace(c), check_receipts(c), check_foreign_keys(c), check_unique(c),
             check_rules(c), check_registries(c)]
    if full:
        parts += [check_links(c), check_reference_index(c), check_roundtrip(c)]
    if search_docs is not None:
        parts.append(check_search_count(c, search_docs))
    return _all(parts)


def summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("code", "severity").agg(F.count(F.lit(1)).alias("findings"))
