"""Corpus counts, graph and change-set summaries, reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.corpus import Corpus
from corpusloom.operators.changes import Changes

# Measure name -> (table, row filter).
MEASURES = {
    "identities": ("node_identity", None), "promoted_nodes": ("node_identity", "lifecycle_state = 'promoted'"),
    "staged_nodes": ("node_identity", "lifecycle_state = 'staged'"),
    "deprecated_nodes": ("node_identity", "lifecycle_state = 'deprecated'"), "revisions": ("node_revision", None),
    "graphs": ("graphs", None), "reference_occurrences": ("reference_occurrences", None), "triples": ("triples", None),
    "predicates": ("predicate_registry", None), "tags": ("tag_registry", None), "tag_assignments": ("node_tags", None),
    "operations": ("operation_ledger", "status = 'committed'"), "audit_events": ("audit_event", None),
}


def corpus_counts(c: Corpus, measures: dict[str, tuple[str, str | None]] | None = None) -> DataFrame:
    """``(measure, value)`` rows; every table is read once whatever the number of its measures."""
    measures = measures or MEASURES
    out = None
    for name in dict.fromkeys(t for t, _ in measures.values()):
        wanted = {m: f for m, (t, f) in measures.items() if t == name}
        sums = c[name].agg(*[F.count_if(F.expr(f) if f else F.lit(True)).alias(m) for m, f in wanted.items()])
        rows = sums.select(F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in wanted])).alias("m"))
        rows = rows.select("m.measure", "m.value")
        out = rows if out is None else out.unionByName(rows)
    return out


def count_changes(before: Corpus, changes: Changes, extra: dict[str, DataFrame] | None = None,
                  measures: dict[str, tuple[str, str | None]] | None = None) -> DataFrame:
    """``(measure, change)``: what committing a batch, with ``extra`` rows, adds to each measure, signed.

    New rows count up; rows that a batch removes or replaces count down as they stood before. Only tables that the batch
    touches are looked at, and of those only the rows under its keys, so a commit's changes can be kept beside it.
    """
    measures = measures or MEASURES
    extra = extra or {}
    out = before.spark.createDataFrame([], "measure STRING, change BIGINT")
    for name in dict.fromkeys(t for t, _ in measures.values()):
        wanted = {m: f for m, (t, f) in measures.items() if t == name}
        counted = [F.count_if(F.expr(f) if f else F.lit(True)).cast("long").alias(m) for m, f in wanted.items()]
        signed = [(rows, 1) for rows in (changes.appended.get(name), changes.replaced.get(name), extra.get(name)) if rows is not None]
        gone = changes.removed.get(name)
        if gone is not None or changes.replaced.get(name) is not None:
            signed.append((_hidden(before, name, gone, changes.replaced.get(name)), -1))
        for rows, sign in signed:
            sums = rows.agg(*counted)
            listed = F.array(*[F.struct(F.lit(m).alias("measure"), (F.col(m) * sign).alias("change")) for m in wanted])
            out = out.unionByName(sums.select(F.explode(listed).alias("m")).select("m.measure", "m.change"))
    return out.groupBy("measure").agg(F.sum("change").alias("change")).where("change != 0")


def _hidden(before: Corpus, name: str, gone: DataFrame | None, replaced: DataFrame | None) -> DataFrame:
    """The rows of a table that a batch takes away or puts others in place of, once each."""
    rows, key, hidden = before[name], list(before.spec(name).key), None
    for keys in (gone, replaced):
        if keys is not None:
            on = key if set(key) <= set(keys.columns) else list(keys.columns)
            met = rows.join(keys.select(*on).distinct(), on, "left_semi").select(*rows.columns)
            hidden = met if hidden is None else hidden.unionByName(met)
    return hidden.dropDuplicates(key)


def advanced_counts(counts: DataFrame, *deltas: DataFrame) -> DataFrame:
    """``(measure, value)`` after the commits with these ``count_changes``; the tables are not read again."""
    rows = counts.select("measure", F.col("value").alias("change"))
    for delta in deltas:
        rows = rows.unionByName(delta)
    return rows.groupBy("measure").agg(F.sum("change").alias("value"))


def graph_summary(c: Corpus) -> DataFrame:
    """Every graph, also empty ones, with its declaration pointer and node count."""
    counts = c["graph_membership"].groupBy("graph_uuid").agg(F.count("node_uuid").alias("node_count"))
    declared = c["node_identity"].select(F.col("uuid").alias("graph_uuid"), F.col("pointer").alias("declaration_pointer"))
    return (c["graphs"].join(declared, "graph_uuid").join(counts, "graph_uuid", "left")
            .select("graph_key", "pointer_prefix", "declaration_pointer", F.coalesce("node_count", F.lit(0)).alias("node_count")))


def change_sets(c: Corpus, status: str | None = None) -> DataFrame:
    sets = c["change_sets"]
    if status is not None:
        sets = sets.where(F.col("status") == status)
    counts = c["change_set_receipts"].groupBy("change_set_uuid").agg(F.count("request_uuid").alias("operation_count"))
    return (sets.join(counts, "change_set_uuid", "left").withColumn("operation_count", F.coalesce("operation_count", F.lit(0)))
                .withColumnRenamed("change_set_uuid", "change_set_id"))


def receipts(c: Corpus, change_set_ids: DataFrame | None = None) -> DataFrame:
    rows = c["change_set_receipts"]
    if change_set_ids is not None:
        rows = rows.join(change_set_ids.select("change_set_uuid").distinct(), "change_set_uuid", "left_semi")
    return rows.select("change_set_uuid", "ordinal", F.col("request_uuid").alias("request_id"), "tool_name", "database_sequence",
                       "output_snapshot_uuid")


# What must agree between a source and its copy.
RECONCILED = {"nodes": ("node_identity", None), "revisions": ("node_revision", None),
              "references": ("reference_occurrences", None), "triples": ("triples", None)}


def reconcile_counts(source: Corpus, target: Corpus) -> DataFrame:
    left = corpus_counts(source, RECONCILED).withColumnRenamed("value", "source_value")
    right = corpus_counts(target, RECONCILED).withColumnRenamed("value", "target_value")
    return left.join(right, "measure", "full").withColumn("equal", F.col("source_value").eqNullSafe(F.col("target_value")))
