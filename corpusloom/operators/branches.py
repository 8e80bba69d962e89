"""Composition of branches, conflicts, comparison, lineage and hand-off classes."""

from __future__ import annotations

import uuid
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.corpus import Branch, Corpus, Head, shaped
from corpusloom.functions import ids
from corpusloom.functions.durable import LazyTables, checkpointed
from corpusloom.functions.rows import computed_once
from corpusloom.operators.fingerprints import HALVES, bucket_of, differing_buckets, digest_halves, digest_of_sums, fingerprint, root_of_parts, row_digest
from corpusloom.operators.views import current_nodes
from corpusloom.schema import BRANCH_TABLES, COMPOSED_TABLES, STATE_TABLES


def _united(branches: list[Branch], name: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [b[name].select(*b.spec(name).names) for b in branches])


def _folded(branches: list[Branch], name: str) -> DataFrame:
    """Rows by key with the least and greatest row digest. Shared rows fold map-side before the shuffle."""
    spec = BRANCH_TABLES[name]
    rest = [n for n in spec.names if n not in spec.key]
    rows = _united(branches, name).withColumn("_d", row_digest(*spec.names))
    # One digest goes with all columns of a row, not one with each.
    kept = F.min(F.struct(F.unhex("_d").alias("_order"), *rest)).alias("_kept")
    folded = rows.groupBy(*spec.key).agg(F.min("_d").alias("_low"), F.max("_d").alias("_high"), kept)
    return folded.select(*spec.key, "_low", "_high", *[F.col(f"_kept.{n}").alias(n) for n in rest])


def _collided(branches: list[Branch], name: str) -> DataFrame:
    """``(table_name, key)`` of one table; of a row only its packed key and its digest are dealt."""
    spec = BRANCH_TABLES[name]
    rows = _united(branches, name).select(*[ids.packed(k).alias(k) for k in spec.key], F.unhex(row_digest(*spec.names)).alias("_d"))
    collided = rows.repartition(*spec.key).groupBy(*spec.key).agg(F.min("_d").alias("_low"), F.max("_d").alias("_high")).where("_low != _high")
    return collided.select(F.lit(name).alias("table_name"), F.concat_ws("|", *[ids.spelled(k) for k in spec.key]).alias("key"))


def collisions(branches: list[Branch]) -> DataFrame:
    """Keys of immutable rows that branches hold with different content: (table_name, key)."""
    return reduce(DataFrame.unionByName, [_collided(branches, name) for name in COMPOSED_TABLES])


def collisions_by_table(branches: list[Branch]) -> DataFrame:
    """How many keys of each table collide. Tables are taken one after another, so that what one deals is gone before the next."""
    return reduce(DataFrame.unionByName, [checkpointed(_collided(branches, name).groupBy("table_name").agg(F.count(F.lit(1)).alias("collisions")))
                                          for name in COMPOSED_TABLES])


def compose(branches: list[Branch], operation_uuid: str, at: str) -> tuple[Branch, DataFrame]:
    """``(composition, collisions)``.

    Immutable rows are united by key. A key that occurs with different content is a collision, and
    a composition with collisions must not be used.
    """
    if not branches:
        raise ValueError("composition needs at least one branch")
    tables = LazyTables({name: (lambda name=name: shaped(_folded(branches, name), BRANCH_TABLES[name])) for name in COMPOSED_TABLES})
    return replace(_with_composition_rows(branches, tables, operation_uuid, at), sources=tuple(branches)), collisions(branches)


def _with_composition_rows(branches: list[Branch], tables: LazyTables, operation_uuid: str, at: str) -> Branch:
    """Adds the composite corpus, its multi-parent snapshot, and the composition's own record."""
    spark = branches[0].spark
    flat = _united(branches, "corpus_components").select("component_corpus_uuid").distinct()
    components = sorted(r[0] for r in flat.collect())  # one row per source corpus
    corpus_id = components[0] if len(components) == 1 else _uuid5(ids.COMPOSITE_NAMESPACE, "composite:" + ":".join(components))
    parents = sorted({b.head.snapshot_uuid for b in branches})
    sources = sorted({(b.workspace_uuid, b.head.corpus_id, b.head.snapshot_uuid) for b in branches})
    plan = ids.canonical_json(
        components=F.lit(",".join(components)), parents=F.lit(",".join(parents)), sources=F.lit(";".join("/".join(s) for s in sources)))
    snapshot, composition = _uuid5(operation_uuid, "snapshot"), _uuid5(operation_uuid, "composition")
    replica = _uuid5(operation_uuid, "replica")
    head = Head(corpus_id, snapshot, 1 + max(b.head.sequence for b in branches))
    base = Branch(spark, tables, branches[0].namespace, corpus_id, head=head, workspace_uuid=_uuid5(operation_uuid, "workspace"), replica_uuid=replica)

    def rows(name: str, **values: object) -> DataFrame:
        columns = [(v if not isinstance(v, (str, int)) else F.lit(v)).alias(k) for k, v in values.items()]
        return shaped(spark.range(1).select(*columns), BRANCH_TABLES[name])

    def local(name: str, listed: list[tuple], columns: str) -> DataFrame:
        return shaped(spark.createDataFrame(listed, columns), BRANCH_TABLES[name])

    own = {
        "replicas": lambda: rows("replicas", replica_uuid=replica, label="composition", created_at=at),
        "semantic_operations": lambda: rows("semantic_operations", operation_uuid=operation_uuid, origin_replica_uuid=replica,
                                            operation_kind="workspace.compose", payload_hash=F.sha2(plan, 256), payload_json=plan, created_at=at),
        "semantic_snapshots": lambda: rows("semantic_snapshots", snapshot_uuid=snapshot, corpus_uuid=corpus_id, operation_uuid=operation_uuid,
                                           state_fingerprint=fingerprint(base).select("fingerprint").scalar(), created_at=at),
        "snapshot_parents": lambda: local("snapshot_parents", [(snapshot, p, i) for i, p in enumerate(parents)],
                                          "snapshot_uuid STRING, parent_snapshot_uuid STRING, ordinal INT"),
    }

    def full(name: str) -> DataFrame:
        return tables[name].unionByName(own[name]()) if name in own else tables[name]

    builders = {name: (lambda name=name: full(name)) for name in tables}
    builders["corpus_components"] = lambda: local("corpus_components", [(corpus_id, x) for x in components], "composite_corpus_uuid STRING, component_corpus_uuid STRING")
    builders["composition_records"] = lambda: rows("composition_records", composition_uuid=composition, operation_uuid=operation_uuid, output_snapshot_uuid=snapshot,
                                                   source_count=len(branches), plan_digest=F.sha2(plan, 256), created_at=at)
    builders["composition_inputs"] = lambda: local("composition_inputs", [(composition, *s) for s in sources],
        "composition_uuid STRING, source_workspace_uuid STRING, source_corpus_uuid STRING, source_snapshot_uuid STRING")
    return Branch(spark, LazyTables(builders), base.namespace, corpus_id, head=head, workspace_uuid=base.workspace_uuid, replica_uuid=replica)


def _uuid5(namespace: str, name: str) -> str:
    return str(uuid.uuid5(uuid.UUID(namespace), name))


# ---- conflicts and listings -------------------------------------------------------
def alias_conflicts(b: Branch) -> DataFrame:
    """Aliases of more than one object. Distinct pairs fold map-side; only conflicting aliases keep their lists."""
    pairs = b["object_alias_assertions"].select("alias_text", "object_uuid").distinct()
    counts = pairs.groupBy("alias_text").agg(F.count(F.lit(1)).alias("object_count")).where("object_count > 1")
    return pairs.join(counts, "alias_text").select(F.col("alias_text").alias("alias"), "object_count", "object_uuid")


def frontier(b: Branch) -> DataFrame:
    """Revisions no other revision descends from."""
    parents = b["revision_parents"].select(F.col("parent_revision_uuid").alias("revision_uuid")).distinct()
    return b["node_revisions"].join(parents, "revision_uuid", "left_anti")


def frontier_conflicts(b: Branch) -> DataFrame:
    """Objects with several frontier revisions, one row per revision."""
    rows = frontier(b).select("node_uuid", "revision_uuid")
    counts = rows.groupBy("node_uuid").agg(F.count(F.lit(1)).alias("frontier_count")).where("frontier_count > 1")
    return rows.join(counts, "node_uuid").select(F.col("node_uuid").alias("object_uuid"), "frontier_count", "revision_uuid")


def objects(b: Branch, limit: int | None = None) -> DataFrame:
    """Objects with their scoped aliases and frontier; all, or the ``limit`` oldest."""
    listed = b["semantic_objects"].select("object_uuid", "object_kind", "created_at")
    if limit is not None:
        listed = listed.orderBy("created_at", "object_uuid").limit(limit)
    alias = F.struct("scope_replica_uuid", F.col("alias_text").alias("alias"))
    aliases = b["object_alias_assertions"].groupBy("object_uuid").agg(F.array_sort(F.collect_set(alias)).alias("aliases"))
    tip = F.struct("revision_uuid", "title", "description", "created_at")
    tips = frontier(b).groupBy(F.col("node_uuid").alias("object_uuid")).agg(F.array_sort(F.collect_list(tip)).alias("revision_frontier"))
    return listed.join(aliases, "object_uuid", "left").join(tips, "object_uuid", "left")


def resolve_alias(b: Branch, df: DataFrame) -> DataFrame:
    """Objects of ``df(alias, scope_replica_uuid)``; without a scope only a unique alias resolves.

    ``status``: ``resolved``, ``ambiguous`` or ``unknown``.
    """
    given = b["object_alias_assertions"].select(F.col("alias_text").alias("alias"), F.col("scope_replica_uuid").alias("_scope"), "object_uuid")
    ends = [F.min("object_uuid").alias("_low"), F.max("object_uuid").alias("_high")]
    anywhere = given.groupBy("alias").agg(*ends)
    scoped = given.groupBy("alias", F.col("_scope").alias("scope_replica_uuid")).agg(*ends)
    free = df.where("scope_replica_uuid IS NULL").join(anywhere, "alias", "left")
    bound = df.where("scope_replica_uuid IS NOT NULL").join(scoped, ["alias", "scope_replica_uuid"], "left")
    rows = free.unionByName(bound)
    status = F.when(F.col("_low").isNull(), "unknown").when(F.col("_low") != F.col("_high"), "ambiguous").otherwise("resolved")
    return rows.withColumn("status", status).withColumn("object_uuid", F.when(F.col("status") == "resolved", F.col("_low"))).drop("_low", "_high")


def verify_state(b: Branch) -> DataFrame:
    """Whether the stored fingerprint of the head snapshot is that of the tables."""
    stored = b["semantic_snapshots"].where(F.col("snapshot_uuid") == b.head.snapshot_uuid).select("snapshot_uuid", "state_fingerprint")
    actual = fingerprint(b).select("fingerprint").scalar()
    return stored.withColumn("actual", actual).withColumn("matches", F.col("state_fingerprint") == F.col("actual"))


def _uncomposed(b: Branch) -> list[Branch]:
    return [x for s in b.sources for x in _uncomposed(s)] if b.sources else [b]


def _digests_of(states: dict[str, Branch], name: str) -> DataFrame:
    """``(state, part, digest)``: the digest of one table in each state."""
    spec, branches = BRANCH_TABLES[name], list({id(x): x for s in states.values() for x in _uncomposed(s)}.values())
    number = {id(x): i for i, x in enumerate(branches)}
    keys = [f"_k{i}" for i in range(len(spec.key))]
    rows = reduce(DataFrame.unionByName, [x[name].select(
        *[ids.packed(k).alias(out) for k, out in zip(spec.key, keys, strict=True)], F.unhex(row_digest(*spec.names)).alias("_d"), F.lit(i).alias("_at"))
        for i, x in enumerate(branches)])
    # Dealt by key before anything is grouped: a task has few rows of one key, and of a row only its key and digest travel.
    counted = rows.repartition(*keys).groupBy(*keys, "_d").agg(*[F.count_if(F.col("_at") == i).alias(f"_n{i}") for i in range(len(branches))])

    def kept(b: Branch) -> Column:
        """The digest of the row that a key has in a branch: a composition keeps the least of its sources'."""
        each = [kept(x) for x in b.sources]
        return F.least(*each) if len(each) > 1 else each[0] if each else F.col(f"_d{number[id(b)]}")

    def apart(df: DataFrame) -> DataFrame:
        return computed_once(df, "_h", F.struct(*[value.alias(half) for half, value in digest_halves(F.lower(F.hex("_d"))).items()]))

    # A branch that is a state itself counts all its rows, repeated ones too; a composition those that it keeps, taken apart once for a key.
    alone = sorted({number[id(b)] for b in states.values() if not b.sources})
    held = apart(counted).groupBy(*keys).agg(
        *[F.min(F.when(F.col(f"_n{i}") > 0, F.col("_d"))).alias(f"_d{i}") for i in range(len(branches))],
        *[F.sum(f"_n{i}").alias(f"_n{i}") for i in alone], *[F.sum(F.col(f"_h.{half}") * F.col(f"_n{i}")).alias(f"_{half}{i}") for i in alone for half in HALVES])
    held = apart(held.select("*", F.posexplode(F.array_distinct(F.array_compact(F.array(*[f"_d{i}" for i in range(len(branches))])))).alias("_nth", "_d")))
    sums, digests = [], []
    for j, (state, b) in enumerate(states.items()):
        if b.sources:
            counts = {"n": F.when(F.col("_d") == kept(b), 1)} | {half: F.when(F.col("_d") == kept(b), F.col(f"_h.{half}")) for half in HALVES}
        else:
            counts = {x: F.when(F.col("_nth") == 0, F.col(f"_{x}{number[id(b)]}")) for x in ("n", *HALVES)}
        sums += [F.sum(value).alias(f"{x}{j}") for x, value in counts.items()]
        digest = digest_of_sums(F.coalesce(f"n{j}", F.lit(0)), {half: F.col(f"{half}{j}") for half in HALVES})
        digests.append(F.struct(F.lit(state).alias("state"), F.lit(name).alias("part"), digest.alias("digest")))
    return held.agg(*sums).select(F.explode(F.array(*digests)).alias("d")).select("d.*")


def fingerprints(states: dict[str, Branch]) -> DataFrame:
    """``(state, fingerprint)``: what :func:`fingerprint` gives of each, at once for several branches and compositions of them.

    A branch that several compositions unite is read once. Tables are taken one after another, so that what one deals is gone before the next.
    """
    parts = reduce(DataFrame.unionByName, [checkpointed(_digests_of(states, name)) for name in STATE_TABLES])
    return parts.groupBy("state").agg(root_of_parts().alias("fingerprint"))


def merge_laws(branches: list[Branch]) -> DataFrame:
    """``(law, holds)``: composition must be idempotent, commutative and associative by fingerprint."""
    operation, at = "00000000-0000-0000-0000-000000000000", ""
    united = lambda bs: compose(bs, operation, at)[0]
    a, b, c = branches[0], branches[1], branches[-1]
    states = {"a": a, "aa": united([a, a]), "ab": united([a, b]), "ba": united([b, a]), "abc": united([a, b, c]),
              "(ab)c": united([united([a, b]), c]), "a(bc)": united([a, united([b, c])])}
    digests = checkpointed(fingerprints(states))
    laws = a.spark.createDataFrame([("idempotent", "aa", "a"), ("commutative", "ab", "ba"), ("associative_left", "(ab)c", "abc"),
                                    ("associative_right", "a(bc)", "abc")], "law STRING, left STRING, right STRING")
    side = lambda name: digests.select(F.col("state").alias(name), F.col("fingerprint").alias(f"{name}_digest"))
    joined = laws.join(side("left"), "left").join(side("right"), "right")
    return joined.select("law", (F.col("left_digest") == F.col("right_digest")).alias("holds"))


# ---- corpora side by side ---------------------------------------------------------
def compare(a: Corpus, b: Corpus) -> DataFrame:
    """Pointers whose current content differs or exists on one side only."""
    return _differences(current_nodes(a), current_nodes(b))


def _differences(a: DataFrame, b: DataFrame) -> DataFrame:
    left = a.select("pointer", F.col("content_hash").alias("left_hash"))
    right = b.select("pointer", F.col("content_hash").alias("right_hash"))
    both = left.join(right, "pointer", "full").where(~F.col("left_hash").eqNullSafe(F.col("right_hash")))
    kind = F.when(F.col("left_hash").isNull(), "right_only").when(F.col("right_hash").isNull(), "left_only").otherwise("changed")
    return both.select("pointer", kind.alias("difference"))


def compare_by_digest(a: Corpus, b: Corpus, a_tree: DataFrame, b_tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What :func:`compare` gives, joining only the nodes of buckets in which the corpora's digest trees differ; and those buckets.

    Trees are tables of at most 4,096 rows that a commit carries on, see ``fingerprints.advanced``; equal corpora join nothing.
    """
    buckets = checkpointed(differing_buckets(a_tree, b_tree))
    chosen = F.broadcast(buckets)  # 4,096 rows at most
    within = lambda c: current_nodes(c).withColumn("bucket", bucket_of(F.col("pointer"))).join(chosen, "bucket", "left_semi")
    return _differences(within(a), within(b)), buckets


def compare_report(a: Corpus, b: Corpus, cap: int = 200) -> DataFrame:
    """The first ``cap`` reconciliation candidates with the full count."""
    rows = compare(a, b)
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    return rows.orderBy("pointer").limit(cap).withColumn("candidate_count", total)


def lineage(c: Corpus, limit: int | None = None) -> DataFrame:
    """Workstreams and materializations (kind, id, snapshot_id, created_at), or the ``limit`` newest of each kind."""
    streams = c["corpus_workstreams"].select(F.lit("workstream").alias("kind"), F.col("workstream_id").alias("id"),
                                             F.col("base_snapshot_id").alias("snapshot_id"), "created_at", "mutation_count")
    made = c["materializations"].select(F.lit("materialization").alias("kind"), F.col("materialization_id").alias("id"), "snapshot_id",
                                        "created_at", F.lit(None).cast("bigint").alias("mutation_count"))
    newest = lambda df: df if limit is None else df.orderBy(F.desc("created_at"), "id").limit(limit)
    return newest(streams).unionByName(newest(made))


def common_base(a: Corpus, b: Corpus) -> DataFrame:
    """The greatest base snapshot shared by workstreams of both corpora; null if none."""
    bases = lambda c: c["corpus_workstreams"].select("base_snapshot_id")
    return bases(a).join(bases(b), "base_snapshot_id", "left_semi").agg(F.max("base_snapshot_id").alias("common_base_snapshot_id"))


# ---- hand-offs --------------------------------------------------------------------
def classify_handoffs(receipts: DataFrame, candidates: DataFrame, snapshots: DataFrame, release_id: str) -> DataFrame:
    """Classifies candidates against their receipts.

    ``receipts(handoff_id, release_id, corpus_id, snapshot_uuid, database_sequence, sha256)``,
    ``candidates(handoff_id, present, readable, corpus_id, snapshot_uuid, database_sequence, sha256)``,
    ``snapshots(handoff_id, snapshot_uuid)`` listing what each candidate's history holds.
    """
    held = snapshots.select("handoff_id", F.col("snapshot_uuid").alias("r_snapshot"), F.lit(True).alias("held")).distinct()
    r = receipts.select("handoff_id", *[F.col(x).alias(f"r_{y}") for x, y in (
        ("release_id", "release"), ("corpus_id", "corpus"), ("snapshot_uuid", "snapshot"), ("database_sequence", "sequence"), ("sha256", "sha"))])
    rows = r.join(candidates, "handoff_id", "left").join(held, ["handoff_id", "r_snapshot"], "left")
    same_head = ((F.col("corpus_id") == F.col("r_corpus")) & (F.col("snapshot_uuid") == F.col("r_snapshot"))
                 & (F.col("database_sequence") == F.col("r_sequence")))
    classified = (F.when(~F.coalesce("present", F.lit(False)), "nonmatching").when(~F.coalesce("readable", F.lit(False)), "unverified")
                   .when(~F.col("r_release").eqNullSafe(F.lit(release_id)), "machinery_mismatch")
                   .when(F.col("snapshot_uuid").isNull(), "migration_required")
                   .when(~F.col("corpus_id").eqNullSafe(F.col("r_corpus")), "different_corpus")
                   .when(same_head & F.col("sha256").eqNullSafe(F.col("r_sha")), "exact").when(same_head, "unverified")
                   .when(F.coalesce("held", F.lit(False)) & (F.col("database_sequence") > F.coalesce("r_sequence", F.lit(-1))), "unexpected_descendant")
                   .otherwise("divergent"))
    return rows.select("handoff_id", classified.alias("classification"), (classified == "exact").alias("authorized"))
