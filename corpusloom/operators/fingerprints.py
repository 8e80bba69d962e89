"""Order-free digests of corpus states and verification of the snapshot chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.corpus import Branch, Corpus
from corpusloom.functions import ids
from corpusloom.operators.views import current_nodes, triples_readable
from corpusloom.schema import STATE_TABLES

_PARTS = (1, 16, 31, 46)


def row_digest(*columns: str) -> Column:
    return F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in columns]), {"ignoreNullFields": "false"}), 256)


def digest_rows(rows: DataFrame, part: str) -> DataFrame:
    """One row ``(part, n, digest)`` for a table of row digests in column ``d``.

    Row digests are added up in four 60-bit parts, so tables of any size combine map-side and in any
    order; the sums and the count are hashed.
    """
    totals = rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum(value).alias(name) for name, value in digest_halves(F.col("d")).items()])
    return totals.select(F.lit(part).alias("part"), "n", digest_of_sums(F.col("n"), {name: F.col(name) for name in HALVES}).alias("digest"))


# Each part of a row digest is summed in two halves of 30 bits, as numbers that 2 ** 33 rows cannot overflow.
_HALF = 30
HALVES = tuple(f"s{at}{half}" for at in _PARTS for half in ("h", "l"))


def digest_halves(d: Column) -> dict[str, Column]:
    """The upper and lower halves of the parts of a row digest, by the names in ``HALVES``."""
    halves = {}
    for at in _PARTS:
        value = F.conv(F.substring(d, at, 15), 16, 10).cast("long")
        halves |= {f"s{at}h": F.shiftright(value, _HALF), f"s{at}l": value.bitwiseAND(F.lit((1 << _HALF) - 1))}
    return halves


def digest_of_sums(n: Column, halves: dict[str, Column]) -> Column:
    """The digest of a table of ``n`` rows by the sums of their halves."""
    whole = lambda at: halves[f"s{at}h"].cast("decimal(38,0)") * F.lit(1 << _HALF) + halves[f"s{at}l"]
    return F.sha2(F.concat_ws(":", n.cast("string"), *[F.coalesce(whole(at).cast("decimal(38,0)").cast("string"), F.lit("0")) for at in _PARTS]), 256)


# ---- digest trees -----------------------------------------------------------------
_BUCKET_DIGITS, _GROUP_DIGITS = 3, 1  # hexadecimal digits of a pointer's hash: 4,096 buckets in 16 groups
_SUMS = [f"s{at}" for at in _PARTS]


def bucket_of(pointer: Column) -> Column:
    return F.substring(F.md5(pointer.cast("binary")), 1, _BUCKET_DIGITS)


def digest_tree(nodes: DataFrame) -> DataFrame:
    """``bucket, n, s1, s16, s31, s46``: count and added-up digests of ``nodes(pointer, content_hash)`` for each bucket that has any.

    Sums combine map-side and can be taken back, so a tree follows a commit by its own rows, see :func:`advanced`.
    """
    rows = nodes.select(bucket_of(F.col("pointer")).alias("bucket"), row_digest("pointer", "content_hash").alias("d"))
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *[
        F.sum(F.conv(F.substring("d", at, 15), 16, 10).cast("decimal(38,0)")).alias(f"s{at}") for at in _PARTS])


def advanced(tree: DataFrame, gone: DataFrame, new: DataFrame) -> DataFrame:
    """The tree after a commit took away ``gone`` and added ``new`` (pointer, content_hash); work grows with the commit."""
    back = digest_tree(gone).select("bucket", (-F.col("n")).alias("n"), *[(-F.col(s)).alias(s) for s in _SUMS])
    return _added(tree.unionByName(back).unionByName(digest_tree(new)), "bucket").where("n != 0")


def _added(rows: DataFrame, by: str | Column) -> DataFrame:
    return rows.groupBy(by).agg(F.sum("n").alias("n"), *[F.sum(s).cast("decimal(38,0)").alias(s) for s in _SUMS])


def differing_buckets(left: DataFrame, right: DataFrame) -> DataFrame:
    """Buckets in which two trees differ; first their groups are compared, then the buckets of the groups that differ."""
    def unlike(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
        whole = lambda df, name: df.select(key, F.struct("n", *_SUMS).alias(name))
        return whole(a, "_a").join(whole(b, "_b"), key, "full").where(~F.col("_a").eqNullSafe(F.col("_b"))).select(key)

    grouped = lambda t: t.withColumn("group", F.substring("bucket", 1, _GROUP_DIGITS))
    groups = unlike(_added(grouped(left), "group"), _added(grouped(right), "group"), "group")
    within = lambda t: grouped(t).join(groups, "group", "left_semi")
    return unlike(within(left), within(right), "bucket")


def root_of_parts() -> Column:
    """Aggregates ``part, digest`` rows to a fingerprint."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("part", "digest"))), lambda p: F.concat(p["part"], F.lit("="), p["digest"]))
    return F.sha2(F.array_join(listed, ";"), 256)


def fingerprint_parts(c: Corpus) -> DataFrame:
    """Digests of nodes, graphs, triples and tags, or of the state tables of a branch."""
    if isinstance(c, Branch):
        tables = {name: c[name].select(row_digest(*c.spec(name).names).alias("d")) for name in STATE_TABLES}
    else:
        names = c["node_identity"].select("uuid", "pointer")
        tags = c["node_tags"].join(names.select(F.col("uuid").alias("subject_uuid"), F.col("pointer").alias("subject")), "subject_uuid").join(
            names.select(F.col("uuid").alias("tag_uuid"), F.col("pointer").alias("tag")), "tag_uuid")
        tables = {
            "nodes": current_nodes(c).select(row_digest("pointer", "title", "description", "lifecycle_state", "revision_uuid", "content_hash").alias("d")),
            "graphs": c["graphs"].select(row_digest("graph_key", "pointer_prefix", "description").alias("d")),
            "triples": triples_readable(c).select(row_digest("subject_pointer", "predicate_pointer", "object_pointer").alias("d")),
            "tags": tags.select(row_digest("subject", "tag").alias("d")),
        }
    out = None
    for part, rows in tables.items():
        digest = digest_rows(rows, part)
        out = digest if out is None else out.unionByName(digest)
    return out


def fingerprint(c: Corpus) -> DataFrame:
    """One row: ``fingerprint`` and the ``snapshot_id`` it names in this corpus."""
    root = fingerprint_parts(c).agg(root_of_parts().alias("fingerprint"))
    return root.withColumn("snapshot_id", ids.derived_uuid_col(c.corpus_id, "semantic-snapshot", F.col("fingerprint")))


def snapshot_uuid(parent: Column, sequence: Column, digest: Column, request: Column, corpus_id: Column) -> Column:
    name = F.concat(F.lit("snapshot:"), F.coalesce(parent, F.lit("None")), F.lit(":"), sequence.cast("string"), F.lit(":"), digest,
                    F.lit(":"), F.coalesce(request, F.lit("None")))
    return ids.uuid5_of(corpus_id, name)


def verify_snapshot_chain(snapshots: DataFrame) -> DataFrame:
    """Findings ``(snapshot_uuid, code)`` on every snapshot after a root.

    The UUID must re-derive from parent, sequence, digest and request; the parent must exist, belong
    to the same corpus and stand one step before.
    """
    parent = snapshots.select(F.col("snapshot_uuid").alias("parent_snapshot_uuid"), F.col("database_sequence").alias("_before"),
                              F.col("corpus_id").alias("_corpus"))
    rows = snapshots.where("parent_snapshot_uuid IS NOT NULL").join(parent, "parent_snapshot_uuid", "left")
    derived = snapshot_uuid(F.col("parent_snapshot_uuid"), F.col("database_sequence"), F.col("transition_digest"), F.col("request_uuid"), F.col("corpus_id"))
    codes = F.filter(F.array(
        F.when(derived != F.col("snapshot_uuid"), "snapshot_uuid_mismatch"),
        F.when(F.col("_before").isNull(), "parent_missing"),
        F.when(F.col("_corpus") != F.col("corpus_id"), "corpus_changed"),
        F.when(F.col("_before") + 1 != F.col("database_sequence"), "sequence_gap")), lambda x: x.isNotNull())
    return rows.select("snapshot_uuid", F.explode(codes).alias("code"))
