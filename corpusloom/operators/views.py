"""Current, staged and historical views of nodes; bulk lookups; link-destination classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.corpus import Corpus
from corpusloom.functions import ids
from corpusloom.functions.durable import broadcast_if_small
from corpusloom.functions.ordered import grouped_last, grouped_page
from corpusloom.functions.text import ReferenceProfile

# Graphs whose pointers are reserved for the system.
SYSTEM_GRAPH_KEYS = ("pgx-format", "predicates", "principles", "staging", "tags", "sentinels")


def current_nodes(c: Corpus) -> DataFrame:
    """Identities with the text of their current revision."""
    revision = c["node_revision"].select(
        "revision_uuid", "title", "description", F.col("created_at").alias("revision_created_at"), "content_hash")
    identity = c["node_identity"].withColumnRenamed("created_at", "data_one")
    return identity.join(revision, F.col("current_revision_uuid") == F.col("revision_uuid")).select(
        "sigil", "pointer", "title", "description", "data_one", "uuid", "lifecycle_state", "revision_uuid",
        "revision_created_at", "content_hash")


def _texts(c: Corpus, state: str) -> DataFrame:
    return current_nodes(c).where(F.col("lifecycle_state") == state).select(
        "sigil", "pointer", "title", "description", "data_one", "uuid")


def nodes(c: Corpus) -> DataFrame:
    return _texts(c, "promoted")


def staging_nodes(c: Corpus) -> DataFrame:
    return _texts(c, "staged")


def staging_worklist(c: Corpus) -> DataFrame:
    """Staged nodes with where they should go and what holds them up."""
    queue = c["staging_queue"].withColumnRenamed("node_uuid", "uuid")
    return current_nodes(c).where("lifecycle_state = 'staged'").join(queue, "uuid")


def triples_readable(c: Corpus) -> DataFrame:
    """Triples by pointer. The few predicates are named first, so that triples are never dealt by their predicate.

    Triples are dealt by their subject and by their object, each time with packed ids.
    """
    def named(role: str) -> DataFrame:
        return c["node_identity"].select(F.col("uuid").alias(f"{role}_uuid"), F.col("pointer").alias(f"{role}_pointer"))

    rows = c["triples"]
    rows = rows.join(broadcast_if_small(rows.select("predicate_uuid").distinct().join(named("predicate"), "predicate_uuid")), "predicate_uuid")
    rows = rows.withColumns({name: ids.packed(name) for name in ("triple_uuid", "subject_uuid", "object_uuid")})
    for role in ("subject", "object"):
        rows = rows.join(named(role).withColumn(f"{role}_uuid", ids.packed(f"{role}_uuid")), f"{role}_uuid")
    return rows.select(ids.spelled("triple_uuid").alias("triple_uuid"), "subject_pointer", "predicate_pointer", "object_pointer", "created_at")


def get_nodes(c: Corpus, pointers: DataFrame) -> DataFrame:
    """Current text, graph and sorted tags of the given pointers."""
    found = current_nodes(c).join(pointers.select("pointer").distinct(), "pointer")
    graph = c["graph_membership"].join(c["graphs"].select("graph_uuid", "graph_key", "pointer_prefix"), "graph_uuid").select(
        F.col("node_uuid").alias("uuid"), "graph_key", "pointer_prefix", "ordinal")
    tag_names = c["node_identity"].select(F.col("uuid").alias("tag_uuid"), F.col("pointer").alias("tag"))
    tags = (c["node_tags"].join(tag_names, "tag_uuid").groupBy(F.col("subject_uuid").alias("uuid"))
                          .agg(F.array_sort(F.collect_set("tag")).alias("tags")))
    out = found.join(graph, "uuid", "left").join(tags, "uuid", "left")
    return out.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def node_history(c: Corpus, pointers: DataFrame | None = None, limit: int = 100, cursor: int = 0) -> DataFrame:
    """Revisions of each node, newest first, one page per node."""
    identity = c["node_identity"].select(F.col("uuid").alias("node_uuid"), "pointer", "current_revision_uuid")
    if pointers is not None:
        identity = identity.join(pointers.select("pointer").distinct(), "pointer", "left_semi")
    rows = c["node_revision"].join(identity, "node_uuid")
    return grouped_page(rows, ["pointer"], [F.col("created_at").desc(), F.col("revision_uuid")], limit, cursor)


def as_of(c: Corpus, moment: str) -> DataFrame:
    """Each node's text at a past moment; nodes that had no revision yet are absent. Revisions are chosen first, texts joined after."""
    past = c["node_revision"].where(F.col("created_at") <= moment).select("node_uuid", "revision_uuid", "created_at")
    latest = past.groupBy("node_uuid").agg(F.max_by("revision_uuid", F.struct("created_at", "revision_uuid")).alias("revision_uuid"))
    texts = c["node_revision"].select("revision_uuid", "title", "description", "created_at")
    named = latest.join(c["node_identity"].select(F.col("uuid").alias("node_uuid"), "pointer"), "node_uuid")
    return named.join(texts, "revision_uuid").select("pointer", "node_uuid", "revision_uuid", "title", "description", "created_at")


def _chosen(c: Corpus, requests: DataFrame, revisions: DataFrame, bucket: Column) -> DataFrame:
    """Each of ``requests(request_id, pointer, at)`` with the text of the last of ``revisions(node_uuid, revision_uuid, at)`` not after it.

    Requests and revisions stand in one sequence per node, and the last revision is carried along it in pieces.
    """
    names = c["node_identity"].select("pointer", ids.packed("uuid").alias("node_uuid"))
    asked = requests.select("request_id", "pointer", "at").join(names, "pointer", "left")
    known = asked.where("node_uuid IS NOT NULL AND at IS NOT NULL").select("node_uuid", "at", F.lit(1).alias("asks"), "request_id", F.lit(None).cast("binary").alias("revision_uuid"))
    empty = F.lit(None).cast(requests.schema["request_id"].dataType)
    given = revisions.withColumns({name: ids.packed(name) for name in ("node_uuid", "revision_uuid")})
    given = given.join(known.select("node_uuid").distinct(), "node_uuid", "left_semi").select(
        "node_uuid", "at", F.lit(0).alias("asks"), empty.alias("request_id"), "revision_uuid")
    order = [F.col("at"), F.col("asks"), F.coalesce("revision_uuid", F.lit(b""))]
    settled = grouped_last(given.unionByName(known), ["node_uuid"], order, bucket, F.col("revision_uuid"), "found").where("asks = 1")
    settled = settled.select("node_uuid", "at", "request_id", F.col("found").alias("revision_uuid")).distinct()
    texts = c["node_revision"].select(ids.packed("revision_uuid").alias("revision_uuid"), "title", "description", "created_at")
    answers = settled.where("revision_uuid IS NOT NULL").join(texts, "revision_uuid").select(
        F.col("node_uuid").alias("_node"), F.col("at").alias("_at"), F.col("request_id").alias("_id"), "revision_uuid", "title", "description", "created_at")
    same = F.col("node_uuid").eqNullSafe(F.col("_node")) & F.col("at").eqNullSafe(F.col("_at")) & F.col("request_id").eqNullSafe(F.col("_id"))
    found = asked.join(answers, same, "left").withColumn("revision_uuid", ids.spelled("revision_uuid"))
    return found.select("request_id", "pointer", "at", "revision_uuid", "title", "description", "created_at")


def as_of_join(c: Corpus, requests: DataFrame, bucket: Column | None = None) -> DataFrame:
    """What each of ``requests(request_id, pointer, at)`` sees: the node's text at that moment, for any number of moments at once.

    Gives ``request_id, pointer, at, revision_uuid, title, description, created_at``. Of revisions of one moment the greatest id counts. Unknown
    pointers, null moments and moments before a node's first revision see nulls; repeated requests stay. ``bucket``, by default the
    hour, is a prefix of the time: a node's revisions within one meet in a task.
    """
    revisions = c["node_revision"].select("node_uuid", "revision_uuid", F.col("created_at").alias("at"))
    return _chosen(c, requests, revisions, F.substring("at", 1, 13) if bucket is None else bucket)


def as_of_sequence(c: Corpus, requests: DataFrame, per_bucket: int = 10_000) -> DataFrame:
    """What each of ``requests(request_id, pointer, at)`` sees once the request numbered ``at`` has been committed; see :func:`as_of_join`.

    A revision has the number of the committed request that made it, 0 if it was loaded without one.
    """
    numbers = c["operation_ledger"].where("status = 'committed' AND request_uuid IS NOT NULL").groupBy("request_uuid").agg(F.min("database_sequence").alias("_number"))
    # Revisions without a request have no number to look up; they are dealt by their own ids, or all of them would meet in one task.
    asked = F.coalesce(ids.packed("request_uuid"), F.concat(F.lit(b"-"), ids.packed("revision_uuid")))
    rows = c["node_revision"].select("node_uuid", "revision_uuid", F.col("request_uuid").isNull().alias("_loaded"), asked.alias("_request"))
    numbers = numbers.select(ids.packed("request_uuid").alias("_request"), "_number")
    revisions = rows.join(numbers, "_request", "left").where("_loaded OR _number IS NOT NULL").select(
        "node_uuid", "revision_uuid", F.when(F.col("_loaded"), F.lit(0)).otherwise(F.col("_number")).cast("long").alias("at"))
    return _chosen(c, requests.withColumn("at", F.col("at").cast("long")), revisions, F.floor(F.col("at") / per_bucket))


def sentinels(c: Corpus, active_only: bool = True) -> DataFrame:
    guidance = c["sentinel_guidance"].withColumnRenamed("created_at", "guided_at").withColumnRenamed("node_uuid", "uuid")
    if active_only:
        guidance = guidance.where("active")
    return current_nodes(c).join(guidance, "uuid").select(
        "pointer", "title", "description", "revision_uuid", "scope", "active", "guided_at")


def resolve(df: DataFrame, c: Corpus, column: str = "pointer") -> DataFrame:
    """Adds ``target_uuid``: the node a pointer names in any lifecycle state, or null."""
    identity = c["node_identity"].select(F.col("pointer").alias("_p"), F.col("uuid").alias("target_uuid"))
    return df.join(identity, F.col(column) == F.col("_p"), "left").drop("_p")


def reserved_pointers(c: Corpus, graph_keys: tuple[str, ...] = SYSTEM_GRAPH_KEYS) -> DataFrame:
    graphs = c["graphs"].where(F.col("graph_key").isin(*graph_keys)).select("graph_uuid", "graph_key")
    identity = c["node_identity"].select(F.col("uuid").alias("node_uuid"), "pointer")
    return (c["graph_membership"].join(graphs, "graph_uuid").join(identity, "node_uuid")
            .select("graph_key", "ordinal", "pointer"))


def open_change_sets(c: Corpus) -> DataFrame:
    return c["change_sets"].where("status = 'open'").select(
        F.col("change_set_uuid").alias("change_set_id"), "title", "intent", "created_at")


# ---- link destinations ------------------------------------------------------------
def quoted(pointer: Column) -> Column:
    """Percent-encoding of everything but unreserved characters."""
    encoded = F.url_encode(pointer)
    for form, percent in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(form), F.lit(percent))
    return encoded


def unquoted(text: Column) -> Column:
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def destination_pointer(destination: Column, profile: ReferenceProfile) -> Column:
    """Pointer a destination names in canonical form under the profile, else null."""
    grammar = rf"^(?:{profile.pointer_pattern})$"
    if profile.is_bare:
        return F.when(destination.rlike(grammar), destination)
    middle = F.regexp_extract(destination, rf"(?s)^\Q{profile.prefix}\E(.*)\Q{profile.suffix}\E$", 1)
    pointer = unquoted(middle)
    expanded = F.concat(F.lit(profile.prefix), quoted(pointer), F.lit(profile.suffix))
    return F.when(pointer.rlike(grammar) & (expanded == destination), pointer)


def destination_matches(destination: Column, profile: ReferenceProfile) -> Column:
    """Whether the profile claims the destination at all, canonical or not."""
    if profile.is_bare:
        return destination.rlike(rf"^(?:{profile.pointer_pattern})$")
    return destination.startswith(profile.prefix) & destination.endswith(profile.suffix)


def classify_destinations(df: DataFrame, profile: ReferenceProfile, column: str = "destination") -> DataFrame:
    """Adds ``destination_class``, ``pointer`` and ``rejection``.

    Classes: ``bare_pointer``, ``http``, ``arcp``, ``not_claimed``; a claimed destination that is
    not in canonical form or belongs to another corpus carries a rejection and no pointer.
    """
    destination = F.col(column)
    claimed = destination_matches(destination, profile)
    scheme = F.lower(F.regexp_extract(destination, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    named = (F.when(destination.rlike(rf"^(?:{profile.pointer_pattern})$"), "bare_pointer")
              .when(scheme.isin("http", "https"), "http").when(scheme == "arcp", "arcp").otherwise("not_claimed"))
    pointer = destination_pointer(destination, profile)
    same_scheme_elsewhere = (scheme == "arcp") & F.lit(profile.uri_template.startswith("arcp:")) & ~claimed
    rejection = (F.when(claimed & pointer.isNull(), "not_canonical")
                  .when(same_scheme_elsewhere, "different_corpus"))
    return df.withColumn("destination_class", named).withColumn("pointer", F.when(claimed, pointer)).withColumn("rejection", rejection)


def resolve_destinations(df: DataFrame, c: Corpus, column: str = "destination") -> DataFrame:
    return resolve(classify_destinations(df, c.profile, column), c)
