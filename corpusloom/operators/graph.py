"""Namespaces, triples, bounded context walks, revision chains and snapshot ancestry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.corpus import Corpus
from corpusloom.functions import ids
from corpusloom.functions.durable import broadcast_if_small, checkpointed
from corpusloom.functions.ids import canonical_json
from corpusloom.functions.ordered import grouped_page, grouped_rank
from corpusloom.operators.reachability import ancestor_ranges, build_index, descendants, listed, range_sums


# ---- namespaces -------------------------------------------------------------------
def assign_graph(df: DataFrame, graphs: DataFrame, column: str = "pointer") -> DataFrame:
    """Adds the graph with the longest matching prefix (nulls when none matches).

    A pointer is expanded to its own prefixes at the lengths that exist among graphs, which turns
    the prefix match into an equality; partial aggregation folds the expansion before the shuffle.
    """
    lengths = F.array_sort(F.collect_set(F.length("pointer_prefix")))
    known = graphs.select(lengths.alias("l")).scalar()
    pointers = df.select(F.col(column).alias("_p")).distinct().withColumn("_known", known)
    prefixes = pointers.select("_p", F.explode(F.filter("_known", lambda n: n <= F.length("_p"))).alias("_n"))
    prefixes = prefixes.withColumn("_prefix", F.expr("substring(_p, 1, _n)"))
    owners = graphs.select(F.col("pointer_prefix").alias("_prefix"), F.struct(
        F.col("graph_uuid").alias("resolved_graph_uuid"), F.col("graph_key").alias("resolved_graph_key"),
        F.col("pointer_prefix").alias("resolved_prefix")).alias("_owner"))
    best = prefixes.join(owners, "_prefix").groupBy("_p").agg(F.max_by("_owner", "_n").alias("_owner"))
    return df.join(best, F.col(column) == F.col("_p"), "left").select(*df.columns, "_owner.*")


def check_namespace(df: DataFrame, graphs: DataFrame) -> DataFrame:
    """Adds ``namespace_error`` to ``df(pointer, graph_key)``.

    ``outside_namespace`` when no graph owns the pointer, ``more_specific_namespace`` when another
    graph does, ``unknown_graph`` when the requested graph does not exist.
    """
    known = graphs.select(F.col("graph_key").alias("_k"), F.lit(True).alias("_known"))
    rows = assign_graph(df, graphs).join(known, F.col("graph_key") == F.col("_k"), "left")
    error = (F.when(F.col("_known").isNull(), "unknown_graph")
              .when(F.col("resolved_graph_key").isNull(), "outside_namespace")
              .when(F.col("resolved_graph_key") != F.col("graph_key"), "more_specific_namespace"))
    return rows.withColumn("namespace_error", error).drop("_k", "_known")


def assign_ordinals(new: DataFrame, membership: DataFrame, order: Column, bucket: Column) -> DataFrame:
    """Ordinals following each graph's last one, for ``new(graph_uuid, ...)`` along ``order``."""
    last = membership.join(new.select("graph_uuid").distinct(), "graph_uuid", "left_semi").groupBy("graph_uuid").agg(
        F.max("ordinal").alias("_last"))
    ranked = grouped_rank(new, ["graph_uuid"], [order], bucket, "_nth")
    return ranked.join(last, "graph_uuid", "left").withColumn(
        "ordinal", F.coalesce(F.col("_last"), F.lit(-1)) + F.col("_nth")).drop("_last", "_nth")


# ---- triples ----------------------------------------------------------------------
def list_triples(c: Corpus, pointers: DataFrame | None = None, direction: str = "outgoing", limit: int = 50,
                 cursor: int = 0) -> DataFrame:
    """Triples of each node in time order, one page per node.

    The few predicates are named by a small table, so that triples are never dealt by their predicate; all other ids are dealt packed.
    """
    here, there = ("subject", "object") if direction == "outgoing" else ("object", "subject")
    packed_ids = ["triple_uuid", "subject_uuid", "object_uuid"]
    names = c["node_identity"].select("uuid", F.col("pointer").alias("name"))
    anchors = names if pointers is None else names.join(pointers.select(F.col("pointer").alias("name")).distinct(), "name", "left_semi")
    predicates = c["triples"].select("predicate_uuid").distinct().join(
        names.select(F.col("uuid").alias("predicate_uuid"), F.col("name").alias("predicate_pointer")), "predicate_uuid")
    rows = c["triples"].withColumns({name: ids.packed(name) for name in packed_ids})
    rows = rows.join(anchors.select(ids.packed("uuid").alias(f"{here}_uuid"), F.col("name").alias("pointer")), f"{here}_uuid")
    page = grouped_page(rows, ["pointer"], [F.col("created_at"), F.col("triple_uuid")], limit, cursor)
    page = page.join(broadcast_if_small(predicates), "predicate_uuid")
    page = page.join(names.select(ids.packed("uuid").alias(f"{there}_uuid"), F.col("name").alias(f"{there}_pointer")), f"{there}_uuid")
    return page.withColumns({name: ids.spelled(name) for name in packed_ids}).withColumn(f"{here}_pointer", F.col("pointer"))


# ---- bounded context --------------------------------------------------------------
# So many nodes reached at a level, at 16 bytes each, are broadcast to find their edges; more are shuffled.
SOURCES = 100_000


def _edge_rows(c: Corpus, include_triples: bool) -> DataFrame:
    """``source, target, place``: every link and triple with packed ids and its place in the source's edge order."""
    def edges(df: DataFrame, source: str, target: str, kind: int, ordinal: Column, moment: Column) -> DataFrame:
        place = F.struct(F.lit(kind).alias("kind"), ordinal.cast("long").alias("ordinal"), moment.alias("moment"))
        return df.where(F.col(target).isNotNull()).select(ids.packed(source).alias("source"), ids.packed(target).alias("target"), place.alias("place"))

    rows = edges(c["reference_occurrences"], "source_node_uuid", "target_uuid", 0, F.col("ordinal"), F.lit(""))
    if include_triples:
        rows = rows.unionByName(edges(c["triples"], "subject_uuid", "object_uuid", 1, F.lit(0), F.col("created_at")))
    return rows


def _placed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source", "target").agg(F.min("place").alias("first"), F.max("place").alias("last"))


def context_edges(c: Corpus, include_triples: bool = True) -> DataFrame:
    """Distinct (source, target) edges with their first and last place in the source's edge order.

    References come first by ordinal, triples after them by time.
    """
    return _placed(_edge_rows(c, include_triples)).withColumns({name: ids.spelled(name) for name in ("source", "target")})


def _record_lengths(c: Corpus) -> DataFrame:
    """``uuid`` (packed), ``pointer`` and ``cost``, the length of the canonical JSON of pointer, title, description and revision.

    Each side's fields are measured where they are, so that no text is shuffled; two objects become one by a comma instead of two braces.
    """
    text = canonical_json(title=F.col("title"), description=F.col("description"), revision_uuid=F.col("revision_uuid"))
    lengths = c["node_revision"].select(ids.packed("revision_uuid").alias("_revision"), F.length(text).cast("long").alias("_text"))
    identity = c["node_identity"].select(ids.packed("uuid").alias("uuid"), "pointer", ids.packed("current_revision_uuid").alias("_revision"))
    cost = F.length(canonical_json(pointer=F.col("pointer"))) + F.col("_text") - 1
    return identity.join(lengths, "_revision").select("uuid", "pointer", cost.alias("cost"))


def context_packs(c: Corpus, roots: DataFrame, max_nodes: int = 20, max_chars: int = 12_000,
                  include_triples: bool = True) -> tuple[DataFrame, DataFrame]:
    """Breadth-first context of every root at once: ``(members, packs)``.

    ``members(root, position, uuid, pointer, cost)`` lists admitted nodes in walk order;
    ``packs(root, node_count, character_count, truncated)`` sums them up. The first node is always
    admitted; the first node that would exceed ``max_chars`` ends its root's walk.

    One round advances all roots by one level. Of a hub's targets only the first
    ``2 * max_nodes + 1`` matter: at most ``max_nodes`` can already be in the pack and the walk
    ends within the next ``max_nodes``, so the walk and its ``truncated`` flag stay exact. Each
    level reads the edges of the nodes that it reached for the first time, and no others.
    """
    if max_nodes < 1 or max_chars < 1:
        raise ValueError("a pack holds at least one node and one character")
    reach = 2 * max_nodes + 1
    rows = checkpointed(_edge_rows(c, include_triples))  # each level reads them
    costs = checkpointed(_record_lengths(c))

    def nearest(sources: DataFrame) -> DataFrame:
        # Dealt by both ends, so that a hub's edges do not meet in one task before they are pruned.
        placed = _placed(rows.join(sources, "source", "left_semi").repartition("source", "target"))
        nth = F.row_number().over(W.partitionBy("source").orderBy("first", "target"))
        return checkpointed(placed.withColumn("nth", nth).where(F.col("nth") <= reach).drop("nth"))

    start = roots.select("pointer").distinct().join(costs, "pointer").select(
        F.col("pointer").alias("root"), "uuid", "pointer", "cost", F.lit(1).alias("position"), F.col("cost").alias("chars"))
    members = checkpointed(start)
    closed: list[DataFrame] = []
    frontier = members
    known = broadcast_if_small(members.select(F.col("uuid").alias("source")).distinct(), SOURCES)
    edges = nearest(known)
    while True:
        # Queue entries of this level: targets not yet in the pack when their source was expanded.
        parents = frontier.select("root", F.col("uuid").alias("source"), F.col("position").alias("parent"))
        seen = members.select("root", F.col("uuid").alias("target"), F.col("position").alias("seen_at"))
        queue = parents.join(edges, "source").join(seen, ["root", "target"], "left")
        queue = queue.where(F.col("seen_at").isNull() | (F.col("seen_at") > F.col("parent")))
        queue = queue.withColumn("enqueued", F.struct("parent", F.col("first").alias("place")))
        queue = queue.withColumn("requeued", F.struct("parent", F.col("last").alias("place")))
        fresh = queue.where("seen_at IS NULL").groupBy("root", "target").agg(F.min("enqueued").alias("at"))
        tail = queue.groupBy("root").agg(F.max("requeued").alias("last_entry"))
        size = members.groupBy("root").agg(F.count(F.lit(1)).alias("taken"), F.max("chars").alias("spent"))
        # At most max_nodes * reach candidates per root; the group limit keeps max_nodes + 1 of them.
        nth = F.row_number().over(W.partitionBy("root").orderBy("at", "target"))
        ahead = fresh.withColumn("nth", nth).where(F.col("nth") <= max_nodes + 1)
        priced = ahead.join(costs.withColumnRenamed("uuid", "target"), "target").join(size, "root")
        running = W.partitionBy("root").orderBy("at", "target").rowsBetween(W.unboundedPreceding, 0)
        priced = priced.withColumn("chars", F.col("spent") + F.sum("cost").over(running))
        fits = F.col("chars") <= max_chars
        priced = priced.withColumn("position", F.col("taken") + F.col("nth"))
        # The walk pops up to the first node that does not fit, or stops once the pack is full.
        priced = priced.withColumn("ok", fits & (F.col("position") <= max_nodes))
        level = checkpointed(priced.withColumn("ok", F.min(F.col("ok").cast("int")).over(running) == 1))
        admitted = level.where("ok").select(
            "root", F.col("target").alias("uuid"), "pointer", "cost", F.col("position").cast("int").alias("position"), "chars")
        cut = level.groupBy("root").agg(
            F.min("ok").alias("all_ok"), F.max(F.when(F.col("ok"), F.col("position"))).alias("top"),
            F.min(F.when(~F.col("ok"), F.struct("at", "position"))).alias("first_out"),
            F.max(F.when(F.col("ok"), F.col("at"))).alias("last_in"))
        # Entry up to which this level was popped, for roots whose walk ended here.
        by_size = F.coalesce(F.col("top"), F.lit(0)) >= max_nodes
        stop = F.when(by_size, F.col("last_in")).otherwise(F.col("first_out.at"))
        ended = cut.where((~F.col("all_ok")) | by_size).select("root", stop.alias("stop"))
        rest = ended.join(tail, "root").select("root", (F.col("last_entry") > F.col("stop")).alias("more"))
        reached = admitted.select(F.col("uuid").alias("source")).distinct().join(known, "source", "left_anti")
        reached = broadcast_if_small(reached, SOURCES)
        if not reached.isEmpty():
            known, edges = known.unionByName(reached), edges.unionByName(nearest(reached))
        # Entries that admitted nodes of this level would enqueue count as left over too.
        expanded = admitted.join(ended.select("root"), "root", "left_semi").select(
            "root", F.col("uuid").alias("source"), F.col("position").alias("parent"))
        grown = seen.unionByName(admitted.select("root", F.col("uuid").alias("target"), F.col("position").alias("seen_at")))
        onward = expanded.join(edges, "source").join(grown, ["root", "target"], "left").where(
            F.col("seen_at").isNull() | (F.col("seen_at") > F.col("parent"))).select("root", F.lit(True).alias("more"))
        closed.append(rest.unionByName(onward).groupBy("root").agg(F.max("more").alias("truncated")))
        members = checkpointed(members.unionByName(admitted))
        frontier = checkpointed(admitted.join(ended.select("root"), "root", "left_anti"))
        if frontier.isEmpty():
            break
    cut_roots = closed[0]
    for part in closed[1:]:
        cut_roots = cut_roots.unionByName(part)
    if max_nodes == 1:
        # A pack of one stops before its root's level is popped: anything enqueued is left over.
        cut_roots = start.select("root", F.col("uuid").alias("source")).join(edges, "source").where(
            F.col("source") != F.col("target")).select("root", F.lit(True).alias("truncated")).distinct()
    packs = members.groupBy("root").agg(F.count(F.lit(1)).alias("node_count"), F.sum("cost").alias("character_count"))
    packs = packs.join(cut_roots, "root", "left").withColumn("truncated", F.coalesce("truncated", F.lit(False)))
    return members.select("root", "position", ids.spelled("uuid").alias("uuid"), "pointer", "cost"), packs


# ---- chains and ancestry ----------------------------------------------------------
def revision_chains(revisions: DataFrame) -> DataFrame:
    """For each revision: ``depth``, ``root`` and whether its chain runs into a cycle.

    Pointer doubling: each round joins unique keys and doubles the distance covered.
    """
    known = revisions.select(F.col("revision_uuid").alias("parent_key"))
    walk = revisions.select("revision_uuid", "previous_revision_uuid").join(
        known, F.col("previous_revision_uuid") == F.col("parent_key"), "left").select(
        "revision_uuid", F.col("parent_key").alias("jump"), F.when(F.col("parent_key").isNull(), 0).otherwise(1).cast("long").alias("depth"))
    walk = walk.withColumn("root", F.coalesce("jump", "revision_uuid"))
    walk = checkpointed(walk)
    done, going = walk.where("jump IS NULL"), walk.where("jump IS NOT NULL")
    while going.head(1):
        ahead = done.unionByName(going).select(F.col("revision_uuid").alias("at"), F.col("jump").alias("next_jump"),
                                               F.col("depth").alias("next_depth"), F.col("root").alias("next_root"))
        moved = checkpointed(going.join(ahead, F.col("jump") == F.col("at")).select(
            "revision_uuid", F.col("next_jump").alias("jump"), (F.col("depth") + F.col("next_depth")).alias("depth"),
            F.col("next_root").alias("root")))
        ended, going = moved.where("jump IS NULL"), moved.where("jump IS NOT NULL")
        done = done.unionByName(ended)
        # A chain that will end has a revision that ends in the next round; once none does, all others run into cycles.
        if not ended.head(1):
            break
    walk = done.unionByName(going)
    cycle = F.col("jump").isNotNull()
    return walk.select("revision_uuid", F.when(~cycle, F.col("root")).alias("root"), F.when(~cycle, F.col("depth")).alias("depth"),
                       cycle.alias("cycle"))


def ancestors(parents: DataFrame, starts: DataFrame) -> DataFrame:
    """Every ancestor (with its least distance) of each start in ``parents(child, parent)``: ``start, ancestor, distance``.

    Where each child has one parent, as snapshots do, ancestors are ranges of chains, listed by one join; a node's depth is the
    length of its ranges. With several parents the least distance has to be found by doubling the reach of the starts.
    """
    index = build_index(parents)
    if not index.is_forest:
        return _nearest_ancestors(parents, starts)
    rows = listed(index, ancestor_ranges(index, starts.select(F.col("child").alias("start"))))
    depths = checkpointed(ancestor_ranges(index, index.positions.select(F.col("node").alias("start"))).groupBy(F.col("start").alias("node")).agg(
        F.sum(F.col("upto") + 1).alias("depth")))
    low = depths.select(F.col("node").alias("start"), F.col("depth").alias("_low"))
    high = depths.select(F.col("node").alias("ancestor"), F.col("depth").alias("_high"))
    return rows.join(low, "start").join(high, "ancestor", "left").select("start", "ancestor", (F.col("_low") - F.coalesce("_high", F.lit(0))).alias("distance"))


def ancestor_totals(parents: DataFrame, starts: DataFrame) -> DataFrame:
    """``start, ancestors, depth, ancestor_sum`` of each start that has ancestors; nodes are numbers.

    Where each child has one parent, a node's depth is the number of its ancestors, and the sums are taken over ranges of chains
    without listing them; see :func:`ancestors`.
    """
    index = build_index(parents)
    asked = starts.select(F.col("child").alias("start"))
    if index.is_forest:
        sums = range_sums(index, ancestor_ranges(index, asked), F.col("node"))
        return sums.select("start", F.col("count").alias("ancestors"), F.col("count").alias("depth"), F.col("total").alias("ancestor_sum"))
    return _nearest_ancestors(parents, starts).groupBy("start").agg(
        F.count(F.lit(1)).alias("ancestors"), F.max("distance").alias("depth"), F.sum("ancestor").alias("ancestor_sum"))


def _nearest_ancestors(parents: DataFrame, starts: DataFrame) -> DataFrame:
    edges = checkpointed(parents.where("parent IS NOT NULL").select("child", "parent").distinct())
    hop = edges
    reach = checkpointed(starts.select(F.col("child").alias("start")).distinct().select(
        "start", F.col("start").alias("ancestor"), F.lit(0).cast("long").alias("distance")))
    step = 1
    while True:
        further = reach.join(hop, F.col("ancestor") == F.col("child")).select(
            "start", F.col("parent").alias("ancestor"), (F.col("distance") + step).alias("distance"))
        grown = checkpointed(reach.unionByName(further).groupBy("start", "ancestor").agg(F.min("distance").alias("distance")))
        if grown.count() == reach.count():
            break
        reach = grown
        other = hop.select(F.col("child").alias("middle"), F.col("parent").alias("far"))
        hop = checkpointed(hop.join(other, F.col("parent") == F.col("middle")).select("child", F.col("far").alias("parent")).distinct())
        step *= 2
    return reach.where("distance > 0")


def is_descendant(parents: DataFrame, pairs: DataFrame) -> DataFrame:
    """Adds ``is_descendant`` to ``pairs(snapshot, ancestor)``, by an index of chains and positions."""
    return descendants(build_index(parents), pairs)
