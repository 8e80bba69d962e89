"""The trie of conversation prefixes, built by a van Emde Boas recursion.

Sequences are cut at half depth, again and again, down to segments of a few turns. A segment's own name follows from its halves'
names; from the top, the name of the prefix up to each cut follows from the prefix above and the upper half's name. Equal
prefixes so get equal names, all segments of a level at once, and every lower forest hangs under a named cut. The tries within
segments are then built all at once; totals of lower forests are grafted on to the cuts, and from these upward, level by level,
to the cuts above them. No conversation, node or forest is ever gathered in a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import run_folder, stored
from corpusloom.llm.merkle import crc32_sql
from corpusloom.llm.positions import numbered

ROOT = b"\x00" * 32
SHARED = 5  # conversations c - c % 5 lend their first turns
BORROWED = 9  # at most 8 of them
LISTED = 10  # ids that agree above the lowest 10 bits are listed together, so at most 1,024


def _digest(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def borrowed(conv: Column) -> Column:
    return (F.crc32(conv.cast("string").cast("binary")) % BORROWED).cast("long")


def rebuilt_turns(conversations: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """(conv), every conversation, and (conv, pos, token, size): turns of the rebuilt ones from 1, their names and bytes of text.

    Turns are ordered by ``turn``, null first, ties by the digest of role and text; null roles and texts are empty. Rows without conv_id
    belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    token = _digest(F.octet_length(role).cast("string").cast("binary"), F.lit(b":"), role.cast("binary"), text.cast("binary"))
    given = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", token.alias("token"), F.octet_length(text).cast("long").alias("size"))
    turns = stored(numbered(given, "conv", [F.col("turn").asc_nulls_first(), F.col("token")], folder, "ordered", "nth").select(
        "conv", (F.col("nth") + 1).alias("nth"), "token", "size"), folder, "turns")
    convs = stored(turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n")), folder, "conversations")
    base = F.col("conv") - F.col("conv") % SHARED
    near = F.transform(F.sequence(F.lit(1 - SHARED), F.lit(SHARED - 1)), lambda k: F.try_add(F.col("conv"), k.cast("long")))
    lent = turns.where((F.col("conv") % SHARED == 0) & (F.col("nth") < BORROWED)).select(
        F.col("conv").alias("of"), F.explode(near).alias("conv"), "nth", "token", "size")
    lent = lent.where((base == F.col("of")) & (F.col("nth") <= borrowed(F.col("conv")))).drop("of").join(convs.select("conv"), "conv", "left_semi")
    lenders = convs.where(F.col("conv") % SHARED == 0).select(F.col("conv").alias("of"), F.col("n").alias("lent"))
    short = convs.join(lenders, base == F.col("of"), "left").select(
        F.col("conv").alias("who"), (borrowed(F.col("conv")) - F.least(borrowed(F.col("conv")), F.coalesce("lent", F.lit(0)))).alias("missing"))
    own = turns.where(F.col("nth") > borrowed(F.col("conv"))).join(short.where("missing > 0"), F.col("conv") == F.col("who"), "left").select(
        "conv", (F.col("nth") - F.coalesce("missing", F.lit(0))).alias("nth"), "token", "size")
    return convs.select("conv"), lent.select(*own.columns).unionAll(own).withColumnRenamed("nth", "pos")


def name_cuts(segments: DataFrame, convs: DataFrame, levels: int, depth: int, folder: str) -> DataFrame:
    """(conv, k, name): the name of the prefix of ``k`` whole segments, for each such prefix of each conversation.

    ``segments`` holds (conv, k, turns), segment ``k`` of a conversation. Upwards, segments of a level are put together in pairs;
    downwards, each cut at half depth gets its name from the prefix above it and the upper half. All levels together hold
    twice the segments at most.
    """
    halves = [stored(segments.where(F.size("turns") == depth).select(
        "conv", "k", _digest(F.lit(b"\x01"), F.concat(*[F.col("turns")[i]["token"] for i in range(depth)])).alias("name")), folder, "whole-0")]
    for level in range(1, levels):
        side = lambda odd: F.max(F.when(F.col("k") % 2 == odd, F.col("name")))
        pairs = halves[-1].groupBy("conv", F.shiftright("k", 1).alias("half")).agg(side(0).alias("upper"), side(1).alias("lower"))
        pairs = pairs.where("upper IS NOT NULL AND lower IS NOT NULL")
        halves.append(stored(pairs.select("conv", F.col("half").alias("k"), _digest(F.lit(b"\x02"), F.col("upper"), F.col("lower")).alias("name")), folder, f"whole-{level}"))
    cuts = convs.select("conv", F.lit(0).cast("long").alias("k"), F.lit(ROOT).alias("name"))
    for level in reversed(range(levels)):
        upper = halves[level].where("k % 2 = 0").select(F.col("conv").alias("of"), F.shiftright("k", 1).alias("half"), F.col("name").alias("part"))
        below = F.array(F.struct((F.col("k") * 2).alias("k"), "name"),
                        F.struct((F.col("k") * 2 + 1).alias("k"), _digest(F.lit(b"\x03"), F.col("name"), F.col("part")).alias("name")))
        met = cuts.join(upper, (F.col("conv") == F.col("of")) & (F.col("k") == F.col("half")), "left")
        cuts = stored(met.select("conv", F.explode(F.when(F.col("part").isNull(), F.slice(below, 1, 1)).otherwise(below)).alias("cut"))
                         .select("conv", "cut.*"), folder, f"cuts-{level}")
    return cuts


def listing_digests(ends: DataFrame) -> DataFrame:
    """(name, ends_sha256) from rows of (name, conv): SHA-256 of the ids in numerical order, joined by commas.

    Ids are first put together where they lie close to each other; the digest of a node reads these pieces in order, in batches.
    """
    import pyarrow as pa

    joined = F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    pieces = ends.groupBy("name", F.shiftright("conv", LISTED).alias("piece")).agg(joined.alias("ids"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(done: list[tuple[bytes, str]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], names=["name", "ends_sha256"])

        name, running = None, None
        for batch in batches:
            done = []
            for node, ids in zip(batch.column("name").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if node == name:
                    running.update(f",{ids}".encode())
                    continue
                if name is not None:
                    done.append((name, running.hexdigest()))
                name, running = node, hashlib.sha256(ids.encode())
            yield batch_of(done)
        if name is not None:
            yield batch_of([(name, running.hexdigest())])

    return pieces.repartition("name").sortWithinPartitions("name", "piece").select("name", "ids").mapInArrow(digests, "name binary, ends_sha256 string")


def trie(spark: SparkSession, conversations: DataFrame, depth: int = 4) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    A node is a distinct sequence of first turns of rebuilt conversations (see ``rebuilt_turns``); the root, without
    turns, has every conversation as a member. ``depth`` is how many turns the segments have at which cutting ends; the result
    does not depend on it. Repeated rows are turns each. An empty table, or one without conv_id in any row, gives no rows. Other columns play no part.
    """
    folder = run_folder(spark, "trie")
    convs, turns = rebuilt_turns(conversations, folder)
    entry = F.struct("pos", "token", "size")
    segments = stored(turns.withColumn("k", F.floor((F.col("pos") - 1) / depth).cast("long")).groupBy("conv", "k").agg(
        F.sort_array(F.collect_list(entry)).alias("turns")), folder, "segments")  # at most ``depth`` turns each
    last = segments.agg(F.max("k")).first()[0]
    levels = 0 if last is None else (int(last) + 1).bit_length()  # cuts go one beyond the last segment
    cuts = name_cuts(segments, convs, levels, depth, folder)

    # The tries within segments. Names of nodes at a cut are those of the cut.
    starts = cuts.select(F.col("conv").alias("c"), F.col("k").alias("at"), F.col("name").alias("start"))
    ends = cuts.where("k > 0").select(F.col("conv").alias("d"), (F.col("k") - 1).alias("to"), F.col("name").alias("end"))
    inner = F.transform(F.sequence(F.lit(1), F.size("turns")), lambda i: F.when(
        i == depth, F.col("end")).otherwise(_digest(F.lit(b"\x04"), F.col("start"), F.aggregate(
            F.slice(F.col("turns"), 1, i), F.lit(b"").cast("binary"), lambda so_far, t: F.concat(so_far, t["token"])))))
    named = stored(segments.join(starts, (F.col("conv") == F.col("c")) & (F.col("k") == F.col("at")))
                           .join(ends, (F.col("conv") == F.col("d")) & (F.col("k") == F.col("to")), "left")
                           .select("conv", "k", "start", inner.alias("names"), F.transform("turns", lambda t: t["size"]).alias("sizes")), folder, "named")
    members = named.select("conv", F.col("k"), "start", "names", "sizes", F.posexplode("names").alias("i", "name")).select(
        "name", "conv", (F.col("k") * depth + F.col("i") + 1).alias("pos"),
        F.when(F.col("i") == 0, F.col("start")).otherwise(F.get("names", F.col("i") - 1)).alias("parent"), F.get("sizes", F.col("i")).alias("size"))
    rooted = members.unionAll(convs.select(F.lit(ROOT).alias("name"), "conv", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("size")))
    nodes = stored(rooted.groupBy("name").agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv"), F.max("pos").alias("depth"), F.max("parent").alias("parent"),
        F.max("size").alias("size")), folder, "nodes")
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("of")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stored(nodes.join(children, F.col("name") == F.col("of"), "left").select(
        "name", "conv", "depth", "parent", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.when(F.col("of").isNull(), 1).otherwise(0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved")), folder, "trie")

    # What each segment's own trie has, node by node, in the rows of the smallest members: they own the node.
    k_of = F.floor((F.col("depth") - 1) / depth).cast("long")
    owned = nodes.where("depth > 0").groupBy(F.col("conv").alias("c"), k_of.alias("at")).agg(
        F.collect_list(F.struct(F.pmod(F.col("depth") - 1, F.lit(depth)).cast("int").alias("i"), "leaves", "saved")).alias("own"))
    held = stored(named.join(owned, (F.col("conv") == F.col("c")) & (F.col("k") == F.col("at"))).select("conv", "k", "start", "names", "own"), folder, "owned")
    whole = lambda f: F.sum(F.aggregate("own", F.lit(0).cast("long"), lambda so_far, o: so_far + o[f])).alias(f)
    forests = held.groupBy(F.col("start").alias("name")).agg(whole("leaves"), whole("saved"))
    # Per node at a cut, the totals of what hangs below it within its segment, then within twice that, and so on.
    at_cuts = nodes.where(F.col("depth") % depth == 0).select("name", "conv", (F.col("depth") / depth).cast("long").alias("k"))
    below = stored(at_cuts.join(forests, "name"), folder, "below-0")
    for level in range(levels):
        # Forests under cuts at half depth are whole now; they go to the cuts of the upper half, which end there.
        lower = below.where((F.shiftright("k", level) % 2 == 1) & (F.col("k") % (1 << level) == 0)).select(
            F.col("conv").alias("c"), F.col("k").alias("cut"), "leaves", "saved")
        upper = cuts.where(F.shiftright("k", level) % 2 == 0).withColumn("to", F.shiftleft(F.shiftright("k", level) + 1, level))
        grafted = upper.join(lower, (F.col("conv") == F.col("c")) & (F.col("to") == F.col("cut"))).select(
            "name", F.lit(None).cast("long").alias("conv"), F.lit(None).cast("long").alias("k"), "leaves", "saved")
        below = stored(below.unionAll(grafted).groupBy("name").agg(
            F.max("conv").alias("conv"), F.max("k").alias("k"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")), folder, f"below-{level + 1}")

    # From the cuts upward within segments: a segment's row gives each of its nodes what it owns from there on.
    hanging = below.where("k > 0").select(F.col("conv").alias("c"), (F.col("k") - 1).alias("at"), F.col("leaves").alias("more_leaves"), F.col("saved").alias("more_saved"))
    full = held.join(hanging, (F.col("conv") == F.col("c")) & (F.col("k") == F.col("at")), "left")
    from_here = lambda i, f: F.aggregate(F.filter("own", lambda o: o["i"] >= i), F.coalesce(f"more_{f}", F.lit(0)), lambda so_far, o: so_far + o[f])
    given = full.select(F.explode(F.transform("names", lambda n, i: F.struct(n.alias("name"), from_here(i, "leaves").alias("leaves"), from_here(i, "saved").alias("saved")))).alias("g")).select("g.*")
    root = nodes.where("depth = 0").select("name", "leaves", "saved").unionAll(below.where("k = 0").select("name", "leaves", "saved"))
    totals = given.unionAll(root).groupBy("name").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))

    parents = nodes.select(F.col("name").alias("above"), F.col("conv").alias("parent_conv_id"))
    described = stored(nodes.join(parents, F.col("parent") == F.col("above"), "left").select(
        "name", "conv", "depth", "parent_conv_id", "n_convs", "n_children"), folder, "described")
    closing = listing_digests(rooted.groupBy("conv").agg(F.max_by("name", "pos").alias("name")))
    named_ends = closing.select(F.col("name").alias("closed"), "ends_sha256")
    sums = totals.withColumnRenamed("name", "summed")
    return described.join(sums, F.col("name") == F.col("summed")).join(named_ends, F.col("name") == F.col("closed"), "left").select(
        F.col("conv").alias("conv_id"), F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


SQL = f"""
WITH ordered AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, ''))) AS nth
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT c, c - c % 5 AS base, {crc32_sql('CAST(c AS VARCHAR)')} % 9 AS h FROM (SELECT DISTINCT c FROM ordered)
), turns AS (
  SELECT v.c, 0 AS part, o.nth, o.role, o.text FROM convs v JOIN ordered o ON o.c = v.base AND o.nth <= v.h
  UNION ALL
  SELECT v.c, 1, o.nth, o.role, o.text FROM convs v JOIN ordered o ON o.c = v.c AND o.nth > v.h
), numbered AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, nth) AS d, role, text FROM turns
), paths AS (
  SELECT c, d, CAST(string_agg(strlen(role) || ':' || role || strlen(text) || ':' || text, '') OVER (PARTITION BY c ORDER BY d) AS VARCHAR) AS path, strlen(text) AS size FROM numbered
  UNION ALL SELECT c, 0, '', 0 FROM convs
), members AS (
  SELECT c, d, sha256(path) AS node, size, lag(sha256(path)) OVER (PARTITION BY c ORDER BY d) AS parent, lead(d) OVER (PARTITION BY c ORDER BY d) IS NULL AS final FROM paths
), nodes AS (
  SELECT node, d, min(c) AS c, count(*) AS n_convs, any_value(parent) AS parent, any_value(size) AS size,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (final), '')) AS ends_sha256 FROM members GROUP BY node, d
), kids AS (
  SELECT parent AS node, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent
), facts AS (
  SELECT n.*, coalesce(k.n, 0) AS n_children, CASE WHEN k.n IS NULL THEN 1 ELSE 0 END AS leaf, (n.n_convs - 1) * size AS saved FROM nodes n LEFT JOIN kids k USING (node)
), totals AS (
  SELECT m.node, sum(f.leaf) AS n_leaves, sum(f.saved) AS saved_tokens FROM facts f JOIN members m ON m.c = f.c AND m.d <= f.d GROUP BY m.node
)
SELECT f.c AS conv_id, CAST(f.d AS BIGINT) AS depth, p.c AS parent_conv_id, f.n_convs, CAST(f.n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM facts f JOIN totals USING (node) LEFT JOIN nodes p ON p.node = f.parent
"""
