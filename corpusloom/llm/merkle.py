"""A Merkle manifest of a dataset, with persistent versions by path copying.

Leaves are dealt in aligned blocks of ``FANOUT ** HEIGHT`` of one tree. A block is a persistent tree: nodes are only ever added,
a version is the node at its top, and a changed leaf makes a version that copies the ancestors of the leaf and shares every
other node. The tops of blocks are the leaves of the blocks above, level by level, until each tree has one node; versions
go on from the top of their block along that block's path through the upper levels, which is joined to them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import run_folder, stored
from corpusloom.llm.positions import numbered

FANOUT = 3
HEIGHT = 5  # of a block: 243 nodes at its foot
BLOCK = FANOUT ** HEIGHT


def digest(*parts: str) -> str:
    """Lower-case hexadecimal SHA-256 of parts put together."""
    return hashlib.sha256("".join(parts).encode("ascii")).hexdigest()


class PathTree:
    """Nodes that are only ever added; a version of the tree is the number of its top node."""

    def __init__(self, leaves: Sequence[str], height: int | None = None):
        """With a ``height`` every level up to it is built, however few its nodes; without, levels end at one node."""
        self.digests = list(leaves)
        self.children: list[tuple[int, ...]] = [()] * len(self.digests)
        row, self.height = list(range(len(self.digests))), 0
        while len(row) > 1 if height is None else self.height < height:
            row = [self._node(tuple(row[i:i + FANOUT])) for i in range(0, len(row), FANOUT)]
            self.height += 1
        self.top = row[0]

    def _node(self, children: tuple[int, ...]) -> int:
        self.digests.append(digest(*[self.digests[c] for c in children]))
        self.children.append(children)
        return len(self.digests) - 1

    def _way(self, version: int, leaf: int) -> list[tuple[int, int]]:
        """(node, which child) from the top down to a leaf."""
        way, node = [], version
        for level in reversed(range(self.height)):
            slot = leaf // FANOUT ** level % FANOUT
            way.append((node, slot))
            node = self.children[node][slot]
        return way

    def changed(self, version: int, leaf: int, to: str) -> int:
        """The version that has ``to`` in place of a leaf: copies of its ancestors, all other nodes shared."""
        self.digests.append(to)
        self.children.append(())
        node = len(self.digests) - 1
        for parent, slot in reversed(self._way(version, leaf)):
            kept = self.children[parent]
            node = self._node((*kept[:slot], node, *kept[slot + 1:]))
        return node

    def siblings(self, version: int, leaf: int) -> list[tuple[str, str]]:
        """For each level, from the leaf up, the digests before and after it in its run."""
        return [("".join(self.digests[c] for c in self.children[node][:slot]), "".join(self.digests[c] for c in self.children[node][slot + 1:]))
                for node, slot in reversed(self._way(version, leaf))]


def _hash(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def encoded(value: Column) -> Column:
    """``-`` for null, else the count of bytes, a colon and the value as text."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*fields: Column) -> Column:
    return _hash(*[encoded(f) for f in fields])


def _tree(block: int, leaves: list[bytes]) -> PathTree:
    """The first block of a tree ends at one node, which for a full one is the whole height; the others have the whole height."""
    return PathTree([d.hex() for d in leaves], None if block == 0 else HEIGHT)


def leaf_blocks(leaves: DataFrame) -> DataFrame:
    """Per row of (id, tree, at, leaf, tampered): ``id, tree, block, leaf, version, siblings, top``.

    ``at`` is the position of a leaf in its tree, ``tampered`` its changed digest or null. ``version`` is the top of the block's
    version with that change, ``siblings`` what the leaf's runs hold besides it, level by level within the block, and ``top`` the
    block's own digest, given in one row of each block. A task holds one block at a time.
    """
    import pyarrow as pa

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        block = table.column("block")[0].as_py()
        tree = _tree(block, table.column("leaf").to_pylist())
        versions, siblings = [], []
        for k, to in enumerate(table.column("tampered").to_pylist()):
            versions.append(None if to is None else bytes.fromhex(tree.digests[tree.changed(tree.top, k, to.hex())]))
            siblings.append(bytes.fromhex("".join(a + b for a, b in tree.siblings(tree.top, k))))
        tops = [bytes.fromhex(tree.digests[tree.top])] + [None] * (len(versions) - 1)
        kept = table.select(["id", "tree", "block", "leaf"])
        for name, values in (("version", versions), ("siblings", siblings), ("top", tops)):
            kept = kept.append_column(name, pa.array(values, pa.binary()))
        return kept

    kind = leaves.schema["id"].dataType.simpleString()
    dealt = leaves.withColumn("block", F.floor(F.col("at") / BLOCK).cast("long"))
    return dealt.groupBy("tree", "block").applyInArrow(
        fold, f"id {kind}, tree string, block long, leaf binary, version binary, siblings binary, top binary")


def upper_block(nodes: DataFrame) -> DataFrame:
    """Per row of (tree, at, digest): ``tree, at, digest, block, steps, top`` with the siblings before and after, level by level in its block."""
    import pyarrow as pa

    steps_of = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        tree = _tree(table.column("block")[0].as_py(), table.column("digest").to_pylist())
        steps = [[{"before": a, "after": b} for a, b in tree.siblings(tree.top, k)] for k in range(table.num_rows)]
        tops = [bytes.fromhex(tree.digests[tree.top])] + [None] * (table.num_rows - 1)
        kept = table.select(["tree", "at", "digest", "block"])
        return kept.append_column("steps", pa.array(steps, steps_of)).append_column("top", pa.array(tops, pa.binary()))

    dealt = nodes.withColumn("block", F.floor(F.col("at") / BLOCK).cast("long"))
    return dealt.groupBy("tree", "block").applyInArrow(
        fold, "tree string, at long, digest binary, block long, steps array<struct<before: string, after: string>>, top binary")


def upper_paths(nodes: DataFrame, folder: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Fold rows of (tree, at, digest) to one node a tree.

    Gives (tree, at, digest, steps), the way of every node up to its tree's top, and (tree, digest) of the tops. Each level has
    a 243rd of the nodes of the one below; the number of levels is the only thing that the driver learns.
    """
    levels = []
    while True:
        level = stored(upper_block(nodes), folder, f"{name}-{len(levels)}")
        levels.append(level)
        nodes = level.where("top IS NOT NULL").select("tree", F.col("block").alias("at"), F.col("top").alias("digest"))
        if not level.where("block > 0").head(1):
            break
    paths = levels[-1].select("tree", "at", "digest", "steps")
    for level in reversed(levels[:-1]):
        above = paths.select(F.col("tree").alias("of"), F.col("at").alias("within"), F.col("steps").alias("more"))
        paths = level.join(above, (F.col("tree") == F.col("of")) & (F.col("block") == F.col("within"))).select(
            "tree", "at", "digest", F.concat("steps", "more").alias("steps"))
    return paths, nodes.select("tree", "digest")


def manifest(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Per row of (id, tree, order, leaf, tampered): ``id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    ``tree`` is a text that sorts trees, ``order`` sorts the leaves of one, ties by the leaf's digest, so that rows with equal
    digests may change places without effect; nulls come first. ``leaf`` and ``tampered`` (null: untouched) are hexadecimal.
    An empty table gives an empty manifest.
    """
    folder = run_folder(spark, "merkle")
    given = rows.select("id", "tree", "order", F.unhex("leaf").alias("leaf"), F.unhex("tampered").alias("tampered"))
    placed = numbered(given, "tree", [F.col("order").asc_nulls_first(), F.col("leaf")], folder, "placed", "at")
    leaves = stored(leaf_blocks(placed.drop("order")), folder, "leaves")
    tops = leaves.where("top IS NOT NULL").select("tree", F.col("block").alias("at"), F.col("top").alias("digest"))
    paths, subroots = upper_paths(tops, folder, "upper")
    subroots = numbered(subroots.select(F.lit("").alias("all"), "tree", "digest"), "all", [F.col("tree")], folder, "subroots", "at")
    sources, root = upper_paths(subroots.select(F.col("all").alias("tree"), "at", "digest"), folder, "sources")
    named = subroots.select(F.col("tree").alias("of"), F.col("at").alias("nth"), F.col("digest").alias("subroot"))
    ends = sources.join(named, F.col("at") == F.col("nth")).select("of", "subroot", F.col("steps").alias("more"))
    ends = ends.crossJoin(F.broadcast(root.select(F.col("digest").alias("root"))))  # one row
    ways = paths.join(ends, F.col("tree") == F.col("of")).select(
        "of", F.col("at").alias("within"), F.lower(F.hex("digest")).alias("start"), F.concat("steps", "more").alias("steps"),
        F.lower(F.hex("subroot")).alias("subroot"), F.lower(F.hex("root")).alias("root"))
    ways = stored(ways, folder, "ways")
    above = F.array_join(F.transform("steps", lambda s: F.concat(s["before"], s["after"])), "")
    start = F.coalesce(F.lower(F.hex("version")), F.col("start"))
    folded = F.aggregate("steps", start, lambda so_far, s: _hash(s["before"], so_far, s["after"]))
    done = leaves.join(ways, (F.col("tree") == F.col("of")) & (F.col("block") == F.col("within"))).select(
        "id", F.lower(F.hex("leaf")).alias("leaf"), "subroot", "root", _hash(F.lower(F.hex("siblings")), above).alias("proof_sha256"),
        folded.alias("folded_root"))
    return done.withColumn("verified", F.col("folded_root") == F.col("root"))


def tamper_check(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The manifest of ``documents``, with each second document tampered by deleting the line breaks of its text.

    A tree is a source, the null one first; leaves ascend by doc_id. A document is tampered if 2 divides the CRC-32 of its id;
    rows without id are not. A text without line breaks and a null one stay as they are and so verify, like all
    untouched ones. Repeated rows are leaves each; empty and very long texts are hashed whole, and no text leaves its task. Other columns
    play no part.
    """
    fields = [F.col("source"), F.col("lang"), F.col("n_chars")]
    digest_of = lambda text: leaf_digest(F.col("doc_id"), *fields, text)
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains(F.col("text"), F.lit("\n"))
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("tree"),
                       F.col("doc_id").alias("order"), digest_of(F.col("text")).alias("leaf"),
                       F.when(hit, digest_of(F.replace(F.col("text"), F.lit("\n"), F.lit("")))).alias("tampered"))
    return manifest(spark, rows).withColumnRenamed("id", "doc_id")


# CRC-32 of a text of ASCII characters, bit by bit.
def crc32_sql(text: str) -> str:
    return (f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT))), "
            "lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 1, 2, 3, 4, 5, 6, 7]), "
            "lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)")


def _leaf_sql(text: str) -> str:
    part = lambda x: f"CASE WHEN {x} IS NULL THEN '-' ELSE CAST(strlen(CAST({x} AS VARCHAR)) AS VARCHAR) || ':' || CAST({x} AS VARCHAR) END"
    return "sha256(" + " || ".join(part(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"


SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || source, '') AS tree, {_leaf_sql('text')} AS leaf,
    CASE WHEN coalesce({crc32_sql("CAST(doc_id AS VARCHAR)")} % 2 = 0, false) THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql('text')} END AS tampered
  FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS pos FROM leaves
), low AS (
  SELECT tree, 0 AS level, pos, leaf AS digest, count(*) OVER (PARTITION BY tree) AS n FROM placed
  UNION ALL
  SELECT tree, level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (n + 2) // 3 FROM low WHERE n > 1 GROUP BY tree, level, pos // 3, n
), subroots AS (
  SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1
), high AS (
  SELECT 0 AS level, pos, digest, n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (n + 2) // 3 FROM high WHERE n > 1 GROUP BY level, pos // 3, n
), heights AS (
  SELECT tree, max(level) AS height FROM low GROUP BY tree
), ways AS (
  SELECT p.rid, g.level, coalesce(string_agg(s.digest, '' ORDER BY s.pos) FILTER (s.pos < g.pos), '') AS before,
    coalesce(string_agg(s.digest, '' ORDER BY s.pos) FILTER (s.pos > g.pos), '') AS after
  FROM (SELECT rid, tree, height, unnest(range(height)) AS level, pos FROM placed JOIN heights USING (tree)) p
  JOIN low g ON g.tree = p.tree AND g.level = p.level AND g.pos = p.pos // CAST(3 ** p.level AS BIGINT)
  JOIN low s ON s.tree = p.tree AND s.level = p.level AND s.pos // 3 = g.pos // 3
  GROUP BY p.rid, g.level, g.pos
  UNION ALL
  SELECT p.rid, p.height + g.level, coalesce(string_agg(s.digest, '' ORDER BY s.pos) FILTER (s.pos < g.pos), ''),
    coalesce(string_agg(s.digest, '' ORDER BY s.pos) FILTER (s.pos > g.pos), '')
  FROM (SELECT rid, height, r.pos, unnest(range((SELECT max(level) FROM high))) AS level FROM placed JOIN heights USING (tree) JOIN subroots r USING (tree)) p
  JOIN high g ON g.level = p.level AND g.pos = p.pos // CAST(3 ** p.level AS BIGINT)
  JOIN high s ON s.level = p.level AND s.pos // 3 = g.pos // 3
  GROUP BY p.rid, p.height, g.level, g.pos
), folds AS (
  SELECT rid, 0 AS level, tampered AS digest FROM leaves
  UNION ALL
  SELECT f.rid, f.level + 1, sha256(w.before || f.digest || w.after) FROM folds f JOIN ways w ON w.rid = f.rid AND w.level = f.level
), folded AS (
  SELECT rid, arg_max(digest, level) AS folded_root FROM folds GROUP BY rid
), proofs AS (
  SELECT rid, string_agg(before || after, '' ORDER BY level) AS proof FROM ways GROUP BY rid
)
SELECT p.doc_id, p.leaf, r.digest AS subroot, t.digest AS root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = t.digest AS verified
FROM placed p JOIN subroots r USING (tree) JOIN folded USING (rid) LEFT JOIN proofs USING (rid)
CROSS JOIN (SELECT arg_max(digest, level) AS digest FROM high) t
"""
