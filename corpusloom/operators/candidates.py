"""Candidates for review: several signals of nearness to chosen members, fused by their ranks.

Each signal is a frame ``(view, member, signal, nearness)`` over the members of ``seeds(view, member)``; greater is nearer.
Nulls in a needed column take no part, repeated rows count once, seeds are no candidates of their own view, and empty inputs
give empty signals.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.durable import checkpointed
from corpusloom.functions.ordered import GROUP_LIMIT, grouped_last, grouped_page

# Vectors of one view's seeds that a vector is compared with at a time.
SEED_BLOCK = 256
_SCALE = 10 ** 9


def _seeds(seeds: DataFrame) -> DataFrame:
    return seeds.where("view IS NOT NULL AND member IS NOT NULL").select("view", "member").distinct()


def _signal(rows: DataFrame, name: str, nearness: Column) -> DataFrame:
    return rows.select("view", "member", F.lit(name).alias("signal"), nearness.cast("double").alias("nearness"))


def shared_words(u: DataFrame, seeds: DataFrame, name: str = "words") -> DataFrame:
    """Members of ``u(member, words)`` that share words with a view's seeds; a word weighs by its rarity, in thousandths."""
    said = u.where("member IS NOT NULL").select("member", F.explode(F.array_distinct("words")).alias("term")).distinct()
    size = u.select(F.count_distinct("member").alias("n")).scalar()
    wanted = said.join(_seeds(seeds), "member").select("view", "term").distinct()
    spread = said.join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weights = wanted.join(spread.select("term", F.round(F.log((1 + size) / (1 + F.col("df"))) * 1000).cast("long").alias("weight")), "term")
    found = said.join(weights, "term").groupBy("view", "member").agg(F.sum("weight").alias("shared"))
    return _signal(found.where("shared > 0"), name, F.col("shared"))


def close_along(u: DataFrame, seeds: DataFrame, reach: float, name: str) -> DataFrame:
    """Members of ``u(member, line, place)`` at most ``reach`` from a view's seed on the same line.

    A line may be a conversation with its turns or one line of time. Only members in a cell of a seed or beside it are looked
    at, and each meets only the seeds just before and after it, however many there are; no line meets in one task.
    """
    if reach <= 0:
        raise ValueError("the reach is greater than 0")
    spots = u.where("member IS NOT NULL AND line IS NOT NULL AND place IS NOT NULL").select(
        "member", "line", F.col("place").cast("double").alias("place")).distinct().withColumn("cell", F.floor(F.col("place") / reach))
    marks = checkpointed(spots.join(_seeds(seeds), "member").select("view", "line", "place", "cell").distinct())
    cells = marks.select("view", "line", F.explode(F.sequence(F.col("cell") - 1, F.col("cell") + 1)).alias("cell")).distinct()
    near = spots.join(cells, ["line", "cell"]).select("view", "line", "place", "member")
    rows = checkpointed(near.unionByName(marks.select("view", "line", "place", F.lit(None).cast(spots.schema["member"].dataType).alias("member"))))
    keys, mark, is_member = ["view", "line"], F.when(F.col("member").isNull(), F.col("place")), F.col("member").isNotNull()
    cell = F.floor(F.col("place") / reach)
    before = grouped_last(rows, keys, [F.col("place"), is_member, F.col("member")], cell, mark, "before")
    both = grouped_last(before, keys, [-F.col("place"), is_member, F.col("member")], -cell, mark, "after")
    away = F.least(F.col("place") - F.col("before"), F.col("after") - F.col("place"))
    found = both.where(is_member).groupBy("view", "member").agg(F.min(away).alias("away"))
    return _signal(found.where(F.col("away") <= reach), name, -F.col("away"))


def _unit(vector: Column) -> Column:
    """The vector at length 1; null if it is null, zero or holds anything that is not a finite number."""
    cells = F.transform(vector, lambda x: x.cast("double"))
    length = F.sqrt(F.aggregate(cells, F.lit(0.0), lambda s, x: s + x * x))
    return F.when((length > 0) & (length < float("inf")), F.transform(cells, lambda x: x / length))


def nearest_example(vectors: DataFrame, seeds: DataFrame, name: str = "vector") -> DataFrame:
    """Members of ``vectors(member, vector)`` by their greatest cosine, to six digits, with any single seed of a view.

    The seeds stand in blocks, and every vector is compared with every block in its row. Of vectors of unlike lengths no cosine is taken.
    """
    units = vectors.where("member IS NOT NULL").select("member", _unit(F.col("vector")).alias("vector")).where("vector IS NOT NULL")
    units = checkpointed(units.withColumn("dims", F.size("vector")))
    known = units.join(_seeds(seeds), "member").select("view", "dims", "vector").distinct()
    numbered = checkpointed(known.withColumn("at", F.monotonically_increasing_id()))
    # Numbers of one partition are consecutive, so a block holds SEED_BLOCK vectors at most.
    blocks = numbered.groupBy("view", "dims", F.floor(F.col("at") / SEED_BLOCK).alias("block")).agg(F.collect_list("vector").alias("examples"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    best = units.join(blocks, "dims").select("view", "member", F.array_max(F.transform("examples", lambda e: dot(F.col("vector"), e))).alias("cosine"))
    return _signal(best.groupBy("view", "member").agg(F.max("cosine").alias("cosine")), name, F.round("cosine", 6))


def fuse(signals: list[DataFrame], seeds: DataFrame, limit: int = 100, depth: int = GROUP_LIMIT, constant: int = 60) -> DataFrame:
    """The ``limit`` leading candidates of each view: ``view, position, member, score, reasons``.

    A candidate scores ``1 / (constant + rank)``, cut to nine digits, for each signal that has it among its ``depth`` nearest;
    ties go to the smaller member. ``reasons`` lists the signals with the candidate's rank in each.
    """
    if not 1 <= depth <= GROUP_LIMIT:
        raise ValueError(f"a signal ranks between 1 and {GROUP_LIMIT} members")
    rows = reduce(DataFrame.unionByName, signals).where("nearness IS NOT NULL").groupBy("view", "member", "signal").agg(F.max("nearness").alias("nearness"))
    others = rows.join(_seeds(seeds), ["view", "member"], "left_anti")
    ranked = grouped_page(others, ["view", "signal"], [F.col("nearness").desc(), F.col("member")], depth)
    share = F.expr(f"{_SCALE}L div ({constant} + position)")
    fused = ranked.groupBy("view", "member").agg(F.sum(share).alias("_score"), F.array_sort(F.collect_list(F.struct("signal", "position"))).alias("_why"))
    why = F.array_join(F.transform("_why", lambda r: F.concat_ws(":", r["signal"], r["position"].cast("string"))), " ")
    fused = fused.select("view", "member", "_score", why.alias("reasons"))
    page = grouped_page(fused, ["view"], [F.col("_score").desc(), F.col("member")], limit)
    return page.select("view", "position", "member", (F.col("_score") / _SCALE).alias("score"), "reasons")
