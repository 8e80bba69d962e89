"""Mixing sources to target weights, with DataFrame functions only.

Tokens are summed per source, a repetition rate follows for each source, and every document is emitted
``floor(rate)`` times plus one copy more where a hash of its id, source, text and number among equal rows falls below the fraction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.durable import checkpointed
from corpusloom.functions.ordered import grouped_rank
from corpusloom.llm.common import n_words, run_folder, stored

# A plan of at most so many sources, of names of 200 bytes say, stays near 20 MB and is sent to every executor.
BROADCAST_SOURCES = 100_000
_DIGITS = 13  # hexadecimal digits of the draw: 52 bits, which a double holds exactly


def source_plan(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """One row per source: ``source, source_size, target, rate`` from rows of (source, size).

    Sources in code-point order, null last, take ``weights`` in turn and divide ``share`` of all tokens. No target passes
    ``limit`` times its source's size: what is over is shared again among the others. In order of limit per weight, a
    source is held at its limit if its part of what is left reaches it, and the first that is not sets the level for all
    after it. The windows run over one row per source. A source without tokens has target and rate 0.
    """
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_n") - 1) % len(weights) + 1).cast("int"))
    rows = (sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
                 .withColumn("_n", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
                 .withColumn("_w", turn).withColumn("_cap", F.col("source_size") * F.lit(float(limit))))
    order = W.orderBy(F.col("_cap") / F.col("_w"), "_n")
    everything = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = (rows.withColumn("_k", F.row_number().over(order))
                .withColumn("_before", F.coalesce(F.sum("_cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
                .withColumn("_rest", F.sum("_w").over(order.rowsBetween(0, W.unboundedFollowing)))
                .withColumn("_total", F.sum("source_size").over(everything) * F.lit(float(share)))
                .withColumn("_level", (F.col("_total") - F.col("_before")) / F.col("_rest")))
    rows = rows.withColumn("_free", F.min(F.when(F.col("_cap") > F.col("_w") * F.col("_level"), F.struct("_k", "_level"))).over(everything))
    held = F.col("_free").isNull() | (F.col("_k") < F.col("_free._k"))
    target = F.when(held, F.col("_cap")).otherwise(F.col("_w") * F.col("_free._level"))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(limit)))).otherwise(F.lit(0.0))
    return rows.withColumn("target", target).select("source", "source_size", "target").withColumn("rate", rate)


def draw_key() -> Column:
    """What a row draws by: a digest of its doc_id, source and text, with nulls told from empty texts."""
    source = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    text = F.coalesce(F.md5(F.col("text").cast("string").cast("binary")), F.lit(""))
    return F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), source, text).cast("binary"))


def with_ordinals(rows: DataFrame, folder: str) -> DataFrame:
    """Adds ``nth``, the number from 0 of each row among those of one ``key``; ``same``, a hash of the whole row, orders them.

    Rows whose key is theirs alone, as nearly all are, get 0 where they stand. Repeated ones are stored and ranked in pieces of
    4,096 rows at most, so that a key with a third of all rows meets in no task.
    """
    repeated = stored(rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("key"), folder, "repeated")
    alone = rows.join(repeated, "key", "left_anti").withColumn("nth", F.lit(0).cast("long"))
    again = stored(rows.join(repeated, "key", "left_semi"), folder, "again").withColumn("_at", F.monotonically_increasing_id())
    piece = F.struct("same", F.shiftright("_at", 12).alias("piece"))
    ranked = grouped_rank(again, ["key"], [F.col("same"), F.col("_at")], piece, "_rank").withColumn("nth", F.col("_rank").cast("long") - 1)
    return alone.select("row", "source", "key", "nth").unionAll(ranked.select("row", "source", "key", "nth"))


def copies(rate: Column, key: Column, nth: Column, seed: str) -> Column:
    """floor(rate), plus one if the draw in [0, 1) of a key and its number is below the fraction."""
    digest = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key, F.lit(":"), nth.cast("string")).cast("binary")), 1, _DIGITS)
    draw = F.conv(digest, 16, 10).cast("long") / F.lit(float(16 ** _DIGITS))
    return F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)


def with_copies(rows: DataFrame, sizes: DataFrame, weights: Sequence[float], share: float, limit: float, seed: str) -> DataFrame:
    """Rows of (row, source, key, same) with their source's plan and the number of copies: ``row, source_size, target, copies``.

    A plan of few sources is broadcast after its rows have been counted; a longer one is joined by shuffle, where adaptive
    execution splits a hot source.
    """
    plan = checkpointed(source_plan(sizes, weights, share, limit)).withColumnRenamed("source", "of")
    plan = F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan
    numbered = with_ordinals(rows, run_folder(rows.sparkSession, "mixing"))
    joined = numbered.join(plan, numbered["source"].eqNullSafe(plan["of"]))
    return joined.select("row", "source_size", "target", copies(F.col("rate"), F.col("key"), F.col("nth"), seed).alias("copies"))


def plan_mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, limit: float = 2.0, seed: str = "mix") -> DataFrame:
    """Per document: ``doc_id, size, source_size, target, taken``.

    Null texts have size 0; a null source is a source of its own; rows that repeat, and rows without id, each draw for
    themselves. An empty table gives an empty result. Other columns of ``docs`` play no part.
    """
    sized = checkpointed(docs.select("doc_id", "source", n_words("text").alias("size"), draw_key().alias("key")))
    rows = sized.select(F.struct("doc_id", "size").alias("row"), "source", "key", F.lit(0).alias("same"))
    return with_copies(rows, sized, weights, share, limit, seed).select(
        "row.doc_id", "row.size", "source_size", "target", (F.col("row.size") * F.col("copies")).cast("long").alias("taken"))


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, limit: float = 2.0, seed: str = "mix") -> DataFrame:
    """The documents of the mix with all their columns, each as often as it is taken (not at all, once, twice, ...).

    Rows with one doc_id, source and text draw by turns, in the order of a hash of all their columns.
    """
    sizes = docs.select("source", n_words("text").alias("size"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(whole.alias("row"), "source", draw_key().alias("key"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("same"))
    taken = with_copies(rows, sizes, weights, share, limit, seed).where("copies > 0")
    return taken.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy")).select("row.*")


SQL = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce('=' || source, '') || ':' || coalesce(md5(text), '')) AS key FROM documents
), turns AS (
  SELECT *, row_number() OVER (PARTITION BY key) - 1 AS nth FROM sized
), numbered AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM sized GROUP BY source
), weighed AS (
  SELECT *, CAST([3, 1, 2][(n - 1) % 3 + 1] AS DOUBLE) AS w, source_size * CAST(2 AS DOUBLE) AS cap FROM numbered
), levels AS (
  SELECT *, row_number() OVER (ORDER BY cap / w, n) AS k,
    (sum(source_size) OVER () * CAST(1.5 AS DOUBLE)
      - coalesce(sum(cap) OVER (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (ORDER BY cap / w, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
), free AS (
  SELECT min(k) AS k, arg_min(level, k) AS level FROM levels WHERE cap > w * level
), plan AS (
  SELECT source, source_size, CASE WHEN free.k IS NULL OR levels.k < free.k THEN cap ELSE w * free.level END AS target FROM levels, free
), rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 2.0) ELSE 0 END AS rate FROM plan
)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(rate) + CASE WHEN CAST('0x' || substr(md5('mix:' || key || ':' || nth), 1, {_DIGITS}) AS BIGINT)
    / {float(16 ** _DIGITS)!r} < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM turns JOIN rates ON turns.source IS NOT DISTINCT FROM rates.source
"""
