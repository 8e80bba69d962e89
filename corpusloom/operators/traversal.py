"""Nested composition notation: extraction, lawfulness, structural index, queries, embedding."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusloom.corpus import Corpus
from corpusloom.functions import text
from corpusloom.functions.durable import checkpointed
from corpusloom.functions.ordered import grouped_rank
from corpusloom.functions.rows import computed_once
from corpusloom.operators.views import resolve


def extract_traversals(nodes: DataFrame) -> DataFrame:
    """Every notation block of ``nodes(uuid, pointer, description)`` with its tokens."""
    held = nodes.where(F.col("description").contains(f"```{text.NOTATION_FENCE}"))
    blocks = held.select("uuid", "pointer", F.posexplode(text.notation_blocks(F.col("description"))).alias("block", "notation"))
    return tokenise(blocks)


def tokenise(df: DataFrame) -> DataFrame:
    """Adds ``tokens`` of ``notation`` without blanks and without the outer bracket pair."""
    rows = computed_once(df, "_s", text.notation_source(F.col("notation")))
    opened, closed = F.col("_s").startswith("["), F.col("_s").endswith("]")
    inner = F.when(opened & closed & (F.length("_s") > 1), F.expr("substring(_s, 2, length(_s) - 2)")).otherwise(F.col("_s"))
    rows = computed_once(rows, "tokens", F.regexp_extract_all(inner, F.lit(text.NOTATION_TOKEN), F.lit(0)))
    return rows.withColumn("unbalanced_brackets", opened != closed).drop("_s")


# What may follow a token: "(" a term or a sequence, a pointer closes its term, a term is followed
# by another or by its own closing, and a colon always opens a term.
def _kind(token: Column) -> Column:
    return F.when(token.isin("(", ")", ":", "[", "]"), token).otherwise("p")


def check_traversals(df: DataFrame) -> DataFrame:
    """Adds ``lawful``, ``reason`` and ``offset`` (character position in the blank-free notation).

    One fold over the row's own tokens: the kind before, the nesting depth, and the first fault. A null notation is an empty one.
    """
    def fault(before: Column, kind: Column, depth: Column) -> Column:
        return (F.when(kind.isin("[", "]"), "not_a_pointer_token")
                 .when((before == "") & (kind != "("), "term_must_open")
                 .when((before == "(") & (kind == ")"), "empty_term")
                 .when((before == "(") & (kind == ":"), "not_a_pointer_token")
                 .when((before == "p") & (kind != ")"), "not_a_pointer_token")
                 .when((before == ")") & ((kind == "(") | (kind == "p")), "trailing_material")
                 .when((before == ":") & (kind != "("), "term_must_open")
                 .when((kind == ")") & (depth == 0), "unmatched_parentheses")
                 .when((kind == ":") & (depth == 0) & (before != ")"), "term_must_open"))

    start = F.struct(F.lit("").alias("before"), F.lit(0).alias("depth"), F.lit(0).alias("at"),
                     F.lit(None).cast("string").alias("reason"), F.lit(None).cast("int").alias("offset"))

    def step(acc: Column, token: Column) -> Column:
        kind = _kind(token)
        found = F.coalesce(acc["reason"], fault(acc["before"], kind, acc["depth"]))
        first = F.when(acc["offset"].isNotNull(), acc["offset"]).when(found.isNotNull(), acc["at"])
        depth = acc["depth"] + F.when(kind == "(", 1).when(kind == ")", -1).otherwise(0)
        return F.struct(kind.alias("before"), depth.alias("depth"), (acc["at"] + F.length(token)).alias("at"),
                        found.alias("reason"), first.alias("offset"))

    folded = computed_once(df, "_f", F.aggregate("tokens", start, step))
    reason = (F.when(F.col("notation").isNull() | (F.trim("notation") == ""), "empty_notation").when(F.col("unbalanced_brackets"), "unmatched_bracket")
               .when(F.size("tokens") == 0, "empty_notation").when(F.col("_f.reason").isNotNull(), F.col("_f.reason"))
               .when(F.col("_f.depth") != 0, "unmatched_parentheses")
               .when(F.col("_f.before") == ":", "empty_trailing_term"))
    offset = F.when(F.col("unbalanced_brackets"), 0).otherwise(F.coalesce("_f.offset", "_f.at", F.lit(0)))
    return (folded.withColumn("reason", reason).withColumn("lawful", F.col("reason").isNull())
                  .withColumn("offset", F.when(F.col("reason").isNotNull(), offset)).drop("_f"))


def canonical_notation(df: DataFrame) -> DataFrame:
    """Adds ``canonical``: one spelling for all bracket and blank variants."""
    return df.withColumn("canonical", F.concat(F.lit("["), F.array_join("tokens", ""), F.lit("]")))


_PLACE = T.StructType([T.StructField(name, kind) for name, kind in (
    ("position", T.IntegerType()), ("depth", T.IntegerType()), ("path", T.ArrayType(T.IntegerType())), ("sibling", T.IntegerType()),
    ("arity", T.IntegerType()), ("pointer", T.StringType()), ("role", T.StringType()))])
# Terms that leave a task in one batch; a single expression is never cut.
_TERMS_A_BATCH = 50_000


def _places(tokens: Iterable[str]) -> Iterator[tuple]:
    """The pointers of one lawful expression with their places, by one pass over its tokens with a stack of open terms."""
    path, at = [], 0
    open_terms = [[[], 0, None]]  # the pointers among its terms, how many terms it has, its own pointer

    def settled(pointers: list, arity: int) -> Iterator[tuple]:
        triad = arity == 3 and any(place[-1] == 1 for _, place, _ in pointers)
        for position, place, pointer in pointers:
            role = "term" if not triad else "operator" if place[-1] == 1 else "operand"
            yield position, len(place), place, place[-1], arity, pointer, role

    for token in tokens:
        if token == "(":
            path.append(open_terms[-1][1])
            open_terms.append([[], 0, None])
        elif token == ")":
            pointers, arity, own = open_terms.pop()
            if own is None:
                yield from settled(pointers, arity)
            else:
                open_terms[-1][0].append((own[0], list(path), own[1]))
            path.pop()
            open_terms[-1][1] += 1
            at += 1
        elif token != ":":
            open_terms[-1][2] = (at, token)
            at += 1
    yield from settled(*open_terms[0][:2])


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = to_arrow_schema(_PLACE)
    for batch in batches:
        keys = batch.select(["uuid", "block"])
        rows, owners = [], []

        def flushed(keys=keys, rows=rows, owners=owners) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
            places = [pa.array(column, field.type) for column, field in zip(columns, schema, strict=True)]
            kept = keys.take(pa.array(owners, pa.int64()))
            rows.clear()
            owners.clear()
            return pa.RecordBatch.from_arrays([*kept.columns, *places], names=[*keys.schema.names, *schema.names])

        for i, tokens in enumerate(batch["tokens"]):
            rows.extend(_places(tokens.as_py()))
            owners.extend([i] * (len(rows) - len(owners)))
            if len(rows) >= _TERMS_A_BATCH:
                yield flushed()
        yield flushed()


def traversal_index(lawful: DataFrame) -> DataFrame:
    """One row per pointer of each lawful expression.

    ``path`` holds the sibling index at every level; ``arity`` counts the terms of the pointer's own
    sequence. In a left-operator-right sequence whose middle is a pointer, that pointer is the
    ``operator`` and pointers beside it are operands; otherwise the role is ``term``. What a pointer's place is
    shows only where its sequence closes; an expression is read once, in its row and in time that grows with its length,
    which a fold over arrays, copying its result at every token, cannot do.
    """
    rows = lawful.where("lawful").select("uuid", "block", "tokens")
    return rows.mapInArrow(_indexed, T.StructType([rows.schema["uuid"], rows.schema["block"], *_PLACE.fields]))


def resolve_traversals(index: DataFrame, c: Corpus) -> DataFrame:
    """The index with ``target_uuid``; null marks a pointer the corpus does not know."""
    return resolve(index, c)


# ---- index queries ----------------------------------------------------------------
def by_pointer(index: DataFrame, pointers: DataFrame, role: str | None = None) -> DataFrame:
    """Expressions that use any of the given pointers, optionally only in one role."""
    rows = index if role is None else index.where(F.col("role") == role)
    return rows.join(pointers.select("pointer").distinct(), "pointer", "left_semi")


def _per_expression(index: DataFrame) -> DataFrame:
    # One group is one expression, bounded by its node's text.
    place = F.struct("position", "path", "pointer")
    return index.groupBy("uuid", "block").agg(F.array_sort(F.collect_list(place)).alias("places")).select(
        "uuid", "block", F.transform("places", lambda p: p["pointer"]).alias("sequence"),
        F.transform("places", lambda p: p["path"]).alias("shape"))


def same_operands(index: DataFrame) -> DataFrame:
    """Sets of pointers that occur in more than one order or under more than one grouping.

    ``orders`` and ``groupings`` count the distinct variants of each set.
    """
    expressions = _per_expression(index)
    keyed = expressions.select(
        F.array_join(F.array_sort("sequence"), " ").alias("operands"), F.array_join("sequence", " ").alias("order_text"),
        F.to_json(F.struct("sequence", "shape")).alias("grouping_text"))
    variants = keyed.groupBy("operands", "order_text", "grouping_text").agg(F.count(F.lit(1)).alias("uses"))
    totals = variants.groupBy("operands").agg(
        F.countDistinct("order_text").alias("orders"), F.countDistinct("grouping_text").alias("groupings"),
        F.sum("uses").alias("uses"))
    return totals.where((F.col("orders") > 1) | (F.col("groupings") > F.col("orders")))


def nested_reuse(index: DataFrame, nodes: DataFrame) -> DataFrame:
    """Expressions of one node that use another node which itself bears an expression."""
    bearing = index.select(F.col("uuid").alias("inner_uuid")).distinct().join(
        nodes.select(F.col("uuid").alias("inner_uuid"), "pointer"), "inner_uuid")
    return index.select("uuid", "block", "pointer").distinct().join(bearing, "pointer").where("uuid != inner_uuid")


def operator_counts(index: DataFrame) -> DataFrame:
    return index.where("role = 'operator'").groupBy("pointer").agg(F.count(F.lit(1)).alias("uses"))


# ---- blast radius -----------------------------------------------------------------
_PACK = 64  # roots to a bitmap


def packed_roots(roots: DataFrame) -> DataFrame:
    """``pointer, pack, bit`` for distinct ``roots(pointer)``: numbered along a hash, 64 to a pack."""
    place = F.xxhash64("pointer")
    numbered = grouped_rank(roots.where("pointer IS NOT NULL").select("pointer").distinct(), [], [place, F.col("pointer")], F.shiftright(place, 52), "_n")
    return numbered.select("pointer", F.floor((F.col("_n") - 1) / _PACK).cast("long").alias("pack"),
                           F.expr(f"shiftleft(1L, CAST((_n - 1) % {_PACK} AS INT))").alias("bit"))


def reached(roots: DataFrame, edges: DataFrame, bearing: DataFrame | None = None, depth: int | None = None) -> tuple[DataFrame, DataFrame]:
    """What depends on each root, with the roots of a node packed into bitmaps.

    ``edges(source, target, kind)`` are pointers, where the source depends on the target; the effect spreads on only through
    ``bearing(pointer)`` nodes, through all of them if not given, ``depth`` steps or until nothing new is reached. Gives the
    ``packed_roots`` and ``source, kind, pack, bits``: the bits of the roots that reach a source over an edge of a kind. A node is joined once a level for
    each pack of roots that has newly reached it, and no row names one root. A root does not reach itself; null pointers reach nothing.
    """
    packed = checkpointed(packed_roots(roots))
    own = packed.select(F.col("pointer").alias("_self"), F.col("pack").alias("_pack"), F.col("bit").alias("_bit"))
    into = checkpointed(edges.where("source IS NOT NULL AND target IS NOT NULL").select("source", "target", "kind").distinct())
    spreads = None if bearing is None else bearing.select(F.col("pointer").alias("target")).distinct()
    front = packed.groupBy(F.col("pointer").alias("target"), "pack").agg(F.bit_or("bit").alias("bits"))
    seen, touched, level = checkpointed(front), None, 0
    while True:
        step = into.join(front, "target").groupBy("source", "kind", "pack").agg(F.bit_or("bits").alias("bits"))
        others = step.join(own, (F.col("source") == F.col("_self")) & (F.col("pack") == F.col("_pack")), "left").withColumn(
            "bits", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_bit", F.lit(0).cast("long"))))).where("bits != 0")
        step = checkpointed(others.select("source", "kind", "pack", "bits"))
        touched = step if touched is None else checkpointed(touched.unionByName(step).groupBy("source", "kind", "pack").agg(F.bit_or("bits").alias("bits")))
        level += 1
        if level == depth:
            break
        arrived = step.groupBy(F.col("source").alias("target"), "pack").agg(F.bit_or("bits").alias("bits"))
        if spreads is not None:
            arrived = arrived.join(spreads, "target", "left_semi")
        known = seen.select(F.col("target").alias("_at"), F.col("pack").alias("_pack"), F.col("bits").alias("_known"))
        fresh = arrived.join(known, (F.col("target") == F.col("_at")) & (F.col("pack") == F.col("_pack")), "left").withColumn(
            "bits", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_known", F.lit(0).cast("long"))))).where("bits != 0")
        front = checkpointed(fresh.select("target", "pack", "bits"))
        if not front.head(1):
            break
        seen = checkpointed(seen.unionByName(front).groupBy("target", "pack").agg(F.bit_or("bits").alias("bits")))
    return packed, touched


def count_reached(packed: DataFrame, touched: DataFrame, *by: str) -> DataFrame:
    """``root, *by, touched``: the bitmaps of a pack are summed bit by bit where they lie; only the sums become rows of roots."""
    bits = [F.sum(F.expr(f"CAST(shiftrightunsigned(bits, {k}) & 1L AS BIGINT)")).alias(f"_{k}") for k in range(_PACK)]
    sums = touched.groupBy("pack", *by).agg(*bits)
    counted = F.array(*[F.struct(F.expr(f"shiftleft(1L, {k})").alias("bit"), F.col(f"_{k}").alias("touched")) for k in range(_PACK)])
    rows = sums.select("pack", *by, F.explode(F.filter(counted, lambda c: c["touched"] > 0)).alias("c")).select("pack", *by, "c.*")
    return rows.join(packed, ["pack", "bit"]).select(F.col("pointer").alias("root"), *by, "touched")


def blast_radius(roots: DataFrame, edges: DataFrame, bearing: DataFrame, depth: int = 2) -> DataFrame:
    """Nodes touched by changing each root, within ``depth`` steps: ``(root, kind, touched)``; see :func:`reached`."""
    return count_reached(*reached(roots, edges, bearing, depth), "kind")
