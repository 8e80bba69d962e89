"""Set algebra over views: tables of (view, member) within one universe and identity regime."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.corpus import Branch
from corpusloom.functions.durable import checkpointed
from corpusloom.functions.ordered import grouped_last, grouped_previous


def universe(df: DataFrame, id_col: str, container_col: str) -> DataFrame:
    """Canonical objects at the declared grain with their container."""
    return df.select(F.col(id_col).alias("member"), F.col(container_col).alias("container")).distinct()


def normalize_members(members: DataFrame, aliases: DataFrame) -> DataFrame:
    """Members brought to canonical ids through ``aliases(alias, canonical)``.

    ``status`` is ``resolved``, ``ambiguous`` (an alias of several objects) or ``unresolved``; only
    resolved rows carry a ``canonical`` id.
    """
    table = aliases.groupBy("alias").agg(F.min("canonical").alias("low"), F.max("canonical").alias("high"))
    joined = members.join(table, members["member"] == table["alias"], "left")
    status = (F.when(F.col("low").isNull(), "unresolved").when(F.col("low") != F.col("high"), "ambiguous").otherwise("resolved"))
    return joined.withColumn("status", status).withColumn("canonical", F.when(F.col("status") == "resolved", F.col("low"))).drop(
        "alias", "low", "high")


def surface_view(u: DataFrame, name: str, predicate: Column) -> DataFrame:
    return u.where(predicate).select(F.lit(name).alias("view"), "member")


def memberships(b: Branch, graphs: DataFrame | None = None) -> DataFrame:
    """Curated membership in its declared order."""
    rows = b["graph_membership_assertions"]
    if graphs is not None:
        rows = rows.join(graphs.select("graph_uuid").distinct(), "graph_uuid", "left_semi")
    return rows.orderBy("graph_uuid", "order_key", "membership_uuid")


def _pairs(views: DataFrame) -> DataFrame:
    return views.select("view", "member").distinct()


def in_at_least(views: DataFrame, n: int, name: str) -> DataFrame:
    """Derived view of the members that at least ``n`` views share."""
    return degree(views).where(F.col("degree") >= n).select(F.lit(name).alias("view"), "member")


def linked_to(u: DataFrame, links: DataFrame, chosen: DataFrame, name: str) -> DataFrame:
    """Derived view of members with a link (member, target) to a chosen target."""
    hits = links.join(chosen.select("target").distinct(), "target", "left_semi").select("member").distinct()
    return u.join(hits, "member", "left_semi").select(F.lit(name).alias("view"), "member")


def in_period(u: DataFrame, moment: str, start: str, end: str, name: str) -> DataFrame:
    """Derived view of members dated in ``[start, end)``."""
    return u.where((F.col(moment) >= start) & (F.col(moment) < end)).select(F.lit(name).alias("view"), "member")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("member").union(b.select("member")).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("member").intersect(b.select("member"))


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("member").subtract(b.select("member"))


def addressed(views: DataFrame) -> DataFrame:
    return views.select("member").distinct()


def uncovered(field: DataFrame, views: DataFrame) -> DataFrame:
    return field.select("member").distinct().join(addressed(views), "member", "left_anti")


def coverage(field: DataFrame, views: DataFrame) -> DataFrame:
    """Size of the field, how much of it any view covers, and the ratio."""
    marked = field.select("member").distinct().join(addressed(views).withColumn("hit", F.lit(1)), "member", "left")
    return marked.agg(F.count(F.lit(1)).alias("field"), F.count("hit").alias("covered")).withColumn(
        "ratio", F.round(F.col("covered") / F.col("field"), 6))


def degree(views: DataFrame) -> DataFrame:
    """How many views hold each member; ``exclusive`` members are in exactly one."""
    counts = _pairs(views).groupBy("member").agg(F.count(F.lit(1)).alias("degree"))
    return counts.withColumn("exclusive", F.col("degree") == 1)


def overlap(views: DataFrame) -> DataFrame:
    """Sizes, intersection and Jaccard of every pair of views that share a member.

    Members are first folded into their distinct sets of views with a count; pairs are formed per
    distinct set, never per member.
    """
    pairs = _pairs(views)
    signatures = pairs.groupBy("member").agg(F.sort_array(F.collect_set("view")).alias("held"))
    weighted = signatures.groupBy("held").agg(F.count(F.lit(1)).alias("n"))
    left = weighted.select("held", "n", F.explode("held").alias("view_a"))
    both = left.select("view_a", "n", F.explode("held").alias("view_b")).where(F.col("view_a") < F.col("view_b"))
    shared = both.groupBy("view_a", "view_b").agg(F.sum("n").alias("shared"))
    sizes = left.groupBy("view_a").agg(F.sum("n").alias("size_a"))
    out = shared.join(sizes, "view_a").join(sizes.select(F.col("view_a").alias("view_b"), F.col("size_a").alias("size_b")), "view_b")
    return out.withColumn("jaccard", F.round(F.col("shared") / (F.col("size_a") + F.col("size_b") - F.col("shared")), 6))


def lift(view: DataFrame, u: DataFrame, k: int) -> DataFrame:
    """Containers with at least ``k`` member children."""
    inside = u.join(view.select("member").distinct(), "member", "left_semi")
    return inside.groupBy("container").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") >= k)


def expand(view: DataFrame, u: DataFrame) -> DataFrame:
    """All children of the members' containers; ``is_member`` keeps context apart from membership."""
    own = view.select("member").distinct()
    containers = u.join(own, "member", "left_semi").select("container").distinct()
    context = u.join(containers, "container", "left_semi")
    return context.join(own.withColumn("hit", F.lit(True)), "member", "left").withColumn(
        "is_member", F.coalesce("hit", F.lit(False))).drop("hit")


def extent_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """``change`` of every (view, member) between two states: added, removed or kept."""
    old = _pairs(before).withColumn("_old", F.lit(True))
    new = _pairs(after).withColumn("_new", F.lit(True))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("kept")
    return old.join(new, ["view", "member"], "full").withColumn("change", change).drop("_old", "_new")


def _extents(views: DataFrame) -> DataFrame:
    """Size and order-free digest of each view's extent, combined map-side whatever the view's size.

    Four sums over independent 60-bit parts of the member digests stand for the set.
    """
    digest = F.sha2("member", 256)
    halves = [F.conv(F.substring(digest, start, 15), 16, 10).cast("decimal(38,0)") for start in (1, 16, 31, 46)]
    sums = [F.sum(h).alias(f"s{i}") for i, h in enumerate(halves)]
    return _pairs(views).groupBy("view").agg(F.count(F.lit(1)).alias("size"), *sums)


def twin_views(views: DataFrame, declarations: DataFrame) -> DataFrame:
    """Groups of views that agree in one part only, from ``declarations(view, declaration)``.

    ``same_extent``: equal members under different declarations; ``same_declaration``: one
    declaration with different members.
    """
    extents = _extents(views).withColumn("extent", F.concat_ws(":", "size", "s0", "s1", "s2", "s3"))
    both = extents.join(declarations, "view").select("view", "extent", "declaration", "size")
    equal = both.groupBy("extent", "size").agg(F.countDistinct("declaration").alias("variants"), F.min("view").alias("first_view"),
                                               F.max("view").alias("last_view"), F.count(F.lit(1)).alias("views"))
    same = both.groupBy("declaration").agg(F.countDistinct("extent").alias("variants"), F.min("view").alias("first_view"),
                                           F.max("view").alias("last_view"), F.count(F.lit(1)).alias("views"))
    columns = ["twin", "first_view", "last_view", "views", "variants"]
    return (equal.where("variants > 1").withColumn("twin", F.lit("same_extent")).select(*columns).unionByName(
            same.where("variants > 1").withColumn("twin", F.lit("same_declaration")).select(*columns)))


def check_views(views: DataFrame, declared: DataFrame, u: DataFrame, snapshot: str) -> DataFrame:
    """Findings (view, code, detail, snapshot) against ``declared(view, member_count)``."""
    derived = _pairs(views).groupBy("view").agg(F.count(F.lit(1)).alias("derived"))
    counts = declared.join(derived, "view", "full").where(~F.col("member_count").eqNullSafe(F.col("derived")))
    wrong = counts.select("view", F.lit("count_mismatch").alias("code"), F.concat_ws(
        "/", F.coalesce(F.col("member_count").cast("string"), F.lit("none")), F.coalesce(F.col("derived").cast("string"), F.lit("none"))).alias("detail"))
    strange = _pairs(views).join(u.select("member").distinct(), "member", "left_anti").groupBy("view").agg(
        F.count(F.lit(1)).alias("n")).select("view", F.lit("wrong_grain").alias("code"), F.col("n").cast("string").alias("detail"))
    return wrong.unionByName(strange).withColumn("snapshot", F.lit(snapshot))


def near_turns(u: DataFrame, seeds: DataFrame, distance: int) -> DataFrame:
    """Turns within ``distance`` of a seed turn in the same container, from ``u(member, container, turn)``."""
    spots = seeds.select("member").distinct().join(u, "member").select(
        "container", F.explode(F.sequence(F.col("turn") - distance, F.col("turn") + distance)).alias("turn")).distinct()
    return u.join(spots, ["container", "turn"]).join(seeds.select("member").distinct(), "member", "left_anti").select("member")


def nearest_to_seeds(vectors: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """The ``k`` vectors closest by cosine to the centroid of the seeds, from ``vectors(member, vector)``.

    The centroid is one row of one vector; each vector is compared with it in place.
    """
    known = seeds.select("member").distinct()
    cells = vectors.join(known, "member", "left_semi").select(F.posexplode("vector").alias("i", "x"))
    mean = cells.groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centre = mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c")).scalar()
    rest = vectors.join(known, "member", "left_anti").withColumn("c", centre)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    cosine = dot(F.col("vector"), F.col("c")) / F.sqrt(dot(F.col("vector"), F.col("vector").cast("array<double>")) * dot(F.col("c"), F.col("c")))
    return rest.select("member", F.round(cosine, 6).alias("cosine")).orderBy(F.desc("cosine"), "member").limit(k)


def first_seen(u: DataFrame, terms: DataFrame, moment: str) -> DataFrame:
    """First and last appearance and spread of each term, from ``u(member, words, moment)``."""
    said = u.select("member", moment, F.explode(F.array_distinct("words")).alias("term")).join(terms.select("term").distinct(), "term")
    return said.groupBy("term").agg(
        F.min(F.struct(F.col(moment), F.col("member"))).alias("f"), F.max(moment).alias("last_at"), F.count(F.lit(1)).alias("members")).select(
        "term", F.col(f"f.{moment}").alias("first_at"), F.col("f.member").alias("first_member"), "last_at", "members")


def recurrence(u: DataFrame, terms: DataFrame, period: Column) -> DataFrame:
    """Members using each term per period."""
    said = u.select("member", period.alias("period"), F.explode(F.array_distinct("words")).alias("term")).join(terms.select("term").distinct(), "term")
    return said.groupBy("term", "period").agg(F.count(F.lit(1)).alias("members"))


def sessions(u: DataFrame, gap: float, bucket: Column | None = None) -> DataFrame:
    """Stretches of time in which a term keeps coming back: ``term, started_at, ended_at, members, longest_gap`` from ``u(term, moment)``.

    A stretch ends where the term stays away for more than ``gap`` seconds; ``longest_gap`` is how many seconds it was away at most
    before and within the stretch, null if it came once only. A term's moments are cut at ``bucket``, by default the hour, and joined again across it, so that a term of
    all rows meets in no task. Moments that repeat count as members each; rows without term or moment play no part.
    """
    rows = u.where("term IS NOT NULL AND moment IS NOT NULL").select("term", F.col("moment").cast("timestamp").alias("moment"))
    bucket = F.date_trunc("hour", "moment") if bucket is None else bucket
    times = rows.groupBy("term", "moment").agg(F.count(F.lit(1)).alias("members"))
    spaced = checkpointed(grouped_previous(times, ["term"], [F.col("moment")], bucket, F.col("moment"), "before"))
    away = (F.unix_micros("moment") - F.unix_micros("before")) / 1e6
    marked = spaced.withColumn("away", away).withColumn("starts", F.when(F.col("before").isNull() | (F.col("away") > gap), F.col("moment")))
    placed = grouped_last(marked, ["term"], [F.col("moment")], bucket, F.col("starts"), "started_at")
    return placed.groupBy("term", "started_at").agg(
        F.max("moment").alias("ended_at"), F.sum("members").alias("members"), F.max("away").alias("longest_gap"))


def recurrence_over_time(stretches: DataFrame) -> DataFrame:
    """Per term of :func:`sessions`: ``term, first_at, last_at, islands, longest_gap, members``."""
    return stretches.groupBy("term").agg(F.min("started_at").alias("first_at"), F.max("ended_at").alias("last_at"), F.count(F.lit(1)).alias("islands"),
                                         F.max("longest_gap").alias("longest_gap"), F.sum("members").alias("members"))
