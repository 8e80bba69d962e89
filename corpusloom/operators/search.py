"""Full-text search: positional postings, conjunctive ranked queries, snippets, coverage, lanes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.corpus import Corpus
from corpusloom.functions import text
from corpusloom.functions.durable import broadcast_if_small, checkpointed
from corpusloom.functions.ordered import grouped_page
from corpusloom.functions.rows import computed_once
from corpusloom.operators.views import current_nodes

# Fixed values of the ranking function.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
# Word positions of later fields start far beyond any earlier field, so no phrase spans two fields.
_FIELD_GAP = 1 << 32


@dataclass(frozen=True)
class SearchIndex:
    """``postings(term, uuid, tf)``, ``occurrences(term, uuid, at)`` for phrases, ``docs(uuid, pointer, title, length)``."""

    postings: DataFrame
    occurrences: DataFrame
    docs: DataFrame

    def write(self, path: str, buckets: int = 64) -> None:
        """Term tables clustered by term bucket, so that a query reads only its terms' buckets."""
        bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
        for name, rows in (("postings", self.postings), ("occurrences", self.occurrences)):
            clustered = rows.withColumn("bucket", bucket).repartitionByRange("bucket", "term", "uuid")
            clustered.sortWithinPartitions("bucket", "term").write.mode("errorifexists").partitionBy("bucket").parquet(f"{path}/{name}")
        self.docs.write.mode("errorifexists").parquet(f"{path}/docs")


def searchable(c: Corpus) -> DataFrame:
    return current_nodes(c).where("lifecycle_state = 'promoted'").select("uuid", "pointer", "title", "description")


FIELDS = ("pointer", "title", "description")


def occurrences(nodes: DataFrame) -> DataFrame:
    """Every search word of ``nodes(uuid, pointer, title, description)`` with its position: (term, uuid, at)."""
    def placed(field: int, name: str) -> Column:
        base = F.lit(field * _FIELD_GAP)
        return F.transform(text.words(F.col(name)), lambda w, i: F.struct(w.alias("term"), (base + i).alias("at")))

    everything = F.concat(*[placed(i, name) for i, name in enumerate(FIELDS)])
    return nodes.select("uuid", F.explode(everything).alias("t")).select("t.term", "uuid", "t.at")


def count_terms(found: DataFrame) -> DataFrame:
    """Term counts per node. Words of nodes that are dealt by node, see :func:`dealt_by_node`, are counted where they are."""
    return found.groupBy("term", "uuid").agg(F.count(F.lit(1)).alias("tf"))


def dealt_by_node(nodes: DataFrame, about: int | None = None, per_task: int = 50_000) -> DataFrame:
    """``nodes`` dealt by their id, so that whole texts are shuffled instead of their words, each with the id of its node.

    ``about`` is the number of nodes, if known; a task gets about ``per_task`` of them, whose terms it counts in memory.
    """
    return nodes.repartition(1 + (nodes.count() if about is None else about) // per_task, "uuid")


def documents(nodes: DataFrame) -> DataFrame:
    length = sum((F.size(text.words(F.col(name))) for name in FIELDS), F.lit(0)).cast("long")
    return nodes.select("uuid", "pointer", "title", length.alias("length"))


def build_search_index(nodes: DataFrame, about: int | None = None) -> SearchIndex:
    """Index of ``nodes(uuid, pointer, title, description)``, ``about`` so many."""
    return SearchIndex(count_terms(occurrences(dealt_by_node(nodes, about))), occurrences(nodes), documents(nodes))


def query_units(queries: DataFrame) -> DataFrame:
    """Blank-separated units of ``queries(query_id, query)``; a unit of several words is a phrase."""
    units = queries.select("query_id", F.posexplode(F.split(F.trim("query"), r"\s+")).alias("unit", "raw"))
    units = units.where(F.length("raw") > 0).select("query_id", "unit", text.words(F.col("raw")).alias("words"))
    return units.select("query_id", "unit", "words", F.size("words").alias("n_words"))


def _phrase_starts(words: DataFrame, found: DataFrame, on: list[str], keep: list[str]) -> DataFrame:
    """Places at which whole phrases start: all words of ``words(nth, term)`` at consecutive positions."""
    placed = words.join(found, on).withColumn("start", F.col("at") - F.col("nth"))
    return placed.groupBy(*keep, "uuid", "unit", "n_words", "start").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == F.col("n_words"))


def _unit_hits(units: DataFrame, index: SearchIndex) -> DataFrame:
    """Occurrences of each unit in each node: single words by count, phrases by adjacent positions."""
    # Postings and places of other terms are dropped before any are dealt.
    asked = broadcast_if_small(units.select(F.explode("words").alias("term")).distinct())
    postings, places = index.postings.join(asked, "term", "left_semi"), index.occurrences.join(asked, "term", "left_semi")
    single = units.where("n_words = 1").withColumn("term", F.col("words")[0])
    hits = single.join(postings, "term").select("query_id", "unit", "uuid", "tf")
    words = units.where("n_words > 1").select("query_id", "unit", "n_words", F.posexplode("words").alias("nth", "term"))
    starts = _phrase_starts(words, places, ["term"], ["query_id"])
    return hits.unionByName(starts.groupBy("query_id", "unit", "uuid").agg(F.count(F.lit(1)).alias("tf")))


def matches(index: SearchIndex, queries: DataFrame) -> DataFrame:
    """All nodes holding every unit of each query: (query_id, uuid, pointer, title, rank), a smaller rank being better.

    Nodes that lack a unit are dropped before anything is scored. Postings are filtered by the queries' terms before
    anything is grouped; a very common term only widens one join.
    """
    units = query_units(queries)
    counts = units.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_units"), F.min("n_words").alias("least"))
    hits = checkpointed(_unit_hits(units, index))
    stats = index.docs.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("avg_length"))
    n_docs, avg_length = stats.select(F.col("n")).scalar(), stats.select(F.col("avg_length")).scalar()
    df = hits.groupBy("query_id", "unit").agg(F.count(F.lit(1)).alias("df"))
    idf = F.greatest(F.log((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(IDF_FLOOR))
    weights = df.withColumn("idf", idf).select("query_id", "unit", "idf")
    norm = F.col("tf") + K1 * (1 - B + B * F.col("length") / avg_length)
    # one row per query and node: its units' counts side by side
    whole = hits.join(weights, ["query_id", "unit"]).groupBy("query_id", "uuid").agg(
        F.count(F.lit(1)).alias("matched"), F.collect_list(F.struct("tf", "idf")).alias("units")).join(counts, "query_id")
    whole = whole.where((F.col("matched") == F.col("n_units")) & (F.col("least") > 0)).select("query_id", "uuid", F.explode("units").alias("u"))
    scored = (whole.select("query_id", "uuid", "u.*").join(index.docs, "uuid")
                   .withColumn("part", F.col("idf") * F.col("tf") * (K1 + 1) / norm))
    return scored.groupBy("query_id", "uuid", "pointer", "title").agg(F.round(-F.sum("part"), 6).alias("rank"))


# ---- ranked search over blocks ------------------------------------------------------
@dataclass(frozen=True)
class BlockIndex:
    """``postings(term, block, uuid, impact)`` clustered by document ranges, and ``blocks(term, block, n, most)`` with the greatest impact of each."""

    postings: DataFrame
    blocks: DataFrame
    docs: DataFrame

    def write(self, path: str, buckets: int = 64) -> None:
        """Postings clustered by term bucket, term and block, so that the row groups of blocks that are not wanted are passed over."""
        bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
        clustered = self.postings.withColumn("bucket", bucket).repartitionByRange("bucket", "term", "block")
        clustered.sortWithinPartitions("bucket", "term", "block").write.mode("errorifexists").partitionBy("bucket").parquet(f"{path}/block_postings")
        self.blocks.write.mode("errorifexists").parquet(f"{path}/blocks")
        self.docs.write.mode("errorifexists").parquet(f"{path}/docs")


def build_blocks(index: SearchIndex, per_length: int = 8) -> BlockIndex:
    """Documents of about one length share a range, so that the impacts within a block lie close together; a length has ``per_length`` ranges."""
    average = index.docs.agg(F.avg("length").alias("a")).scalar()
    norm = F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("_average"))
    block = F.floor(4 * F.log2(F.col("length") + 1)) * per_length + F.pmod(F.xxhash64("uuid"), F.lit(per_length))
    placed = index.docs.select("uuid", "length", average.alias("_average"), block.cast("int").alias("block"))
    postings = index.postings.join(placed, "uuid").select("term", "block", "uuid", (F.col("tf") * (K1 + 1) / norm).alias("impact"))
    return BlockIndex(postings, summed_blocks(postings), index.docs)


def summed_blocks(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term", "block").agg(F.count(F.lit(1)).alias("n"), F.max("impact").alias("most"))


def pruned_search(index: SearchIndex, ranked: BlockIndex, queries: DataFrame, limit: int = 20, cursor: int = 0, first: int = 4) -> tuple[DataFrame, DataFrame]:
    """The page that :func:`search` gives, without ``total``, reading only blocks that can matter; and what was read for each query.

    The best ``first`` ranges of a query by the sum of their units' greatest impacts are scored first. The score at the end of the page
    is the threshold: of the other ranges only those whose sum reaches it are read. Queries with a phrase are ranked by :func:`search`,
    since how often a phrase occurs is not in any block. The second frame has ``query_id, postings_read, postings_total``.
    """
    units = query_units(queries)
    shape = units.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_units"), F.min("n_words").alias("least"), F.max("n_words").alias("longest"))
    phrased = shape.where("longest > 1 AND least > 0").select("query_id")
    words = checkpointed(units.join(shape.where("longest = 1 AND least > 0"), "query_id").select(
        "query_id", "unit", F.col("words")[0].alias("term"), "n_units"))
    n_docs = ranked.docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    met = words.join(ranked.blocks, "term")
    df = met.groupBy("query_id", "unit").agg(F.sum("n").alias("df"))
    idf = F.greatest(F.log((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(IDF_FLOOR))
    weights = checkpointed(df.select("query_id", "unit", idf.alias("idf")))
    bounds = met.join(weights, ["query_id", "unit"]).groupBy("query_id", "block", "n_units").agg(
        F.count(F.lit(1)).alias("present"), F.sum(F.col("idf") * F.col("most")).alias("bound"), F.sum("n").alias("n"))
    by_bound = W.partitionBy("query_id").orderBy(F.col("bound").desc(), "block")
    bounds = checkpointed(bounds.where("present = n_units").select("query_id", "block", "bound", "n", F.row_number().over(by_bound).alias("nth")))

    def scored(chosen: DataFrame) -> DataFrame:
        wanted = words.join(weights, ["query_id", "unit"]).join(chosen.select("query_id", "block"), "query_id")
        # Postings of other terms are dropped before any are dealt.
        asked = broadcast_if_small(words.select("term").distinct())
        hits = wanted.join(ranked.postings.join(asked, "term", "left_semi"), ["term", "block"])
        whole = hits.groupBy("query_id", "uuid", "n_units").agg(F.count(F.lit(1)).alias("matched"), F.sum(F.col("idf") * F.col("impact")).alias("score"))
        return whole.where("matched = n_units").select("query_id", "uuid", F.round(-F.col("score"), 6).alias("rank"))

    page_end = cursor + limit
    head = checkpointed(scored(bounds.where(F.col("nth") <= first)))
    nth = F.row_number().over(W.partitionBy("query_id").orderBy("rank"))
    threshold = head.withColumn("_nth", nth).where(F.col("_nth") == page_end).select("query_id", (-F.col("rank") - 2e-6).alias("least"))
    rest = checkpointed(bounds.where(F.col("nth") > first).join(threshold, "query_id", "left").where("least IS NULL OR bound >= least"))
    found = head.unionByName(scored(rest)).join(ranked.docs.select("uuid", "pointer", "title"), "uuid")
    whole = matches(index, queries.join(phrased, "query_id", "left_semi")).select("query_id", "uuid", "rank", "pointer", "title")
    page = grouped_page(found.select("query_id", "uuid", "rank", "pointer", "title").unionByName(whole), ["query_id"], [F.col("rank"), F.col("pointer")], limit, cursor)
    read = bounds.where(F.col("nth") <= first).select("query_id", "n").unionByName(rest.select("query_id", "n")).groupBy("query_id").agg(F.sum("n").alias("postings_read"))
    total = met.groupBy("query_id").agg(F.sum("n").alias("postings_total"))
    metric = total.join(read, "query_id", "left").select("query_id", F.coalesce("postings_read", F.lit(0)).alias("postings_read"), "postings_total")
    return page.drop("total", "next_cursor"), metric


def search(index: SearchIndex, queries: DataFrame, limit: int = 20, cursor: int = 0) -> DataFrame:
    """The matches of each query, best rank first, then pointer; one page per query."""
    return grouped_page(matches(index, queries), ["query_id"], [F.col("rank"), F.col("pointer")], limit, cursor)


def unit_places(words: Column, units: Column) -> Column:
    """Where whole units stand among ``words``: array of (at, to, unit), places from 1, by ``to`` and then ``at``.

    ``units`` is an array of word arrays; a unit without words stands nowhere.
    """
    def places(unit: Column, i: Column) -> Column:
        n = F.size(unit)
        starts = F.filter(F.transform(words, lambda w, at: F.when(w == unit[0], at + 1)), lambda at: at.isNotNull())
        whole = F.filter(starts, lambda at: (n == 1) | (F.slice(words, at, n) == unit))
        return F.transform(whole, lambda at: F.struct((at + n - 1).alias("to"), at.alias("at"), i.alias("unit")))

    return F.array_sort(F.flatten(F.transform(F.transform(units, lambda u, i: F.struct(u.alias("u"), i.alias("i"))),
                                              lambda s: F.filter(places(s["u"], s["i"]), lambda p: F.size(s["u"]) > 0))))


def best_window(places: Column, n_units: Column, size: int) -> Column:
    """First word of the window of ``size`` words that holds the most distinct units, the earliest of several; 1 if there is none.

    One pass over the places by their ends: a window that ends with a place holds each unit whose last place starts within it.
    """
    start = F.struct(F.array_repeat(F.lit(0), n_units).alias("last"), F.lit(0).alias("most"), F.lit(1).alias("at"))

    def step(best: Column, place: Column) -> Column:
        last = F.transform(best["last"], lambda x, i: F.when(i == place["unit"], place["at"]).otherwise(x))
        first = F.greatest(F.lit(1), place["to"] - size + 1)
        held = F.size(F.filter(last, lambda x: x >= first))
        better = held > best["most"]
        return F.struct(last.alias("last"), F.when(better, held).otherwise(best["most"]).alias("most"), F.when(better, first).otherwise(best["at"]).alias("at"))

    return F.aggregate(places, start, step, lambda best: best["at"])


def snippets(hits: DataFrame, nodes: DataFrame, queries: DataFrame, size: int = 18) -> DataFrame:
    """Adds ``excerpt``: the ``size`` words of the description that hold the most distinct units of the query, hits in brackets.

    The earliest window is taken of several; a phrase is marked as one, and so are hits that overlap. A unit longer than the window is never whole
    in it. Without any hit the first words are shown. A null description gives a null excerpt. All of it happens within the row.
    """
    wanted = query_units(queries).where("n_words > 0").groupBy("query_id").agg(F.sort_array(F.collect_set("words")).alias("units"))
    rows = hits.join(nodes.select("uuid", "description"), "uuid").join(wanted, "query_id")
    # Each piece is a word, marks included, with the separator that follows it.
    pieces = F.regexp_extract_all("description", F.lit(rf"{text.MARKED_WORD}[^\p{{L}}\p{{N}}]*"), F.lit(0))
    rows = computed_once(rows, "_pieces", pieces)
    rows = computed_once(rows, "_places", unit_places(F.transform("_pieces", lambda p: F.regexp_extract(text.fold(p), text.WORD, 0)), F.col("units")))
    rows = computed_once(rows, "_start", best_window(F.col("_places"), F.size("units"), size))
    last = F.col("_start") + size - 1
    inside = F.array_sort(F.transform(F.filter("_places", lambda p: (p["at"] >= F.col("_start")) & (p["to"] <= last)), lambda p: F.struct(p["at"], p["to"])))
    nothing = F.array().cast("array<struct<at:int,to:int>>")

    def merge(spans: Column, place: Column) -> Column:
        before = F.try_element_at(spans, F.lit(-1))
        grown = F.struct(before["at"].alias("at"), F.greatest(before["to"], place["to"]).alias("to"))
        return F.when(F.coalesce(before["to"] >= place["at"], F.lit(False)),
                      F.array_append(F.slice(spans, F.lit(1), F.greatest(F.size(spans) - 1, F.lit(0))), grown)).otherwise(F.array_append(spans, place))

    rows = computed_once(rows, "_spans", F.aggregate(inside, nothing, merge))
    opened, closed = F.transform("_spans", lambda x: x["at"]), F.transform("_spans", lambda x: x["to"])

    def shown(piece: Column, i: Column) -> Column:
        at = i + F.col("_start")
        left = F.when(F.array_contains(opened, at), F.concat(F.lit("["), piece)).otherwise(piece)
        return F.when(F.array_contains(closed, at), F.regexp_replace(left, rf"^(\[?{text.MARKED_WORD})", "$1]")).otherwise(left)

    body = F.trim(F.array_join(F.transform(F.slice("_pieces", F.col("_start"), F.lit(size)), shown), ""))
    lead = F.when(F.col("_start") > 1, "…").otherwise("")
    tail = F.when(last < F.size("_pieces"), "…").otherwise("")
    return rows.withColumn("excerpt", F.concat(lead, body, tail)).drop("_pieces", "_places", "_start", "_spans", "units", "description")


def search_coverage(nodes: DataFrame, index: SearchIndex) -> DataFrame:
    """Nodes that their own pointer or full title fails to find: (pointer, code)."""
    probes = nodes.select("uuid", "pointer", F.lit("pointer_coverage").alias("query_id"), F.col("pointer").alias("query")).unionByName(
        nodes.select("uuid", "pointer", F.lit("title_coverage").alias("query_id"), F.col("title").alias("query")))
    units = probes.select("uuid", "query_id", F.posexplode(F.split(F.trim("query"), r"\s+")).alias("unit", "raw"))
    units = units.select("uuid", "query_id", "unit", text.words(F.col("raw")).alias("words"))
    units = units.withColumn("n_words", F.size("words"))
    needed = units.groupBy("uuid", "query_id").agg(F.count(F.lit(1)).alias("n_units"))
    words = units.select("uuid", "query_id", "unit", "n_words", F.posexplode("words").alias("nth", "term"))
    # Joined on term and node, so a probe meets only its own node.
    hits = _phrase_starts(words, index.occurrences, ["term", "uuid"], ["query_id"]).select("uuid", "query_id", "unit").distinct()
    got = hits.groupBy("uuid", "query_id").agg(F.count(F.lit(1)).alias("n_hits"))
    missed = needed.join(got, ["uuid", "query_id"], "left").where(F.coalesce("n_hits", F.lit(0)) < F.col("n_units"))
    return missed.join(nodes.select("uuid", "pointer"), "uuid").select("pointer", F.col("query_id").alias("code"))


def lane_of(title: Column, description: Column, kinds: dict[str, str]) -> Column:
    """Lane of a hit: traversal-bearing nodes first, then by title prefix, else canonical."""
    lane = F.when(description.contains(f"```{text.NOTATION_FENCE}"), "traversal")
    for prefix, name in kinds.items():
        lane = lane.when(title.startswith(prefix), name)
    return lane.otherwise("canonical")


def search_lanes(hits: DataFrame, nodes: DataFrame, kinds: dict[str, str], limit: int = 20) -> DataFrame:
    """Hits, usually all :func:`matches`, ranked within lanes instead of in one list."""
    rows = hits.join(nodes.select("uuid", "description"), "uuid")
    rows = rows.withColumn("lane", lane_of(F.col("title"), F.col("description"), kinds)).drop("description")
    ranked = rows.withColumn("lane_rank", F.row_number().over(
        W.partitionBy("query_id", "lane").orderBy("rank", "pointer")))
    return ranked.where(F.col("lane_rank") <= limit)
