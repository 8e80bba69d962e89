"""Registered queries of the view algebra and the notation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.functions.durable import checkpointed
from corpusloom.operators import candidates, traversal, viewalgebra, views
from corpusloom.plans import bindings as b
from corpusloom.plans.registry import query
from corpusloom.plans.sqltwins import node_id, uuid5, with_ctes


def _field(spark: SparkSession, sf: str) -> DataFrame:
    docs = b.table(spark, sf, "documents")
    return docs.select(b.pointer("D", "doc_id").alias("member"), F.col("source").alias("container"), "text", "lang", "n_chars")


def _chosen(spark: SparkSession, sf: str, *names: str) -> DataFrame:
    return b.document_views(spark, sf).where(F.col("view").isin(*names))


# ---- views ------------------------------------------------------------------------
@query("m1_universe", with_ctes("turnrow", "SELECT DISTINCT member, container FROM turnrow"))
def universe(spark: SparkSession, sf: str) -> DataFrame:
    return viewalgebra.universe(b.turns(spark, sf), "member", "container")


# Every document answers to its pointer, its number and, per source, its length class.
_ALIASES = """SELECT 'D'||doc_id AS alias, 'D'||doc_id AS canonical FROM documents UNION ALL SELECT doc_id::VARCHAR, 'D'||doc_id FROM documents
    UNION ALL SELECT source||'/'||n_chars, 'D'||doc_id FROM documents"""


@query("m2_normalize_members", f"""SELECT member, CASE WHEN n IS NULL THEN 'unresolved' WHEN n > 1 THEN 'ambiguous' ELSE 'resolved' END AS status, CASE WHEN n = 1 THEN c END AS canonical
    FROM (SELECT doc_id::VARCHAR AS member FROM labels UNION ALL SELECT source||'/'||n_chars FROM documents UNION ALL SELECT item_id||'?' FROM benchmark) m
    LEFT JOIN (SELECT alias, count(DISTINCT canonical) AS n, min(canonical) AS c FROM ({_ALIASES}) GROUP BY alias) a ON a.alias = m.member""")
def normalized(spark: SparkSession, sf: str) -> DataFrame:
    docs = b.table(spark, sf, "documents")
    canonical = b.pointer("D", "doc_id").alias("canonical")
    place = b._text(F.col("source"), "/", F.col("n_chars"))
    aliases = (docs.select(b.pointer("D", "doc_id").alias("alias"), canonical).unionByName(docs.select(F.col("doc_id").cast("string").alias("alias"), canonical))
                   .unionByName(docs.select(place.alias("alias"), canonical)))
    members = (b.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("member")).union(docs.select(place))
               .union(b.table(spark, sf, "benchmark").select(b._text(F.col("item_id"), "?"))))
    return viewalgebra.normalize_members(members, aliases)


@query("m3_surface_view", "SELECT 'word:the' AS view, 'D'||doc_id AS member FROM documents WHERE contains(text, ' the ')")
def surface(spark: SparkSession, sf: str) -> DataFrame:
    return viewalgebra.surface_view(_field(spark, sf), "word:the", F.col("text").contains(" the "))


@query("m4_memberships", f"SELECT {uuid5(b.NAMESPACE, chr(39) + 'branch-graph' + chr(39))} AS graph_uuid, o_orderpriority AS order_key, count(*) AS members FROM orders WHERE o_orderstatus IN ('F','O') GROUP BY ALL")
def curated(spark: SparkSession, sf: str) -> DataFrame:
    rows = viewalgebra.memberships(b.branch(spark, sf, "east"))
    return rows.groupBy("graph_uuid", "order_key").agg(F.count(F.lit(1)).alias("members"))


@query("m5_derived_view", with_ctes("dv turnrow", """SELECT 'in three' AS view, member FROM dv GROUP BY member HAVING count(*) >= 3
    UNION ALL SELECT 'orders of 1997', 'O'||o_orderkey FROM orders WHERE o_orderdate >= '1997-01-01' AND o_orderdate < '1998-01-01'
    UNION ALL SELECT 'buys from Asia', 'O'||o_orderkey FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey WHERE r_name='ASIA'"""))
def derived(spark: SparkSession, sf: str) -> DataFrame:
    orders = b.table(spark, sf, "orders").select(b.pointer("O", "o_orderkey").alias("member"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
                                                 b.pointer("C", "o_custkey").alias("target"))
    nations = b.table(spark, sf, "nation").join(b.table(spark, sf, "region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    asian = b.table(spark, sf, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(b.pointer("C", "c_custkey").alias("target"))
    return (viewalgebra.in_at_least(b.document_views(spark, sf), 3, "in three")
            .union(viewalgebra.in_period(orders, "day", "1997-01-01", "1998-01-01", "orders of 1997"))
            .union(viewalgebra.linked_to(orders, orders.select("member", "target"), asian, "buys from Asia")))


_AB = ("SELECT member FROM dv WHERE view='long'", "SELECT member FROM dv WHERE view='quality'")


@query("m6_union", with_ctes("dv", f"{_AB[0]} UNION {_AB[1]}"))
def united(spark: SparkSession, sf: str) -> DataFrame:
    return viewalgebra.union(_chosen(spark, sf, "long"), _chosen(spark, sf, "quality"))


@query("m6_intersection", with_ctes("dv", f"{_AB[0]} INTERSECT {_AB[1]}"))
def shared(spark: SparkSession, sf: str) -> DataFrame:
    return viewalgebra.intersect(_chosen(spark, sf, "long"), _chosen(spark, sf, "quality"))


@query("m6_difference", with_ctes("dv", f"{_AB[0]} EXCEPT {_AB[1]}"))
def different(spark: SparkSession, sf: str) -> DataFrame:
    return viewalgebra.minus(_chosen(spark, sf, "long"), _chosen(spark, sf, "quality"))


_MARKED = "view IN ('long','quality','toxic')"


@query("m7_addressed", with_ctes("dv", f"SELECT DISTINCT member FROM dv WHERE {_MARKED}"))
def addressed(spark: SparkSession, sf: str) -> DataFrame:
    return viewalgebra.addressed(_chosen(spark, sf, "long", "quality", "toxic"))


@query("m8_uncovered", with_ctes("dv", f"SELECT 'D'||doc_id AS member FROM documents EXCEPT SELECT member FROM dv WHERE {_MARKED}"))
def uncovered(spark: SparkSession, sf: str) -> DataFrame:
    return viewalgebra.uncovered(_field(spark, sf), _chosen(spark, sf, "long", "quality", "toxic"))


@query("m8_coverage", with_ctes("dv", f"SELECT count(*) AS field, count(m) AS covered, round(count(m)/count(*), 6) AS ratio FROM documents LEFT JOIN (SELECT DISTINCT member AS m FROM dv WHERE {_MARKED}) ON m='D'||doc_id"))
def covered(spark: SparkSession, sf: str) -> DataFrame:
    return viewalgebra.coverage(_field(spark, sf), _chosen(spark, sf, "long", "quality", "toxic"))


@query("m9_degree", with_ctes("dv", "SELECT member, count(*) AS degree, count(*)=1 AS exclusive FROM dv GROUP BY member"))
def degrees(spark: SparkSession, sf: str) -> DataFrame:
    return viewalgebra.degree(b.document_views(spark, sf))


@query("m10_overlap", with_ctes("dv", """SELECT view_a, view_b, shared::BIGINT AS shared, size_a::BIGINT AS size_a, size_b::BIGINT AS size_b, round(shared/(size_a+size_b-shared), 6) AS jaccard FROM
    (SELECT x.view AS view_a, y.view AS view_b, count(*) AS shared FROM dv x JOIN dv y ON x.member=y.member AND x.view < y.view GROUP BY ALL)
    JOIN (SELECT view AS view_a, count(*) AS size_a FROM dv GROUP BY 1) USING (view_a) JOIN (SELECT view AS view_b, count(*) AS size_b FROM dv GROUP BY 1) USING (view_b)"""))
def overlaps(spark: SparkSession, sf: str) -> DataFrame:
    return viewalgebra.overlap(b.document_views(spark, sf))


@query("m11_lift", "SELECT conv_id AS container, count(*) AS members FROM conversations WHERE role='user' GROUP BY conv_id HAVING count(*) >= 3")
def lifted(spark: SparkSession, sf: str) -> DataFrame:
    turns = b.turns(spark, sf)
    return viewalgebra.lift(viewalgebra.surface_view(turns, "user", F.col("role") == "user"), turns.select("member", "container"), 3)


_HAS_THE = "contains(lower(text), 'the')"


@query("m12_expand", with_ctes("turnrow", f"SELECT member, container, {_HAS_THE} AS is_member FROM turnrow WHERE container IN (SELECT container FROM turnrow WHERE {_HAS_THE})"))
def expanded(spark: SparkSession, sf: str) -> DataFrame:
    turns = b.turns(spark, sf)
    view = viewalgebra.surface_view(turns, "the", F.lower("text").contains("the"))
    return viewalgebra.expand(view, turns.select("member", "container"))


_STATE = "SELECT 'U'||user_id AS member, 'last:'||arg_max(event_type, ts) AS view FROM events WHERE ts <= TIMESTAMP '{}' GROUP BY user_id"


@query("m13_extent_diff", f"""SELECT view, member, CASE WHEN o IS NULL THEN 'added' WHEN n IS NULL THEN 'removed' ELSE 'kept' END AS change
    FROM (SELECT *, 1 AS o FROM ({_STATE.format('2024-01-10')})) FULL JOIN (SELECT *, 1 AS n FROM ({_STATE.format('2024-01-20')})) USING (view, member)""")
def drift(spark: SparkSession, sf: str) -> DataFrame:
    """Users by the last thing they did, at two moments of the history."""
    c = b.corpus(spark, sf)
    at = lambda moment: views.as_of(c, moment).where("pointer RLIKE '^U[0-9]'").select(
        F.concat(F.lit("last:"), "title").alias("view"), F.col("pointer").alias("member"))
    return viewalgebra.extent_diff(at("2024-01-10T00:00:00.000000000Z"), at("2024-01-20T00:00:00.000000000Z"))


@query("m14_twin_views", """SELECT 'same_extent' AS twin, 'a' AS first_view, 'b' AS last_view, 2::BIGINT AS views, 2::BIGINT AS variants
    UNION ALL SELECT 'same_declaration', 'b', 'c', 2, 2 FROM (SELECT 1 WHERE EXISTS (SELECT 1 FROM conversations WHERE role != 'user'))""")
def twins(spark: SparkSession, sf: str) -> DataFrame:
    """One extent under two declarations, and one declaration with two extents."""
    turns = b.turns(spark, sf)
    asked = F.col("role") == "user"
    rows = (viewalgebra.surface_view(turns, "a", asked).union(viewalgebra.surface_view(turns, "b", asked))
            .union(viewalgebra.surface_view(turns, "c", F.lit(True))))
    declared = spark.createDataFrame([("a", "said by a person"), ("b", "asked"), ("c", "asked")], "view STRING, declaration STRING")
    return viewalgebra.twin_views(rows, declared)


@query("m15_check_views", """SELECT 'quality' AS view, 'count_mismatch' AS code, ((SELECT count(*) FROM labels WHERE quality=1)+1)||'/'||(SELECT count(*) FROM labels WHERE quality=1) AS detail, 's1' AS snapshot
    UNION ALL SELECT 'turns', 'wrong_grain', count(*)::VARCHAR, 's1' FROM conversations""")
def checked(spark: SparkSession, sf: str) -> DataFrame:
    """A view declared one member too large, and a view of turns where documents are the grain."""
    turns = b.turns(spark, sf).select(F.lit("turns").alias("view"), "member")
    rows = _chosen(spark, sf, "quality").union(turns)
    sizes = rows.groupBy("view").agg((F.count(F.lit(1)) + F.when(F.col("view") == "quality", 1).otherwise(0)).alias("member_count"))
    return viewalgebra.check_views(rows, sizes, _field(spark, sf), "s1")


@query("m16_candidate_turns", with_ctes("turnrow", f"""SELECT DISTINCT t.member FROM turnrow t JOIN turnrow s ON t.container=s.container AND abs(t.turn-s.turn) <= 1 AND contains(lower(s.text), 'sch')
    WHERE NOT contains(lower(t.text), 'sch')"""))
def neighbours(spark: SparkSession, sf: str) -> DataFrame:
    turns = b.turns(spark, sf)
    return viewalgebra.near_turns(turns.select("member", "container", "turn"), turns.where(F.lower("text").contains("sch")), 1)


@query("m16_nearest", """SELECT vec_id AS member, cosine FROM (SELECT vec_id, round(list_sum(list_transform(list_zip(e, c), lambda p: p[1]*p[2])) /
      sqrt(list_sum(list_transform(e, lambda x: x*x)) * list_sum(list_transform(c, lambda x: x*x))), 6) AS cosine
    FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE label != 3), (SELECT list(m ORDER BY i) AS c FROM
      (SELECT i, avg(x) AS m FROM (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE label = 3) GROUP BY i)))
    ORDER BY cosine DESC, member LIMIT 50""")
def nearest(spark: SparkSession, sf: str) -> DataFrame:
    rows = b.table(spark, sf, "embeddings").select(F.col("vec_id").alias("member"), F.col("embedding").alias("vector"), "label")
    return viewalgebra.nearest_to_seeds(rows.select("member", "vector"), rows.where("label = 3"), 50)


_WORDS = r"regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+')"
_TERMS = f"SELECT DISTINCT unnest({_WORDS}) AS term FROM benchmark"
_DOC_WORDS = f"SELECT 'D'||doc_id AS member, lpad(doc_id::VARCHAR, 12, '0') AS seen_at, source, unnest(list_distinct({_WORDS})) AS term FROM documents"


def _terms(spark: SparkSession, sf: str) -> DataFrame:
    return b.table(spark, sf, "benchmark").select(F.explode(text.words(F.col("text"))).alias("term")).distinct()


def _spoken(spark: SparkSession, sf: str) -> DataFrame:
    return b.table(spark, sf, "documents").select(b.pointer("D", "doc_id").alias("member"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("seen_at"),
                                                  "source", text.words(F.col("text")).alias("words"))


# A turn is said at the time of one event, and the leading turns of a conversation carry a vector.
_SAID = f"""SELECT t.member, t.container, t.turn, epoch_us(v.ts) / 1e6 AS at, CASE WHEN t.turn < 4 THEN e.embedding::DOUBLE[] END AS vector,
    e.label, t.role, list_distinct({_WORDS.replace("(text", "(t.text")}) AS words, t.text FROM turnrow t
    LEFT JOIN events v ON v.event_id = t.container * 7 + t.turn LEFT JOIN embeddings e ON t.turn < 4 AND e.vec_id = t.container * 4 + t.turn"""
_FUSED = {
    "said": _SAID,
    "seed": """SELECT 'asked' AS view, member FROM said WHERE role = 'user' AND turn = 0 AND contains(lower(text), 'sch')
      UNION SELECT 'third', member FROM said WHERE label = 3 AND turn < 2""",
    "term": "SELECT member, unnest(words) AS term FROM said",
    "weight": """SELECT view, term, round(ln((1 + (SELECT count(*) FROM said)) / (1 + df)) * 1000)::BIGINT AS w
      FROM (SELECT DISTINCT view, term FROM seed JOIN term USING (member)) JOIN (SELECT term, count(*) AS df FROM term GROUP BY term) USING (term)""",
    "unit": "SELECT member, list_transform(vector, lambda x: x / sqrt(list_sum(list_transform(vector, lambda y: y * y)))) AS e FROM said WHERE vector IS NOT NULL",
    "near": """SELECT view, member, 'words' AS signal, sum(w)::DOUBLE AS nearness FROM weight JOIN term USING (term) GROUP BY view, member HAVING sum(w) > 0
      UNION ALL SELECT view, m.member, 'time', -min(abs(m.at - s.at)) FROM seed JOIN said s USING (member) JOIN said m ON abs(m.at - s.at) <= 3600 GROUP BY view, m.member
      UNION ALL SELECT view, m.member, 'turn', -min(abs(m.turn - s.turn))::DOUBLE FROM seed JOIN said s USING (member) JOIN said m ON m.container = s.container AND abs(m.turn - s.turn) <= 2 GROUP BY view, m.member
      UNION ALL SELECT view, m.member, 'vector', round(max(list_sum(list_transform(list_zip(m.e, s.e), lambda p: p[1] * p[2]))), 6) FROM seed JOIN unit s USING (member), unit m GROUP BY view, m.member""",
    "ranked": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY view, signal ORDER BY nearness DESC, member) AS r
      FROM near ANTI JOIN seed USING (view, member)) WHERE r <= 1000""",
    "fused": "SELECT view, member, sum(1000000000 // (60 + r))::BIGINT AS s, string_agg(signal||':'||r, ' ' ORDER BY signal) AS reasons FROM ranked GROUP BY view, member",
}


@query("m16_candidates", with_ctes("turnrow", """SELECT view, p::INTEGER AS position, member, s / 1e9 AS score, reasons
    FROM (SELECT *, row_number() OVER (PARTITION BY view ORDER BY s DESC, member) AS p FROM fused) WHERE p <= 100""", _FUSED))
def fused_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """The hundred turns nearest to two sets of turns by words, time, place in the conversation and vector, with reasons."""
    turns = b.turns(spark, sf)
    times = b.table(spark, sf, "events").select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    vectors = b.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vector"), "label")
    said = (turns.join(times, F.col("event_id") == F.col("container") * 7 + F.col("turn"), "left")
                 .join(vectors, (F.col("turn") < 4) & (F.col("vec_id") == F.col("container") * 4 + F.col("turn")), "left"))
    said = checkpointed(said.select("member", "container", "turn", "at", "vector", "label", "role", "text"))
    asked = said.where((F.col("role") == "user") & (F.col("turn") == 0) & F.lower("text").contains("sch"))
    seeds = checkpointed(asked.select(F.lit("asked").alias("view"), "member").union(said.where("label = 3 AND turn < 2").select(F.lit("third"), "member")))
    signals = [candidates.shared_words(said.select("member", text.words(F.col("text")).alias("words")), seeds),
               candidates.close_along(said.select("member", F.lit("").alias("line"), F.col("at").alias("place")), seeds, 3600, "time"),
               candidates.close_along(said.select("member", F.col("container").alias("line"), F.col("turn").alias("place")), seeds, 2, "turn"),
               candidates.nearest_example(said.select("member", "vector"), seeds)]
    return candidates.fuse(signals, seeds, limit=100)


@query("m17_first_seen", f"SELECT term, min(seen_at) AS first_at, arg_min(member, seen_at) AS first_member, max(seen_at) AS last_at, count(*) AS members FROM ({_DOC_WORDS}) JOIN ({_TERMS}) USING (term) GROUP BY term")
def first_seen(spark: SparkSession, sf: str) -> DataFrame:
    return viewalgebra.first_seen(_spoken(spark, sf), _terms(spark, sf), "seen_at")


@query("m17_recurrence", f"SELECT term, source AS period, count(*) AS members FROM ({_DOC_WORDS}) JOIN ({_TERMS}) USING (term) GROUP BY ALL")
def recurrence(spark: SparkSession, sf: str) -> DataFrame:
    return viewalgebra.recurrence(_spoken(spark, sf), _terms(spark, sf), F.col("source"))


# ---- notation ---------------------------------------------------------------------
def _expressions(spark: SparkSession, sf: str) -> DataFrame:
    return traversal.check_traversals(traversal.extract_traversals(views.current_nodes(b.corpus(spark, sf))))


@query("t1_extract_traversals", with_ctes("otext", "SELECT 'O'||o_orderkey AS pointer, 0::BIGINT AS block, notation, (CASE WHEN o_orderpriority='1-URGENT' AND o_orderstatus='F' THEN 20 ELSE 21 END)::BIGINT AS n_tokens FROM otext"))
def expressions(spark: SparkSession, sf: str) -> DataFrame:
    rows = traversal.extract_traversals(views.current_nodes(b.corpus(spark, sf)))
    return rows.select("pointer", F.col("block").cast("long").alias("block"), "notation", F.size("tokens").cast("long").alias("n_tokens"))


_BROKEN = "(o_orderpriority='1-URGENT' AND o_orderstatus='F')"


@query("t2_check_traversals", with_ctes("otext", f"""SELECT 'O'||o_orderkey AS pointer, NOT {_BROKEN} AS lawful, CASE WHEN {_BROKEN} THEN 'unmatched_parentheses' END AS reason,
    CASE WHEN {_BROKEN} THEN length(notation)-2 END AS "offset" FROM otext"""))
def lawfulness(spark: SparkSession, sf: str) -> DataFrame:
    return _expressions(spark, sf).select("pointer", "lawful", "reason", F.col("offset").cast("long").alias("offset"))


_TERM_ROWS = f"""SELECT node, position::BIGINT AS position, depth::BIGINT AS depth, path, sibling::BIGINT AS sibling, 3::BIGINT AS arity, pointer, role FROM (
    SELECT 'O'||o_orderkey AS node, 0 AS position, 2 AS depth, '0.0' AS path, 0 AS sibling, 'O'||o_orderkey AS pointer, 'operand' AS role FROM otext WHERE NOT {_BROKEN}
    UNION ALL SELECT 'O'||o_orderkey, 2, 2, '0.1', 1, 'PRN002', 'operator' FROM otext WHERE NOT {_BROKEN}
    UNION ALL SELECT 'O'||o_orderkey, 4, 2, '0.2', 2, 'C'||o_custkey, 'operand' FROM otext WHERE NOT {_BROKEN}
    UNION ALL SELECT 'O'||o_orderkey, 7, 1, '1', 1, 'PRN001', 'operator' FROM otext WHERE NOT {_BROKEN}
    UNION ALL SELECT 'O'||o_orderkey, 9, 1, '2', 2, 'N'||c_nationkey, 'operand' FROM otext WHERE NOT {_BROKEN})"""


def _index(spark: SparkSession, sf: str) -> DataFrame:
    return traversal.traversal_index(_expressions(spark, sf))


@query("t3_traversal_index", with_ctes("otext", _TERM_ROWS))
def structure(spark: SparkSession, sf: str) -> DataFrame:
    c = b.corpus(spark, sf)
    rows = _index(spark, sf).join(c["node_identity"].select("uuid", F.col("pointer").alias("node")), "uuid")
    long = lambda name: F.col(name).cast("long").alias(name)
    return rows.select("node", long("position"), long("depth"), F.array_join(F.transform("path", lambda p: p.cast("string")), ".").alias("path"),
                       long("sibling"), long("arity"), "pointer", "role")


@query("t4_canonical_notation", with_ctes("otext", f"SELECT 'O'||o_orderkey AS pointer, notation AS canonical FROM otext WHERE NOT {_BROKEN}"))
def canonical(spark: SparkSession, sf: str) -> DataFrame:
    """Every expression respelled with blanks and without its brackets, then brought back to one form."""
    lawful = _expressions(spark, sf).where("lawful").select("uuid", "pointer", F.expr("replace(substring(notation, 2, length(notation) - 2), ':', ' :\n ')").alias("notation"))
    return traversal.canonical_notation(traversal.tokenise(lawful)).select("pointer", "canonical")


@query("t5_resolve_traversals", with_ctes("otext ident", f"SELECT pointer, uses, CASE WHEN pointer IN (SELECT pointer FROM ident) THEN {node_id('pointer')} END AS target_uuid FROM (SELECT pointer, count(*) AS uses FROM ({_TERM_ROWS}) GROUP BY pointer)"))
def resolved(spark: SparkSession, sf: str) -> DataFrame:
    uses = _index(spark, sf).groupBy("pointer").agg(F.count(F.lit(1)).alias("uses"))
    return traversal.resolve_traversals(uses, b.corpus(spark, sf))


@query("t7_by_pointer", with_ctes("otext", f"SELECT DISTINCT node FROM ({_TERM_ROWS}) WHERE pointer IN (SELECT 'C'||c_custkey FROM customer WHERE c_mktsegment='BUILDING') AND role='operand'"))
def users_of(spark: SparkSession, sf: str) -> DataFrame:
    c = b.corpus(spark, sf)
    wanted = b.table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(b.pointer("C", "c_custkey").alias("pointer"))
    rows = traversal.by_pointer(_index(spark, sf), wanted, "operand").select("uuid").distinct()
    return rows.join(c["node_identity"].select("uuid", F.col("pointer").alias("node")), "uuid").select("node")


@query("t7_operator_counts", with_ctes("otext", f"SELECT pointer, count(*) AS uses FROM ({_TERM_ROWS}) WHERE role='operator' GROUP BY pointer"))
def operators(spark: SparkSession, sf: str) -> DataFrame:
    return traversal.operator_counts(_index(spark, sf))




@query("t7_same_operands", """SELECT least(a, z)||' '||greatest(a, z) AS operands, count(DISTINCT a||' '||z) AS orders, count(DISTINCT a||' '||z) AS groupings, count(*) AS uses
    FROM (SELECT 'N'||n_nationkey AS a, 'RG'||n_regionkey AS z FROM nation UNION ALL SELECT 'RG'||n_regionkey, 'N'||n_nationkey FROM nation WHERE n_regionkey != 0
      UNION ALL SELECT 'C'||c_custkey, 'N'||c_nationkey FROM customer UNION ALL SELECT 'N'||c_nationkey, 'C'||c_custkey FROM customer WHERE c_acctbal > 0)
    GROUP BY 1 HAVING count(DISTINCT a||' '||z) > 1""")
def reordered(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of places written in both orders."""
    nation, customer = b.table(spark, sf, "nation"), b.table(spark, sf, "customer")
    n, rg, cu, cn = b.pointer("N", "n_nationkey"), b.pointer("RG", "n_regionkey"), b.pointer("C", "c_custkey"), b.pointer("N", "c_nationkey")
    pairs = (nation.select(n.alias("a"), rg.alias("z")).union(nation.where("n_regionkey != 0").select(rg, n))
             .union(customer.select(cu, cn)).union(customer.where("c_acctbal > 0").select(cn, cu)))
    rows = pairs.select(F.concat_ws("/", "a", "z").alias("uuid"), F.lit(0).alias("block"), F.concat(F.lit("[("), "a", F.lit("):("), "z", F.lit(")]")).alias("notation"))
    return traversal.same_operands(traversal.traversal_index(traversal.check_traversals(traversal.tokenise(rows))))


@query("t7_nested_reuse", "SELECT DISTINCT 'O'||o_orderkey AS outer_node, 'C'||o_custkey AS pointer FROM orders JOIN customer ON o_custkey=c_custkey WHERE c_acctbal > 0")
def nested(spark: SparkSession, sf: str) -> DataFrame:
    """Orders whose expression uses a customer that carries an expression of its own."""
    customers = b.table(spark, sf, "customer").where("c_acctbal > 0").select(b.pointer("C", "c_custkey").alias("uuid"), b._text("(", b.pointer("N", "c_nationkey"), ")").alias("notation"))
    orders = b.table(spark, sf, "orders").select(b.pointer("O", "o_orderkey").alias("uuid"), b._text("(", b.pointer("C", "o_custkey"), "):(PRN001)").alias("notation"))
    rows = customers.union(orders).withColumn("block", F.lit(0))
    index = traversal.traversal_index(traversal.check_traversals(traversal.tokenise(rows)))
    return traversal.nested_reuse(index, rows.select("uuid", F.col("uuid").alias("pointer")).distinct()).select(F.col("uuid").alias("outer_node"), "pointer").distinct()


_EDGES = f"""SELECT src AS s, target AS o, 'link' AS kind FROM occ UNION SELECT s, o, 'triple' FROM triple
    UNION SELECT node, pointer, 'traversal' FROM ({_TERM_ROWS})"""


def _dependencies(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(source, target, kind) through references, triples and expressions, and the nodes that bear expressions."""
    c = b.corpus(spark, sf)
    names = c["node_identity"].select("uuid", "pointer")
    index = _index(spark, sf).join(names.withColumnRenamed("pointer", "node"), "uuid")
    source = names.select(F.col("uuid").alias("source_node_uuid"), F.col("pointer").alias("source"))
    links = c["reference_occurrences"].join(source, "source_node_uuid").select("source", F.col("target_pointer").alias("target"), F.lit("link").alias("kind"))
    triples = views.triples_readable(c).select(F.col("subject_pointer").alias("source"), F.col("object_pointer").alias("target"), F.lit("triple").alias("kind"))
    used = index.select(F.col("node").alias("source"), F.col("pointer").alias("target"), F.lit("traversal").alias("kind"))
    return links.unionByName(triples).unionByName(used), index.select(F.col("node").alias("pointer")).distinct()


_REACHED = """SELECT root, kind, count(DISTINCT s) AS touched FROM (
      SELECT front.root, e.s, e.kind FROM front JOIN e ON e.o = front.node WHERE e.s != front.root) GROUP BY root, kind"""


@query("t8_blast_radius", with_ctes("occ triple otext", _REACHED, {"e": _EDGES, "bearing": f"SELECT DISTINCT node AS p FROM ({_TERM_ROWS})",
    "f0": "SELECT 'C'||c_custkey AS root, 'C'||c_custkey AS node FROM customer",
    "f1": "SELECT DISTINCT root, e.s AS node FROM f0 JOIN e ON e.o = node JOIN bearing ON p = e.s WHERE e.s != root",
    "f2": "SELECT DISTINCT root, e.s AS node FROM f1 JOIN e ON e.o = node JOIN bearing ON p = e.s WHERE e.s != root",
    "front": "SELECT * FROM f0 UNION SELECT * FROM f1 UNION SELECT * FROM f2"}))
def radius(spark: SparkSession, sf: str) -> DataFrame:
    """What changing each customer touches within three steps, through references, triples and expressions."""
    edges, bearing = _dependencies(spark, sf)
    roots = b.table(spark, sf, "customer").select(b.pointer("C", "c_custkey").alias("pointer"))
    return traversal.blast_radius(roots, edges, bearing, depth=3)


@query("t8_reach_all_roots", with_ctes("occ triple otext", _REACHED, {"e": _EDGES, "root": "SELECT 'C'||c_custkey AS r FROM customer UNION ALL SELECT 'S'||s_suppkey FROM supplier",
    "hop": "SELECT DISTINCT s, o FROM e", "front": "SELECT r AS root, r AS node FROM root UNION SELECT root, hop.s FROM front JOIN hop ON hop.o = node WHERE hop.s != root"}).replace("WITH ", "WITH RECURSIVE ", 1))
def all_roots(spark: SparkSession, sf: str) -> DataFrame:
    """All that depends on each customer and each supplier, over any number of steps."""
    edges, _ = _dependencies(spark, sf)
    roots = b.table(spark, sf, "customer").select(b.pointer("C", "c_custkey").alias("pointer")).union(
        b.table(spark, sf, "supplier").select(b.pointer("S", "s_suppkey")))
    return traversal.count_reached(*traversal.reached(roots, edges), "kind")
