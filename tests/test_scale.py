"""Work and space that may not grow faster than the input."""

from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusloom import schema
from corpusloom.corpus import Branch, Corpus, Head, shaped
from corpusloom.functions import durable, ids
from corpusloom.functions.durable import LazyTables
from corpusloom.operators import branches, changes, fingerprints, graph, quality, reachability, views
from corpusloom.operators.references import build_reference_index
from corpusloom.operators.search import BlockIndex, build_blocks, build_search_index, pruned_search, search, summed_blocks
from corpusloom.plans import bindings, change_queries


@pytest.fixture
def rounds(monkeypatch):
    """How often the chain operators materialise a step."""
    made = []
    for module in (graph, reachability):
        monkeypatch.setattr(module, "checkpointed", lambda df, keep=durable.checkpointed: made.append(1) or keep(df))
    return made


def test_checkpoints_are_compressed_columns(spark):
    rows = spark.range(50_000).select("id", F.expr("uuid()").alias("name"), F.lit("the same text over and over").alias("text"))
    kept = durable.checkpointed(rows)
    assert all(f.endswith(".zstd.parquet") for f in kept.inputFiles()) and kept.inputFiles()
    assert kept.schema.simpleString() == rows.schema.simpleString()
    assert kept.select("name").collect() == kept.select("name").collect()  # drawn once
    twice = rows.limit(3).select("id", "id")
    assert durable.checkpointed(twice).count() == 3
    assert durable.checkpointed(rows.limit(3).select(F.lit(None).alias("nothing"))).count() == 3
    assert durable.checkpointed(rows.limit(3).select()).count() == 3


def test_cycles_end_the_search_once_no_chain_ends(spark, rounds):
    ids = F.col("id").cast("string")
    loop = spark.range(3).select(ids.alias("revision_uuid"), ((F.col("id") + 1) % 3).cast("string").alias("previous_revision_uuid"))
    tail = spark.range(3, 6).select(ids.alias("revision_uuid"), (F.col("id") - 1).cast("string").alias("previous_revision_uuid"))
    single = spark.range(100, 5_000).select(ids.alias("revision_uuid"), F.when(F.col("id") % 2 == 1, (F.col("id") - 1).cast("string")).alias("previous_revision_uuid"))
    chains = graph.revision_chains(loop.unionByName(tail).unionByName(single))
    found = {r.revision_uuid: (r.root, r.depth, r.cycle) for r in chains.collect()}
    assert {k for k, v in found.items() if v[2]} == {"0", "1", "2", "3", "4", "5"}
    assert found["101"] == ("100", 1, False) and found["100"] == ("100", 0, False) and len(found) == 4_906
    assert len(rounds) <= 4


def test_chains_with_cycles_are_ranked_in_few_rounds(spark, rounds):
    loop = spark.range(4).select(F.col("id").alias("node"), ((F.col("id") + 1) % 4).alias("up"))
    single = spark.range(10, 3_000).select(F.col("id").alias("node"), F.lit(None).cast("long").alias("up"))
    ranked = {r.node: (r.head, r.steps) for r in reachability._ranked(loop.unionByName(single)).collect()}
    assert ranked[0] == (None, None) and ranked[10] == (10, 0) and len(ranked) == 2_994
    assert len(rounds) <= 3


@pytest.mark.parametrize("extra", [[], [(7, 3)]], ids=["forest", "several parents"])
def test_totals_of_ancestors_without_their_pairs(spark, extra, monkeypatch):
    parents = {n: (n - 1 if n % 5 else n // 2) for n in range(1, 60)} | {0: None}
    rows = [*parents.items(), *extra]
    table = spark.createDataFrame([(c, p if p != c else None) for c, p in rows], "child BIGINT, parent BIGINT")
    starts = spark.createDataFrame([(n,) for n in (0, 7, 33, 59, 59)], "child BIGINT")
    listed = graph.ancestors(table, starts).groupBy("start").agg(
        F.count(F.lit(1)).alias("ancestors"), F.max("distance").alias("depth"), F.sum("ancestor").alias("ancestor_sum"))
    expected = {tuple(r) for r in listed.collect()}
    if not extra:
        monkeypatch.setattr(graph, "listed", lambda *_: pytest.fail("ancestors were listed"))
    assert {tuple(r) for r in graph.ancestor_totals(table, starts).collect()} == expected and len(expected) == 3


def test_sums_run_across_stretches_of_a_chain(spark):
    index = reachability.build_index(spark.range(1, 95).select(F.col("id").alias("child"), (F.col("id") - 1).alias("parent")))
    ranges = reachability.ancestor_ranges(index, spark.createDataFrame([(94,), (31,)], "start BIGINT"))
    sums = {tuple(r) for r in reachability.range_sums(index, ranges, F.col("node"), per_bucket=10).collect()}
    assert sums == {(94, 94, sum(range(94))), (31, 31, sum(range(31)))}


def test_folds_carry_one_digest_a_row(spark):
    from corpusloom.corpus import Branch
    from corpusloom.schema import BRANCH_TABLES

    names = BRANCH_TABLES["node_revisions"].names
    rows = lambda title: spark.createDataFrame([tuple(title if n == "title" else "k" if n == "revision_uuid" else None if n == "description" else "v" for n in names)],
                                               BRANCH_TABLES["node_revisions"].schema)
    sides = [Branch(spark, {"node_revisions": rows(t)}, "n", "c") for t in ("one", "two", "one")]
    folded = branches._folded(sides, "node_revisions")
    assert "min_by" not in folded._jdf.queryExecution().toString()
    row = folded.first()
    assert row["_low"] != row["_high"] and row["title"] in ("one", "two") and row["description"] is None
    again = branches._folded(list(reversed(sides)), "node_revisions").first()
    assert again == row


def test_blocks_are_summed_from_their_postings(spark):
    nodes = spark.createDataFrame([(f"u{n}", f"P{n}", "a title", "alpha beta " * (n % 7) + "gamma") for n in range(200)],
                                  "uuid STRING, pointer STRING, title STRING, description STRING")
    index = build_search_index(nodes)
    built = build_blocks(index)
    blocks = summed_blocks(built.postings)
    assert sorted(map(tuple, blocks.collect())) == sorted(map(tuple, built.blocks.collect()))
    queries = spark.createDataFrame([(1, "alpha beta"), (2, "gamma")], "query_id BIGINT, query STRING")
    page, _ = pruned_search(index, BlockIndex(built.postings, blocks, built.docs), queries, limit=5)
    whole = search(index, queries, limit=5).select("query_id", "uuid", "rank", "position")
    assert sorted(map(tuple, page.select("query_id", "uuid", "rank", "position").collect())) == sorted(map(tuple, whole.collect()))


def test_ids_are_packed_and_spelled_again(spark):
    texts = ["8f94d91d-6f6a-5227-8174-41becfe4dbb8", "00000000-0000-0000-0000-000000000000", "8F94D91D-6f6a-5227-8174-41becfe4dbb8", "E1", "", "a" * 16,
             "8f94d91d-6f6a-5227-8174-41becfe4dbb8\n", "8f94d91d6f6a5227817441becfe4dbb8", "żółć", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t STRING").select("t", ids.packed("t").alias("p"))
    found = rows.select("t", F.octet_length("p").alias("n"), ids.spelled("p").alias("again")).collect()
    assert all(r.t == r.again for r in found) and [r.n for r in found[:2]] == [16, 16] and len({bytes(r.p) for r in rows.where("p IS NOT NULL").collect()}) == 9


def test_triples_are_dealt_with_packed_ids(spark):
    name = lambda i: f"00000000-0000-5000-8000-{i:012d}"
    identity = spark.createDataFrame([(name(i), f"E{i}") for i in range(4)] + [("odd", "E9"), ("odd", "E9")], "uuid STRING, pointer STRING")
    triples = spark.createDataFrame([(name(7), name(0), name(1), name(2), "t"), ("x", "odd", name(1), name(3), None), (None, name(2), name(1), "odd", "t"),
                                     ("y", "gone", name(1), name(3), "t"), ("z", None, name(1), name(3), "t")],
                                    "triple_uuid STRING, subject_uuid STRING, predicate_uuid STRING, object_uuid STRING, created_at STRING")
    rows = views.triples_readable(Corpus(spark, {"node_identity": identity, "triples": triples}, name(0), name(0)))
    expected = [(name(7), "E0", "E1", "E2", "t")] + [("x", "E9", "E1", "E3", None)] * 2 + [(None, "E2", "E1", "E9", "t")] * 2
    assert sorted(map(tuple, rows.collect()), key=repr) == sorted(expected, key=repr)
    joins = [line for line in rows._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]
    assert len(joins) == 3 and rows.schema["triple_uuid"].dataType.simpleString() == "string"
    assert "unhex" in rows._jdf.queryExecution().optimizedPlan().toString()


def test_first_orders_are_found_without_sorting(spark, tmp_path):
    orders = spark.sql("""SELECT * FROM VALUES (7L, 1L, 'F', '2-HIGH', TIMESTAMP '1995-01-02', 10.0D), (3L, 1L, 'F', '2-HIGH', TIMESTAMP '1996-01-02', 11.0D),
        (3L, 1L, 'F', '2-HIGH', TIMESTAMP '1996-01-02', 11.0D), (CAST(NULL AS BIGINT), 1L, 'O', '5-LOW', TIMESTAMP '1994-01-02', 12.0D),
        (CAST(NULL AS BIGINT), 2L, 'O', '5-LOW', TIMESTAMP '1994-01-02', 13.0D), (1L, 1L, 'P', '5-LOW', TIMESTAMP '1994-01-02', 14.0D)
        AS t(o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_orderdate, o_totalprice)""")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    rows = bindings.branch(spark, str(tmp_path), "east").tables.builders["object_alias_assertions"]()
    first = rows.where("alias_text LIKE 'CUST%'")
    found = {r.alias_text: (r.object_uuid, r.operation_uuid, r.created_at) for r in first.collect()}
    operation = ids.derived_uuid_col(bindings.NAMESPACE, "order-operation", F.lit(3))
    told = spark.range(1).select(ids.uuid5_of(operation, F.lit("object:node")), operation).first()
    assert found == {"CUST1": (*told, "1996-01-02T00:00:00.000000003Z"), "CUST2": (None, None, None)} and first.count() == 2
    assert "SortAggregate" not in first._jdf.queryExecution().executedPlan().toString()


def test_a_batch_asks_only_for_tables_that_its_operations_need(spark, make_corpus):
    c = make_corpus([("E1", "one", "x")], graphs=(("tags", "T", "T0"), ("examples", "E", "E0")), tags=("E1",))
    asked = set()

    def noted(name):
        asked.add(name)
        return c.tables[name]

    watched = replace(c, tables=LazyTables({name: (lambda name=name: noted(name)) for name in c.tables}))
    ops = spark.createDataFrame([(0, "T1", "tag", "see [one](E1)")], "index BIGINT, pointer STRING, title STRING, description STRING")
    plan = changes.create_tags(watched, ops)
    assert plan.rejections.collect() == [] and [r["pointer"] for r in plan.appended["node_identity"].collect()] == ["T1"]
    assert plan.appended["reference_occurrences"].count() == 1
    assert not asked & {"triples", "predicate_registry", "node_tags"}
    asked.clear()
    watched = replace(c, tables=LazyTables({name: (lambda name=name: noted(name)) for name in c.tables}))
    tags = changes.assign_tags(watched, spark.createDataFrame([(0, "E0", "E1"), (1, "E404", "E1")], "index BIGINT, subject_pointer STRING, tag_pointer STRING"))
    assert tags.appended["node_tags"].count() == 1 and [r["code"] for r in tags.rejections.collect()] == ["node_not_found"]
    assert not asked & {"triples", "predicate_registry", "graph_membership", "node_revision"}


def test_a_check_derives_only_the_tables_that_it_reads(spark, make_corpus, monkeypatch, tmp_path):
    c = make_corpus([("E1", "one", "x")])
    asked = set()

    def noted(name):
        asked.add(name)
        return c.tables[name]

    for name, columns in {"supplier": "0L AS s_suppkey, -1D AS s_acctbal", "part": "0L AS p_partkey, 1 AS p_size", "customer": "0L AS c_custkey, 'BUILDING' AS c_mktsegment"}.items():
        spark.sql(f"SELECT {columns}").write.parquet(f"{tmp_path}/{name}.parquet")
    monkeypatch.setattr(bindings, "corpus", lambda *_: replace(c, tables=LazyTables({name: (lambda name=name: noted(name)) for name in c.tables})))
    assert quality.check_uuid(change_queries.damaged(spark, str(tmp_path))).collect() == []
    assert asked == {"node_identity"}


def test_references_are_counted_before_they_meet_the_keys(spark, make_corpus):
    c = make_corpus([("E1", "one", "x")], predicates=("E1",))
    known = c["node_identity"].where("pointer = 'E1'").first()["uuid"]
    rows = [(f"t{i}", known, "gone", known if i % 2 else None, "now") for i in range(6)]
    triples = spark.createDataFrame(rows, "triple_uuid STRING, subject_uuid STRING, predicate_uuid STRING, object_uuid STRING, created_at STRING")
    found = quality.check_foreign_keys(c.with_tables(triples=triples), ["triples"])
    assert "triples.predicate_uuid=gone" in {r["key"] for r in found.where("detail = '6'").collect()}
    assert not found.where("key LIKE 'triples.subject%' OR key LIKE 'triples.object%'").collect()
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and 0 <= plan.index("LeftOuter") < plan.index("Aggregate")


def test_last_revisions_are_those_of_the_chains(spark, tmp_path):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(minutes=37 * (i * 7 % 11)), i % 3, "view", 1.0, "p") for i in range(20)]
    rows += [(3, rows[3][1], 0, "view", 1.0, "p"), (None, start + timedelta(days=9), 1, "view", 1.0, "p"), (40, None, 1, "view", 1.0, "p"), (41, start, None, "view", 1.0, "p")]
    spark.createDataFrame(rows, "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING").write.parquet(f"{tmp_path}/events.parquet")
    chained = bindings.user_revisions(spark, str(tmp_path))
    wanted = chained.groupBy("node_uuid").agg(F.max_by("revision_uuid", F.struct("ts", "event_id")).alias("r")).collect()
    found = bindings.last_revisions(spark, str(tmp_path)).collect()
    assert {(r["node_uuid"], r["current_revision_uuid"]) for r in found} == {tuple(r) for r in wanted} and len(found) == 3
    names = {r["revision_uuid"]: (r["user_id"], r["event_id"]) for r in chained.collect()}
    links = {(names[r["revision_uuid"]], names.get(r["previous_revision_uuid"])) for r in chained.collect() if r["user_id"] == 2}
    order = sorted((r for r in rows if r[2] == 2), key=lambda r: (r[1], r[0]))
    assert links == {((2, r[0]), (2, p[0]) if p else None) for p, r in zip([None, *order], order)}


def test_words_are_counted_where_their_node_is(spark):
    nodes = spark.createDataFrame([("a", "E1", "one two", "two three two"), ("a", "E1", "one two", "two"), ("b", "E2", "x", "y"), ("c", "E3", None, "z")],
                                  "uuid STRING, pointer STRING, title STRING, description STRING")
    postings = build_search_index(nodes).postings
    plan = postings._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("RepartitionByExpression")
    assert postings._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    found = {(r["term"], r["uuid"]): r["tf"] for r in postings.collect()}
    assert found == {("e1", "a"): 2, ("one", "a"): 2, ("two", "a"): 5, ("three", "a"): 1, ("e2", "b"): 1, ("x", "b"): 1, ("y", "b"): 1}


def _connected(spark, make_corpus):
    """Chains E1 to E3 and E5 to E44, linked by triples of one predicate."""
    c = make_corpus([(f"E{i}", f"title {i}", "x") for i in range(1, 45)], predicates=("E4",))
    u = lambda name: ids.uuid5_col("6ba7b811-9dad-11d1-80b4-00c04fd430c8", name)
    pairs = [("E1", "E2"), ("E1", "E2"), ("E2", "E3"), *((f"E{i}", f"E{i + 1}") for i in range(5, 44))]
    rows = spark.createDataFrame([(*p, f"{i:04d}") for i, p in enumerate(pairs)], "s STRING, o STRING, created_at STRING")
    rows = rows.select(ids.derived_uuid_col("6ba7b811-9dad-11d1-80b4-00c04fd430c8", "triple", "s", "o", "created_at").alias("triple_uuid"),
                       u("s").alias("subject_uuid"), u(F.lit("E4")).alias("predicate_uuid"), u("o").alias("object_uuid"), "created_at")
    return c.with_tables(triples=durable.checkpointed(rows))


def test_triples_are_not_dealt_by_their_predicate(spark, make_corpus):
    c = _connected(spark, make_corpus)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        page = graph.list_triples(c, limit=1)
        assert "hashpartitioning(predicate_uuid" not in page._jdf.queryExecution().executedPlan().toString()
        found = {r["pointer"]: r for r in page.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    known = {r["triple_uuid"]: r for r in c["triples"].where("created_at = '0000'").collect()}
    first = found["E1"]
    assert (first["subject_pointer"], first["predicate_pointer"], first["object_pointer"], first["total"], first["next_cursor"]) == ("E1", "E4", "E2", 2, 1)
    assert all(first[k] == known[first["triple_uuid"]][k] for k in ("subject_uuid", "predicate_uuid", "object_uuid")) and len(found) == 41


def test_context_reads_the_edges_of_reached_nodes_only(spark, make_corpus, monkeypatch):
    c, made = _connected(spark, make_corpus), []

    def noted(df, keep=durable.checkpointed):
        kept = keep(df)
        if {"first", "last", "source"} <= set(kept.columns):
            made.append(kept)
        return kept

    monkeypatch.setattr(graph, "checkpointed", noted)
    members, packs = graph.context_packs(c, spark.createDataFrame([("E1",)], "pointer STRING"))
    names = {r["uuid"]: r["pointer"] for r in c["node_identity"].collect()}
    assert [(names[r["uuid"]], r["pointer"]) for r in members.orderBy("position").collect()] == [("E1", "E1"), ("E2", "E2"), ("E3", "E3")]
    assert packs.first()["node_count"] == 3 and sum(df.count() for df in made) == 2


def test_links_are_read_once_for_the_index(spark, make_corpus):
    c = make_corpus([("E1", "one", "see [two](E2)"), ("E2", "two", "see [one](E1) and [lost](E404)")])
    index = build_reference_index(c)
    assert index._jdf.queryExecution().optimizedPlan().toString().count("Generate posexplode") == 1
    assert [(r["canonical_uri"], r["ordinal"], len(r["target_uuid"])) for r in index.collect()] == [("E2", 0, 36)]


def test_revisions_without_a_request_do_not_meet_in_one_task(spark, make_corpus):
    c = make_corpus([(f"E{i}", f"title {i}", "x") for i in range(1, 9)])
    asked = spark.createDataFrame([(i, f"E{i}", 0) for i in range(1, 10)], "request_id LONG, pointer STRING, at LONG")
    seen = views.as_of_sequence(c, asked)
    joins = [line for line in seen._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join LeftOuter" in line]
    assert joins and not any("request_uuid" in line for line in joins)
    assert {r["request_id"]: r["title"] for r in seen.collect()} == {**{i: f"title {i}" for i in range(1, 9)}, 9: None}


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _held(spark, label, rows):
    """A branch whose aliases and objects are (key, text) pairs; keys may repeat or be null."""
    given = spark.createDataFrame(rows, "key STRING, text STRING")
    spec = schema.BRANCH_TABLES
    tables = {"object_alias_assertions": shaped(given.select(F.col("key").alias("assertion_uuid"), F.col("text").alias("alias_text")), spec["object_alias_assertions"]),
              "semantic_objects": shaped(given.select(F.col("key").alias("object_uuid"), F.lit("node").alias("object_kind")), spec["semantic_objects"]),
              "corpus_components": spark.createDataFrame([(bindings.CORPUS_ID, bindings.CORPUS_ID)], spec["corpus_components"].schema)}
    return Branch(spark, tables, bindings.NAMESPACE, bindings.CORPUS_ID, head=Head(bindings.CORPUS_ID, label, 1), workspace_uuid=label)


def test_fingerprints_of_compositions_from_one_pass(spark, monkeypatch):
    a = _held(spark, "a", [("k1", "x"), ("k1", "x"), ("k1", "y"), ("k2", "z"), (None, "n"), (None, "m")])
    b, c = _held(spark, "b", [("k1", "w"), ("k3", "q"), (None, "n")]), _held(spark, "c", [])
    made = lambda *bs: branches.compose(list(bs), "00000000-0000-0000-0000-000000000000", "")[0]
    states = {"a": a, "c": c, "aa": made(a, a), "ab": made(a, b), "ba": made(b, a), "(ab)c": made(made(a, b), c), "cc": made(c, c),
              "lost": made(a, b).with_tables(semantic_objects=a["semantic_objects"])}
    expected = {name: fingerprints.fingerprint(s).first().fingerprint for name, s in states.items()}
    assert {r.state: r.fingerprint for r in branches.fingerprints(states).collect()} == expected
    assert expected["ab"] == expected["ba"] == expected["(ab)c"] and len({expected[x] for x in ("a", "aa", "ab", "lost", "c")}) == 5
    assert {r.law: r.holds for r in branches.merge_laws([a, b, c]).collect()} == {
        "idempotent": False, "commutative": True, "associative_left": True, "associative_right": True}
    read, given = [], Branch.__getitem__
    monkeypatch.setattr(Branch, "__getitem__", lambda s, name: read.append((s.workspace_uuid, name)) or given(s, name))
    branches.fingerprints({name: s for name, s in states.items() if name != "lost"})
    assert read.count(("a", "semantic_objects")) == read.count(("b", "semantic_objects")) == 1


def test_collisions_deal_keys_and_digests_only(spark):
    a = _held(spark, "a", [("k1", "x"), ("k1", "x"), ("k2", "z"), (None, "n"), ("6ba7b811-9dad-11d1-80b4-00c04fd430c8", "u")])
    b = _held(spark, "b", [("k1", "w"), ("k2", "z"), (None, "m"), ("6ba7b811-9dad-11d1-80b4-00c04fd430c8", "v")])
    found = branches.collisions([a, b])
    assert sorted(map(tuple, found.collect())) == [("object_alias_assertions", x) for x in ("", "6ba7b811-9dad-11d1-80b4-00c04fd430c8", "k1")]
    assert [tuple(r) for r in branches.collisions_by_table([a, b]).collect()] == [("object_alias_assertions", 3)]
    plan = _plan(branches._collided([a, b], "object_alias_assertions"))
    dealt = plan[plan.index("RepartitionByExpression"):].splitlines()[1:3]
    assert "unhex" in " ".join(dealt) and "alias_text#" not in plan.split("RepartitionByExpression")[0]


def test_shuffles_go_with_the_step_that_made_them(spark, tmp_path):
    setting = durable._RELEASE
    before = spark.conf.get(setting)
    context = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    folders = [Path(str(x)) for x in context.blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for folder in folders for f in folder.glob("*/shuffle_*")}
    old = files()
    kept = durable.checkpointed(spark.range(20_000).groupBy((F.col("id") % 1_000).alias("k")).agg(F.sum("id").alias("s")))
    assert not files() - old and kept.count() == 1_000 and kept.agg(F.sum("s")).first()[0] == sum(range(20_000))
    assert spark.conf.get(setting) == before


def test_promotions_are_judged_once(spark, make_corpus):
    c = make_corpus([("E1", "One", "See [nothing](E9).", "staged"), ("E2", "Two", "Plain.", "staged"), ("E3", "Three", "Plain.")])
    ops = spark.createDataFrame([(i, f"E{i}") for i in (1, 2, 3, 4)], "index BIGINT, pointer STRING")
    plan = changes.promote_nodes(c, ops)
    assert {tuple(r) for r in plan.rejections.collect()} == {(1, "unresolved_pointer", "E9"), (3, "not_staged", "E3"), (4, "node_not_found", "E4")}
    assert {r.node_uuid for r in plan.appended["graph_membership"].collect()} == {r.uuid for r in c["node_identity"].where("pointer IN ('E1', 'E2')").collect()}
    # The reasons are read, not found again for each that asks for them.
    assert "not_staged" not in _plan(plan.rejections)


def test_changes_are_settled_without_the_tables_that_they_change(spark, make_corpus):
    c = make_corpus([("E1", "One", "First."), ("E2", "Two", "Second."), ("E3", "Three", "See [one](E1).")])
    ops = spark.createDataFrame([(1, "E1", "Uno")], "index BIGINT, pointer STRING, title STRING")
    plan = changes.revise_nodes(c, ops)
    settled = plan.settled({"node_identity", "node_revision"})
    assert settled.appended["node_revision"].count() == 1 and settled.replaced["node_identity"].count() == 1
    assert "Join" not in _plan(settled.replaced["node_identity"]) and settled.replaced["staging_queue"] is plan.replaced["staging_queue"]
    rows = lambda corpus, name: sorted(map(str, corpus[name].collect()))
    for name in ("node_identity", "node_revision", "reference_occurrences"):
        assert rows(settled.applied_to(c), name) == rows(plan.applied_to(c), name)


def test_triples_are_told_by_their_numbers_not_stored(spark, tmp_path):
    rows = {"nation": "SELECT 1 AS n_nationkey, 0 AS n_regionkey", "customer": "SELECT 7 AS c_custkey, 1 AS c_nationkey",
            "supplier": "SELECT 3 AS s_suppkey, 1 AS s_nationkey", "orders": "SELECT 9L AS o_orderkey, 7 AS o_custkey",
            "lineitem": "SELECT 9L AS l_orderkey, 4L AS l_partkey, 3L AS l_suppkey UNION ALL SELECT 9L, 4L, 3L"}
    c = bindings.corpus(spark, str(tmp_path))
    derived = lambda: shaped(bindings.triple_rows(spark, str(tmp_path)).select(
        *[ids.uuid5_col(bindings.NAMESPACE, f"{role}_pointer").alias(f"{role}_uuid") for role in ("subject", "predicate", "object")], "created_at"), schema.CORPUS_TABLES["triples"])
    for name, sql in rows.items():
        spark.sql(sql).write.parquet(f"{tmp_path}/{name}.parquet")
    c.tables.builders["triples"] = derived
    assert c["triples"].count() == 6 and c["triples"].where("subject_uuid IS NULL").count() == 0
    assert (spark.sparkContext.applicationId, str(tmp_path), "triples") not in durable.StoredTables._written
