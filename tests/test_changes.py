import json
import uuid
from dataclasses import replace

import pytest
from conftest import CORPUS_ID, NAMESPACE
from pyspark.sql import functions as F

from corpusloom.corpus import Branch, Head
from corpusloom.functions import ids
from corpusloom.operators import aggregates, branches, changes, fingerprints, quality, views
from corpusloom.operators.references import build_reference_index
from corpusloom.sources import snapshots
from corpusloom.streaming import ingest


def _ops(spark, *rows):
    fields = [f.name for f in changes.OPERATION.fields]
    return spark.createDataFrame([tuple({"index": i, "request_uuid": "r", **r}.get(f) for f in fields) for i, r in enumerate(rows)], changes.OPERATION)


def _create(pointer, description="text", graph="examples", title="t"):
    return {"operation": "node.create", "pointer": pointer, "title": title, "description": description, "graph_key": graph}


def _codes(plan):
    return {(r["index"], r["code"]) for r in plan.rejections.collect()}


def test_batch_sees_its_own_earlier_operations(spark, make_corpus):
    c = make_corpus([("E1", "one", "x"), ("EP", "predicate", "p")], predicates=("EP",))
    plan = changes.plan_changes(c, _ops(
        spark, _create("E2", "[one](E1) and [self](E2)"), {"operation": "node.update", "pointer": "E2", "title": "second"},
        {"operation": "triple.add", "subject_pointer": "E2", "predicate_pointer": "EP", "object_pointer": "E1"},
        {"operation": "triple.add", "subject_pointer": "E2", "predicate_pointer": "EP", "object_pointer": "E1"},
        {"operation": "traversal.embed", "pointer": "E2", "notation": "(E1):(E2)", "read": "as one"},
        {"operation": "node.update", "pointer": "E1", "title": "one"}))
    assert _codes(plan) == set()
    assert {r["index"]: r["outcome"] for r in plan.results.collect()} == {0: "done", 1: "done", 2: "done", 3: "already_present", 4: "done", 5: "unchanged"}
    after = plan.applied_to(c).settled()
    row = views.current_nodes(after).where("pointer = 'E2'").first()
    assert row["title"] == "second"
    assert row["description"] == "[one](E1) and [self](E2)\n\n### Traversal expression\n\n```pgx-traversal\n[(E1):(E2)]\n```\n\nRead: as one"
    chain = {r["revision_uuid"]: r["previous_revision_uuid"] for r in after["node_revision"].collect()}
    walked, at = 0, row["revision_uuid"]
    while at is not None:
        walked, at = walked + 1, chain[at]
    assert walked == 3
    assert after["triples"].count() == 1 and after["reference_occurrences"].count() == 2
    assert quality.validate(after).where("key NOT LIKE 'reference_occurrences%'").collect() == []
    assert quality.check_append_only(c, after).count() == 0


def test_rejections(spark, make_corpus):
    c = make_corpus([("E1", "one", "x"), ("E3", "waits", "[gone](E9)", "staged")], graphs=(("examples", "E", "E0"), ("experiments", "EXP", "EXP0")))
    plan = changes.plan_changes(c, _ops(
        spark, _create("E1"), _create("E5", "[later](E6)"), _create("E6"), _create("EXP1"), _create("Z1"), _create("E7", graph="nowhere"), _create("9bad"),
        {"operation": "node.update", "pointer": "E1", "title": "x", "expected_revision_uuid": "old"}, {"operation": "node.update", "pointer": "E404", "title": "x"},
        {"operation": "traversal.embed", "pointer": "E1", "notation": "(E1)(E0)"}, {"operation": "traversal.embed", "pointer": "E0", "notation": "(E404)"},
        {"operation": "triple.add", "subject_pointer": "E1", "predicate_pointer": "E0", "object_pointer": "E1"}, {"operation": "node.erase", "pointer": "E1"},
        {"operation": "node.promote", "pointer": "E3"}, {"operation": "node.promote", "pointer": "E1"}, _create("E8", title="two\nlines")))
    assert _codes(plan) >= {(0, "pointer_exists"), (1, "unresolved_pointer"), (3, "more_specific_namespace"), (4, "outside_namespace"), (5, "unknown_graph"),
                            (6, "pointer_grammar"), (7, "stale_write"), (8, "node_not_found"), (9, "unlawful_notation"), (10, "node_not_found"),
                            (11, "predicate_not_registered"), (12, "unsupported_operation"), (13, "unresolved_pointer"), (14, "not_staged"), (15, "invalid_title")}
    assert not {i for i, _ in _codes(plan)} & {2}


def test_staging_and_promotion(spark, make_corpus):
    c = make_corpus([("E1", "one", "x")])
    stage = lambda p, d: {"operation": "node.stage", "pointer": p, "title": "t", "description": d, "graph_key": "examples"}
    c2 = changes.plan_changes(c, _ops(spark, stage("E2", "[one](E1)"), stage("E3", "[gone](E9) [more](E8)"))).applied_to(c).settled()
    assert {r["pointer"]: r["status"] for r in views.staging_worklist(c2).collect()} == {"E2": "pending", "E3": "blocked"}
    assert c2["staging_issues"].count() == 2
    fixed = changes.plan_changes(c2, _ops(spark, {"operation": "node.update", "pointer": "E3", "description": "fine"}), "2000-01-02 00:00:00")
    c3 = fixed.applied_to(c2).settled()
    assert {r["status"] for r in views.staging_worklist(c3).collect()} == {"pending"} and c3["staging_issues"].count() == 0
    done = changes.promote_nodes(c3, _ops(spark, {"pointer": "E2"}, {"pointer": "E3"}), "2000-01-03 00:00:00")
    assert _codes(done) == set()
    c4 = done.applied_to(c3).settled()
    assert c4["staging_queue"].count() == 0 and views.nodes(c4).count() == 4
    assert quality.check_transitions(c3, c4).count() == 0 and quality.check_transitions(c4, c3).count() == 2


def test_tags_graphs_sentinels_and_revert(spark, make_corpus):
    c = make_corpus([("E1", "one", "x")], graphs=(("examples", "E", "E0"), ("tags", "TGN", "TGN000"), ("sentinels", "SNT", "SNT000")))
    first = c["node_identity"].where("pointer = 'E1'").first()["current_revision_uuid"]
    plan = changes.plan_changes(c, _ops(
        spark, {"operation": "tag.create", "pointer": "TGN1", "title": "tag", "description": "d"}, {"operation": "tag.assign", "subject_pointer": "E1", "tag_pointer": "TGN1"},
        {"operation": "tag.assign", "subject_pointer": "E1", "tag_pointer": "TGN1"}, {"operation": "graph.create", "pointer": "K0", "title": "k", "description": "d", "graph_key": "kind", "pointer_prefix": "K"},
        {"operation": "sentinel.create", "pointer": "SNT1", "title": "s", "description": "mind this"}, {"operation": "node.update", "pointer": "E1", "title": "changed"}))
    assert _codes(plan) == set()
    after = plan.applied_to(c).settled()
    asked = spark.createDataFrame([("E1",)], "pointer STRING")
    assert [r["tags"] for r in views.get_nodes(after, asked).collect()] == [["TGN1"]]
    assert {r["graph_key"]: r["node_count"] for r in aggregates.graph_summary(after).collect()}["kind"] == 1
    assert [r["pointer"] for r in views.sentinels(after).collect()] == ["SNT1"]
    assert _codes(changes.create_graphs(after, _ops(spark, {"pointer": "Q0", "title": "q", "description": "d", "graph_key": "kind", "pointer_prefix": "Q"}))) == {(0, "graph_exists")}
    back = changes.revert_nodes(after, _ops(spark, {"pointer": "E1", "target_revision_uuid": first}), "2000-01-02 00:00:00")
    assert [r["title"] for r in back.appended["node_revision"].collect()] == ["one"]
    assert _codes(changes.revert_nodes(after, _ops(spark, {"pointer": "E0", "target_revision_uuid": first}))) == {(0, "revision_not_found")}


def _commit(spark, c, ops, root, request="a", at="2000-01-01 00:00:00"):
    plan = changes.plan_changes(c, ops, at)
    head, _ = changes.next_head(c, c.head, request, "batch.apply", "h", {})
    return snapshots.commit_changes(c, plan, root, head)


def test_commits_are_atomic_and_ordered(spark, make_corpus, tmp_path, monkeypatch):
    root = str(tmp_path / "corpus")
    start = make_corpus([("E1", "one", "x")])
    c0 = snapshots.write_corpus(start, root, start.head)
    c1 = _commit(spark, c0, _ops(spark, _create("E2", "[one](E1)")), root)
    assert c1.head.sequence == 1 and views.nodes(c1).count() == 3 and snapshots.read_head(spark, root) == c1.head
    with pytest.raises(snapshots.StaleHead):
        _commit(spark, c0, _ops(spark, _create("E3")), root)
    with pytest.raises(snapshots.RejectedBatch):
        _commit(spark, c1, _ops(spark, _create("E4"), _create("E1")), root)
    assert snapshots.read_corpus(spark, root).head == c1.head
    c2 = _commit(spark, c1, _ops(spark, {"operation": "node.update", "pointer": "E2", "description": "[one](E1) [again](E1)"}), root, "b", "2000-01-02 00:00:00")
    assert c2["reference_occurrences"].count() == 2 and c2["node_revision"].count() == c1["node_revision"].count() + 1
    assert quality.check_reference_index(c2).count() == 0
    # the commit wrote the changed node's rows and keys only
    written = {name: spark.read.parquet(str(p)).count() for name in ("node_identity-new", "node_identity-replaced", "reference_occurrences", "reference_occurrences-removed")
               for p in [tmp_path / "corpus" / "data" / c2.head.snapshot_uuid / name]}
    assert written == {"node_identity-new": 1, "node_identity-replaced": 1, "reference_occurrences": 2, "reference_occurrences-removed": 1}
    monkeypatch.setattr(snapshots, "COMPACT_AFTER", 2)
    c3 = _commit(spark, c2, _ops(spark, {"operation": "node.update", "pointer": "E2", "title": "third"}), root, "c", "2000-01-03 00:00:00")
    assert (tmp_path / "corpus" / "data" / c3.head.snapshot_uuid / "node_identity-whole").exists()
    titles = {r["pointer"]: r["title"] for r in views.nodes(c3).collect()}
    assert titles["E2"] == "third" and len(titles) == 3 and c3["reference_occurrences"].count() == 2


def test_log_ingest(spark, make_corpus, tmp_path):
    root, log, check = str(tmp_path / "corpus"), tmp_path / "log", str(tmp_path / "check")
    log.mkdir()
    start = make_corpus([("E1", "one", "x")])
    snapshots.write_corpus(start, root, start.head)

    def line(request, tool, ts, **arguments):
        return json.dumps({"request_id": request, "tool": tool, "ts": f"2024-01-01T00:{ts:02d}:00Z", "arguments": arguments, "change_set_id": "cs"})

    create = line("r1", "node.create", 1, pointer="E2", title="two", description="[one](E1)", graph_key="examples")
    (log / "a.json").write_text("\n".join([create, create, "junk",
        line("r2", "node.update", 2, pointer="E2", title="deux"), line("r3", "node.update", 3, pointer="E9", title="no such node"),
        line("r4", "node.create", 4, pointer="E3", title="t", description="d", graph_key="examples"),
        line("r4", "node.create", 5, pointer="E4", title="t", description="d", graph_key="examples")]) + "\n")
    run = lambda: ingest.ingest_oplog(ingest.oplog_stream(spark, str(log)), root, check).awaitTermination()
    run()
    c = snapshots.read_corpus(spark, root)
    assert {r["pointer"]: r["title"] for r in views.nodes(c).collect()}["E2"] == "deux"
    assert {(r["request_uuid"], r["database_sequence"]) for r in c["operation_ledger"].collect()} == {("r1", 1), ("r2", 2)}
    assert [r["ordinal"] for r in c["change_set_receipts"].orderBy("ordinal").collect()] == [1, 2]
    refused = {(r["request_id"], r["code"]) for r in spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/refused").collect()}
    assert refused == {("r3", "node_not_found"), ("r4", "request_reused"), (None, "corrupt_line")}
    # a request that is days late, and one of the same second as the batch before
    late = line("r6", "node.create", 0, pointer="E6", title="six", description="d", graph_key="examples").replace("2024-01-01", "2023-12-20")
    (log / "b.json").write_text("\n".join([create, late, line("r5", "node.create", 5, pointer="E5", title="five", description="d", graph_key="examples")]) + "\n")
    run()
    later = snapshots.read_corpus(spark, root)
    assert later.head.sequence == 2 and later["operation_ledger"].count() == 4
    assert {r["database_sequence"] for r in later["operation_ledger"].collect()} == {1, 2, 3, 4}
    old, new = ({r["created_at"] for r in x.collect()} for x in (c["node_revision"], later["node_revision"].join(c["node_revision"], "revision_uuid", "left_anti")))
    assert len(new) == 2 and min(new) > max(old)
    chain = later["semantic_snapshots"]
    assert chain.count() == 2 and fingerprints.verify_snapshot_chain(chain.where("database_sequence = 1")).count() == 1  # its parent is not in the table
    assert {r["code"] for r in fingerprints.verify_snapshot_chain(chain).collect()} <= {"parent_missing"}


def test_request_reuse_against_the_ledger(spark):
    log = spark.createDataFrame([("a", "t", "h1"), ("a", "t", "h1"), ("b", "t", "h1"), ("b", "t", "h2"), ("c", "t", "h1"), ("d", "t", "h9")], "request_id STRING, tool STRING, input_hash STRING")
    ledger = spark.createDataFrame([("c", "h1"), ("d", "h1")], "request_uuid STRING, input_hash STRING")
    assert {(r["request_id"], r["disposition"]) for r in changes.dedupe_requests(log, ledger).collect()} == {("a", "new"), ("b", "conflict"), ("c", "replay"), ("d", "conflict")}


def _workspace(spark, label, corpus_id=CORPUS_ID):
    uid = lambda kind: str(uuid.uuid5(uuid.UUID(NAMESPACE), f"{kind}:{label}"))
    return Branch(spark, {"corpus_components": spark.createDataFrame([(corpus_id, corpus_id)], "composite_corpus_uuid STRING, component_corpus_uuid STRING")},
                  NAMESPACE, corpus_id, head=Head(corpus_id, uid("head"), 1), workspace_uuid=uid("w"), replica_uuid=uid("r"))


def test_forks_compose(spark):
    objects = lambda *rows: spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "index BIGINT, alias STRING, title STRING, description STRING, object_kind STRING")
    origin = _workspace(spark, "origin")
    made = changes.create_objects(origin, objects(("G", "graph", "g", "graph"), ("A", "shared", "s", "node")))
    origin = made.applied_to(origin).settled()
    ids_ = {r["index"]: (r["object_uuid"], r["revision_uuid"]) for r in made.results.collect()}

    def fork(label):
        other = replace(_workspace(spark, label), tables=dict(origin.tables))
        other = changes.create_objects(other, objects(("CWV27", label, "d", "node")), "2001-01-01 00:00:00").applied_to(other)
        revise = spark.createDataFrame([(0, *ids_[1], f"by {label}", "d")], "index BIGINT, object_uuid STRING, parent_revision_uuid STRING, title STRING, description STRING")
        other = changes.revise_objects(other, revise, "2001-01-02 00:00:00").applied_to(other)
        join = spark.createDataFrame([(0, ids_[0][0], ids_[1][0], "10")], "index BIGINT, graph_uuid STRING, object_uuid STRING, order_key STRING")
        return changes.add_memberships(other, join, "2001-01-03 00:00:00").applied_to(other).settled()

    a, b = fork("a"), fork("b")
    op = "00000000-0000-4000-8000-000000000009"
    whole, collided = branches.compose([a, b], op, "2002")
    assert collided.count() == 0
    assert {(r["alias"], r["object_count"]) for r in branches.alias_conflicts(whole).collect()} == {("CWV27", 2)}
    assert {(r["object_uuid"], r["frontier_count"]) for r in branches.frontier_conflicts(whole).collect()} == {(ids_[1][0], 2)}
    assert branches.verify_state(whole).first()["matches"] and whole.corpus_id == CORPUS_ID
    assert whole["graph_membership_assertions"].count() == 2 and whole["snapshot_parents"].count() == 2
    assert all(r["holds"] for r in branches.merge_laws([a, b, origin]).collect())
    tampered = b.with_tables(node_revisions=b["node_revisions"].withColumn("title", F.lit("changed")))
    assert branches.compose([a, tampered], op, "2002")[1].where("table_name = 'node_revisions'").count() == 2
    foreign = branches.compose([a, _workspace(spark, "z", "11111111-1111-4111-8111-111111111111")], op, "2002")[0]
    names = ":".join(sorted([CORPUS_ID, "11111111-1111-4111-8111-111111111111"]))
    assert foreign.corpus_id == str(uuid.uuid5(uuid.UUID(ids.COMPOSITE_NAMESPACE), f"composite:{names}"))
    bad = spark.createDataFrame([(0, ids_[1][0], ids_[1][0], "1")], "index BIGINT, graph_uuid STRING, object_uuid STRING, order_key STRING")
    assert changes.add_memberships(origin, bad).rejections.count() == 1


def test_lineage_and_handoffs(spark, make_corpus):
    left, right = make_corpus([("K1", "left", "x")], graphs=(("kind", "K", "K0"),)), make_corpus([("K2", "right", "x")], graphs=(("kind", "K", "K0"),))
    assert {(r["pointer"], r["difference"]) for r in branches.compare(left, right).collect()} == {("K1", "left_only"), ("K2", "right_only")}
    report = branches.compare_report(left, right, cap=1).collect()
    assert [(r["pointer"], r["candidate_count"]) for r in report] == [("K1", 2)]
    schema = "handoff_id STRING, release_id STRING, corpus_id STRING, snapshot_uuid STRING, database_sequence BIGINT, sha256 STRING"
    names = ["exact", "bytes", "stale", "fork", "other", "old", "gone", "unread", "headless"]
    receipts = spark.createDataFrame([(n, "r0" if n == "old" else "r1", "c", "s1", 5, "x") for n in names], schema)
    rows = {"exact": (True, True, "c", "s1", 5, "x"), "bytes": (True, True, "c", "s1", 5, "y"), "stale": (True, True, "c", "s2", 6, "x"), "fork": (True, True, "c", "s3", 6, "x"),
            "other": (True, True, "d", "s1", 5, "x"), "old": (True, True, "c", "s1", 5, "x"), "gone": (False, None, None, None, None, None),
            "unread": (True, False, None, None, None, None), "headless": (True, True, "c", None, None, "x")}
    candidates = spark.createDataFrame([(n, *rows[n]) for n in names], "handoff_id STRING, present BOOLEAN, readable BOOLEAN, corpus_id STRING, snapshot_uuid STRING, database_sequence BIGINT, sha256 STRING")
    held = spark.createDataFrame([("stale", "s1"), ("stale", "s2"), ("fork", "s3")], "handoff_id STRING, snapshot_uuid STRING")
    got = {r["handoff_id"]: r["classification"] for r in branches.classify_handoffs(receipts, candidates, held, "r1").collect()}
    assert got == {"exact": "exact", "bytes": "unverified", "stale": "unexpected_descendant", "fork": "divergent", "other": "different_corpus", "old": "machinery_mismatch",
                   "gone": "nonmatching", "unread": "unverified", "headless": "migration_required"}


def test_fingerprint_ignores_order_and_sees_content(spark, make_corpus):
    one = make_corpus([("E1", "one", "x"), ("E2", "two", "y")])
    mixed = one.with_tables(node_identity=one["node_identity"].orderBy(F.desc("pointer")).repartition(3))
    other = make_corpus([("E1", "one", "x"), ("E2", "two", "z")])
    digest = lambda c: fingerprints.fingerprint(c).first()["fingerprint"]
    assert digest(one) == digest(mixed) != digest(other)


def test_index_of_changed_nodes_only(spark, make_corpus):
    c = make_corpus([("E1", "one", "x"), ("E2", "two", "[one](E1)"), ("E3", "three", "[one](E1)")])
    part = views.current_nodes(c).where("pointer = 'E3'")
    assert build_reference_index(c, part).count() == 1


def test_any_number_of_operations_on_one_node(spark, make_corpus, monkeypatch):
    monkeypatch.setattr(changes, "CHUNK", 40)
    c = make_corpus([("E1", "one", "x"), ("E2", "two", "y")])
    plan = changes.plan_changes(c, _ops(spark, *[{"operation": "node.update", "pointer": "E1", "title": f"title {i // 2}"} for i in range(200)],
                                        {"operation": "node.update", "pointer": "E2", "title": "second"}), kinds={"node.update"})
    assert _codes(plan) == set()
    rows = {r["revision_uuid"]: r for r in plan.appended["node_revision"].collect()}
    assert len(rows) == 101 and sum(r["outcome"] == "unchanged" for r in plan.results.collect()) == 100
    at, walked = next(r["current_revision_uuid"] for r in plan.replaced["node_identity"].collect() if r["pointer"] == "E1"), 0
    while at in rows:
        assert rows[at]["title"] == f"title {99 - walked}"
        at, walked = rows[at]["previous_revision_uuid"], walked + 1
    assert walked == 100 and at == c["node_identity"].where("pointer = 'E1'").first()["current_revision_uuid"]


def test_counts_follow_commits(spark, make_corpus):
    c = make_corpus([("E1", "one", "x"), ("E2", "two", "[one](E1)"), ("E3", "three", "later", "staged")])
    plan = changes.plan_changes(c, _ops(spark, {"operation": "node.update", "pointer": "E2", "title": "second"},
                                        {"operation": "node.promote", "pointer": "E3", "graph_key": "examples"}), kinds={"node.update", "node.promote"})
    assert _codes(plan) == set()
    extra = {"operation_ledger": c["operation_ledger"].limit(0)}
    kept = aggregates.advanced_counts(aggregates.corpus_counts(c), aggregates.count_changes(c, plan, extra))
    recount = aggregates.corpus_counts(plan.applied_to(c))
    assert {tuple(r) for r in kept.collect()} == {tuple(r) for r in recount.collect()}
    assert dict(aggregates.count_changes(c, plan).collect())["staged_nodes"] == -1


def test_a_writer_that_died_leaves_no_commit(spark, make_corpus, tmp_path):
    root = str(tmp_path / "corpus")
    c = make_corpus([("E1", "one", "x")])
    c = snapshots.write_corpus(c, root, c.head)
    commits = tmp_path / "corpus" / "commits"
    (commits / f"{c.head.sequence + 1:012d}.json").write_bytes(b'{"corpus_id": "half')  # between create and close
    (commits / ".000000000001-aside").write_bytes(b"{}")  # between writing aside and renaming
    assert snapshots.read_head(spark, root) == c.head
    plan = changes.plan_changes(c, _ops(spark, {"operation": "node.update", "pointer": "E1", "title": "two"}), kinds={"node.update"})
    head, _ = changes.next_head(c, c.head, "r1", "batch.apply", "x", {})
    after = snapshots.commit_changes(c, plan, root, head)
    assert after.head == head and {r["title"] for r in views.current_nodes(after).where("pointer = 'E1'").collect()} == {"two"}
    with pytest.raises(snapshots.StaleHead):
        snapshots._publish(spark, root, {"sequence": head.sequence, "corpus_id": "another"})
    assert snapshots.read_head(spark, root) == head and not [p for p in commits.iterdir() if p.name.startswith(".") and "aside" not in p.name and not p.name.endswith(".crc")]


def test_streamed_operations_equal_those_within_the_row(spark, make_corpus, monkeypatch):
    c = make_corpus([("E1", "one", "x  \n"), ("E2", "two", " ")])
    first = c["node_identity"].where("pointer = 'E1'").first()["current_revision_uuid"]
    steps = [{"operation": "node.update", "title": "t1"}, {"operation": "node.update", "description": "d\n\n", "expected_revision_uuid": first},
             {"operation": "node.update", "title": "t1"}, {"operation": "traversal.embed", "notation": "[(E1)]", "read": "aloud"}, {"operation": "node.create", "title": "n", "description": "d"},
             {"operation": "node.stage", "title": "s", "description": "", "graph_key": "examples"}, {"operation": "node.update", "title": "é", "reason": "why"},
             {"operation": "traversal.embed", "notation": "[(E2):(E1)]"}, {"operation": "node.update", "description": "y"}]
    ops = _ops(spark, *[{**s, "pointer": p} for s in steps for p in ("E1", "E2", "E9")])
    plans = []
    for chunk in (500, 2):
        monkeypatch.setattr(changes, "CHUNK", chunk)
        history = changes._histories(c, changes._default_graph(changes.operations(ops)), "2000-01-01 00:00:07")
        plans.append((sorted(history.columns), sorted((str(sorted(r.asDict().items(), key=str)) for r in history.collect()))))
    assert plans[0] == plans[1] and len(plans[0][1]) == 27
    assert {code for r in history.collect() if (code := r["code"])} == {"stale_write", "unchanged", "pointer_exists", "node_not_found"}


def test_batches_follow_each_other_in_time(spark, make_corpus):
    c = make_corpus([("E1", "one", "x")])
    assert changes.next_moment(c.head) < changes.next_moment(replace(c.head, sequence=1)) < changes.next_moment(replace(c.head, sequence=61))
