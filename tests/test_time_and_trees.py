import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import ordered
from corpusloom.operators import branches, filetree, fingerprints, viewalgebra, views


def test_last_value_is_carried_across_buckets(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), i, rng.choice([None, None, None, i])) for i in range(300)]
    df = spark.createDataFrame(rows, "k STRING, at INT, v INT")
    got = ordered.grouped_last(df, ["k"], [F.col("at")], F.floor(F.col("at") / 7), F.col("v"), "last").collect()
    last, want = {}, {}
    for k, at, v in rows:
        last[k] = v if v is not None else last.get(k)
        want[at] = last[k]
    assert {r["at"]: r["last"] for r in got} == want


def _history(make_corpus, spark):
    c = make_corpus([("E1", "one", "x"), ("E2", "two", "y")])
    uuid = {r["pointer"]: r["uuid"] for r in c["node_identity"].collect()}
    rows = [("r1", "E1", "2001-01-01T00", None), ("r2", "E1", "2001-01-02T00", "q2"), ("r3", "E1", "2001-01-02T00", "q3"), ("r4", "E1", "2001-03-01T00", "lost"), ("s1", "E2", "2001-02-01T00", "q1")]
    revisions = spark.createDataFrame([(r, uuid[p], f"title {r}", "d", at, None, "h", q, "") for r, p, at, q in rows],
                                      "revision_uuid STRING, node_uuid STRING, title STRING, description STRING, created_at STRING, previous_revision_uuid STRING, content_hash STRING, request_uuid STRING, reason STRING")
    ledger = spark.createDataFrame([("q1", 5), ("q2", 3), ("q3", 8)], "request_uuid STRING, database_sequence LONG").withColumn("status", F.lit("committed"))
    return c.with_tables(node_revision=revisions.select(*c.spec("node_revision").names), operation_ledger=ledger)


def test_as_of_many_moments_and_numbers(spark, make_corpus):
    c = _history(make_corpus, spark)
    asked = [(1, "E1", "2000-12-31T00"), (2, "E1", "2001-01-01T00"), (3, "E1", "2001-01-02T00"), (3, "E1", "2001-01-02T00"), (4, "E1", "2009-01-01T00"),
             (5, "E2", "2001-02-01T00"), (6, "none", "2001-02-01T00"), (7, "E1", None), (None, "E2", "2009-01-01T00")]
    for bucket in (None, F.lit("one")):
        got = views.as_of_join(c, spark.createDataFrame(asked, "request_id LONG, pointer STRING, at STRING"), bucket).collect()
        assert sorted(((r["request_id"], r["title"]) for r in got), key=str) == sorted([
            (1, None), (2, "title r1"), (3, "title r3"), (3, "title r3"), (4, "title r4"), (5, "title s1"), (6, None), (7, None), (None, "title s1")], key=str)
    numbers = spark.createDataFrame([(1, "E1", 0), (2, "E1", 3), (3, "E1", 7), (4, "E1", 100), (5, "E2", 4), (6, "E2", 5)], "request_id LONG, pointer STRING, at INT")
    got = {r["request_id"]: r["title"] for r in views.as_of_sequence(c, numbers, per_bucket=2).collect()}
    assert got == {1: "title r1", 2: "title r2", 3: "title r2", 4: "title r3", 5: None, 6: "title s1"}
    assert {r["pointer"]: r["revision_uuid"] for r in views.as_of(c, "2001-02-15T00").collect()} == {"E1": "r3", "E2": "s1"}
    assert views.as_of_join(c, spark.createDataFrame([], "request_id LONG, pointer STRING, at STRING")).count() == 0


def test_digest_trees_follow_commits_and_find_what_differs(spark, make_corpus):
    a = make_corpus([(f"E{i}", "t", f"d{i}") for i in range(1, 60)])
    b = make_corpus([(f"E{i}", "t", f"d{i}" if i != 7 else "other") for i in range(1, 59)] + [("E99", "t", "new")])
    state = lambda c: views.current_nodes(c).select("pointer", "content_hash")
    tree = lambda c: fingerprints.digest_tree(state(c))
    sums = lambda t: sorted(map(tuple, t.select("bucket", "n", "s1", "s16", "s31", "s46").collect()))
    later = fingerprints.advanced(tree(a), state(a).where("pointer IN ('E7', 'E59')"), state(b).where("pointer IN ('E7', 'E99')"))
    assert sums(later) == sums(tree(b))
    rows, read = branches.compare_by_digest(a, b, tree(a), later)
    want = sorted(map(tuple, branches.compare(a, b).collect()))
    assert sorted(map(tuple, rows.collect())) == want and {p for p, _ in want} == {"E7", "E59", "E99"} and read.count() <= 3
    rows, read = branches.compare_by_digest(a, a, tree(a), tree(a))
    assert rows.count() == read.count() == 0


def test_stretches_of_time(spark):
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.6 else rng.choice("xyz"), rng.randrange(0, 400_000)) for _ in range(500)]
    u = spark.createDataFrame([*rows, (None, 5), ("x", None)], "term STRING, s INT").select("term", F.timestamp_seconds("s").alias("moment"))
    got = sorted((r["term"], int(r["started_at"].timestamp()), int(r["ended_at"].timestamp()), r["members"], r["longest_gap"]) for r in viewalgebra.sessions(u, 3000).collect() or [])
    want = []
    for term in {t for t, _ in rows}:
        times, before = sorted(s for t, s in rows if t == term), None
        for s in times:
            if before is None or s - before > 3000:
                want.append([term, s, s, 0, None])
            if before is not None and s != before:
                want[-1][4] = max(want[-1][4] or 0, s - before)
            want[-1][2], want[-1][3], before = s, want[-1][3] + 1, s
    offset = got[0][1] - sorted(want, key=lambda w: (w[0], w[1]))[0][1]
    assert [(t, a - offset, z - offset, n, g) for t, a, z, n, g in got] == [tuple(w) for w in sorted(want, key=lambda w: (w[0], w[1]))]
    whole = {r["term"]: (r["islands"], r["members"]) for r in viewalgebra.recurrence_over_time(viewalgebra.sessions(u, 3000)).collect()}
    assert whole == {t: (sum(w[0] == t for w in want), sum(x == t for x, _ in rows)) for t in {t for t, _ in rows}}


@pytest.mark.parametrize("chars", [1_000_000, 40])
def test_many_needles(spark, chars):
    rng = random.Random(6)
    needles = list({"".join(rng.choice("abc") for _ in range(rng.choice([1, 2, 3, 6]))) for _ in range(40)}) + ["", "é–", "a.b"]
    texts = [(f"p{i}", "".join(rng.choice("abcd .é–") for _ in range(rng.choice([0, 5, 60])))) for i in range(60)] + [("null", None), ("dup", "abc"), ("dup", "abc")]
    found = filetree.mentions(spark.createDataFrame(texts, "path STRING, text STRING"), spark.createDataFrame([(n,) for n in [*needles, "a"]], "needle STRING"), chars)
    assert {tuple(r) for r in found.collect()} == {(p, n) for p, t in texts for n in needles if n and t and n in t}
    none = filetree.mentions(spark.createDataFrame(texts, "path STRING, text STRING"), spark.createDataFrame([], "needle STRING"))
    assert none.count() == 0


def test_many_needles_take_one_pass(spark):
    needles = [f"O{n}" for n in range(3000)] + ["x", "é😀–tail", "é😀–tall"]
    texts = spark.createDataFrame([("a", "(O12) 😀O2999."), ("b", "x é😀–tal"), ("c", "é😀–talléO"), ("d", None)], "path STRING, text STRING")
    found = filetree.mentions(texts, spark.createDataFrame([(n,) for n in needles], "needle STRING"), 500)
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted(map(tuple, found.collect())) == [("a", "O1"), ("a", "O12"), ("a", "O2"), ("a", "O29"), ("a", "O299"), ("a", "O2999"), ("b", "x"), ("c", "é😀–tall")]


def test_unlinked_resources_by_table(spark):
    texts = spark.createDataFrame([("a.md", "see lib/x.bin"), ("b.md", "x.bin and y"), ("lib/x.bin", "x.bin"), ("skip/c.md", "x.bin")], "path STRING, text STRING")
    got = filetree.check_unlinked_many(texts, spark.createDataFrame([("lib/x.bin",), ("q/zzz",)], "resource STRING"), ["skip/**"])
    listed = filetree.check_unlinked(texts, ["lib/x.bin", "q/zzz"], ["skip/**"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, listed.collect())) and got.count() == 2
