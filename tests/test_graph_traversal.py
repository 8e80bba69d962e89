import json
import random
from collections import deque

import pytest
from conftest import NAMESPACE
from pyspark.sql import functions as F

from corpusloom.corpus import shaped
from corpusloom.functions import ids
from corpusloom.operators import graph, reachability, traversal
from corpusloom.schema import CORPUS_TABLES


def test_longest_prefix_owns(spark, make_corpus):
    c = make_corpus([], graphs=(("examples", "E", "E0"), ("experiments", "EXP", "EXP0")))
    df = spark.createDataFrame([("EXP1", "examples"), ("E1", "examples"), ("EXP2", "experiments"), ("Z1", "examples"), ("E2", "nope")], "pointer STRING, graph_key STRING")
    got = {r["pointer"]: r["namespace_error"] for r in graph.check_namespace(df, c["graphs"]).collect()}
    assert got == {"EXP1": "more_specific_namespace", "E1": None, "EXP2": None, "Z1": "outside_namespace", "E2": "unknown_graph"}


def _walk(start, nodes, links, triples, max_nodes, max_chars):
    """Plain breadth-first walk, one node at a time."""
    queue, seen, out, chars = deque([start]), set(), [], 0
    while queue and len(out) < max_nodes:
        at = queue.popleft()
        if at in seen:
            continue
        seen.add(at)
        cost = len(json.dumps(nodes[at], sort_keys=True, separators=(",", ":"), ensure_ascii=False))
        if out and chars + cost > max_chars:
            break
        out.append(at)
        chars += cost
        queue.extend(n for n in links.get(at, []) + triples.get(at, []) if n not in seen)
    return out, chars, bool(queue)


@pytest.mark.parametrize("seed, max_nodes, max_chars", [(1, 5, 100_000), (2, 20, 1500), (3, 50, 100_000), (4, 1, 1000), (5, 2, 100_000), (6, 8, 2500)])
def test_context_packs_equal_a_plain_walk(spark, make_corpus, seed, max_nodes, max_chars):
    rng = random.Random(seed)
    names = [f"E{i}" for i in range(1, 41)]
    texts = {n: "é" * rng.randrange(1, 400) for n in names}
    c = make_corpus([(n, f"title {n}", texts[n]) for n in names])
    rev = {r["pointer"]: r["current_revision_uuid"] for r in c["node_identity"].collect()}
    nodes = {n: {"pointer": n, "title": f"title {n}", "description": texts[n], "revision_uuid": rev[n]} for n in names}
    hub = names[0]  # one node holds a large share of all edges
    link_rows, triple_rows, links, triples = [], [], {}, {}
    for n in names:
        count = 60 if n == hub else rng.randrange(0, 5)
        for i in range(count):
            t = rng.choice(names)
            links.setdefault(n, []).append(t)
            link_rows.append((n, t, i))
        for t in rng.sample(names, 20 if n == hub else rng.randrange(0, 3)):
            triples.setdefault(n, []).append(t)
            triple_rows.append((n, t, f"{len(triple_rows):06d}"))
    u = lambda col: ids.uuid5_col(NAMESPACE, col)
    occurrences = spark.createDataFrame(link_rows, "s STRING, t STRING, ordinal INT").select(
        u("s").alias("source_node_uuid"), u("t").alias("target_uuid"), "ordinal")
    facts = spark.createDataFrame(triple_rows, "s STRING, t STRING, created_at STRING").select(
        u("s").alias("subject_uuid"), u("t").alias("object_uuid"), "created_at")
    c = c.with_tables(reference_occurrences=shaped(occurrences, CORPUS_TABLES["reference_occurrences"]), triples=shaped(facts, CORPUS_TABLES["triples"]))
    members, packs = graph.context_packs(c, c["node_identity"].where("pointer != 'E0'").select("pointer"), max_nodes, max_chars)
    got = {}
    for r in members.collect():
        got.setdefault(r["root"], []).append((r["position"], r["pointer"]))
    sums = {r["root"]: (r["character_count"], r["truncated"]) for r in packs.collect()}
    for n in names:
        want, chars, truncated = _walk(n, nodes, links, triples, max_nodes, max_chars)
        assert [p for _, p in sorted(got[n])] == want
        assert sums[n] == (chars, truncated), n


def test_chains_and_cycles(spark):
    rows = [(f"a{i}", f"a{i-1}" if i else None) for i in range(37)] + [("x", "y"), ("y", "z"), ("z", "x"), ("tail", "x"), ("lost", "nowhere"), ("self", "self")]
    got = {r["revision_uuid"]: (r["depth"], r["root"], r["cycle"]) for r in graph.revision_chains(
        spark.createDataFrame(rows, "revision_uuid STRING, previous_revision_uuid STRING")).collect()}
    assert all(got[f"a{i}"] == (i, "a0", False) for i in range(37))
    assert all(got[k] == (None, None, True) for k in ("x", "y", "z", "tail", "self"))
    assert got["lost"] == (0, "lost", False)


def test_ancestors_in_a_dag(spark):
    edges = [("d", "b"), ("d", "c"), ("b", "a"), ("c", "a"), ("a", None), ("e", "d"), ("f", "e"), ("g", "f"), ("g", "a")]
    parents = spark.createDataFrame(edges, "child STRING, parent STRING")
    got = {(r["start"], r["ancestor"], r["distance"]) for r in graph.ancestors(parents, spark.createDataFrame([("g",), ("b",)], "child STRING")).collect()}
    assert got == {("g", "f", 1), ("g", "a", 1), ("g", "e", 2), ("g", "d", 3), ("g", "b", 4), ("g", "c", 4), ("b", "a", 1)}
    pairs = spark.createDataFrame([("g", "c"), ("c", "g"), ("b", "a")], "snapshot STRING, ancestor STRING")
    assert {tuple(r) for r in graph.is_descendant(parents, pairs).collect()} == {("g", "c", True), ("c", "g", False), ("b", "a", True)}


def _above(edges):
    """Every node with what can be reached over one step or more."""
    up = {}
    for child, parent in edges:
        if child is not None and parent is not None:
            up.setdefault(child, set()).add(parent)
    out = {}
    for node in {n for e in edges for n in e if n is not None}:
        found, todo = set(), list(up.get(node, ()))
        while todo:
            n = todo.pop()
            if n not in found:
                found.add(n)
                todo += up.get(n, ())
        out[node] = found - {node}
    return out


@pytest.mark.parametrize("kind", ["forest", "cycles"])
def test_reachability_by_brute_force(spark, kind):
    rng = random.Random(3)
    edges = [("n0", None), ("n1", "n0"), ("n1", "n0"), (None, "n0"), ("alone", None)]
    edges += [(f"n{i}", f"n{rng.choice([i - 1, i - 1, rng.randrange(i)])}") for i in range(2, 40)]
    edges += [(f"t{i}", f"t{i - 1}") for i in range(1, 12)]
    if kind == "cycles":
        edges += [(f"n{i}", f"n{rng.randrange(i)}") for i in rng.sample(range(5, 40), 12)] + [("n30", "t5"), ("t9", "n12")]
        edges += [("x", "y"), ("y", "z"), ("z", "x"), ("below", "x"), ("x", "n7"), ("self", "self"), ("n3", "n33")]
    above = _above(edges)
    parents = spark.createDataFrame(edges, "child STRING, parent STRING")
    index = reachability.build_index(parents)
    assert index.is_forest == (kind == "forest")
    asked = [(a, b) for a in above for b in above] + [("n5", "n0"), ("nowhere", "n0"), (None, "n0"), ("n5", None)]
    pairs = spark.createDataFrame(asked, "snapshot STRING, ancestor STRING")
    got = {}
    for r in reachability.descendants(index, pairs).collect():
        got.setdefault((r["snapshot"], r["ancestor"]), []).append(r["is_descendant"])
    assert sum(map(len, got.values())) == len(asked) and got["n5", "n0"] == [True, True]
    assert all(set(hit) == {b in above.get(a, ())} for (a, b), hit in got.items())
    starts = spark.createDataFrame([(a,) for a in above], "start STRING")
    rows = reachability.listed(index, reachability.ancestor_ranges(index, starts)).collect()
    assert sorted((r["start"], r["ancestor"]) for r in rows) == sorted((a, b) for a in above for b in above[a])
    if kind == "forest":
        up = {c: p for c, p in edges if c and p}
        far = {(r["start"], r["ancestor"]): r["distance"] for r in graph.ancestors(parents, starts.withColumnRenamed("start", "child")).collect()}
        assert len(far) == len(rows)
        for (a, b), n in far.items():
            for _ in range(n):
                a = up[a]
            assert a == b


def test_reachability_of_nothing(spark):
    index = reachability.build_index(spark.createDataFrame([], "child STRING, parent STRING"))
    assert index.positions.count() == 0
    assert reachability.descendants(index, spark.createDataFrame([("a", "b")], "snapshot STRING, ancestor STRING")).first()["is_descendant"] is False


@pytest.mark.parametrize("depth, with_bearing", [(3, True), (None, False)])
def test_blast_radius_by_brute_force(spark, depth, with_bearing):
    rng = random.Random(8)
    nodes = [f"p{i}" for i in range(220)]
    edges = {(rng.choice(nodes), rng.choice(nodes[:60]), rng.choice(["link", "triple"])) for _ in range(400)} | {(n, "hub", "link") for n in nodes[:150]} | {("hub", "p3", "triple")}
    bearing = set(rng.sample(nodes, 110)) | {"hub"}
    roots = [*nodes[:140], "hub", "unknown", "p0", None]
    want = {}
    for root in set(roots) - {None}:
        front, seen, level, hit = {root}, {root}, 0, set()
        while front and level != depth:
            step = {(s, k) for s, t, k in edges if t in front and s != root}
            hit |= step
            level += 1
            front = {s for s, _ in step if not with_bearing or s in bearing} - seen
            seen |= front
        for _, k in hit:
            want[root, k] = want.get((root, k), 0) + 1
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    given = [*edges, *list(edges)[:9], (None, "p1", "link"), ("p1", None, "link")]
    packed, touched = traversal.reached(frame([(r,) for r in roots], "pointer STRING"), frame(given, "source STRING, target STRING, kind STRING"),
                                        frame([(n,) for n in bearing], "pointer STRING") if with_bearing else None, depth)
    got = traversal.count_reached(packed, touched, "kind").collect()
    assert {(r["root"], r["kind"]): r["touched"] for r in got} == want
    # A node that many roots reach is a few rows of bitmaps.
    assert touched.where("source = 'p5'").count() <= 2 * 3
    nothing = traversal.blast_radius(frame([], "pointer STRING"), frame(given, "source STRING, target STRING, kind STRING"), frame([], "pointer STRING"))
    assert nothing.count() == 0


def _lawful(text):
    """Reads the grammar S = T(':'T)*, T = '(' (P | S) ')' recursively."""
    source = "".join(text.split())
    if source.startswith("[") != source.endswith("]") or not source:
        return False
    if source.startswith("["):
        source = source[1:-1]

    def sequence(s):
        at = 0
        while True:
            if at >= len(s) or s[at] != "(":
                return False
            depth, end = 0, None
            for i in range(at, len(s)):
                depth += {"(": 1, ")": -1}.get(s[i], 0)
                if depth == 0:
                    end = i
                    break
            if end is None:
                return False
            inner = s[at + 1:end]
            if not inner or not (sequence(inner) if inner[0] == "(" else not set(inner) & set("()[]:")):
                return False
            at = end + 1
            if at == len(s):
                return True
            if s[at] != ":":
                return False
            at += 1

    return sequence(source)


def test_lawfulness_equals_the_grammar(spark):
    rng = random.Random(11)
    texts = {"(A)", "[(A):(B)]", "((A):(B)):(C)", "[(A)", "(A):", "()", "(A)(B)", "[ ]", "A", "((A))", "(A:B)", " ", "[]", "]", "(A):(B))"}
    while len(texts) < 3000:
        texts.add("".join(rng.choice("()()():AB[] ") for _ in range(rng.randrange(1, 13))))
    df = spark.createDataFrame([(t, t, 0) for t in texts], "uuid STRING, notation STRING, block INT")
    got = traversal.check_traversals(traversal.tokenise(df)).select("notation", "lawful", "reason", "offset").collect()
    for r in got:
        assert r["lawful"] == _lawful(r["notation"]), (r["notation"], r["reason"])
        assert (r["reason"] is None) == r["lawful"] and (r["offset"] is None) == r["lawful"]


def test_index_shapes(spark):
    rows = [("n1", "[((A):(OP):(B)):(OP2):(C)]"), ("n2", "(A):(B)"), ("n3", "(B):(A)"), ("n4", "((A):(B))"), ("n5", "(A):(x)(")]
    df = spark.createDataFrame([(u, n, 0) for u, n in rows], "uuid STRING, notation STRING, block INT")
    index = traversal.traversal_index(traversal.check_traversals(traversal.tokenise(df)))
    got = {(r["uuid"], r["pointer"]): (tuple(r["path"]), r["arity"], r["role"]) for r in index.collect()}
    assert got[("n1", "A")] == ((0, 0), 3, "operand") and got[("n1", "OP")] == ((0, 1), 3, "operator")
    assert got[("n1", "OP2")] == ((1,), 3, "operator") and got[("n1", "C")] == ((2,), 3, "operand")
    assert got[("n2", "A")] == ((0,), 2, "term") and not [k for k in got if k[0] == "n5"]
    variants = traversal.same_operands(index.where("uuid IN ('n2', 'n3', 'n4')")).first()
    assert (variants["operands"], variants["orders"], variants["groupings"], variants["uses"]) == ("A B", 2, 3, 3)


def test_spellings_collapse(spark):
    df = spark.createDataFrame([(t,) for t in ("(E1):(E2)", "[(E1):(E2)]", " [ ( E1 ) :\n(E2) ] ")], "notation STRING")
    assert {r["canonical"] for r in traversal.canonical_notation(traversal.tokenise(df)).collect()} == {"[(E1):(E2)]"}


def test_index_equals_the_written_trees(spark):
    rng = random.Random(12)

    def tree(depth):
        return [rng.choice("ABC") if depth == 0 or rng.random() < 0.6 else tree(depth - 1) for _ in range(rng.randrange(1, 5))]

    def spelled(terms):
        return ":".join(f"({t if isinstance(t, str) else spelled(t)})" for t in terms)

    def places(terms, path=()):
        triad = len(terms) == 3 and isinstance(terms[1], str)
        for i, t in enumerate(terms):
            if isinstance(t, str):
                yield (*path, i), len(terms), t, "operator" if triad and i == 1 else "operand" if triad else "term"
            else:
                yield from places(t, (*path, i))

    trees = {str(i): tree(4) for i in range(300)} | {"wide": ["A"] * 60_000}
    deep = "A"
    for _ in range(300):
        deep = [deep]
    trees["deep"] = deep
    rows = [(k, spelled(t), 1 << 40) for k, t in trees.items()] + [("none", None, 0), ("empty", "", 0)]
    df = spark.createDataFrame(rows, "uuid STRING, notation STRING, block LONG")
    got = {}
    for r in traversal.traversal_index(traversal.check_traversals(traversal.tokenise(df))).collect():
        assert r["block"] == 1 << 40 and r["depth"] == len(r["path"]) and r["sibling"] == r["path"][-1]
        got.setdefault(r["uuid"], []).append((r["position"], (tuple(r["path"]), r["arity"], r["pointer"], r["role"])))
    assert {k: [place for _, place in sorted(v)] for k, v in got.items()} == {k: list(places(t)) for k, t in trees.items()}
    none = traversal.traversal_index(traversal.check_traversals(traversal.tokenise(df.limit(0))))
    assert none.collect() == []
