import hashlib
import json
import random
import re
import uuid
from types import SimpleNamespace

from conftest import CORPUS_ID, NAMESPACE
from pyspark.sql import functions as F

from corpusloom.functions import ids
from corpusloom.operators import filetree, quality, search, views
from corpusloom.plans import change_queries
from corpusloom.sources import files, imports, nodetext, oplog


def _search(spark, c, *queries, **page):
    nodes = search.searchable(c)
    index = search.build_search_index(nodes)
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id BIGINT, query STRING")
    return search.search(index, asked, **page), nodes, asked, index


def test_search(spark, make_corpus):
    c = make_corpus([("E1", "dandelion soup", "boil the a-b root"), ("E2", "soup", "dandelion once, then dandelion again; see soup"),
                     ("E3", "secret dandelion soup", "staged", "staged"), ("E4", "b a", "Soupçon a x b DANDÉLION")])
    hits, nodes, asked, _ = _search(spark, c, "dandelion soup", "a-b", "b-a", "dandelion", "!!", "soup missing", "title boil")
    got = {}
    for r in hits.orderBy("query_id", "position").collect():
        got.setdefault(r["query_id"], []).append(r["pointer"])
    assert set(got[0]) == {"E1", "E2"} and got[1] == ["E1"] and got[2] == ["E4"]
    assert set(got[3]) == {"E1", "E2", "E4"}
    assert 4 not in got and 5 not in got and 6 not in got
    ranks = [r["rank"] for r in hits.where("query_id = 0").orderBy("position").collect()]
    assert ranks == sorted(ranks)
    excerpt = search.snippets(hits, nodes, asked, 4).where("query_id = 3 AND pointer = 'E2'").first()["excerpt"]
    assert excerpt == "[dandelion] once, then [dandelion]…"


def test_hits_with_marks_are_shown_whole(spark):
    nodes = spark.createDataFrame([("u", "E1", "one", "Un cafe\u0301 noir, un café.")], "uuid STRING, pointer STRING, title STRING, description STRING")
    asked = spark.createDataFrame([(0, "CAFE")], "query_id INT, query STRING")
    hits = search.search(search.build_search_index(nodes), asked)
    assert search.snippets(hits, nodes, asked).first()["excerpt"] == "Un [cafe\u0301] noir, un [café]."


def _excerpt(description, units, size):
    """Tries every window."""
    pieces = re.findall(r"[^\W_]+[\W_]*", description)
    ws = [re.match(r"[^\W_]+", p)[0].lower() for p in pieces]
    places = [(a, a + len(u) - 1, i) for i, u in enumerate(units) for a in range(len(ws) - len(u) + 1) if ws[a:a + len(u)] == u]
    inside = lambda s: [p for p in places if p[0] >= s and p[1] < s + size]
    best = max(range(max(1, len(ws) - size + 1)), key=lambda s: (len({p[2] for p in inside(s)}), -s))
    spans = []
    for a, z, _ in sorted(inside(best)):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(z, spans[-1][1])
        else:
            spans.append([a, z])
    out = []
    for i, piece in list(enumerate(pieces))[best:best + size]:
        word = re.match(r"[^\W_]+", piece)[0]
        out.append("[" * any(a == i for a, _ in spans) + word + "]" * any(z == i for _, z in spans) + piece[len(word):])
    return ("…" if best else "") + "".join(out).strip(" ") + ("…" if best + size < len(ws) else "")


def test_best_window_by_trying_all(spark):
    rng = random.Random(5)
    texts = [rng.choice(["", "(", "* "]) + "".join(rng.choice("abcde") + rng.choice([" ", " ", ", ", "-", ".\n"]) for _ in range(rng.choice([1, 4, 18, 60]))) for _ in range(80)]
    asked = ["a b", "a-b", "a-b b-c d", "c-d-e a", "e e-e", "zz a", "a-b-c-d-e"]
    nodes = spark.createDataFrame([(f"u{i}", t) for i, t in enumerate(texts)] + [("none", None), ("empty", "")], "uuid STRING, description STRING")
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id BIGINT, query STRING")
    hits = nodes.select("uuid").crossJoin(queries.select("query_id"))
    got = {(r["uuid"], r["query_id"]): r["excerpt"] for r in search.snippets(hits, nodes, queries, 5).collect()}
    assert len(got) == 82 * len(asked) and got["none", 0] is None and got["empty", 0] == ""
    for i, t in enumerate(texts):
        for k, query in enumerate(asked):
            units = sorted({tuple(u.split("-")) for u in query.split()})
            assert got[f"u{i}", k] == _excerpt(t, [list(u) for u in units], 5), (t, query)


def test_pruned_search_equals_search(spark):
    rng = random.Random(3)
    rows = [(f"u{i:03}", f"N{i}", "title", " ".join(rng.choice(["common", "common", f"w{rng.randrange(30)}", f"r{rng.randrange(400)}"]) for _ in range(rng.choice([3, 10, 80])))) for i in range(600)]
    nodes = spark.createDataFrame(rows, "uuid STRING, pointer STRING, title STRING, description STRING")
    index = search.build_search_index(nodes)
    blocks = search.build_blocks(index, per_length=2)
    asked = ["common", "w1 common", "w2 w3", "common common", "w4-common", "title common w5", "r7", "nowhere common", "!!", "N77", "w1", "w9"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id BIGINT, query STRING")
    for limit, cursor, first in ((5, 0, 2), (20, 10, 1), (1000, 0, 4)):
        want = sorted((r["query_id"], r["position"], r["pointer"], r["rank"]) for r in search.search(index, queries, limit, cursor).collect())
        page, read = search.pruned_search(index, blocks, queries, limit, cursor, first)
        assert sorted((r["query_id"], r["position"], r["pointer"], r["rank"]) for r in page.collect()) == want
        spent = {r["query_id"]: (r["postings_read"], r["postings_total"]) for r in read.collect()}
        assert all(a <= b for a, b in spent.values()) and (limit > 5 or all(a < 0.6 * b for a, b in (spent[10], spent[11])))


def test_coverage_finds_what_an_index_lost(spark, make_corpus):
    c = make_corpus([("E1", "one", "x"), ("E2", "two", "y"), ("E3", "***", "z")])
    nodes = search.searchable(c)
    stale = search.build_search_index(nodes.where("pointer != 'E2'"))
    assert {tuple(r) for r in search.search_coverage(nodes, stale).collect()} == {
        ("E2", "pointer_coverage"), ("E2", "title_coverage"), ("E3", "title_coverage")}


def test_lanes(spark, make_corpus):
    c = make_corpus([("E1", "term: root", "root"), ("E2", "root", "root\n\n```pgx-traversal\n[(E1)]\n```"), ("E3", "root", "root")])
    hits, nodes, _, _ = _search(spark, c, "root")
    lanes = {r["pointer"]: (r["lane"], r["lane_rank"]) for r in search.search_lanes(hits, nodes, {"term:": "lexical"}).collect()}
    assert lanes == {"E1": ("lexical", 1), "E2": ("traversal", 1), "E3": ("canonical", 1)}


def test_written_index_is_bucketed(spark, make_corpus, tmp_path):
    _, _, _, index = _search(spark, make_corpus([("E1", "one", "x y z")]), "one")
    index.write(str(tmp_path / "i"), buckets=4)
    back = spark.read.parquet(str(tmp_path / "i" / "postings"))
    assert "bucket" in back.columns and back.count() == index.postings.count()


def test_lines_round_trip(spark, make_corpus, tmp_path):
    title, text = "a|b title", "one || two \\ three\nfour 😀 | \\n"
    c = make_corpus([("E1", title, text), ("E2", "padded", " blank ahead")])
    nodetext.write_pgx(c, str(tmp_path / "out"), ["examples"])
    nodes, rejects = nodetext.read_pgx(spark, str(tmp_path / "out"))
    got = {r["pointer"]: (r["title"], r["description"]) for r in nodes.collect()}
    assert got["E1"] == (title, text) and got["E2"] == ("padded", "blank ahead") and rejects.count() == 0
    assert [r["key"] for r in quality.check_roundtrip(c).collect()] == ["E2"]


def test_bad_lines_are_set_aside(spark, tmp_path):
    lines = ["# heading", "", "- pgx: || A || t || d ||", "- pgx: || B || t || d || 2020 ||", "- pgx: || C || only ||", "- pgx: || D || t || bad \\x ||",
             "- pgx: no delimiters", "  - pgx: || F || t\\|u || d\\\\ ||  ", "- pgx: || G || t || d \\|| ||"]
    (tmp_path / "a.md").write_text("\n".join(lines))
    nodes, rejects = nodetext.read_pgx(spark, str(tmp_path))
    assert {(r["pointer"], r["title"], r["description"], r["data_one"]) for r in nodes.collect()} == {
        ("A", "t", "d", None), ("B", "t", "d", "2020"), ("F", "t|u", "d\\", None)} | {
        (r["pointer"], r["title"], r["description"], r["data_one"]) for r in nodes.where("pointer = 'G'").collect()}
    assert {r["reject"] for r in rejects.collect()} >= {"field_count", "bad_escape", "missing_delimiters"}


def test_oplog(spark, tmp_path):
    ok = {"request_id": "r1", "tool": "node.create", "arguments": {"title": "t", "pointer": "E1"}}
    (tmp_path / "log.json").write_text(json.dumps(ok) + "\nnot json\n" + json.dumps({"tool": "x"}) + "\n")
    good, bad = oplog.read_oplog(spark, str(tmp_path))
    body = '{"arguments":{"pointer":"E1","title":"t"},"change_set_id":null,"tool":"node.create"}'
    assert [(r["request_id"], r["input_hash"]) for r in good.collect()] == [("r1", hashlib.sha256(body.encode()).hexdigest())]
    assert bad.count() == 2


def test_first_generation_import(spark):
    nid = lambda p: str(uuid.uuid5(uuid.UUID(NAMESPACE), p))
    cols = "sigil STRING, pointer STRING, title STRING, description STRING, data_one STRING, uuid STRING"
    nodes = spark.createDataFrame([("pgx:", "E0", "g", "d", "t0", nid("E0")), ("pgx:", "E1", "a", "[g](E0)", "t1", nid("E1"))], cols)
    staged = spark.createDataFrame([("pgx:", "E2", "s", "[x](E9)", "t2", nid("E2")), ("pgx:", "E3", "s", "x", "t3", "wrong")], cols)
    graphs = spark.createDataFrame([(nid("E0"), "examples", "E", "")], "graph_uuid STRING, graph_key STRING, pointer_prefix STRING, description STRING")
    members = spark.createDataFrame([(nid("E0"), nid("E0"), 0)], "graph_uuid STRING, node_uuid STRING, ordinal BIGINT")
    queue = spark.createDataFrame([(nid("E2"), "examples", "")], "node_uuid STRING, intended_graph_key STRING, tracking_note STRING")
    c, mismatches = imports.import_v1(spark, {"nodes": nodes, "staging_nodes": staged, "graphs": graphs, "graph_membership": members, "staging_queue": queue}, NAMESPACE, CORPUS_ID)
    assert [r["pointer"] for r in mismatches.collect()] == ["E3"]
    assert [r["target_pointer"] for r in c["reference_occurrences"].collect()] == ["E0"]
    assert [r["status"] for r in views.staging_worklist(c).collect()] == ["blocked"]


def test_file_tree(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "notes" / "__pycache__").mkdir(parents=True)
    (root / "notes" / "Home page.md").write_text("[[Other#top|shown]] [[notes/Other.md]] [[Missing]] [[a/Other]] mentions secret.bin")
    (root / "notes" / "Other.md").write_text("[[Home page]]\n\nand a second line")
    (root / "notes" / "__pycache__" / "x.pyc").write_bytes(b"x")
    inventory = files.file_inventory(spark, str(root))
    assert {r["path"] for r in inventory.collect()} == {"notes/Home page.md", "notes/Other.md", "notes/__pycache__/x.pyc"}
    assert {r["key"] for r in filetree.check_cleanliness(inventory).collect()} == {"notes/__pycache__/x.pyc"}
    notes = files.read_markdown(spark, str(root))
    assert {r["text"] for r in notes.collect()} == {p.read_text() for p in (root / "notes").glob("*.md")}
    assert {r["detail"] for r in filetree.check_wikilinks(notes).collect()} == {"Missing", "a/Other"}
    assert [(r["key"], r["detail"]) for r in filetree.check_unlinked(files.read_texts(spark, str(root)), ["hidden/secret.bin"]).collect()] == [("hidden/secret.bin", "notes/Home page.md")]
    clean = files.file_inventory(spark, str(root), ["**/__pycache__/**"])
    listed = clean.where("path NOT LIKE '%Other%'").withColumn("size_bytes", F.col("size_bytes") + 1)
    got = {(r["code"], r["key"]) for r in filetree.check_manifest(clean, listed.union(listed), file_count=3).collect()}
    assert got == {("manifest.unlisted_files", "notes/Other.md"), ("manifest.mismatch", "notes/Home page.md"), ("manifest.duplicate", "notes/Home page.md")}


def test_bundle_identity(spark):
    entry = {"path": "a.db", "sha256": "00", "byte_size": 3}
    digest = hashlib.sha256(json.dumps([entry], sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    name = str(uuid.uuid5(uuid.UUID(ids.BUNDLE_NAMESPACE), f"folder:{digest}"))
    listing = spark.createDataFrame([("b", "a.db", "00", 3)], "bundle STRING, path STRING, sha256 STRING, byte_size BIGINT")
    manifest = spark.createDataFrame([("b", "v1", "folder", digest, name, "v1")], "bundle STRING, format STRING, source_kind STRING, content_digest STRING, resource_uuid STRING, supported_format STRING")
    assert filetree.check_bundles(listing, listing, manifest).count() == 0
    assert [r["code"] for r in filetree.check_bundles(listing.where("false"), listing, manifest).collect()] == ["resource_content_mismatch"]


def test_listings_are_digested_in_batches(spark):
    rows = [(f"b{i % 3}", f"d/{i:05}é.md", f"{i:x}", i) for i in range(3000)]
    listing = spark.createDataFrame(rows, "bundle STRING, path STRING, sha256 STRING, byte_size BIGINT").repartition(5)
    want = {}
    for name in ("b0", "b1", "b2"):
        entries = [{"byte_size": n, "path": p, "sha256": h} for x, p, h, n in rows if x == name]
        want[name] = hashlib.sha256(json.dumps(entries, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 70)
    try:
        found = filetree.listing_digests(listing)
        assert {r["bundle"]: r["digest"] for r in found.collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    manifest = spark.createDataFrame([("b0", "f", "k", "d", "u", "f")], "bundle STRING, format STRING, source_kind STRING, content_digest STRING, resource_uuid STRING, supported_format STRING")
    plan = filetree.check_bundles(listing, listing, manifest)._jdf.queryExecution().toString()
    assert "collect_list" not in plan


def test_validate_query_runs_all_checks(spark, make_corpus, monkeypatch):
    asked = []
    state = make_corpus([("E1", "object: one", "Text with a [gone](E404) link.")])
    monkeypatch.setattr(change_queries, "damaged", lambda *_: state)
    monkeypatch.setattr(change_queries.b, "search_index", lambda c: SimpleNamespace(docs=None))
    for name in ("check_links", "check_reference_index", "check_roundtrip"):
        check = getattr(quality, name)
        monkeypatch.setattr(quality, name, lambda c, name=name, check=check: asked.append(name) or check(c))
    found = {r["code"] for r in change_queries.everything(spark, "").collect()}
    assert asked == ["check_links", "check_reference_index", "check_roundtrip"] and "promoted_reference_contract" in found
