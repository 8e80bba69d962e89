import hashlib
import random
import zlib

import numpy as np
import pytest

from corpusloom.llm import merkle, neighbour_vote, positions, prefix_trie
from corpusloom.llm.common import run_folder


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# ---- positions ----------------------------------------------------------------------
def test_positions_of_hot_and_null_keys(spark):
    from pyspark.sql import functions as F

    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(50)]), i) for i in range(700)]
    df = spark.createDataFrame(rows, "key STRING, at INT, i INT")
    found = positions.numbered(df, "key", [F.col("at").asc_nulls_first(), F.col("i")], run_folder(spark, "t"), "n", "nth").collect()
    places = {}
    for key, at, i in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0, r[2])):
        places[i] = (key, sum(k == key for k, _ in places.values()))
    assert {r["i"]: (r["key"], r["nth"]) for r in found} == places


# ---- Merkle manifest -------------------------------------------------------------------
DOCS = "doc_id LONG, source STRING, lang STRING, n_chars LONG, text STRING, tree STRING, leaf STRING, `order` INT, block INT"


def encoded(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        row = levels[-1]
        levels.append([sha(*row[i:i + 3]) for i in range(0, len(row), 3)])
    return levels


def way(levels, at):
    steps = []
    for row in levels[:-1]:
        first = at - at % 3
        steps.append((row[first:at], row[at + 1:first + 3]))
        at //= 3
    return steps


def by_hand(rows):
    first = lambda x: (x is not None, x if x is not None else 0)
    leaf = lambda r, text: sha(*map(encoded, (r[0], r[1], r[2], r[3], text)))
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    groups = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (first(r[0]), leaf(r, r[4]))) for s in sources}
    trees = {s: levels_of([leaf(r, r[4]) for r in groups[s]]) for s in sources}
    top = levels_of([trees[s][-1][0] for s in sources])
    out = []
    for n, s in enumerate(sources):
        for k, r in enumerate(groups[s]):
            steps = way(trees[s], k) + way(top, n)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            folded = leaf(r, r[4].replace("\n", "")) if hit else leaf(r, r[4])
            for before, after in steps:
                folded = sha(*before, folded, *after)
            out.append((r[0], leaf(r, r[4]), trees[s][-1][0], top[-1][0], sha(*[x for a, b in steps for x in (*a, *b)]), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def manifest_of(spark, rows):
    df = spark.createDataFrame([(*r, "t", "l", 1, 2) for r in rows], DOCS)
    got = merkle.tamper_check(spark, df)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def documents(n, seed=5):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["s0"] * 8 + ["Z", "ä", "", None]), rng.choice(["en", None]), rng.choice([None, 3]),
             rng.choice([None, "", "a\nb", "ü\n\n" * 20, "no breaks", "long " * 4000 + "\n"])) for i in range(n)]
    return rows + rows[:9] + [(None, "s0", None, None, "x\ny"), (None, "s0", None, None, "x\ny"), (7, "s0", "en", 1, "other\ntext")]


@pytest.mark.parametrize("n", [0, 1, 3, 900])
def test_manifest_by_hand(spark, n):
    rows = documents(n) if n != 1 else [(4, None, None, None, "a\nb")]
    rows = [] if n == 0 else rows
    assert manifest_of(spark, rows) == by_hand(rows)


def test_many_sources(spark):
    rows = [(i, f"s{i % 260}", "en", i, f"t\n{i}") for i in range(600)]
    got = manifest_of(spark, rows)
    assert got == by_hand(rows)
    assert {r[-1] for r in got} == {True, False}


def test_versions_share_all_but_ancestors():
    tree = merkle.PathTree([sha(str(i)) for i in range(100)])
    before = list(tree.digests)
    top = tree.top
    version = tree.changed(top, 42, sha("new"))
    assert tree.digests[:len(before)] == before and len(tree.digests) == len(before) + 1 + tree.height
    leaves = [sha(str(i)) for i in range(100)]
    leaves[42] = sha("new")
    assert tree.digests[version] == levels_of(leaves)[-1][0] and tree.digests[top] == levels_of([sha(str(i)) for i in range(100)])[-1][0]
    again = tree.changed(version, 43, sha("more"))
    leaves[43] = sha("more")
    assert tree.digests[again] == levels_of(leaves)[-1][0]


# ---- prefix trie -----------------------------------------------------------------------
TALK = "conv_id LONG, turn LONG, role STRING, text STRING, name STRING, depth INT, conv INT, k INT"


def trie_by_hand(rows):
    talks = {}
    token = lambda r: (r[2] or "", r[3] or "")
    digest = lambda t: hashlib.sha256(f"{len(t[0].encode())}:{t[0]}{t[1]}".encode()).digest()
    for r in rows:
        if r[0] is not None:
            talks.setdefault(r[0], []).append((r[1] is not None, r[1] or 0, digest(token(r)), token(r)))
    talks = {c: [t[-1] for t in sorted(ts)] for c, ts in talks.items()}
    rebuilt = {}
    for c, own in talks.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        rebuilt[c] = tuple(talks.get(base, [])[:h] + own[h:])
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)

    def total(node):
        todo, leaves, saved = [node], 0, 0
        while todo:
            x = todo.pop()
            leaves += x not in kids
            saved += (len(members[x]) - 1) * (len(x[-1][1].encode()) if x else 0)
            todo += kids.get(x, [])
        return leaves, saved

    out = []
    for node, convs in members.items():
        ended = ",".join(str(c) for c in sorted(convs) if len(rebuilt[c]) == len(node))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(kids.get(node, [])), *total(node), sha(ended)))
    return sorted(out, key=str)


def trie_of(spark, rows, depth):
    df = spark.createDataFrame([(*r, "n", 1, 2, 3) for r in rows], TALK)
    got = prefix_trie.trie(spark, df, depth=depth)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def conversations(n=60, seed=2):
    rng = random.Random(seed)
    rows = []
    for c in [*range(n), -3, -5, 10 ** 12, 2 ** 63 - 1, -2 ** 63]:
        if rng.random() < 0.15:
            continue
        for t in range(rng.choice([1, 2, 3, 8, 9, 17])):
            rows.append((c, rng.choice([t, t, None]) if t < 3 else t, rng.choice(["user", "user", "bot", None]), rng.choice(["hi", "hi", "é", "", None])))
    rows += [(c, 0, "user", "hot") for c in range(2000, 2300)]
    return rows + rows[:5] + [(None, 1, "user", "lost")]


@pytest.mark.parametrize("depth", [1, 4])
def test_trie_by_hand(spark, depth):
    rows = conversations()
    assert trie_of(spark, rows, depth) == trie_by_hand(rows)


def test_trie_of_one_long_talk_and_of_nothing(spark):
    rows = [(0, t, "user", f"t{t % 3}" * (t % 5)) for t in range(70)] + [(c, t, "user", f"t{t % 3}" * (t % 5)) for c in (1, 2) for t in range(40 + c)]
    assert trie_of(spark, rows, 2) == trie_by_hand(rows)
    assert trie_of(spark, [], 4) == [] and trie_of(spark, [(None, 1, "a", "b")], 4) == []
    only = [(1, 0, "a", "b")]  # borrows from a conversation that is not there
    assert trie_of(spark, only, 4) == trie_by_hand(only)


# ---- quality votes ------------------------------------------------------------------------
def text_of(rng, good):
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(20, 80))]
    if good:
        return " ".join(words) + "."
    return rng.choice([" ".join(w.upper() + "!!" for w in words), " ".join([words[0]] * 40), " | ".join(words)])


def test_votes_on_held_out_texts():
    rng = random.Random(4)
    rows = [(text_of(rng, y), int(y)) for y in [True, True, False] * 150]
    model = neighbour_vote.fit(rows[:300])
    scores = model.score([t for t, _ in rows[300:]])
    assert np.mean((scores >= 0.5) == np.array([y for _, y in rows[300:]])) > 0.97
    assert model.score([None, "", " \n"]) == pytest.approx([model.prior] * 3)
    again = neighbour_vote.fit(rows[:300][::-1])
    assert np.allclose(again.score([t for t, _ in rows[300:]]), scores)


def test_nearest_and_vote_against_brute_force():
    rng = np.random.default_rng(3)
    cosines = rng.integers(0, 4, (40, 30)).astype(np.float32)
    for k in (1, 5, 30, 50):
        want = np.sort(np.argsort(-cosines, axis=1, kind="stable")[:, :k], axis=1)
        assert (np.sort(neighbour_vote._nearest(cosines, k), axis=1) == want).all()
    r = random.Random(9)
    rows = [(text_of(r, y), int(y)) for y in [True, False] * 40]
    model = neighbour_vote.fit(rows)
    texts = [text_of(r, y) for y in [True, False] * 10]
    for text, score in zip(texts, model.score(texts, neighbours=7, block=3), strict=True):
        near = sorted(((-float(model.place([text])[0] @ v), i) for i, v in enumerate(model.vectors)))[:7]
        weights = [max(0.0, -c) ** 4 for c, _ in near]
        assert score == pytest.approx(sum(w * model.labels[i] for w, (_, i) in zip(weights, near, strict=True)) / sum(weights), abs=1e-4)


def test_votes_of_tables(spark):
    rng = random.Random(6)
    docs = [(i, text_of(rng, i % 3 > 0), "x") for i in range(90)] + [(90, None, "x"), (None, "words alone", "x"), (91, "", "x"), (1, text_of(rng, True), "x"), (92, "word " * 60_000, "x")]
    df = spark.createDataFrame(docs, "doc_id LONG, text STRING, score STRING")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(60)] + [(3, 1), (None, 1), (70, None)], "doc_id LONG, quality INT")
    model = neighbour_vote.train(df, labels)
    got = df.select("doc_id", neighbour_vote.quality(df, model).alias("v")).collect()
    assert len(got) == len(docs) and all(0 <= r["v"] <= 1 for r in got)
    told = {r["doc_id"]: r["v"] for r in got if r["doc_id"] is not None and 60 <= r["doc_id"] < 90}
    assert all((v >= 0.5) == (i % 3 > 0) for i, v in told.items())
    assert {r["v"] for r in got if r["doc_id"] in (90, 91)} == {model.prior}
    none = neighbour_vote.train(df, labels.where("false"))
    assert {r[0] for r in df.select(neighbour_vote.quality(df, none)).collect()} == {0.5}
    assert df.where("false").select(neighbour_vote.quality(df, model)).collect() == []
