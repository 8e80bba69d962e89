import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import ann, ngram_join

VECTORS = "vec_id LONG, embedding ARRAY<FLOAT>, id STRING, part STRING, v STRING"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "a", "b", "c") for i, v in rows], VECTORS)


def nearest(rows, k=20):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows]
    out = set()
    for i, q in good:
        if i % 20 == 0:
            ranked = sorted((-(q * v).sum(), j) for j, v in good if j != i)[:k]
            out |= {(i, n, j, -s) for n, (s, j) in enumerate(ranked, 1)}
    return out


def clustered(n, d=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d))
    x = centres[rng.integers(0, 12, n)] + 0.4 * rng.normal(size=(n, d))
    return list(enumerate(x / np.linalg.norm(x, axis=1, keepdims=True)))


def test_one_part_is_exact_with_copies_and_odd_rows(spark):
    rows = clustered(300)
    rows += [(1000 + i, rows[7][1]) for i in range(60)]
    odd = [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [None] + [1.0] * 15), (2080, [1.0] * 3), (None, rows[0][1]), (2100, [float("inf")] * 16)]
    got = {tuple(r) for r in ann.search(vectors_of(spark, rows + odd), F.col("id") % 20 == 0).collect()}
    want = nearest(rows)
    assert {r[:3] for r in got} == {r[:3] for r in want}
    scores = {r[:3]: r[3] for r in want}
    assert all(abs(s - scores[i, n, j]) < 1e-12 for i, n, j, s in got)


def test_few_rows_and_none(spark):
    rows = clustered(5)
    assert {tuple(r)[:3] for r in ann.search(vectors_of(spark, rows), F.col("id") % 20 == 0).collect()} == {r[:3] for r in nearest(rows)}
    assert ann.search(vectors_of(spark, rows).limit(0), F.lit(True)).count() == 0
    twice = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.0])]
    assert {(r["query_id"], r["vec_id"]) for r in ann.search(vectors_of(spark, twice), F.col("id") % 20 == 0).collect()} == {(0, 1)}


@pytest.mark.parametrize("settings", [ann.Settings(), ann.Settings(part_rows=60, coverage=1.0, block_rows=64, epochs=5)])
def test_ids_that_repeat_count_once(spark, settings):
    rows = clustered(240)
    again = [rows[0], rows[0], rows[20], rows[7], rows[7], rows[33]]
    other = [(40, rows[3][1]), (5, rows[9][1]), (5, -np.array(rows[9][1]))]
    found = ann.search(vectors_of(spark, rows + again + other), F.col("id") % 20 == 0, settings=settings)
    got = [tuple(r)[:3] for r in found.orderBy("query_id", "rank").collect()]
    of = {}
    for i, v in rows + other:
        of.setdefault(i, []).append(np.array(v, np.float32).astype(float))
    want = []
    for i in range(0, 240, 20):
        ranked = sorted((-max((a * b).sum() for a in of[i] for b in of[j]), j) for j in of if j != i)
        want += [(i, n, j) for n, (_, j) in enumerate(ranked[:20], 1)]
    assert got == want


def test_few_ids_of_many_rows_are_all_found(spark):
    rows = clustered(30)
    rows += [rows[0]] * 600
    settings = ann.Settings(part_rows=60, coverage=0.0, block_rows=64, epochs=2)
    got = ann.search(vectors_of(spark, rows), F.col("id") == 0, settings=settings).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 21)) and len({r["vec_id"] for r in got}) == 20


def test_many_parts_reach_recall(spark):
    rows = clustered(4000)
    rows += [(10_000 + i, rows[3][1]) for i in range(1500)]
    settings = ann.Settings(sample_rows=2_000, part_rows=300, epochs=15, block_rows=512)
    got = ann.search(vectors_of(spark, rows), F.col("id") % 20 == 0, settings=settings).collect()
    want = nearest(rows)
    hits = {(r["query_id"], r["vec_id"]) for r in got} & {(i, j) for i, _, j, _ in want}
    assert len(hits) >= 0.93 * len(want) and len(got) == len(want)


def test_parts_are_balanced():
    x = np.array([v for _, v in clustered(1000)])
    label = ann.balanced_parts(x, ann.neighbour_graph(x, 10), 8, 1.1)
    assert np.bincount(label, minlength=8).max() <= 1.1 * 125 + 1


DOCS = "doc_id LONG, text STRING, source STRING, print STRING, key STRING, row STRING"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "s", "a", "b", "c") for r in rows], DOCS)


def shingles(text):
    words = (text or "").split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    near = [[j for j in range(len(rows)) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8] for i in range(len(rows))]
    root = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, js in enumerate(near):
            for j in js:
                if root[j] < root[i]:
                    root[i], changed = root[j], True
    ids = {}
    for i, r in enumerate(root):
        if rows[i][0] is not None:
            ids[r] = min(ids.get(r, 1 << 62), rows[i][0])
    return sorted(((rows[i][0], ids.get(root[i]) if sets[i] else rows[i][0], len(near[i])) for i in range(len(rows))), key=repr)


def near_copies(rng, base, n, edits):
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10 ** 6)}"
        yield " ".join(words)


def corpus(seed=2):
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    texts = [" ".join(fresh(rng.randint(1, 120))) for _ in range(60)]
    texts += list(near_copies(rng, fresh(200), 90, 8))
    for _ in range(8):
        texts += near_copies(rng, fresh(80), 5, 3)
    texts += [texts[70]] * 40 + [None, "", " \n", "one two", "one two", "x " * 20_000]
    rows = list(enumerate(texts, 100))
    rng.shuffle(rows)
    return rows + [(None, texts[0]), (None, "alone without any id here now"), rows[0]]


@pytest.mark.parametrize("few, tile", [(64, 256), (3, 7)])
def test_join_matches_brute_force(spark, few, tile):
    rows = corpus()
    got = ngram_join.join(docs_of(spark, rows), ngram_join.Settings(few=few, tile=tile)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_one_of_each_keeps_least_ids(spark):
    rows = [r for r in corpus() if r[0] is not None]
    kept = ngram_join.one_of_each(docs_of(spark, rows))
    assert kept.columns == docs_of(spark, rows).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({i for i, c, _ in brute(rows) if i == c})
    assert ngram_join.join(docs_of(spark, rows).limit(0)).count() == 0


def test_one_of_each_of_ids_with_several_texts(spark):
    base = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(3, base), (5, base + " tail"), (5, other), (7, other + " x"), (7, other + " y"), (7, other + " y"), (None, "no id here at all"),
            (None, "no id here at all"), (8, None), (8, None), (8, ""), (None, None), (5, "a third text of this id")]
    kept = sorted(((r["doc_id"], r["text"]) for r in ngram_join.one_of_each(docs_of(spark, rows)).collect()), key=str)
    assert kept == sorted([(3, base), (5, other), (None, "no id here at all"), (8, None), (8, ""), (None, None), (5, "a third text of this id")], key=str)
    hot = docs_of(spark, [(None, "copied")] * 500 + [(1, "alone")])
    assert sorted((r["text"] for r in ngram_join.one_of_each(hot).collect())) == ["alone", "copied"]


def test_pruning_bounds():
    s = ngram_join.Settings()
    steps = dict(ngram_join.least_matches(s))
    assert list(steps) == [25, 50, 75, 100, 125] and all(0 < m < 0.8 * n for n, m in steps.items())
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 32, (2000, s.hashes), dtype=np.uint64).astype(np.uint32)
    for share, kept in ((0.8, 1.0), (0.3, 0.0)):
        b = np.where(rng.random(a.shape) < share, a, a + 1)
        assert abs(ngram_join.survives(a, b, s).mean() - kept) < 0.002


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)]
    got = {r["node"]: r["root"] for r in ngram_join.components(spark.createDataFrame(edges, "u LONG, v LONG")).collect()}
    assert got == {i: 0 for i in range(41)} | {k: 100 for k in range(100, 160)}


def test_tile_of_one_block_equals_two():
    s = ngram_join.Settings()
    rng = random.Random(5)
    texts = list(near_copies(rng, [f"w{i}" for i in range(150)], 30, 6))
    sets = [ngram_join.shingle_set(t, 5) for t in texts]
    frame = pd.DataFrame({"id": range(30), "sig": [ngram_join.min_hashes(x, s.hashes).tobytes() for x in sets],
                          "shingles": [x.tobytes() for x in sets], "copies": 1})
    total = lambda frames: sum(f["links"].sum() for f in frames)
    one = [ngram_join.compare_tile(frame, None, b, s) for b in range(s.bands)]
    halves = frame[:11].reset_index(drop=True), frame[11:].reset_index(drop=True)
    parts = [f for b in range(s.bands) for f in (ngram_join.compare_tile(halves[0], None, b, s), ngram_join.compare_tile(halves[1], None, b, s), ngram_join.compare_tile(*halves, b, s))]
    want = sum(2 for i in range(30) for j in range(i) if ngram_join.jaccard(sets[i], sets[j]) >= 0.8)
    assert total(one) == total(parts) == want


def test_filter_holds_all_ids(spark):
    ids = [0, -1, 5, 1 << 40, -(1 << 63), *range(1000, 3000, 7)]
    words = ngram_join.id_filter(spark.createDataFrame([(i,) for i in ids], "_id LONG"))
    assert ngram_join.in_filter(words, np.array(ids)).all()
    assert ngram_join.in_filter(words, np.arange(100_000, 200_000)).mean() < 0.2
