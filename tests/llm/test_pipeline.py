import random
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__
import corpus_pipeline
from corpusloom.llm import langid, packing, queries, toxicity

from test_ann_join import brute, near_copies


@pytest.fixture(scope="module")
def sf_dir(tmp_path_factory):
    """Documents in two languages with toxic ones, near copies, odd texts and several sources, and their labels."""
    rng = random.Random(11)
    speech = {"en": "the and thing water house green".split(), "de": "der und schön wasser haus grün".split()}
    rows, toxic = [], {}
    for i in range(240):
        lang = rng.choice(["en", "de"])
        words = [rng.choice(speech[lang]) + "".join(rng.choices("aeiou", k=rng.randint(0, 3))) for _ in range(rng.randint(20, 90))]
        toxic[i] = i % 6 == 0
        if toxic[i]:
            for _ in range(3):
                words[rng.randrange(len(words))] = "moron"
        rows.append((i, " ".join(words), lang, rng.choice(["a", "a", "b", "c", None]), 0))
    for k in range(6):
        base = [rng.choice(speech["en"]) + str(rng.randrange(500)) for _ in range(100)]
        rows += [(300 + 10 * k + j, t, "en", "b", 0) for j, t in enumerate(near_copies(rng, base, 5, 2))]
    rows += [(900, None, "en", "a", 0), (901, "123 456", "en", "a", 0), (902, "", None, None, 0), (903, "the house", "en", "c", None)]
    folder = tmp_path_factory.mktemp("tables")
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    pq.write_table(pa.table({n: [r[k] for r in rows] for k, n in enumerate(names)}), folder / "documents.parquet")
    labels = [(i, int(t)) for i, t in toxic.items() if i % 4]
    pq.write_table(pa.table({"doc_id": [i for i, _ in labels], "quality": [1] * len(labels), "toxic": [t for _, t in labels]}), folder / "labels.parquet")
    return str(folder), rows, toxic


def test_stages_match_brute_force(spark, sf_dir):
    folder, rows, toxic = sf_dir
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    at = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, folder).cache()
        at[name] = [r.asDict() for r in docs.collect()]
        if name != "packing":
            assert docs.columns == before.columns
    with_letters = [r for r in rows if r[1] and any(map(str.isalpha, r[1]))]
    assert sorted(r["doc_id"] for r in at["language_id"]) == sorted(r[0] for r in with_letters)
    assert sorted(r["doc_id"] for r in at["toxicity"]) == sorted(r[0] for r in with_letters if not toxic.get(r[0]))
    left = [(r["doc_id"], r["text"]) for r in at["toxicity"]]
    assert sorted(r["doc_id"] for r in at["ngram_join"]) == sorted(i for i, c, _ in brute(left) if i == c)
    size = lambda r: len(r["text"].split())
    given, taken = Counter(), Counter()
    for r in at["ngram_join"]:
        given[r["source"]] += size(r)
    for r in at["mixing"]:
        taken[r["source"]] += size(r)
    assert max(Counter(r["doc_id"] for r in at["mixing"]).values()) <= 2 and set(taken) <= set(given)
    assert abs(sum(taken.values()) / (1.5 * sum(given.values())) - 1) < 0.15
    lengths = sorted(map(size, at["mixing"]))
    assert sorted(r["n_tokens"] for r in at["packing"]) == lengths
    bounds = packing.optimal_boundaries(sorted((n, c, n * c) for n, c in Counter(lengths).items()), 16)
    assert sum(r["padding"] for r in at["packing"]) == sum(min(b for b in bounds if b >= n) - n for n in lengths)


def test_run_agrees_with_the_stages_and_reruns(spark, sf_dir):
    folder, *_ = sf_dir
    key = lambda df: sorted(map(tuple, df.select("doc_id", "n_tokens", "bucket", "padding").collect()))
    assert key(corpus_pipeline.run(spark, folder)) == key(corpus_pipeline.run(spark, folder))


def test_held_out_predictions(spark, sf_dir):
    folder, rows, toxic = sf_dir
    found = {r["doc_id"]: r for r in queries.op4_toxicity(spark, folder).collect()}
    assert len(found) == len(rows) and all(found[i]["predicted"] == int(t) for i, t in toxic.items())
    named = queries.op5_language_id(spark, folder).collect()
    lang = {r[0]: r[2] for r in rows if r[2] and r[1] and any(map(str.isalpha, r[1]))}
    assert all(r["lang_pred"] == lang[r["doc_id"]] for r in named if r["doc_id"] in lang and r["doc_id"] < 300)
    assert {r["lang_pred"] for r in named if r["doc_id"] in (900, 901, 902)} == {langid.UNDETERMINED}


def test_all_are_registered():
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in __spark_entry__.queries()
    assert {k for k in __spark_entry__.oracle_sql() if k in queries.QUERIES} == set(queries.SQL)
    assert toxicity.GRAMMAR.arcs
