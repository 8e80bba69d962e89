import itertools
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import mixing, packing

DOCS = "doc_id LONG, text STRING, source STRING, size STRING, target STRING, row STRING"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], DOCS)


def words(n):
    return " ".join(["w"] * n)


def many(seed=3, n=400):
    rng = random.Random(seed)
    return [(i, words(rng.choice([0, 1, 5, 40])), rng.choice(["a", "a", "a", "b", "ä", "Z", None])) for i in range(n)]


def filled(sizes, weights, total, limit):
    """Targets by sharing the excess again and again."""
    held, left = {}, dict(zip(sizes, weights, strict=True))
    while left:
        rest = total - sum(held.values())
        over = {k for k, w in left.items() if rest * w / sum(left.values()) > limit * sizes[k]}
        if not over:
            return held | {k: rest * w / sum(left.values()) for k, w in left.items()}
        held |= {k: limit * sizes[k] for k in over}
        left = {k: w for k, w in left.items() if k not in over}
    return held


def test_plan_matches_repeated_sharing_and_sql(spark):
    rows = [*many(), (None, "one two", "b"), (7, None, None), (7, None, None), (9001, words(30000), "long")]
    docs = docs_of(spark, rows)
    got = mixing.plan_mix(docs).collect()
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    targets = filled({s: sizes[s] for s in order}, [(3, 1, 2)[i % 3] for i in range(len(order))], 1.5 * sum(sizes.values()), 2)
    assert {(r["source_size"], round(r["target"], 6)) for r in got} == {(sizes[s], round(targets[s], 6)) for s in order}
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    documents = docs.select("doc_id", "text", "source").toArrow()  # noqa: F841
    expected = duckdb.sql(mixing.SQL).fetchall()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)


def test_mix_emits_what_the_plan_takes(spark):
    docs = docs_of(spark, many())
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    times = Counter(r["doc_id"] for r in mixed.collect())
    for r in mixing.plan_mix(docs).collect():
        assert r["taken"] == r["size"] * times[r["doc_id"]]


def test_rows_without_id_and_repeated_ones_draw_for_themselves(spark):
    rows = [(None, words(1 + i % 3), "abc"[i % 3]) for i in range(2000)] + [(4, words(3), "d")] * 10_000 + [(5, None, "d")] * 3
    docs = docs_of(spark, rows)
    taken, target = Counter(), {}
    for r in mixing.plan_mix(docs).collect():
        taken[r["source_size"], r["target"]] += r["taken"]
    assert len(taken) == 4 and all(abs(n - target) < 0.06 * target for (_, target), n in taken.items())
    mixed = Counter(r["source"] for r in mixing.mix(docs).collect() if r["text"])
    size = {"a": 1, "b": 2, "c": 3, "d": 3}
    assert sorted(mixed[s] * size[s] for s in size) == sorted(taken.values())
    documents = docs.select("doc_id", "text", "source").toArrow()  # noqa: F841
    assert sorted(map(str, duckdb.sql(mixing.SQL).fetchall())) == sorted(str(tuple(r)) for r in mixing.plan_mix(docs).collect())


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert mixing.plan_mix(empty).count() == 0 and mixing.mix(empty).count() == 0
    assert [r["taken"] for r in mixing.plan_mix(docs_of(spark, [(1, None, None), (2, "", "a")])).collect()] == [0, 0]


def padding(lengths, bounds):
    return sum(min(b for b in bounds if b >= n) - n for n in lengths)


@pytest.mark.parametrize("seed", range(6))
def test_boundaries_are_optimal(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([0, 1, 2, 3, 7, 20, 21, 50, 99]) for _ in range(60)]
    histogram = sorted((n, c, n * c) for n, c in Counter(lengths).items())
    for buckets in range(1, 6):
        bounds = packing.optimal_boundaries(histogram, buckets)
        inner = sorted(set(lengths))[:-1]
        best = min(padding(lengths, [*chosen, max(lengths)]) for k in range(min(buckets, len(inner) + 1)) for chosen in itertools.combinations(inner, k))
        assert padding(lengths, bounds) == best and len(bounds) <= buckets and bounds[-1] == max(lengths)
    assert padding(lengths, packing.optimal_boundaries(histogram, 50)) == 0


def test_batches_hold_the_budget(spark):
    rows = [*many(5, 3000), (None, None, None), (8, words(100_000), "a"), (9, words(100_000), "a")]
    got = packing.pack(docs_of(spark, rows), budget=200, buckets=3, shard_rows=64).collect()
    assert len(got) == len(rows) and sorted(r["n_tokens"] for r in got) == sorted(len((t or "").split()) for _, t, _ in rows)
    batches = Counter((r["bucket"], r["batch"], r["bucket_length"]) for r in got)
    for (_, _, length), n in batches.items():
        assert n <= max(1, 200 // max(1, length))
    for bucket in {b for b, _, _ in batches}:
        sizes = [n for (b, batch, _), n in sorted(batches.items()) if b == bucket]
        assert sorted(batch for b, batch, _ in batches if b == bucket) == list(range(len(sizes)))
        assert len(set(sizes[:-1])) <= 1
    assert all(r["padding"] == r["bucket_length"] - r["n_tokens"] >= 0 for r in got)


def test_long_lengths_share_bins(spark):
    lengths = spark.range(16_000, 40_000).select(F.col("id").alias("n_tokens"))
    bins = packing.length_histogram(lengths)
    assert sum(b[1] for b in bins) == 24_000 and bins[-1][0] == 39_999 and len(bins) < 9_000
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0
