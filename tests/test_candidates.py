import math
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import candidates

SEEDS = "view STRING, member STRING"


def _nearness(df):
    return {(r["view"], r["member"]): r["nearness"] for r in df.collect()}


def test_closest_seed_along_lines(spark):
    rng = random.Random(5)
    rows = [(f"m{i}", rng.choice(["a", "b", None]), rng.choice([None, *map(float, range(-40, 40))])) for i in range(200)]
    rows += rows[:20] + [(None, "a", 1.0)]
    seeds = [("v", f"m{i}") for i in range(6)] + [("w", "m7"), ("w", "m7"), ("w", None), (None, "m8"), ("w", "unknown")]
    got = _nearness(candidates.close_along(spark.createDataFrame(rows, "member STRING, line STRING, place DOUBLE"), spark.createDataFrame(seeds, SEEDS), 3, "turn"))
    want = {}
    places = {r for r in rows if None not in r}
    for view, seed in seeds:
        for s, line, at in places:
            if s == seed and view is not None:
                for m, other, place in places:
                    if other == line and abs(place - at) <= 3:
                        want[view, m] = max(want.get((view, m), -9.0), -abs(place - at))
    assert got == want
    with pytest.raises(ValueError):
        candidates.close_along(spark.createDataFrame(rows, "member STRING, line STRING, place DOUBLE"), spark.createDataFrame(seeds, SEEDS), 0, "turn")


def test_nearest_single_example(spark):
    rng = random.Random(6)
    rows = [(f"m{i}", [rng.uniform(-1, 1) for _ in range(5)]) for i in range(600)]
    rows += [("zero", [0.0] * 5), ("nan", [1.0, math.nan, 0.0, 0.0, 0.0]), ("inf", [math.inf, 1.0, 0.0, 0.0, 0.0]), ("hole", [1.0, None, 0.0, 0.0, 0.0]), ("none", None), ("short", [1.0, 2.0])]
    seeds = [("v", f"m{i}") for i in range(300)] + [("w", "m4"), ("w", "zero"), ("w", "nan"), ("x", "none")]
    got = _nearness(candidates.nearest_example(spark.createDataFrame(rows, "member STRING, vector ARRAY<DOUBLE>"), spark.createDataFrame(seeds, SEEDS)))
    unit = {m: [x / math.sqrt(sum(y * y for y in v)) for x in v] for m, v in rows[:600]}
    want = {}
    for view, seed in seeds:
        for m in unit if seed in unit else ():
            cosine = sum(a * b for a, b in zip(unit[seed], unit[m], strict=True))
            want[view, m] = max(want.get((view, m), -2), cosine)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_words_weigh_by_rarity(spark):
    rows = [("a", ["red", "red", "stone"]), ("b", ["stone"]), ("c", ["stone", "red"]), ("d", ["blue"]), ("e", None), ("f", [])]
    got = _nearness(candidates.shared_words(spark.createDataFrame(rows, "member STRING, words ARRAY<STRING>"), spark.createDataFrame([("v", "a")], SEEDS)))
    red, stone = round(math.log(7 / 3) * 1000), round(math.log(7 / 4) * 1000)
    assert got == {("v", "a"): red + stone, ("v", "b"): stone, ("v", "c"): red + stone}


def test_ranks_are_fused(spark):
    rows = [("v", "a", "time", -1.0), ("v", "b", "time", -2.0), ("v", "b", "time", -5.0), ("v", "s", "time", 0.0), ("v", "c", "time", -2.0),
            ("v", "c", "words", 9.0), ("v", "d", "words", 8.0), ("w", "a", "words", 1.0), ("w", "b", "words", None)]
    signals = spark.createDataFrame(rows, "view STRING, member STRING, signal STRING, nearness DOUBLE")
    seeds = spark.createDataFrame([("v", "s"), ("v", "s")], SEEDS)
    got = [(r["view"], r["position"], r["member"], r["reasons"]) for r in candidates.fuse([signals, signals], seeds, 3).orderBy("view", "position").collect()]
    assert got == [("v", 1, "c", "time:3 words:1"), ("v", 2, "a", "time:1"), ("v", 3, "b", "time:2"), ("w", 1, "a", "words:1")]
    shallow = candidates.fuse([signals], seeds, 10, depth=1).collect()
    assert {(r["view"], r["member"]) for r in shallow} == {("v", "a"), ("v", "c"), ("w", "a")}
    for depth in (0, 5000):
        with pytest.raises(ValueError):
            candidates.fuse([signals], seeds, depth=depth)


def test_empty_inputs(spark):
    none = spark.createDataFrame([], SEEDS)
    u = spark.createDataFrame([("a", "l", 1.0, ["x"], [1.0])], "member STRING, line STRING, place DOUBLE, words ARRAY<STRING>, vector ARRAY<DOUBLE>")
    some = spark.createDataFrame([("v", "a")], SEEDS)
    for rows, seeds in ((u, none), (u.where(F.lit(False)), some)):
        signals = [candidates.shared_words(rows, seeds), candidates.close_along(rows, seeds, 1, "turn"), candidates.nearest_example(rows, seeds)]
        assert candidates.fuse(signals, seeds).collect() == []
