import hashlib
import random
import uuid

from conftest import NAMESPACE
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import ids
from corpusloom.functions.durable import broadcast_if_small
from corpusloom.functions.ordered import grouped_page, grouped_previous, grouped_rank
from corpusloom.functions.text import escape_field, unescape_field, words


def test_ids_equal_the_standard_library(spark):
    names = ["E1", "naïve", "日本", "", "a|b", "😀"]
    df = spark.createDataFrame([(n,) for n in names], "n STRING")
    got = {r["n"]: (r["u"], r["d"], r["o"]) for r in df.select(
        "n", ids.uuid5_col(NAMESPACE, "n").alias("u"), ids.derived_uuid_col(NAMESPACE, "kind", "n", F.lit(3)).alias("d"),
        ids.uuid5_of(F.lit(NAMESPACE), F.col("n")).alias("o")).collect()}
    for n in names:
        plain = str(uuid.uuid5(uuid.UUID(NAMESPACE), n))
        assert got[n] == (plain, str(uuid.uuid5(uuid.UUID(NAMESPACE), f"kind:{n}|3")), plain)


def test_content_hash_and_time(spark):
    row = spark.range(1).select(
        ids.content_hash(F.lit("tï"), F.lit("d")).alias("h"), ids.object_content_hash(F.lit('a"'), F.lit("b\n")).alias("o"),
        ids.ns_time(F.lit("2020-01-01 00:00:59").cast("timestamp"), F.lit(2_000_000_005)).alias("t")).first()
    assert row["h"] == hashlib.sha256("tï\0d".encode()).hexdigest()
    assert row["o"] == hashlib.sha256('{"description":"b\\n","title":"a\\""}'.encode()).hexdigest()
    assert row["t"] == "2020-01-01T00:01:01.000000005Z"


def test_skewed_groups_match_plain_windows(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(20)}", rng.randrange(10_000) * 1000 + i % 1000, f"v{i}") for i in range(900)]
    rows = list({(k, t): (k, t, v) for k, t, v in rows}.values())
    df = spark.createDataFrame(rows, "k STRING, t BIGINT, v STRING")
    w = W.partitionBy("k").orderBy("t")
    want = {tuple(r) for r in df.select("k", "t", F.row_number().over(w), F.lag("v").over(w)).collect()}
    bucket = F.floor(F.col("t") / 100_000)
    ranked = grouped_rank(df, ["k"], [F.col("t")], bucket)
    both = grouped_previous(ranked, ["k"], [F.col("t")], bucket, F.col("v"), "prev")
    assert {tuple(r) for r in both.select("k", "t", "rank", "prev").collect()} == want


def test_deep_pages_use_the_bucket(spark):
    df = spark.range(5000).select(F.lit("hot").alias("k"), F.col("id").alias("t"))
    page = grouped_page(df, ["k"], [F.col("t")], 10, 3000, F.floor(F.col("t") / 100)).orderBy("position").collect()
    assert [r["t"] for r in page] == list(range(3000, 3010))
    assert {(r["total"], r["next_cursor"]) for r in page} == {(5000, 3010)}
    last = grouped_page(df, ["k"], [F.col("t")], 10, 4995).collect()
    assert len(last) == 5 and last[0]["next_cursor"] is None


def test_pages_prune_before_the_shuffle(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), F.col("id").alias("t"))
    plan = grouped_page(df, ["k"], [F.col("t")], 10)._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_escapes_invert(spark):
    texts = ["a|b||c", "back\\slash", "line\nbreak\r", "😀 \\n literal", "", "trailing\\"]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    assert all(r["t"] == r["b"] for r in df.select("t", unescape_field(escape_field(F.col("t"))).alias("b")).collect())


def test_words_without_marks(spark):
    said = ["Crème BRÛLÉE", "cafe\u0301s Łódź Việt ǖ", "ĥąčęk’s žluťoučký", "Ёж й ά", "x\u0301\u0323y 1\u0301", None, ""]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i INT, s STRING")
    got = [r["w"] for r in df.orderBy("i").select(words(F.col("s")).alias("w")).collect()]
    assert got == [["creme", "brulee"], ["cafes", "łodz", "viet", "u"], ["hacek", "s", "zlutoucky"], ["ёж", "й", "ά"], ["xy", "1"], None, []]


def test_only_counted_tables_are_broadcast(spark):
    small = spark.range(5)
    plan = lambda df: spark.range(100).join(df, "id")._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(broadcast_if_small(small, 5)) and "broadcast" not in plan(broadcast_if_small(small, 4))
    assert spark.range(100).join(broadcast_if_small(small, 4), "id").count() == 5
