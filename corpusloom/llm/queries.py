"""The registered queries of this subpackage, and SQL twins where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import ann, html_extract, langid, licenses, merkle, mixing, neighbour_vote, ngram_join, packing, prefix_trie, quality, toxicity, warc
from corpusloom.llm.common import crc_remainder, table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.withColumn("_m", html_extract.extract("html")).select("page_id", "url", "_m.text", "_m.n_chars", "_m.n_blocks", "_m.n_kept")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    return toxicity.train(docs, labels.where(crc_remainder("doc_id", 5) != 0))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    return docs.select("doc_id", (crc_remainder("doc_id", 5) == 0).alias("held_out"), toxicity.toxicity(docs, model).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


def language_model(docs: DataFrame) -> langid.Model:
    return langid.train(docs.where(crc_remainder("doc_id", 4) != 2), langid.public_pieces())


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    named = langid.identify(docs, language_model(docs)).alias("_p")
    return docs.select("doc_id", (crc_remainder("doc_id", 4) == 2).alias("held_out"), named).select("doc_id", "held_out", "_p.lang_pred", "_p.score")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", licenses.scan("text").alias("_f")).select("doc_id", "_f.*").drop("matches")


def op9_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", quality.judge(quality.fit_cascade(docs)).alias("_m")).select("doc_id", "_m.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(table(spark, sf_dir, "documents"))


def quality_model(docs: DataFrame, labels: DataFrame) -> neighbour_vote.Model:
    return neighbour_vote.train(docs, labels.where(crc_remainder("doc_id", 3) != 1))


def op11_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model(docs, table(spark, sf_dir, "labels"))
    return docs.select("doc_id", (crc_remainder("doc_id", 3) == 1).alias("held_out"), neighbour_vote.quality(docs, model).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tamper_check(spark, table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(spark, table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_html_extraction, op2_warc, op3_nearest_neighbours, op4_toxicity, op5_language_id, op6_packing,
                                   op7_ngram_join, op8_license_scan, op9_quality_cascade, op10_mixing, op11_quality_votes, op12_merkle_manifest, op13_prefix_trie)}
SQL = {"op2_warc": warc.SQL, "op7_ngram_join": ngram_join.SQL, "op10_mixing": mixing.SQL,
       "op12_merkle_manifest": merkle.SQL, "op13_prefix_trie": prefix_trie.SQL}
