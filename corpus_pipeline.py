"""A training-data pipeline over ``documents``: identify languages, drop toxic texts, join near copies, mix sources, pack."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import langid, mixing, ngram_join, packing, queries, toxicity
from corpusloom.llm.common import run_folder, stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts whose language cannot be told: null ones and those without a letter."""
    model = queries.language_model(docs)
    return docs.where(langid.identify(docs, model)["lang_pred"] != langid.UNDETERMINED)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that score 0.5 or more."""
    model = queries.toxicity_model(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.toxicity(docs, model) < 0.5)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, the one with the smallest id."""
    return ngram_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources meet their target weights."""
    return mixing.mix(docs)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bucket and batch of every document of the mix."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("toxicity", reject_toxic),
    ("ngram_join", join_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_batches),
]
# Learned models and MinHash joins are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result is written in the shared folder and read again by the next."""
    folder = run_folder(spark, "pipeline")
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for k, (name, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), folder, f"{k}-{name}")
    return docs
