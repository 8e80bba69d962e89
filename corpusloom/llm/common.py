"""Small pieces that several operators of this subpackage share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.durable import shared_folder

LETTERS = re.compile(r"[^\W\d_]+")
# Lowers ASCII letters and makes blanks of all other ASCII, so that split() gives runs of letters and of what lies beyond.
_LETTERS_ONLY = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))

# A word of the size, quality and packing contracts: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: str | Column) -> Column:
    """Words of a text, 0 for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def crc_remainder(key: str, modulus: int) -> Column:
    """crc32 of the key written as text, by ``modulus``; a null key counts as an empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, for tables and files of one run."""
    return f"{shared_folder(spark).rstrip('/')}/corpusloom-llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """``df`` written to the shared folder once and read back, so that no later job derives it again."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rough_words(text: str) -> list[bytes]:
    """Runs of letters in UTF-8, found fast; runs with bytes beyond ASCII may hold capitals and other characters."""
    return text.encode("utf-8", "surrogatepass").translate(_LETTERS_ONLY).split()


def exact_words(rough: bytes) -> list[str]:
    """The lower-case words of letters in a rough one."""
    return [rough.decode()] if rough.isascii() else [w for w in LETTERS.findall(rough.decode("utf-8", "surrogatepass").lower()) if any(map(str.isalpha, w))]
