"""Markdown trees and file inventories."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.durable import checkpointed


def glob_pattern(glob: str) -> str:
    """Regular expression of a file glob; ``*`` also crosses folders, as in plain name matching."""
    out = []
    for piece in re.findall(r"\*+|\?|\[[^\]]+\]|[^*?\[]+|\[", glob):
        if piece.startswith("*"):
            out.append(".*")
        elif piece == "?":
            out.append(".")
        elif piece.startswith("[") and len(piece) > 1:
            out.append("[^" + piece[2:] if piece[1] == "!" else piece)
        else:
            out.append(re.escape(piece))
    return "".join(out)


def matches_any(path: Column, globs: list[str]) -> Column:
    """A path matches a glob as a whole, or with its leading folders dropped."""
    if not globs:
        return F.lit(False)
    bodies = "|".join(glob_pattern(g[3:] if g.startswith("**/") else g) for g in globs)
    return path.rlike(rf"(?s)^(?:.*/)?(?:{bodies})$")


def _relative(path: Column, root: str) -> Column:
    plain = F.regexp_replace(path, r"^file:/+", "/")
    return F.regexp_replace(plain, rf"^\Q{root.rstrip('/')}/\E", "")


def _decoded(path: Column) -> Column:
    """File metadata spells paths as URIs."""
    return F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def read_markdown(spark: SparkSession, root: str) -> DataFrame:
    """Every Markdown file below ``root``: (path, text)."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    return files.select(_relative(_decoded(F.col("_metadata.file_path")), root).alias("path"), F.col("value").alias("text"))


_LISTED = "path STRING, is_dir BOOLEAN, size_bytes BIGINT"


def _list_folders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Entries directly below each folder; links are left out."""
    for batch in batches:
        for folder in batch["path"]:
            system, place = pafs.FileSystem.from_uri(folder)
            local = isinstance(system, pafs.LocalFileSystem)
            found = [f for f in system.get_file_info(pafs.FileSelector(place)) if not (local and os.path.islink(f.path))]
            prefix = folder[: len(folder) - len(place)] if folder.endswith(place) else ""
            yield pd.DataFrame({"path": [prefix + f.path for f in found], "is_dir": [f.type == pafs.FileType.Directory for f in found],
                                "size_bytes": [f.size or 0 for f in found]})


def _hash_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each file, read in blocks so that a file may be larger than memory."""
    for batch in batches:
        digests = []
        for path in batch["path"]:
            system, place = pafs.FileSystem.from_uri(path)
            digest = hashlib.sha256()
            with system.open_input_stream(place) as stream:
                while block := stream.read(1 << 20):
                    digest.update(block)
            digests.append(digest.hexdigest())
        yield batch.assign(sha256=digests)[["path", "sha256", "size_bytes"]]


def file_inventory(spark: SparkSession, root: str, excludes: list[str] | None = None) -> DataFrame:
    """Every file below ``root``, hidden ones too: (path, sha256, size_bytes).

    Spark's file sources pass over names starting with a dot or underscore, which are the very names
    a cleanliness check looks for, so folders are listed level by level in tasks.
    """
    folders = spark.createDataFrame([(root.rstrip("/"),)], "path STRING")
    found = None
    while True:
        level = checkpointed(folders.mapInPandas(_list_folders, _LISTED))
        files = level.where("NOT is_dir").select("path", "size_bytes")
        found = files if found is None else found.unionByName(files)
        folders = level.where("is_dir").select("path").repartition(spark.sparkContext.defaultParallelism)
        if folders.isEmpty():
            break
    wanted = found.where(~matches_any(_relative(F.col("path"), root), excludes or []))
    hashed = wanted.repartition(spark.sparkContext.defaultParallelism).mapInPandas(_hash_files, "path STRING, sha256 STRING, size_bytes BIGINT")
    return hashed.withColumn("path", _relative(F.col("path"), root))


def read_texts(spark: SparkSession, root: str) -> DataFrame:
    """Text files by suffix below ``root``: (path, text)."""
    suffixes = "*.{md,txt,json,toml,yaml,yml,py,pgx}"  # fixed values
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=suffixes)
    return files.select(_relative(_decoded(F.col("_metadata.file_path")), root).alias("path"), F.col("value").alias("text"))
