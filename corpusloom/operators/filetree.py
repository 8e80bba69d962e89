"""Checks on file trees that travel with a corpus: manifests, projections, wikilinks, bundles."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import ids
from corpusloom.functions.durable import checkpointed
from corpusloom.sources.files import matches_any

# Files that must not be released.
TRANSIENT_GLOBS = ["**/__pycache__", "**/__pycache__/**", "**/.pytest_cache", "**/.pytest_cache/**", "**/*.pyc", "**/*-wal",
                   "**/*-shm", "**/*-journal", "**/.DS_Store"]
WIKILINK = r"\[\[([^\]]+)\]\]"


def _finding(df: DataFrame, code: str | Column, key: str, detail: Column | None = None) -> DataFrame:
    code = F.lit(code) if isinstance(code, str) else code
    return df.select(code.alias("code"), F.lit("error").alias("severity"), F.col(key).alias("key"),
                     (detail if detail is not None else F.lit(None)).cast("string").alias("detail"))


def check_manifest(inventory: DataFrame, declared: DataFrame, file_count: int | None = None, counts_itself: bool = True) -> DataFrame:
    """``inventory`` and ``declared`` are (path, sha256, size_bytes); ``file_count`` is the declared total."""
    listed = declared.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("sha256", "size_bytes")).alias("d"))
    there = inventory.select("path", F.struct("sha256", "size_bytes").alias("a"))
    both = there.join(listed, "path", "full")
    code = (F.when(F.col("d").isNull(), "manifest.unlisted_files").when(F.col("a").isNull(), "manifest.missing_files")
             .when(~F.col("a").eqNullSafe(F.col("d")), "manifest.mismatch"))
    out = _finding(both.where(code.isNotNull()), code, "path").unionByName(_finding(listed.where("n > 1"), "manifest.duplicate", "path"))
    if file_count is not None:
        total = inventory.agg((F.count(F.lit(1)) + (1 if counts_itself else 0)).alias("expected")).withColumn("path", F.lit("file_count"))
        out = out.unionByName(_finding(total.where(F.col("expected") != file_count), "manifest.file_count", "path", F.col("expected")))
    return out


def check_cleanliness(inventory: DataFrame, globs: list[str] | None = None) -> DataFrame:
    return _finding(inventory.where(matches_any(F.col("path"), globs or TRANSIENT_GLOBS)), "tree.transient", "path")


def check_projection(inventory: DataFrame, expected: DataFrame, directory: str, suffix: str = "") -> DataFrame:
    """Expected files (name) that a projection folder lacks."""
    name = F.when(F.col("name").endswith(suffix), F.col("name")).otherwise(F.concat("name", F.lit(suffix)))
    wanted = expected.select(F.concat(F.lit(f"{directory}/"), name).alias("path"))
    return _finding(wanted.join(inventory.select("path"), "path", "left_anti"), "projection.missing_files", "path")


def wikilinks(notes: DataFrame) -> DataFrame:
    """(source, target) of every wikilink in ``notes(path, text)``.

    A display name after a bar and a heading after a number sign are no part of the target; neither may be empty.
    """
    links = notes.select(F.col("path").alias("source"), F.explode(F.regexp_extract_all("text", F.lit(WIKILINK), F.lit(1))).alias("inner"))
    links = links.withColumn("shown", F.split("inner", r"\|", 2)).withColumn("place", F.split(F.col("shown")[0], "#", 2))
    whole = F.forall("shown", lambda x: x != "") & F.forall("place", lambda x: x != "")
    return links.where(whole).select("source", F.replace(F.trim(F.col("place")[0]), F.lit("\\"), F.lit("/")).alias("target"))


def check_wikilinks(notes: DataFrame) -> DataFrame:
    """Links that name neither a note's path nor the stem of exactly one note."""
    links = wikilinks(notes).withColumn("clean", F.regexp_replace("target", r"(?i)\.md$", ""))
    bare = F.regexp_replace("path", r"(?i)\.md$", "")
    paths = notes.select(bare.alias("clean")).distinct()
    stems = notes.groupBy(F.regexp_extract(bare, r"([^/]+)$", 1).alias("clean")).agg(F.count(F.lit(1)).alias("n")).where("n = 1")
    left = links.join(paths, "clean", "left_anti")
    by_stem = stems.select("clean", F.lit(True).alias("_stem"))
    unresolved = left.join(by_stem, "clean", "left").where(F.col("_stem").isNull() | F.col("clean").contains("/"))
    return _finding(unresolved, "projection.wikilink", "source", F.col("target"))


def check_unlinked(texts: DataFrame, declared: list[str], excludes: list[str] | None = None) -> DataFrame:
    """Resources declared unlinked (a short configured list) that some text mentions by path or name."""
    parts = []
    for path in declared:
        needles = {path, path.rsplit("/", 1)[-1]}
        hit = F.lit(False)
        for needle in sorted(needles):
            hit = hit | F.col("text").contains(needle)
        parts.append(F.when(hit & (F.col("path") != path), F.lit(path)))
    searched = texts.where(~matches_any(F.col("path"), excludes or []))
    rows = searched.select("path", F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull())).alias("resource"))
    return _finding(rows, "unlinked.referenced", "resource", F.col("path"))


# Words of the automaton hold so many characters at most; it takes some 30 bytes for each on every executor.
AUTOMATON_CHARS = 4_000_000


def mentions(texts: DataFrame, needles: DataFrame, chars: int = AUTOMATON_CHARS) -> DataFrame:
    """``(path, needle)`` for each row of ``texts(path, text)`` and each of ``needles(needle)`` that it holds anywhere, in words or across them.

    All needles are sought at once, in one pass over a text, by an automaton that goes to the executors. If the needles have more than
    ``chars`` characters together, the automaton holds the longest beginnings that fit. Where a beginning stands, the text's own
    pieces of the lengths that such needles have are told from needles by a join. Empty needles and null texts match nothing.
    """
    import ahocorasick

    wanted = checkpointed(needles.select("needle").where("length(needle) > 0").distinct())
    size = wanted.agg(F.sum(F.length("needle")).alias("total"), F.max(F.length("needle")).alias("longest")).first()
    if not size["total"]:
        return texts.select("path", F.col("path").alias("needle")).limit(0)
    whole = size["total"] <= chars
    cut = size["longest"] if whole else _longest_cut(wanted, size["longest"], chars)
    lengths: dict[str, list[int]] = {}
    for row in _beginnings(wanted, cut).toLocalIterator():
        lengths.setdefault(row["beginning"], []).append(row["n"])
    automaton = ahocorasick.Automaton()
    for beginning, ns in lengths.items():
        automaton.add_word(beginning, (len(beginning), tuple(ns)))
    automaton.make_automaton()
    rows = texts.select("path", F.explode(_held(texts.sparkSession, automaton)(F.col("text"))).alias("needle"))
    return rows if whole else rows.join(wanted, "needle", "left_semi").select("path", "needle")


def _beginnings(needles: DataFrame, cut: int) -> DataFrame:
    """The first ``cut`` characters of needles, each with every length ``n`` of a needle that begins so."""
    return needles.select(F.substring("needle", 1, cut).alias("beginning"), F.length("needle").alias("n")).distinct()


def _longest_cut(needles: DataFrame, longest: int, chars: int) -> int:
    """How long beginnings may be for all of them, counted once for each of their lengths, to hold ``chars`` characters at most; 1 at least."""
    low, high = 1, longest
    while low < high:
        middle = (low + high + 1) // 2
        if (_beginnings(needles, middle).agg(F.sum(F.length("beginning")).alias("n")).first()["n"] or 0) <= chars:
            low = middle
        else:
            high = middle - 1
    return low


def _held(spark: SparkSession, automaton) -> Callable[[Column], Column]:
    """The distinct pieces of a text that stand where a word of the automaton does, with the lengths that go with the word."""
    shared = spark.sparkContext.broadcast(automaton)

    def pieces(text: str) -> list[str]:
        found = set()
        for last, (size, lengths) in shared.value.iter(text):
            start = last + 1 - size
            found.update(text[start:start + n] for n in lengths if start + n <= len(text))
        return sorted(found)

    @F.pandas_udf("array<string>")
    def held(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([pieces(text) if text else [] for text in batch])

    return held


def check_unlinked_many(texts: DataFrame, declared: DataFrame, excludes: list[str] | None = None) -> DataFrame:
    """Like :func:`check_unlinked` for a table of any number of ``declared(resource)``, sought by path and by name."""
    name = F.regexp_extract("resource", r"([^/]*)$", 1)
    sought = declared.select("resource", F.explode(F.array_distinct(F.array("resource", name))).alias("needle")).distinct()
    searched = texts.where(~matches_any(F.col("path"), excludes or []))
    rows = mentions(searched, sought).join(sought, "needle").where("path <> resource").select("path", "resource").distinct()
    return _finding(rows, "unlinked.referenced", "resource", F.col("path"))


def listing_digests(declared: DataFrame) -> DataFrame:
    """(bundle, digest): the SHA-256 of each bundle's listing ``(path, sha256, byte_size)`` as canonical JSON in order of paths.

    A digest reads its listing from first to last, so the sorted entries of a bundle pass through one task, batch by batch; no
    listing is held as a whole.
    """
    entry = ids.canonical_json(path=F.col("path"), sha256=F.col("sha256"), byte_size=F.col("byte_size"))
    rows = declared.select("bundle", "path", entry.alias("j")).where("bundle IS NOT NULL").repartition("bundle").sortWithinPartitions("bundle", "path", "j")

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bundle, digest = None, None
        for batch in batches:
            done = []
            for name, entries in groupby(zip(batch["bundle"], batch["j"], strict=True), itemgetter(0)):
                text = ",".join(j for _, j in entries)
                if name == bundle:
                    digest.update(f",{text}".encode())
                    continue
                if bundle is not None:
                    digest.update(b"]")
                    done.append((bundle, digest.hexdigest()))
                bundle, digest = name, hashlib.sha256(f"[{text}".encode())
            yield pd.DataFrame(done, columns=["bundle", "digest"])
        if bundle is not None:
            digest.update(b"]")
            yield pd.DataFrame([(bundle, digest.hexdigest())], columns=["bundle", "digest"])

    return rows.select("bundle", "j").mapInPandas(digests, "bundle string, digest string")


def check_bundles(inventory: DataFrame, declared: DataFrame, manifests: DataFrame) -> DataFrame:
    """Stored bundles against their manifests.

    ``inventory`` and ``declared`` are (bundle, path, sha256, byte_size); ``manifests`` is (bundle,
    format, source_kind, content_digest, resource_uuid, supported_format). The digest covers the
    declared inventory as canonical JSON in order of paths, see ``listing_digests``.
    """
    side = lambda df, name: df.select("bundle", "path", F.struct("sha256", "byte_size").alias(name))
    both = side(inventory, "a").join(side(declared, "d"), ["bundle", "path"], "full").where(~F.col("a").eqNullSafe(F.col("d")))
    content = both.groupBy("bundle").agg(F.count(F.lit(1)).alias("n"))
    rows = manifests.join(listing_digests(declared), "bundle", "left").withColumn("digest", F.coalesce("digest", F.sha2(F.lit("[]"), 256)))
    identity = ids.uuid5_col(ids.BUNDLE_NAMESPACE, F.concat_ws(":", "source_kind", "digest"))
    codes = F.filter(F.array(
        F.when(F.col("format") != F.col("supported_format"), "unsupported_format"),
        F.when(F.col("digest") != F.col("content_digest"), "content_digest_mismatch"),
        F.when(identity != F.col("resource_uuid"), "resource_identity_mismatch")), lambda x: x.isNotNull())
    checked = rows.select("bundle", F.explode(codes).alias("_code"))
    return _finding(content, "resource_content_mismatch", "bundle", F.col("n")).unionByName(_finding(checked, F.col("_code"), "bundle"))
