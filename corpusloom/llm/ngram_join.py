"""N-gram Jaccard self-join with Bayesian candidate pruning.

Texts become sets of word five-grams. Sets that share a band of MinHash values are candidates. The values of a candidate pair
are compared a few at a time, and the pair is dropped as soon as the posterior probability that its similarity reaches the
threshold is below a tolerance; the rest are verified on the sets themselves.

Equal sets are joined as one. Bands that few sets share give pairs; a band that many share, as with a large group of near
copies, is cut into tiles whose pairs are compared inside a task and leave as counts, never as rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.durable import checkpointed
from corpusloom.llm.common import run_folder, stored


@dataclass(frozen=True)
class Settings:
    """25 bands of 5 values miss a pair at similarity 0.8 with probability 5e-5, and one at 0.9 with 4e-10."""

    words: int = 5
    threshold: float = 0.8
    bands: int = 25
    rows: int = 5
    step: int = 25  # MinHash values compared at a time
    tolerance: float = 1e-6
    few: int = 64  # sets that share a band and still give pairs
    tile: int = 256  # sets of a block; two blocks meet in a task

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


_MIX = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: str | None, n: int, memory: dict[bytes, int] | None = None) -> np.ndarray:
    """Sorted 64-bit hashes of the runs of n words (runs without ASCII white space); of all words together if they are fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    memory = _Words() if memory is None else memory
    if not words:
        return np.zeros(0, np.uint64)
    if len(memory) > 300_000:
        memory.clear()
    h = np.fromiter(map(memory.__getitem__, words), np.uint64, len(words))
    size = min(n, len(h))
    total = np.full(len(h) - size + 1, np.uint64(size))
    for i in range(size):
        total = total * np.uint64(0x9E3779B97F4A7C15) + _mixed(h[i:len(h) - size + 1 + i])
    return np.unique(_mixed(total))


@lru_cache
def _permutations(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    a = rng.integers(0, 1 << 63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a[:, None], rng.integers(0, 1 << 63, hashes, dtype=np.uint64)[:, None]


def min_hashes(shingles: np.ndarray, hashes: int) -> np.ndarray:
    a, b = _permutations(hashes)
    best = np.full(hashes, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), 512):
        np.minimum(best, (shingles[start:start + 512] * a + b).min(1), out=best)
    return (best >> np.uint64(32)).astype(np.uint32)


_BAND_BITS = 6


def band_keys(signatures: np.ndarray, s: Settings) -> np.ndarray:
    """A 64-bit key for each band of each signature; its last bits are the number of the band."""
    parts = signatures.reshape(len(signatures), s.bands, s.rows).astype(np.uint64)
    key = np.arange(1, s.bands + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for i in range(s.rows):
        key = _mixed(key ^ parts[:, :, i]) + key
    return ((_mixed(key) << np.uint64(_BAND_BITS)) | np.arange(s.bands, dtype=np.uint64)[None, :]).view(np.int64)


@lru_cache
def least_matches(s: Settings) -> tuple[tuple[int, int], ...]:
    """(values compared, fewest matches to go on). Under a uniform prior the posterior after m matches of n is Beta(m + 1, n - m + 1),
    and its mass from the threshold t up is the chance of at most m successes in n + 1 trials of chance t."""
    out = []
    for n in range(s.step, s.hashes + 1, s.step):
        mass, m = 0.0, 0
        while m <= n:
            mass += comb(n + 1, m) * s.threshold ** m * (1 - s.threshold) ** (n + 1 - m)
            if mass >= s.tolerance:
                break
            m += 1
        out.append((n, m))
    return tuple(out)


def survives(a: np.ndarray, b: np.ndarray, s: Settings) -> np.ndarray:
    """For rows of two signature arrays: which pairs are still likely enough after each step; dropped pairs are compared no further."""
    alive, matches, last = np.arange(len(a)), np.zeros(len(a), np.int32), 0
    for n, fewest in least_matches(s):
        matches[alive] += (a[alive, last:n] == b[alive, last:n]).sum(1, dtype=np.int32)
        alive, last = alive[matches[alive] >= fewest], n
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def first_shared_band(a: np.ndarray, b: np.ndarray, s: Settings) -> np.ndarray:
    """The first band in which the signatures of each row agree (the number of bands if none)."""
    same = (a == b).reshape(len(a), s.bands, s.rows).all(2)
    return np.where(same.any(1), same.argmax(1), s.bands)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _signatures(column: pd.Series, s: Settings) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint32).reshape(len(column), s.hashes)


def compare_tile(left: pd.DataFrame, right: pd.DataFrame | None, band: int, s: Settings) -> pd.DataFrame:
    """Counts of links between two blocks (or within one) that share ``band``: ``id, links, root``.

    A pair counts in the first band that it shares. Overlaps of whole blocks come from products of membership matrices over the
    shingles that at least two sets hold.
    """
    rows = left if right is None else pd.concat([left, right], ignore_index=True)
    nl = len(left)
    signatures = _signatures(rows["sig"], s)
    sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"]]
    size = np.array([len(x) for x in sets])
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = np.where(counts > 1, np.cumsum(counts > 1) - 1, -1)[inverse]
    owner = np.repeat(np.arange(len(sets)), size)
    owner, common = owner[common >= 0], common[common >= 0]
    order = np.argsort(common, kind="stable")
    owner, common = owner[order], common[order]
    columns = slice(0, nl) if right is None else slice(nl, len(rows))
    overlap = np.zeros((nl, columns.stop - columns.start), np.float32)
    for start in range(0, int((counts > 1).sum()), 4_096):
        lo, hi = np.searchsorted(common, [start, start + 4_096])
        member = np.zeros((len(rows), 4_096), np.float32)
        member[owner[lo:hi], common[lo:hi] - start] = 1
        overlap += member[:nl] @ member[columns].T
    copies, ids = rows["copies"].to_numpy(), rows["id"].tolist()
    links, root = np.zeros(len(rows), np.int64), list(range(len(rows)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(nl):
        js = np.arange(i + 1, nl) if right is None else np.arange(nl, len(rows))
        if not len(js):
            continue
        mine = np.broadcast_to(signatures[i], (len(js), s.hashes))
        js = js[survives(mine, signatures[js], s)]
        js = js[first_shared_band(np.broadcast_to(signatures[i], (len(js), s.hashes)), signatures[js], s) == band] if len(js) else js
        both = overlap[i, js - columns.start].astype(np.float64)
        js = js[both / (size[i] + size[js] - both) >= s.threshold]
        links[i] += copies[js].sum()
        links[js] += copies[i]
        for j in js:
            a, b = top(i), top(int(j))
            if a != b:
                a, b = (a, b) if ids[a] < ids[b] else (b, a)
                root[b] = a
    linked = np.flatnonzero(links)
    return pd.DataFrame({"id": [ids[i] for i in linked], "links": links[linked], "root": [ids[top(i)] for i in linked]})


def id_filter(ids: DataFrame, most_bits: int = 1 << 26) -> np.ndarray:
    """A bitmap over hashes of ``_id`` (a long), about eight bits an id and at most ``most_bits``.

    It only saves work: an id that is missing from it is surely not among ``ids``, others have to be joined.
    """
    bits = min(most_bits, max(1 << 16, 1 << (8 * ids.count()).bit_length()))
    place = F.pmod(_spread("_id"), F.lit(bits))
    words = ids.select(F.floor(place / 32).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 32).cast("int")).alias("b"))
    out = np.zeros(bits // 32, np.int64)
    for row in words.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas().itertuples(index=False):
        out[row.w] = row.b
    return out


def _spread(column: str) -> Column:
    """A hash that numpy can repeat."""
    x = F.col(column)
    return x.bitwiseXOR(F.shiftrightunsigned(x, 17)).bitwiseXOR(F.shiftrightunsigned(x, 41))


def in_filter(words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.int64).view(np.uint64)
    x = (x ^ (x >> np.uint64(17)) ^ (x >> np.uint64(41))).view(np.int64)
    place = np.mod(x, len(words) * 32)
    return (words[place // 32] >> (place % 32)) & 1 == 1


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of undirected edges (u, v): the least node of each connected component.

    Alternates large-star and small-star steps until the edges stay as they are; each round ends in a checkpoint.
    """
    edges = checkpointed(edges.where("u <> v").select("u", "v").distinct())
    state = None
    while True:
        facts = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if facts == state or not facts[0]:
            break
        state = facts
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = checkpointed(small.select("e.u", "e.v").where("u <> v").distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def join(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per row of (doc_id, text): ``doc_id, class_id, n_links``.

    ``n_links`` counts the other rows whose similarity is at least the threshold, copies included. ``class_id`` is the smallest
    doc_id among all rows connected by links, the row's own id if it has none. Null and empty texts, and texts of white space,
    have no shingles and no links; their class is their own id. Texts of fewer than five words have one shingle of all words.
    Rows with a null id take part, but name a class only if it has no other id (it is null then). Repeated rows are copies of
    each other. An empty table gives an empty result.
    """
    sketches, facts = classes_of(docs, settings)
    bare = sketches.where("print IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return sketches.where("print IS NOT NULL").select("doc_id", "print").join(
        facts.select("print", "class_id", "n_links"), "print").select("doc_id", "class_id", "n_links").unionByName(bare)


def text_mark(text: str) -> Column:
    """A digest of a text, null told from empty."""
    return F.unhex(F.md5(F.coalesce(F.concat(F.lit("="), F.col(text).cast("string")), F.lit("")).cast("binary")))


def classes_of(docs: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """(doc_id, mark, print, sig) of every row, and per print: ``print, class, class_id, n_links, first``.

    Equal prints are equal shingle sets, null if there is none. ``class`` is the same for all sets connected by links and for no other; ``first`` is
    the row (no_id, doc_id, mark) of the set with the smallest id.
    """
    s = settings
    folder = run_folder(docs.sparkSession, "join")

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory = _Words()
        for batch in batches:
            rows = []
            for text in batch["text"]:
                shingles = shingle_set(text, s.words, memory)
                rows.append((xxhash.xxh3_128_digest(shingles.tobytes()), min_hashes(shingles, s.hashes).tobytes()) if len(shingles) else (None, None))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "mark": batch["mark"], "print": [r[0] for r in rows], "sig": [r[1] for r in rows]})

    def bands(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                keys = band_keys(_signatures(batch["sig"], s), s)
                yield pd.DataFrame({"id": np.repeat(batch["id"].to_numpy(), s.bands), "key": keys.ravel()})

    def prune(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                a, b = _signatures(batch["sig_a"], s), _signatures(batch["sig_b"], s)
                yield batch.loc[survives(a, b, s) & (first_shared_band(a, b, s) == batch["band"].to_numpy()), ["a", "b"]]

    def shingles_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory = _Words()
        for batch in batches:
            maybe = batch["text"][in_filter(bitmap.value, batch["_id"].to_numpy())]
            sets = [shingle_set(text, s.words, memory).tobytes() for text in maybe]
            yield pd.DataFrame({"print": [xxhash.xxh3_128_digest(x) for x in sets], "shingles": sets})

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            close = [jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= s.threshold for x, y in zip(batch["set_a"], batch["set_b"], strict=True)]
            yield batch.loc[np.array(close, bool), ["a", "b", "copies_a", "copies_b"]]

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = stored(texts.withColumn("mark", text_mark("text")).mapInPandas(sketch, "doc_id long, mark binary, print binary, sig binary"), folder, "sketches")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")
    sets = stored(sketches.where("print IS NOT NULL").groupBy("print").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min("sig").alias("sig"), F.min(row).alias("first")).withColumn("id", F.monotonically_increasing_id()), folder, "sets")

    keyed = sets.select("id", "sig").mapInPandas(bands, "id long, key long")
    crowded = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    meets = stored(keyed.join(crowded, "key"), folder, "meets")
    band = F.col("key").bitwiseAND((1 << _BAND_BITS) - 1).cast("int")

    few = meets.where(F.col("n") <= s.few)
    left, right = few.select("key", F.col("id").alias("a")), few.select("key", F.col("id").alias("b"))
    pairs = left.join(right, "key").where("a < b").groupBy("a", "b").agg(F.min(band).alias("band"))
    signed = (pairs.join(sets.select(F.col("id").alias("a"), F.col("sig").alias("sig_a")), "a")
                   .join(sets.select(F.col("id").alias("b"), F.col("sig").alias("sig_b")), "b"))
    likely = stored(signed.select("a", "b", "band", "sig_a", "sig_b").mapInPandas(prune, "a long, b long"), folder, "likely")

    many = meets.where(F.col("n") > s.few)
    wanted = likely.select(F.col("a").alias("id")).unionByName(likely.select(F.col("b").alias("id"))).unionByName(many.select("id")).distinct()
    wanted = stored(wanted.join(sets, "id"), folder, "wanted")
    known = lambda c: F.coalesce(c, F.lit(-(1 << 63)))
    # Only texts that may be wanted are cut into shingles again and leave their task.
    bitmap = docs.sparkSession.sparkContext.broadcast(id_filter(wanted.select(known(F.col("rep")).alias("_id"))))
    again = texts.where("text IS NOT NULL").select(known(F.col("doc_id")).alias("_id"), "text").mapInPandas(shingles_of, "print binary, shingles binary")
    held = stored(again.join(wanted, "print").dropDuplicates(["id"]), folder, "held")

    side = lambda x: held.select(F.col("id").alias(x), F.col("shingles").alias(f"set_{x}"), F.col("copies").alias(f"copies_{x}"))
    checked = likely.join(side("a"), "a").join(side("b"), "b").select("a", "b", "copies_a", "copies_b", "set_a", "set_b")
    links = stored(checked.mapInPandas(verify, "a long, b long, copies_a long, copies_b long"), folder, "links")

    blocks = F.ceil(F.col("n") / s.tile).cast("int")
    placed = many.withColumn("band", band).withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    placed = placed.join(held, "id").select("key", "band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                                            "block", "id", "sig", "shingles", "copies")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        i, j, band = (int(rows[c].iloc[0]) for c in ("i", "j", "band"))
        if i == j:
            return compare_tile(rows.reset_index(drop=True), None, band, s)
        one, other = rows[rows["block"] == i], rows[rows["block"] == j]
        if one.empty or other.empty:
            return pd.DataFrame({"id": [], "links": [], "root": []})
        return compare_tile(one.reset_index(drop=True), other.reset_index(drop=True), band, s)

    tiles = stored(placed.groupBy("key", "i", "j").applyInPandas(compare, "id long, links long, root long"), folder, "tiles")

    per = (links.select(F.col("a").alias("id"), F.col("copies_b").alias("links"))
                .unionByName(links.select(F.col("b").alias("id"), F.col("copies_a").alias("links")))
                .unionByName(tiles.select("id", "links")).groupBy("id").agg(F.sum("links").alias("links")))
    edges = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(tiles.select(F.col("id").alias("u"), F.col("root").alias("v")))
    rooted = components(edges).select(F.col("node").alias("id"), "root").join(sets.select("id", "rep"), "id")
    classes = rooted.join(rooted.groupBy("root").agg(F.min("rep").alias("class_id")), "root").select("id", "class_id", "root")
    return sketches, sets.select("id", "print", "rep", "copies", "first").join(per, "id", "left").join(classes, "id", "left").select(
        "print", F.coalesce("root", "id").alias("class"), F.coalesce("class_id", "rep").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "first")


def one_of_each(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One document of each class: the one with the smallest id, or of several texts that share it the one with the smallest digest.

    Of rows with one id and text, one stays, with the columns of any of them. A class without any id keeps one row too. Rows
    without shingles have no near copies; of those with one id and text, one stays.
    """
    sketches, facts = classes_of(docs, settings)
    folder = run_folder(docs.sparkSession, "kept")
    known = lambda c: F.coalesce(c.cast("long"), F.lit(-(1 << 63)))
    chosen = facts.groupBy("class").agg(F.min("first").alias("first")).select(known(F.col("first.doc_id")).alias("_id"), F.col("first.mark").alias("_mark"))
    rows_of = sketches.groupBy(known(F.col("doc_id")).alias("_id"), F.col("mark").alias("_mark"), F.col("print").isNull().alias("_bare")).agg(F.count(F.lit(1)).alias("_n"))
    kept = stored(rows_of.where("NOT _bare").join(chosen, ["_id", "_mark"], "left_semi").unionAll(rows_of.where("_bare")).select("_id", "_mark", "_n"), folder, "rows")
    whole = docs.select(known(F.col("doc_id")).alias("_id"), text_mark("text").alias("_mark"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    once = whole.join(kept.where("_n = 1"), ["_id", "_mark"]).select("row.*")
    more = kept.where("_n > 1")
    if not more.head(1):
        return once
    # Repeated rows are stored before they are grouped, so that each task hands on one of a key.
    repeated = stored(whole.join(more, ["_id", "_mark"]), folder, "repeated")
    return once.unionAll(repeated.groupBy("_id", "_mark").agg(F.first("row").alias("row")).select("row.*"))


SQL = r"""
WITH RECURSIVE doc AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingle AS (
  SELECT DISTINCT r, hash(unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w] ELSE list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4]) END)) AS s
  FROM doc
), size AS (
  SELECT r, count(*) AS n FROM shingle GROUP BY r
), link AS (
  SELECT o.a, o.b FROM (SELECT x.r AS a, y.r AS b, count(*) AS k FROM shingle x JOIN shingle y ON x.s = y.s AND x.r <> y.r GROUP BY ALL) o
  JOIN size p ON p.r = o.a JOIN size q ON q.r = o.b WHERE k / (p.n + q.n - k) >= 0.8
), reach AS (
  SELECT r AS a, r AS b FROM doc UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
)
SELECT d.doc_id, (SELECT min(e.doc_id) FROM reach JOIN doc e ON e.r = reach.b WHERE reach.a = d.r) AS class_id,
  (SELECT count(*) FROM link WHERE link.a = d.r) AS n_links
FROM doc d
"""
