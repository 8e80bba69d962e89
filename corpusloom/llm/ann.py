"""Approximate nearest neighbours by learned partitions.

A neighbour graph over a bounded sample is cut into balanced parts; a small classifier learns to tell, from a vector alone,
in which parts its neighbours lie. Every row is indexed in its likeliest part; a query goes to its several likeliest parts,
whose rows are ranked by their exact inner products.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm.common import run_folder, stored


@dataclass(frozen=True)
class Settings:
    sample_rows: int = 8_192  # vectors that the graph and the classifier are fitted on, read to the driver
    part_rows: int = 1_024  # wanted rows of a part
    neighbours: int = 20  # of the sample's graph
    hidden: int = 128
    epochs: int = 30
    slack: float = 1.1  # a part of the sample graph holds at most so many times its fair share
    coverage: float = 0.95  # of true neighbours that the probed parts must hold on the sample
    block_rows: int = 8_192  # rows of a bin of parts, and queries, that meet in one task


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of each row by inner product."""
    out = np.empty((len(x), k), np.int64)
    for start in range(0, len(x), 1_024):
        near = x[start:start + 1_024] @ x.T
        near[np.arange(len(near)), np.arange(start, start + len(near))] = -np.inf
        out[start:start + 1_024] = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, slack: float, rounds: int = 8) -> np.ndarray:
    """Parts of nearly equal size that few edges of the graph cross.

    Recursive halving at the median along the leading direction gives a start; then nodes move to the part where most of
    their neighbours are, while it has room.
    """
    label = np.zeros(len(x), np.int64)

    def halve(rows: np.ndarray, first: int, count: int) -> None:
        if count == 1:
            label[rows] = first
            return
        centred = x[rows] - x[rows].mean(0)
        direction = np.linalg.eigh(centred.T @ centred)[1][:, -1]
        order = rows[np.argsort(centred @ direction, kind="stable")]
        middle = len(order) * (count // 2) // count
        halve(order[:middle], first, count // 2)
        halve(order[middle:], first + count // 2, count - count // 2)

    halve(np.arange(len(x)), 0, parts)
    n, k = graph.shape
    near = np.concatenate([np.stack([np.repeat(np.arange(n), k), graph.ravel()]), np.stack([graph.ravel(), np.repeat(np.arange(n), k)])], axis=1)
    room = int(slack * n / parts) + 1
    for _ in range(rounds):
        votes = np.zeros((n, parts), np.float32)
        np.add.at(votes, (near[0], label[near[1]]), 1)
        best = votes.argmax(1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), label]
        size, moved = np.bincount(label, minlength=parts), 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[best[i]] < room:
                size[label[i]] -= 1
                size[best[i]] += 1
                label[i] = best[i]
                moved += 1
        if not moved:
            break
    return label


@dataclass
class Router:
    """A network with one hidden layer that gives log odds of the parts; ``probes`` parts of a query are searched."""

    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int = 1

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x * self.scale) @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    @classmethod
    def fit(cls, x: np.ndarray, wanted: np.ndarray, hidden: int, epochs: int) -> Router:
        """Minimise the cross entropy to each row's wanted distribution over parts, by Adam."""
        rng = np.random.default_rng(7)
        d, parts = x.shape[1], wanted.shape[1]
        scale = float(np.sqrt(d) / max(1e-12, np.sqrt((x * x).sum(1).mean())))
        p = [rng.normal(size=(d, hidden)) * np.sqrt(2 / d), np.zeros(hidden), rng.normal(size=(hidden, parts)) * np.sqrt(1 / hidden), np.zeros(parts)]
        m, v, t, data = [0 * a for a in p], [0 * a for a in p], 0, x * scale
        for epoch in range(epochs):
            rate = 0.004 * (1 - epoch / epochs) + 1e-4
            for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
                a, y = data[rows], wanted[rows]
                h = np.maximum(a @ p[0] + p[1], 0)
                z = h @ p[2] + p[3]
                e = np.exp(z - z.max(1, keepdims=True))
                g = (e / e.sum(1, keepdims=True) - y) / len(rows)
                back = (g @ p[2].T) * (h > 0)
                t += 1
                for i, grad in enumerate((a.T @ back, back.sum(0), h.T @ g, g.sum(0))):
                    m[i] = 0.9 * m[i] + 0.1 * grad
                    v[i] = 0.999 * v[i] + 0.001 * grad * grad
                    p[i] = p[i] - rate * (m[i] / (1 - 0.9 ** t)) / (np.sqrt(v[i] / (1 - 0.999 ** t)) + 1e-8)
        return cls(scale, *p)


def fit_router(sample: np.ndarray, parts: int, s: Settings = Settings()) -> Router:
    """Graph, parts, classifier, and the least number of probes that cover enough of the sample's true neighbours."""
    d = sample.shape[1] if sample.ndim == 2 else 1
    if parts <= 1:
        return Router(1.0, np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    graph = neighbour_graph(sample, min(s.neighbours, len(sample) - 1))
    label = balanced_parts(sample, graph, parts, s.slack)
    wanted = np.zeros((len(sample), parts))
    np.add.at(wanted, (np.repeat(np.arange(len(sample)), graph.shape[1]), label[graph].ravel()), 0.5 / graph.shape[1])
    wanted[np.arange(len(sample)), label] += 0.5
    # Probes are set on rows that the classifier has not seen.
    seen = np.arange(len(sample)) % 8 != 0
    router = Router.fit(sample[seen], wanted[seen], s.hidden, s.epochs)
    odds = router.odds(sample)
    place = np.argsort(np.argsort(-odds[~seen], axis=1, kind="stable"), axis=1, kind="stable")
    reached = place[np.arange(len(place))[:, None], odds.argmax(1)[graph[~seen]]]
    covered = [(reached < m).mean() for m in range(1, parts + 1)]
    router.probes = next((m for m, c in enumerate(covered, 1) if c >= s.coverage), parts)
    return router


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the rows that take part: an id, and a vector without null or non-finite components that is not zero.

    Inner products need equal lengths: of several lengths the commonest takes part, of equally common ones the longest.
    """
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    return rows.where(F.size("v") == (lengths[0]["d"] if lengths else 0))


def search(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k rows found nearest to each query, ties to the smaller id.

    ``is_query`` is a condition on ``id``. A query never finds rows of its own id; with fewer than k others it finds them all.
    An id counts once, however many rows it has: rows that repeat an id and its vector count as one row, and of an id with
    several vectors, as query and as neighbour, the best score of any pair of them counts. So each query id has the ranks 1 to k
    at most, each with another ``vec_id``.
    Equal vectors are scored once within a task, so any number of copies costs little and ties among them are exact. An empty
    table gives an empty result.
    """
    spark = vectors.sparkSession
    folder = run_folder(spark, "ann")
    rows = stored(usable(vectors, key, vector), folder, "usable")
    n = rows.count()
    share = int(1_000_000 * min(1.0, settings.sample_rows / max(1, n)))
    sample = rows.where(F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1_000_000)) < share).orderBy("id").select("v").toPandas()["v"]
    # Copies would only fill the graph with themselves.
    x = np.unique(np.array(list(sample), float), axis=0) if len(sample) else np.zeros((0, 1))
    parts = max(1, min(n // settings.part_rows, len(x) // 64))
    shared = spark.sparkContext.broadcast(fit_router(x, parts, settings))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            a = np.array(batch["v"].tolist(), float).reshape(len(batch), -1) + 0.0  # no negative zeros: equal vectors have equal bytes
            part = shared.value.odds(a).argmax(1) if len(a) else []
            yield pd.DataFrame({"id": batch["id"], "part": part, "v": [r.tobytes() for r in a]})

    placed = stored(rows.mapInPandas(place, "id long, part int, v binary"), folder, "placed")
    sizes = np.zeros(parts, np.int64)
    for r in placed.groupBy("part").count().collect():
        sizes[r["part"]] = r["count"]
    first, pieces = bins_of(sizes, settings.block_rows)
    # Ids by the first part that holds one of their rows: probed parts hold at least as many different ids as these add up to.
    homes = np.zeros(parts, np.int64)
    for r in placed.groupBy("id").agg(F.min("part").alias("part")).groupBy("part").count().collect():
        homes[r["part"]] = r["count"]
    wanted = min(k, int(homes.sum()) - 1)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            a = np.frombuffer(b"".join(batch["v"])).reshape(len(batch), -1)
            order = np.argsort(-shared.value.odds(a), axis=1, kind="stable")
            most = np.maximum(shared.value.probes, 1 + np.argmax(np.cumsum(homes[order], axis=1) > wanted, axis=1))
            out = []
            for query, v, chosen in zip(batch["id"], batch["v"], (o[:m] for o, m in zip(order, most, strict=True)), strict=True):
                in_bin: dict[int, list[int]] = {}
                for part in chosen.tolist():
                    for piece in range(pieces[part]):
                        in_bin.setdefault(int(first[part] + piece), []).append(part)
                out += [(query, place, probed, v) for place, probed in in_bin.items()]
            yield pd.DataFrame(out, columns=["id", "bin", "parts", "v"])

    of = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("part") + 1)
    binned = placed.withColumn("bin", of(first) + F.pmod(F.xxhash64("id"), of(pieces)).cast("int"))
    routed = stored(placed.where(is_query).dropDuplicates(["id", "v"]).mapInPandas(route, "id long, bin int, parts array<int>, v binary"), folder, "routed")
    asked = {r["bin"]: -(-r["count"] // settings.block_rows) for r in routed.groupBy("bin").count().collect()}
    chunks = F.element_at(F.array(*[F.lit(asked.get(i, 1)) for i in range(int(first[-1] + pieces[-1]))]), F.col("bin") + 1)
    # Every chunk of the queries of a bin meets the whole bin.
    held = binned.withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks.cast("int") - 1)))
    queries = routed.withColumn("chunk", F.pmod(F.xxhash64("id"), chunks).cast("int"))

    def rank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return nearest_in_bin(left, right, k)

    found = queries.groupBy("bin", "chunk").cogroup(held.groupBy("bin", "chunk")).applyInPandas(rank, "query_id long, vec_id long, score double")
    # Several vectors of an id may give one neighbour several scores. Dealt out by query once, for both steps.
    best = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def bins_of(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """For each part its first bin and over how many it is spread: small parts share a bin, one beyond ``room`` has several."""
    first, pieces, at, filled = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), 0, 0
    for part, size in enumerate(sizes):
        if filled and filled + size > room:
            at, filled = at + 1, 0
        first[part], pieces[part] = at, max(1, -(-int(size) // room))
        filled += size
        if size > room:
            at, filled = at + int(pieces[part]), 0
    return first, pieces


def nearest_in_bin(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest ids of a bin for each query, among the parts that it probes, by exact scores of distinct vectors."""
    if queries.empty or rows.empty:
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
    rows = rows.drop_duplicates(["id", "part", "v"])
    group = rows.sort_values("id", kind="stable").groupby(["part", "v"], sort=True)["id"].apply(list)
    ids, part = group.tolist(), group.index.get_level_values(0).to_numpy()
    c = np.frombuffer(b"".join(group.index.get_level_values(1))).reshape(len(group), -1)
    spans = {int(p): slice(*np.searchsorted(part, [p, p + 1])) for p in np.unique(part)}
    # So many vectors have k + 1 different ids among them, also if an id has several vectors.
    take = min(len(c), (k + 1) * int(rows["id"].value_counts().max()) + 3)
    step, out = max(1, 256 * (k + 4) // max(k + 4, take)), []
    for start in range(0, len(queries), step):
        some = queries[start:start + step]
        q = np.frombuffer(b"".join(some["v"])).reshape(len(some), -1)
        near = np.full((len(q), len(c)), -np.inf)
        for p, span in spans.items():
            asking = np.flatnonzero([p in probed for probed in some["parts"]])
            near[asking, span] = q[asking] @ c[span].T
        best = np.argpartition(-near, take - 1, axis=1)[:, :take]
        probed = np.take_along_axis(near, best, axis=1) > -np.inf
        # One way of summing for all, so that equal vectors have equal scores wherever they are scored.
        exact = (q[:, None, :] * c[best]).sum(-1)
        for own, places, scores, good in zip(some["id"].to_numpy(), best, exact, probed, strict=True):
            found = []
            for p, score in zip(places[good], scores[good], strict=True):
                same = ids[p]
                found += [(-score, i) for i in same[:k + bisect_right(same, own) - bisect_left(same, own)] if i != own]
            nearest: dict[int, float] = {}
            for score, i in sorted(found):
                nearest.setdefault(i, -score)
            out += [(own, i, score) for i, score in islice(nearest.items(), k)]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])
