"""Packing by optimal length buckets.

A global histogram of lengths is small whatever the corpus, so the bucket boundaries that waste the least padding are found
exactly by dynamic programming over it. Inside a bucket every document is padded to the bucket's length, and batches take
as many documents as the token budget holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.durable import checkpointed
from corpusloom.functions.ordered import grouped_rank
from corpusloom.llm.common import n_words

EXACT_LENGTHS = 16_384  # lengths below this have a bin of their own
RELATIVE_BINS = 4_096  # longer ones share a bin if they differ by less than one part in so many


def length_histogram(lengths: DataFrame) -> list[tuple[int, int, int]]:
    """(greatest length, documents, tokens) per bin, ascending, from rows of ``n_tokens``.

    The bins number at most ``EXACT_LENGTHS + RELATIVE_BINS * log2(longest / EXACT_LENGTHS)``, however many rows there are.
    """
    n = F.col("n_tokens")
    step = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(n, F.lit(1)).cast("double")))) / RELATIVE_BINS
    edge = F.when(n < EXACT_LENGTHS, n).otherwise((F.floor(n / step) * step).cast("long"))
    rows = lengths.groupBy(edge.alias("edge")).agg(F.max(n).alias("longest"), F.count(F.lit(1)).alias("docs"), F.sum(n).alias("tokens"))
    return sorted((r["longest"], r["docs"], r["tokens"]) for r in rows.collect())


def optimal_boundaries(histogram: Sequence[tuple[int, int, int]], buckets: int) -> list[int]:
    """At most ``buckets`` boundaries, the last one the longest length, with the least total padding (no more bins than buckets: none).

    With P and S the running counts and tokens, the best cost of the first j bins in b buckets is
    ``l_j P_j - S_j + min over i of (cost(i, b - 1) + S_i - l_j P_i)``: a minimum over lines in l_j, whose slopes fall as i
    grows, so a hull of lines gives each layer in linear time. All numbers are whole.
    """
    if not histogram:
        return []
    count, total = [0], [0]
    for _, docs, tokens in histogram:
        count.append(count[-1] + docs)
        total.append(total[-1] + tokens)
    longest = [0, *(h[0] for h in histogram)]
    size = len(histogram)
    cost: list[int | None] = [0, *([None] * size)]
    chosen: list[list[int]] = []
    for _ in range(min(buckets, size)):
        after: list[int | None] = [None] * (size + 1)
        back, hull, head = [0] * (size + 1), [], 0  # a line is (slope, intercept, i)
        for j in range(1, size + 1):
            if cost[j - 1] is not None:
                line = (-count[j - 1], cost[j - 1] + total[j - 1], j - 1)
                while len(hull) - head >= 2 and ((line[1] - hull[-2][1]) * (hull[-2][0] - hull[-1][0])
                                                 <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - line[0])):
                    hull.pop()
                hull.append(line)
            at = longest[j]
            while len(hull) - head >= 2 and hull[head + 1][0] * at + hull[head + 1][1] <= hull[head][0] * at + hull[head][1]:
                head += 1
            if len(hull) > head:
                slope, intercept, back[j] = hull[head]
                after[j] = at * count[j] - total[j] + slope * at + intercept
        chosen.append(back)
        cost = [None, *after[1:]]
    bounds, j = [], size
    for back in reversed(chosen):
        bounds.append(longest[j])
        j = back[j]
    return bounds[::-1]


def pack(docs: DataFrame, budget: int = 32_768, buckets: int = 16, tokens: Column | None = None, shard_rows: int = 1_024) -> DataFrame:
    """Per document: ``doc_id, n_tokens, bucket, bucket_length, batch, padding``.

    ``bucket`` counts from 0 by length and ``batch`` from 0 within the bucket, in an order by hash of the id. A batch holds
    ``max(1, budget // bucket_length)`` documents, so only a document longer than the budget, alone in its batch, passes it;
    only the last batch of a bucket may be short. Null and empty texts have length 0. Repeated rows are packed each. An
    empty table gives an empty result. Ranks are taken in hash shards of about ``shard_rows`` rows, so that a bucket with a
    third of all documents is spread over many tasks.
    """
    sized = checkpointed(docs.select("doc_id", (n_words("text") if tokens is None else F.coalesce(tokens, F.lit(0))).cast("long").alias("n_tokens")))
    histogram = length_histogram(sized)
    bounds = optimal_boundaries(histogram, buckets) or [0]
    sizes, k = [0] * len(bounds), 0
    for longest, n, _ in histogram:
        while longest > bounds[k]:
            k += 1
        sizes[k] += n
    of = lambda values: F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.col("bucket") + 1)
    bucket = sum((F.col("n_tokens") > b).cast("int") for b in bounds[:-1]) if len(bounds) > 1 else F.lit(0)
    placed = (sized.withColumn("bucket", bucket).withColumn("bucket_length", of(bounds))
                   .withColumn("_hash", F.xxhash64("doc_id"))
                   .withColumn("_shard", F.pmod(F.col("_hash"), of([max(1, n // shard_rows) for n in sizes]))))
    ranked = grouped_rank(placed, ["bucket"], [F.col("_hash"), F.col("doc_id"), F.col("n_tokens")], F.col("_shard"))
    fits = of([max(1, budget // max(1, b)) for b in bounds])
    return ranked.select("doc_id", "n_tokens", "bucket", "bucket_length",
                         F.floor((F.col("rank") - 1) / fits).cast("long").alias("batch"),
                         (F.col("bucket_length") - F.col("n_tokens")).alias("padding"))
