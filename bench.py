"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

No query is begun once $BENCH_SECONDS (600) have passed; the line names those under "not_run".
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from corpusloom.plans import bindings, catalog  # noqa: E402
from corpusloom.session import local_session  # noqa: E402

# Tables that queries share are derived and stored once; that cost is reported as "ingest".
INGESTED = ("node_identity", "node_revision", "graph_membership", "triples", "semantic_snapshots", "reference_occurrences",
            "search_occurrences", "search_postings", "search_docs")
HEADLINE = ("r5_top_backlinks", "r1_extract_links", "r3_reference_index", "r5_incoming", "v1_current_nodes", "v6_node_history", "v7_as_of",
            "g1_assign_graph", "g4_triples_outgoing", "g5_context_packs", "g6_revision_chains", "f2_ranked_search", "f3_phrase_search",
            "m9_degree", "m10_overlap", "t3_traversal_index", "b1_compose", "b8_compare", "w12_dedupe_requests", "w8_add_triples",
            "q1_uuid", "q4_content_hash", "q7_namespace", "a1_corpus_counts")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session()
    times: dict[str, float] = {}
    started = time.time()
    tables = bindings.corpus(spark, sf_dir).tables
    for name in INGESTED:
        tables[name]
    times["ingest"] = round(time.time() - started, 3)
    limit, not_run = float(os.environ.get("BENCH_SECONDS", "600")), []
    for name in HEADLINE:
        if time.time() - started > limit:
            not_run.append(name)
            continue
        began = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "not_run": not_run,
                      "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
