"""Time the headline queries; prints one JSON line.

Every query is run once at the smallest scale first, so that the times are not those of a
cold JVM, then once over the whole tables of ``$BENCH_SF_DIR``, all rows produced.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quillgraph.plans.catalog import QUERIES  # noqa: E402
from quillgraph.session import build_session  # noqa: E402

HEADLINE = [
    "top_senders",
    "sender_duration",
    "replies",
    "conversations_top",
    "dead_end_messages",
    "reply_edges",
    "attendance",
    "list_explode_counts",
    "click_register",
    "stratified_sample",
    "mail_pages_parsed",
    "paragraphs",
    "tokens",
    "term_counts",
    "vocabulary",
    "graf_nodes",
    "graf_edges",
    "tiles",
    "sentence_record",
    "textrank_ranks",
    "textrank_phrases",
    "textrank_summary",
    "degrees",
    "pagerank",
    "shortest_paths",
    "scc_sizes",
    "stream_running_counts",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    warm = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="16g",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="quillgraph-bench-"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        if os.path.isdir(warm):
            QUERIES[name](spark, warm).write.format("noop").mode("overwrite").save()
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    spark.stop()
    line = {"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/"))}
    print(json.dumps(line))


if __name__ == "__main__":
    main()
