"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from wordmill.plans.catalog import QUERIES
from wordmill.session import build_session

HEADLINES = [
    "basic_tokens", "doc_freq", "term_freq", "wordpieces", "vocab_table", "freq_rank", "vocab_index", "bucketize",
    "swap_rank", "swap_greedy", "swap_random", "swap_oov_similar", "apply_swap", "scramble_window", "shuffle_words",
    "sample_exact", "bow", "bucket_bow", "pair_bow", "bucket_lift", "bucket_coverage", "pair_lift", "proximity_corr",
    "classification_report", "span_report", "random_baseline",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["doc_freq"](spark, folder).count()  # warm-up: code generation and file cache
    times = {}
    for name in HEADLINES:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    spark.stop()
    result = {
        "metric": "headline queries, total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
