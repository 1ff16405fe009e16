"""Headline benchmark: runs the main study stages at $BENCH_SF_DIR on
local[$BENCH_CPUS] and prints one JSON line with per-query seconds.

Each query is forced with the ``noop`` sink (full execution, no driver collect); its time
is the median of three runs after a warm-up.
"""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from forumshift.plans.registry import all_queries  # noqa: E402
from forumshift.session import get_spark  # noqa: E402

HEADLINE = (
    "weekly_panel",            # posts -> weekly panel -> log/index
    "treatment_flags",         # regression panel
    "pivot_log_counts",        # wide pivot
    "post_lengths",            # HTML split + tags + lengths
    "normalise_text",          # token normalisation
    "word_freq",               # corpus word frequencies
    "weekly_complexity_lang",  # z-scores + weekly complexity
    "tfidf_mean_shift",        # TF-IDF fit/transform + term shift
    "did_att",                 # two-way FE DiD
    "sdid_att",                # synthetic DiD + 100 placebo replicates
    "pretrend_slopes",         # pre-trend interaction slopes
    "html_split_pages",        # raw web pages -> text / code
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [a for a in sys.argv[1:]] or list(HEADLINE)
    spark = get_spark(f"local[{cpus}]", app="forumshift-bench", shuffle_partitions=cpus * 2)
    qs = all_queries()
    # warm-up: JVM, codegen and file listing on the smallest query
    qs["weekly_panel"].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        runs = []
        for _ in range(3):
            t0 = time.perf_counter()
            qs[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            spark.catalog.clearCache()
            runs.append(time.perf_counter() - t0)
        times[name] = round(median(runs), 3)
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
