"""Print the formatted physical plans of registered queries (review aid).

usage: python scripts/show_plans.py [sf_dir] name [name ...]
"""
from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from forumshift.plans.registry import all_queries  # noqa: E402
from forumshift.session import get_spark  # noqa: E402


def main(argv):
    sf = "/root/testdata/sf0.01"
    names = []
    for a in argv:
        if a.startswith("/"):
            sf = a
        else:
            names.append(a)
    spark = get_spark("local[8]", shuffle_partitions=8)
    qs = all_queries()
    for n in names or ["weekly_panel", "tfidf_long", "word_freq"]:
        print(f"===== {n}")
        qs[n].build(spark, sf).explain("formatted")


if __name__ == "__main__":
    main(sys.argv[1:])
