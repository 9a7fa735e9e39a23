"""Print the formatted physical plan of registered queries.

Usage: python scripts/show_plans.py [data_dir] name [name ...]

Lazy queries print their plan directly.  Queries whose callables run loops
(thinning, hysteresis) execute those rounds first; the plan printed is then the
remaining plan on top of the last checkpointed round.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from grovecount.plans.registry import QUERIES  # noqa: E402
from grovecount.session import build_session  # noqa: E402


def main() -> None:
    args = sys.argv[1:]
    data_dir = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    spark = build_session()
    for name in args or ["line_suffix_count", "suffix_filter", "lookup_left", "tumbling_count"]:
        print(f"===== {name}")
        QUERIES[name](spark, data_dir).explain("formatted")
    spark.stop()


if __name__ == "__main__":
    main()
