"""Print the executed (AQE final) physical plans of the headline queries.

    python tools/show_plans.py [--sf-dir DIR] > PLANS.md

Attribute ids and long column lists are shortened so the operator tree
is readable.
"""

from __future__ import annotations

import argparse
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bazaar.plans.registry import QUERIES  # noqa: E402
from bazaar.session import build_session  # noqa: E402

HEADLINE = ["top_products", "catalog", "search_products", "catalog_page", "category_page", "order_totals",
            "orders_nested", "fold_cart_events", "checkout_order_items"]


def tidy(line: str) -> str:
    line = re.sub(r"#\d+L?", "", line)
    line = re.sub(r"\[plan_id=\d+\]", "", line)
    line = re.sub(r"Location: InMemoryFileIndex\(1 paths\)\[file:[^\]]*/", "Location: [", line)
    line = re.sub(r"output=\[[^\]]*\]", "output=[...]", line)
    line = re.sub(r"Project \[[^\]]{120,}\]", "Project [...]", line)
    return line.rstrip()[:220]


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.1")
    args = ap.parse_args()
    spark = build_session(shuffle_partitions=16)
    print(f"# Executed plans at {os.path.basename(args.sf_dir)} (local[8], 16 shuffle partitions, AQE)\n")
    print("AQE final plans as recorded after each query ran; `python tools/show_plans.py` regenerates "
          "this file.  Categories are a distinct over `part.p_type` (partial aggregate, one shuffle) "
          "numbered by a window over the distinct names.\n")
    for name in HEADLINE:
        df = QUERIES[name](spark, args.sf_dir)
        df.collect()  # runs this DataFrame's own plan, so AQE's final plan is recorded
        plan = df._jdf.queryExecution().executedPlan().toString()
        # drop the "Initial Plan" half of every adaptive plan (nested ones too)
        out, skip_indent, marker = [], None, ""
        for x in plan.splitlines():
            indent = len(x) - len(x.lstrip(" :|+-"))
            if skip_indent is not None:
                if indent >= skip_indent if "Initial" in marker else indent > skip_indent:
                    continue
                skip_indent = None
            if "== Initial Plan ==" in x:
                skip_indent, marker = indent, "Initial"
                continue
            if x.strip():
                out.append(tidy(x))
            if "InMemoryRelation" in x:      # cached dimension: its plan is elided
                skip_indent, marker = indent, "cache"
        print(f"## {name}\n\n```\n" + "\n".join(out) + "\n```\n")
    spark.stop()


if __name__ == "__main__":
    main()
