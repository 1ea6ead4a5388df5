"""Summarise the executed plans of registered queries: scans with pruned schema and pushed filters,
exchanges, joins, windows, Expand nodes, checkpoints.

Usage: python tools/explain_plans.py [sf_dir] [name ...]   (default: the bench headline set)
       ARREARS_FULL_PLAN=1 prints the whole formatted plan as well.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

from arrears.catalog import QUERIES, load_all  # noqa: E402
from arrears.session import local_session  # noqa: E402
from bench import HEADLINE  # noqa: E402

NODES = ["Exchange", "SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin",
         "CartesianProduct", "Window", "Expand", "SortAggregate", "HashAggregate", "Generate"]


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    names = sys.argv[2:] or HEADLINE
    load_all()
    spark = local_session(8)
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    for name in names:
        df = QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()  # final (adaptive) plan
        text = df._jdf.queryExecution().explainString(mode)
        counts = {n: len(re.findall(rf"^\({{1}}\d+\) {n}\b", text, re.M)) for n in NODES}
        print(f"\n== {name}: " + ", ".join(f"{k}={v}" for k, v in counts.items() if v))
        for section in text.split("\n\n"):
            if re.match(r"\(\d+\) Scan parquet", section.strip()):
                info = dict(re.findall(r"^(ReadSchema|PushedFilters): (.*)$", section, re.M))
                print(f"   scan {info.get('ReadSchema', '?')}  pushed={info.get('PushedFilters', '[]')}")
        if os.environ.get("ARREARS_FULL_PLAN"):
            print(text)


if __name__ == "__main__":
    main()
