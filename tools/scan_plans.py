"""List physical-plan nodes that should not appear (or need a reason) in the registered queries."""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rainshed.plans.catalog import REGISTRY  # noqa: E402
from rainshed.session import local_session  # noqa: E402

SUSPECT = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroups", "SinglePartition")


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    pattern = sys.argv[2] if len(sys.argv) > 2 else "."
    spark = local_session()
    for name, q in REGISTRY.items():
        if not re.search(pattern, name):
            continue
        plan = q.run(spark, sf)._jdf.queryExecution().executedPlan().toString()
        found = {s: plan.count(s) for s in SUSPECT if s in plan}
        exchanges = len(re.findall(r"(?<!Reused)(?<!Broadcast)Exchange ", plan))
        if found or exchanges > 6:
            print(f"{name}: exchanges={exchanges} {found}")
        spark.catalog.clearCache()


if __name__ == "__main__":
    main()
