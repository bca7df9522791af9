"""Prints one JSON line: seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
HEADLINE = ["knn_hybrid_all", "knn_k100_underfull", "knn_type2_joined", "selectivity", "strategy_choice", "interval_split", "sq8sym_encode", "sq8sym_two_phase", "recall_per_type", "knn_graph_pruned", "graph_search_type1"]


def main() -> None:
    from vicinity import queries
    from vicinity.session import local

    root, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_CPUS", "8"))
    spark = local(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        run = lambda: queries.QUERIES[name](spark, root).write.format("noop").mode("overwrite").save()  # noqa: B023, E731
        run()
        began = time.time()
        run()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, second run", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(root.rstrip("/"))}))


if __name__ == "__main__":
    main()
