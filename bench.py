"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR: folder of the given tables (default /root/testdata/sf0.1). BENCH_CPUS: local cores.
Arguments, if any, name the queries to run instead.
"""

from __future__ import annotations

import json
import os
import sys
import time

from riskloom.queries.catalog import queries
from riskloom.session import build_session

HEADLINE = (
    "safe_ratios",
    "group_deviation",
    "recipe_basic",
    "recipe_moments",
    "conditional_aggs",
    "conditional_distinct",
    "two_level",
    "group_max_of_large_groups",
    "quantiles_of_large_groups",
    "latest_ties_one",
    "last_k_aggs",
    "applicant_features",
    "bureau_features",
    "bureau_balance_features",
    "previous_application_features",
    "pos_cash_features",
    "loan_instalment_features",
    "loan_instalment_statistics",
    "payment_history_features",
    "last_k_instalment_features",
    "credit_card_features",
    "wide_feature_table",
    "cv_scoring",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
        spark__ui__enabled="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = queries()
    # One small job first, so that the first query does not pay for the start of the session.
    registered["table_shape"](spark, sf_dir).collect()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        # Every column of every row is computed; nothing is collected.
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
