"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1) and BENCH_CPUS the number of
local threads. Results go to a sink that discards them, so every row is computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

from terrapanel import get_session
from terrapanel.plans.catalog import QUERIES
from terrapanel.plans.model_queries import penalty_grid

#: Timed without the check that the query's result is.
WITHOUT_CHECK = {"penalty_search": penalty_grid}
HEADLINE = (
    "city_month_rollup",
    "effective_fill",
    "temperature_day_bins",
    "temporal_split",
    "missing_profile",
    "range_profile",
    "coverage_entity",
    "engineered_grid_features",
    "engineered_city_features",
    "corr_with_target",
    "corr_matrix",
    "mutual_information",
    "consensus_ranking",
    "point_in_polygon",
    "zonal_mean",
    "penalty_search",
    "forest_importance",
    "tree_attributions",
    "fe_ols_conley",
    "fe_ols_three_way",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "terrapanel-bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # start the engine
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        WITHOUT_CHECK.get(name, QUERIES[name])(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
