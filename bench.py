"""Time the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from tidelog import queries as log

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
#: Counterparts of the published five, over the event and the line item tables, and further operators.
TEXTS = {
    "b1_filtered_count": 'from events | where event_type="error" | stats count',
    "b2_count_by": "from events | stats count by event_type",
    "b3_search": 'from documents | search "of the" | stats count',
    "b4_range_top": "from events | where value >= 50 | top 10 user_id",
    "b5_timechart": "from events | timechart count span=5m",
    "b1_lineitem": 'from lineitem | where l_returnflag="R" | stats count',
    "b2_lineitem": "from lineitem | stats count by l_suppkey",
    "b4_lineitem": "from lineitem | where l_quantity >= 25 | top 10 l_partkey",
    "b5_lineitem": "from lineitem | timechart count span=1d",
    "where_stats": "from lineitem | where l_quantity > 10 | stats count, sum(l_extendedprice), avg(l_discount) by l_returnflag, l_linestatus",
    "head": "from events | head 10",
    "percentiles": "from events | percentiles value by event_type",
    "dedup": "from events | dedup user_id",
    "eventstats": "from events | eventstats avg(value) as mean by user_id | where value > mean | stats count",
    "streamstats": "from events | streamstats sum(value) as total by user_id | stats max(total)",
    "sessionize": "from events | sessionize maxpause=12h by user_id | stats dc(_session_id)",
    "transaction": "from events | transaction user_id | stats avg(duration)",
    "join": "from orders | rename o_custkey as c_custkey | join c_custkey [from customer | fields c_custkey, c_mktsegment] | stats sum(o_totalprice) by c_mktsegment",
    "rollup": "from events | rollup 5m, 1h, 1d",
    "parse_json": "from events | parse json(props) extract (k) | stats count by k",
}


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    e = log.engine(spark, SF_DIR)
    rows = {t: spark.read.parquet(f"{SF_DIR}/{t}.parquet").count() for t in ("events", "lineitem")}
    seconds = {}
    for name, text in TEXTS.items():
        best = float("inf")
        for _ in range(3):  # the first run compiles
            began = time.perf_counter()
            e.query(text).collect()
            best = min(best, time.perf_counter() - began)
        seconds[name] = round(best, 4)
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, warm, total",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "rows_per_sec": {"where_stats": round(rows["lineitem"] / seconds["where_stats"]), "b2_count_by": round(rows["events"] / seconds["b2_count_by"])},
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    sys.exit(main())
