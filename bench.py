"""Time the headline flow queries; prints one JSON line.

Times are of first runs: the query that first needs a shared table (flows, labels, members) pays for building it."""

import json
import os
import time

from pyspark.sql import SparkSession

from flowscape.plans import registry

HEADLINE = ["flow_patterns", "flows_timeout", "scan_windows", "flow_labels", "membership_native", "flow_length_quantiles", "ecdf_exact", "tuple_context", "address_behaviour", "heavy_residuals"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()

    def seconds(name: str, folder: str) -> float:
        began = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.time() - began

    small = os.path.join(os.path.dirname(sf_dir), "sf0.001")
    if os.path.isdir(small) and small != sf_dir:
        seconds("flow_patterns", small)  # compile once, on other tables
    first = {name: round(seconds(name, sf_dir), 3) for name in HEADLINE}
    print(json.dumps({"metric": "total_seconds", "value": round(sum(first.values()), 3), "unit": "sec", "queries": first, "sf": os.path.basename(sf_dir).removeprefix("sf")}))


if __name__ == "__main__":
    main()
