"""Headline queries, timed on the tables in BENCH_SF_DIR; prints one line of JSON."""

import json
import os
import time

from pyspark.sql import SparkSession

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ["retrieve_topk", "recall_at_k", "cosine_pairs", "knn_adjacency", "scene_graph", "context_graph", "message_layer", "segment_sum", "info_nce", "edge_coverage", "allocate_points", "split_80_20", "pair_key", "serialize_record", "table1_cube", "unique_batches"]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from orbweave.plans import catalog

    def run(name: str) -> float:
        began = time.perf_counter()
        catalog.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - began, 3)

    run("retrieve_topk")  # starts the JVM's and the workers' code
    times = {name: run(name) for name in HEADLINE}
    again = {name: run(name) for name in HEADLINE}  # when their code is compiled
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "again": again, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
