"""Times the headline queries: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the tables and cores."""

import json
import os
import time

from pyspark.sql import SparkSession

from readloom import queries

HEADLINE = ("m4_filter", "m4_stage1_gap", "m4_stage1_highcopy", "m4_gap_in_coverage", "m4_stage2_best", "m4_contained", "ovl_cov_stats", "len_nx_lx", "preassembly_stats", "gff_subtract", "interval_overlap_join", "track_rank", "base_counts", "gc_skew", "kmers", "bam2paf", "bam_filter_clipped", "rdb_reblock", "graph_components")


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        times = []
        for _ in range(2):
            began = time.time()
            queries.queries()[name](spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.time() - began)
        took[name] = round(min(times), 3)
    print(json.dumps({"metric": "total of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
