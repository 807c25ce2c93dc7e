"""Times the headline queries: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the data and the threads."""

import json
import os
import time

from pyspark.sql import SparkSession

from stranda.plans import registry

NAMES = ("ag_mean_len", "ag_mean_by_chrom", "ag_filter_len", "ag_type_counts", "ij_weighted_score", "ij_overlap_inner", "ij_merge", "ij_tile_counts", "tx_introns", "rd_depth", "seq_functions",
         "ij_annotate_sides", "ij_gene_triples", "seq_fetch", "seq_spliced", "seq_genome_windows", "seq_genome_kmers", "rd_mates", "rd_mates_deduplicated", "rd_md_mismatches", "tx_nearest_attribute", "tx_flavours")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in NAMES:
        times = []
        for _ in range(2):
            began = time.time()
            registry.queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.time() - began)
        took[name] = round(min(times), 3)
    print(json.dumps({"metric": "total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir).removeprefix("sf")}))


if __name__ == "__main__":
    main()
