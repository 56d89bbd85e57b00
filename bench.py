"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
the tables and the cores.  Every query runs to the end: its rows are written to
the noop sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [HERE, os.environ.get("PYTHONPATH")]))
SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from motifloom import catalog
    from motifloom.operators import measures, pairs, windows
    from motifloom.plans import planner

    registered = catalog.queries()
    raw = catalog.f2(spark, SF).persist()
    values = raw.count()
    # Python workers start before anything is timed
    spark.range(0, 64, 1, int(CPUS)).mapInArrow(lambda batches: batches, "id long").count()
    jobs = {
        "motifs_exact": lambda: registered["motifs_exact"](spark, SF),
        "matrix_profile_exact": lambda: registered["matrix_profile_exact"](spark, SF),
        "motiflets_exact": lambda: registered["motiflets_exact"](spark, SF),
        "motifs_lsh_planted_top5": lambda: registered["motifs_lsh"](spark, SF),
        "motifs_kernel_planted_top10": lambda: registered["motifs_kernel"](spark, SF),
        "raw_rolling_stats_w100": lambda: windows.rolling_stats_fast(raw, 100),
        "raw_distance_profile_w100": lambda: pairs.distance_profile(raw, 100, 1000),
        "raw_sliding_dot_w100": lambda: pairs.sliding_dot_product(raw, 100, 1000),
        "raw_all_pairs_top10_w100": lambda: planner.motifs(raw, 100, 10, 100, "kernel"),
        "lsh_candidates": lambda: registered["lsh_candidates"](spark, SF),
        "sax_projection": lambda: registered["sax_projection"](spark, SF),
        "exp_joins": lambda: registered["exp_joins"](spark, SF),
    }
    seconds, facts = {}, {}
    for name, job in jobs.items():
        begin = time.time()
        out = job()
        if name == "raw_all_pairs_top10_w100":
            rows = out.collect()
            facts["raw_10th_distance"] = max(r["distance"] for r in rows)
        else:
            out.write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - begin, 3)
    # how hard the raw series is: cost of hashing depends on it
    average = measures.sampled_distances(raw, 100, 1000, 100, 1).agg(F.avg("d")).first()[0]
    facts |= {"raw_values": values, "raw_relative_contrast_10": round(average / facts["raw_10th_distance"], 3)}
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(SF.rstrip("/")), **facts}))


if __name__ == "__main__":
    main()
