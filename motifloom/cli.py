"""Motiflets of a text file from the command line: ``python -m motifloom.cli --window 100 PATH``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from motifloom.functions.distance import byte_size
from motifloom.operators import motiflets
from motifloom.plans.planner import MotifletsIterator
from motifloom.sources import series as S
from motifloom.sources import sinks

FOUND = "support int, indices array<long>, extent double"


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="motifloom", description="Repeated patterns of a time series in a text file with one number a line.")
    out.add_argument("path")
    out.add_argument("--window", type=int, required=True, help="values of a subsequence")
    out.add_argument("--failure-probability", type=float, default=0.01)
    out.add_argument("--max-memory", help="memory for hash tables, such as 10GB")
    out.add_argument("--exact", action="store_true", help="compare all pairs")
    out.add_argument("--support", type=int, default=2)
    out.add_argument("--topk", type=int, default=1)
    out.add_argument("--prefix", type=int, help="values to read")
    out.add_argument("--seed", type=int, default=12453)
    out.add_argument("--precise", action="store_true", help="accepted for scripts; statistics are always precise")
    out.add_argument("--exclusion-zone", type=int, help="half a window where it is not given")
    out.add_argument("--output", default="motiflets.csv")
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    own = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("motifloom").getOrCreate()
    ez = own.exclusion_zone or max(own.window // 2, 1)
    series = S.read_text(spark, own.path, own.prefix)
    if own.exact:
        found = motiflets.motiflets_exact(series, own.window, own.support, ez, own.topk).select("support", "indices", "extent")
    else:
        memory = None
        if own.max_memory is not None:
            memory = spark.range(1).select(byte_size(F.lit(own.max_memory))).first()[0]
            if memory is None:
                parser().error(f"--max-memory {own.max_memory!r} is not a size")
        lazy = MotifletsIterator(series, own.window, own.support, own.topk, ez, own.failure_probability, own.seed, max_memory=memory)
        found = spark.createDataFrame([(m.support, list(m.indices), m.extent) for m in lazy], FOUND)
    sinks.write_motiflets(found.orderBy("support", "extent"), own.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
