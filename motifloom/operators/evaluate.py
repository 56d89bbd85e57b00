"""Recall of found motifs against known ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall(truth: DataFrame, found: DataFrame, w: int) -> DataFrame:
    """``n_truth, n_found, recall``: known pairs of which either side lies within ``w`` of that side of a found pair.

    Positions fall into bands of ``w``; a side within reach lies in the same band or in one that adjoins.
    """
    truth = truth.select(F.monotonically_increasing_id().alias("t"), "a", "b")
    sides = lambda df, *keep: df.select(*keep, F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("p")) for s in "ab"])).alias("s")).select(*keep, "s.*")
    band = F.floor(F.col("p") / max(w, 1))
    known = sides(truth, "t").withColumn("band", F.explode(F.array(band - 1, band, band + 1)))
    near = sides(found).select("side", F.col("p").alias("q"), F.floor(F.col("p") / max(w, 1)).alias("band"))
    hit = known.join(near, ["side", "band"]).where(F.abs(F.col("p") - F.col("q")) <= w).select("t").distinct().withColumn("hit", F.lit(1))
    return truth.join(hit, "t", "left").agg(F.count(F.lit(1)).alias("n_truth"), F.count("hit").alias("n_found")).select(
        "n_truth", "n_found", F.try_divide("n_found", "n_truth").alias("recall")
    )
