"""How hard a series is: average distances, histograms, local dimensionality, relative contrast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from motifloom.functions.distance import euclidean
from motifloom.operators import pairs as P
from motifloom.operators.windows import TILE, znormalized_subsequences


def average_distance(pairs: DataFrame) -> DataFrame:
    """Exact mean distance over all pairs."""
    return pairs.groupBy("series_id").agg(F.avg("d").alias("average"), F.count(F.lit(1)).alias("pairs"))


def sampled_distances(series: DataFrame, w: int, n: int, ez: int = 0, seed: int = 0) -> DataFrame:
    """``series_id, a, b, d`` of about ``n`` pairs of positions drawn at random; pairs closer than ``ez`` are left out."""
    z = znormalized_subsequences(series, w).select("series_id", "i", "z")
    spans = z.groupBy("series_id").agg((F.max("i") + 1).alias("m"))
    drawn = spans.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(n)))).select(
        "series_id", F.floor(F.rand(seed) * F.col("m")).alias("a"), F.floor(F.rand(seed + 1) * F.col("m")).alias("b")
    )
    drawn = drawn.where(F.abs(F.col("a") - F.col("b")) >= max(ez, 1))
    za = z.select("series_id", F.col("i").alias("a"), F.col("z").alias("za"))
    zb = z.select("series_id", F.col("i").alias("b"), F.col("z").alias("zb"))
    both = drawn.join(za, ["series_id", "a"]).join(zb, ["series_id", "b"])
    return both.select("series_id", "a", "b", euclidean(F.col("za"), F.col("zb")).alias("d"))


def distance_histogram(pairs: DataFrame, w: int, bins: int = 20) -> DataFrame:
    """``series_id, bucket, n`` over equal bins from 0 to the largest possible distance."""
    bucket = F.width_bucket(F.round("d", 6), F.lit(0.0), F.lit(2 * w**0.5), F.lit(bins))
    return pairs.groupBy("series_id", bucket.cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def difficulty(series: DataFrame, w: int, start: int) -> DataFrame:
    """Nearest neighbour, local intrinsic dimensionality and relative contrast at 1, 10 and 100 of one distance profile."""
    far = P.distance_profile(series, w, start).where(F.abs(F.col("i") - start) > w).withColumn("d", F.round("distance", 6))
    # the hundred nearest of each tile first, so no task orders a whole series
    tiles = far.withColumn("r", F.row_number().over(Window.partitionBy("series_id", F.expr(f"i div {TILE}")).orderBy("d", "i"))).where("r <= 100")
    ranked = tiles.withColumn("r", F.row_number().over(Window.partitionBy("series_id").orderBy("d", "i"))).where("r <= 100")
    at = {k: F.max(F.when(F.col("r") == k, F.col("d"))).alias(f"d{k}") for k in (1, 10, 100)}
    whole = far.groupBy("series_id").agg(F.avg("d").alias("mean"), F.count(F.lit(1)).alias("n"), F.max("d").alias("most"))
    logs = far.join(whole.select("series_id", "most"), "series_id").groupBy("series_id").agg(
        F.sum(F.when(F.col("d") > 0, F.ln(F.try_divide(F.col("d"), F.col("most"))))).alias("logs")
    )
    out = whole.join(logs, "series_id").join(ranked.groupBy("series_id").agg(*at.values()), "series_id")
    contrast = [F.try_divide(F.col("mean"), F.col(f"d{k}")).alias(f"rc{k}") for k in (1, 10, 100)]
    return out.select("series_id", F.lit(start).cast("long").alias("i"), F.col("d1").alias("nn"), F.try_divide(-F.col("n"), F.col("logs")).alias("lid"), *contrast)
