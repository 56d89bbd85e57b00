"""Approximate matrix profile from sampled subsequences, spread along diagonals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifloom.functions.distance import euclidean
from motifloom.operators import pairs as P
from motifloom.operators.windows import znormalized_subsequences


def approximate_profile(series: DataFrame, w: int, ez: int, skip: int) -> DataFrame:
    """``series_id, i, nn_dist, nn_idx``: an upper bound of the matrix profile.

    Every ``skip``-th subsequence finds its nearest neighbour; the pair's
    neighbours on the same diagonal, up to ``skip`` away, are compared as well.
    """
    z = znormalized_subsequences(series, w).select("series_id", "i", "z").persist()
    left = z.where(F.col("i") % skip == 0).select("series_id", F.col("i").alias("s"), F.col("z").alias("zs"))
    # sampled rows against all rows in blocks, a key for each pair of blocks
    tile = P.PAIR_TILE
    last = z.groupBy("series_id").agg(F.expr(f"max(i) div {tile}").alias("last"))
    asked = left.join(F.broadcast(last), "series_id").withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last")))).drop("last")
    met = asked.join(z.withColumn("t", F.expr(f"i div {tile}")), ["series_id", "t"]).where(F.abs(F.col("i") - F.col("s")) >= ez)
    near = met.groupBy("series_id", "s").agg(F.min(F.struct(F.round(euclidean(F.col("zs"), F.col("z")), 6).alias("d"), F.col("i").alias("j"))).alias("p"))
    steps = F.explode(F.sequence(F.lit(-skip + 1), F.lit(skip - 1)))
    spread = near.select("series_id", "s", F.col("p.j").alias("j"), steps.alias("k")).select(
        "series_id", F.least(F.col("s") + F.col("k"), F.col("j") + F.col("k")).alias("a"), F.greatest(F.col("s") + F.col("k"), F.col("j") + F.col("k")).alias("b")
    ).distinct()
    za, zb = z.select("series_id", F.col("i").alias("a"), F.col("z").alias("za")), z.select("series_id", F.col("i").alias("b"), F.col("z").alias("zb"))
    pairs = spread.join(za, ["series_id", "a"]).join(zb, ["series_id", "b"])
    pairs = pairs.select("series_id", "a", "b", F.round(euclidean(F.col("za"), F.col("zb")), 6).alias("d"))
    best = P.neighbours(pairs).groupBy("series_id", "src").agg(F.min(F.struct("d", "dst")).alias("p"))
    return best.select("series_id", F.col("src").alias("i"), F.col("p.d").alias("nn_dist"), F.col("p.dst").alias("nn_idx"))
